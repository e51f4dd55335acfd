"""Mixing sources to target weights by entropy balancing.

Document rates r minimise the relative entropy to one copy each, subject to one constraint per source:
the sum of r * size is the source's target. The dual's solution tilts exponentially, r = exp(lam * z)
with z the document's size over its source's mean size, here bounded by 3 copies. A rate depends on a
document's size and source alone, so documents are summed to cells (source, size) first. Newton's
iterations run over the table of cells, of all sources at once: a step sums each source's gap and slope in
a distributed aggregate, exact decimals so that reruns agree to the bit, and moves each multiplier in a
bracket that shrinks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import discard, running, stage, tasks, uniform_key

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Newton's steps at most and in one job, and the share of a source's size by which it may miss its target before rounding.
ITERATIONS, TOGETHER, MISSED = 64, 8, 1e-9


def word_count(text: str = "text") -> F.Column:
    """The number of words: where a word begins, a word byte follows none. Nothing is split into an array."""
    begins = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(begins, F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with _i, each one's place by code point, null last: no task has all of them."""
    parts = min(tasks(sources.sparkSession), 1024)
    dealt = sources.repartitionByRange(parts, F.col("source").isNull(), "source").withColumn("_p", F.spark_partition_id())
    dealt = stage(dealt, "sources")  # ranges are drawn anew in another run
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per part
    counts = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").isNull(), "source")) - 1
    return dealt.withColumn("_own", inner).join(F.broadcast(counts), "_p").withColumn("_i", F.col("_own") + F.col("_before")).drop("_p", "_own", "_before")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sources`` (source, source_size) with the target of each.

    Sources take the weights in the order of their code points, null last. Together they share all
    sizes; what is above ``most`` times a source's size goes to the others by weight. The level, a weight of
    one's share, only rises as sources reach their bounds, and is summed anew until it stays.
    """
    placed = ranked(sources)
    placed = placed.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")).cast("long"))
    placed = placed.withColumn("_cap", (F.col("source_size") * most).cast("long")).drop("_i")
    total, level = None, 0.0
    while True:
        over = F.col("_cap") < F.lit(level) * F.col("_w")
        row = placed.agg(F.sum("source_size").alias("t"), F.sum(F.when(over, F.col("_cap")).otherwise(0)).alias("c"), F.sum(F.when(over, 0).otherwise(F.col("_w"))).alias("w")).first()
        total = row["t"] or 0
        now = (total - row["c"]) / row["w"] if row["w"] else None
        if now is None or now <= level:
            break
        level = now
    target = F.col("_cap").cast("double") if now is None else F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_w"))
    return placed.select("source", "source_size", target.alias("target"))


def tilted(cells: DataFrame, aims: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """``cells`` (source, size, n) with source_size, target and rate: Newton's steps on all sources' multipliers."""
    same = F.col("source").eqNullSafe(F.col("_s"))
    some = F.col("size") > 0
    sums = cells.groupBy(F.col("source").alias("_s")).agg(F.sum(F.when(some, F.col("n")).otherwise(0)).alias("_docs"), F.min(F.when(some, F.col("size"))).alias("_least"))
    # z is size / (source_size / _docs); a multiplier of _high takes all documents ``most`` times, one of _low none
    state = sums.join(aims, same).drop("source")
    unit = F.col("source_size") / F.greatest("_docs", F.lit(1))
    state = state.select("_s", "source_size", "target", F.when(F.col("source_size") > 0, unit).otherwise(1.0).alias("_unit"), F.coalesce(F.col("_least").cast("double"), F.lit(1.0)).alias("_least"))
    full = F.col("target") >= F.lit(float(most)) * F.col("source_size")
    state = state.withColumn("_done", (F.col("source_size") == 0) | full).withColumn("_high", F.log(F.lit(float(most))) * F.col("_unit") / F.col("_least")).withColumn("_low", -60.0 * F.col("_unit") / F.col("_least"))
    state, held = state.withColumn("_lam", F.when(F.col("_done") & (F.col("source_size") > 0), F.col("_high") * 2).otherwise(0.0)), None
    tilt = F.col("_lam") * F.col("size") / F.col("_unit")
    rate = F.least(F.exp(F.least(tilt, F.log(F.lit(float(most))))), F.lit(float(most)))
    mass = F.col("size") * F.col("n")
    exact = lambda x: F.sum(x.cast("decimal(32,8)")).cast("double")

    def step(state: DataFrame) -> DataFrame:
        free = F.exp(tilt) < most
        # each source has cells, so its row is that of its sums
        moved = cells.join(state, same).groupBy(*state.columns).agg(exact(mass * rate).alias("_sum"), exact(F.when(free, mass * rate * F.col("size") / F.col("_unit")).otherwise(0.0)).alias("_slope"))
        moved = moved.withColumn("_gap", F.col("_sum") - F.col("target"))
        moved = moved.withColumn("_done", F.col("_done") | (F.abs("_gap") <= MISSED * F.col("source_size")))
        moved = moved.withColumn("_high", F.when(~F.col("_done") & (F.col("_gap") > 0), F.col("_lam")).otherwise(F.col("_high"))).withColumn("_low", F.when(~F.col("_done") & (F.col("_gap") <= 0), F.col("_lam")).otherwise(F.col("_low")))
        newton = F.when(F.col("_slope") > 0, F.col("_lam") - F.col("_gap") / F.col("_slope"))
        inside = F.coalesce((newton > F.col("_low")) & (newton < F.col("_high")), F.lit(False))
        return moved.withColumn("_lam", F.when(F.col("_done"), F.col("_lam")).when(inside, newton).otherwise((F.col("_low") + F.col("_high")) / 2)).drop("_sum", "_slope", "_gap")

    for _ in range(0, ITERATIONS, TOGETHER):
        for _ in range(TOGETHER):
            state = step(state)
        old, state = held, stage(state, "multipliers")
        held = state
        if old is not None:
            discard(old)
        if state.where("NOT _done").isEmpty():
            break
    return cells.join(state, same).select("source", "size", "n", "source_size", "target", rate.alias("rate"))


def rounded(size: np.ndarray, n: np.ndarray, rate: np.ndarray, most: int = MOST_COPIES) -> tuple[np.ndarray, np.ndarray]:
    """Copies that all documents of a size get, and the number of documents that get one more.

    From the longest documents to the shortest, what rounding a size's documents leaves over or short is
    carried to the next size, so that a source ends within about half of one short document.
    """
    base = np.minimum(np.floor(rate), most).astype(np.int64)
    extra, owed = np.zeros(len(size), np.int64), 0.0
    for i in np.argsort(-size, kind="stable"):
        if size[i] > 0:
            owed += (rate[i] - base[i]) * n[i] * size[i]
            room = n[i] if base[i] < most else 0
            extra[i] = min(max(round(owed / size[i]), 0), room)
            owed -= extra[i] * size[i]
            if owed < 0 and base[i] > 0 and extra[i] == 0:  # as many fewer, by lowering all and raising most again
                fewer = min(int(round(-owed / size[i])), n[i])
                if fewer:
                    base[i], extra[i] = base[i] - 1, n[i] - fewer
                    owed += fewer * size[i]
    return base, extra


def mix(df: DataFrame, text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, carry: Sequence[str] = (), key: Sequence[str] | None = None) -> DataFrame:
    """``df``'s rows with size, source_size, target, rate, copies and taken = copies * size.

    Words are counted in whole texts; a null or empty text has size 0 and one copy. A null source is a
    source of its own. Which documents of a size get the copy more is decided by a hash of the columns
    ``key`` (those of ``carry`` if not given) and of the text, so equal rows may differ in copies but reruns agree. No source's rows meet
    in one task. An empty table gives an empty result. Only ``carry`` and the columns named are read.
    """
    rows = df.select(F.struct(*carry).alias("_row") if carry else F.struct(F.lit(0).alias("_")).alias("_row"), F.col(source).alias("source"), word_count(text).alias("size"), uniform_key(*(carry if key is None else key), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_key"))
    rows = stage(rows, "sizes")
    cells = stage(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    aims = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)

    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("size", kind="stable")
        base, extra = rounded(cell["size"].to_numpy(np.float64), cell["n"].to_numpy(np.int64), cell["rate"].to_numpy(np.float64), most)
        return cell.assign(base=base, extra=extra)

    # a source has at most as many cells as its longest text has words
    kind = cells.schema["source"].dataType.simpleString()
    plan = tilted(cells, aims, most).groupBy("source").applyInPandas(solve, f"source {kind}, size long, n long, source_size long, target double, rate double, base long, extra long")
    plan = stage(plan, "rates").drop("n")
    numbered = running(rows, ["source", "size"], ["_key"], None, "_rank")
    out = numbered.join(plan.withColumnsRenamed({"source": "_s", "size": "_z"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    copies = F.col("base") + (F.col("_rank") < F.col("extra")).cast("long")
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in carry], *([] if "source" in carry else ["source"]), "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def repeat_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, each as often as it has copies."""
    numbered = stage(docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_rid")), "numbered")
    given = numbered.select("_rid", *[F.col(f"_doc.{c}").alias(c) for c in ("doc_id", "text", "source")])
    copies = stage(mix(given, carry=["_rid"], key=["doc_id"]).select("_rid", "copies").where("copies > 0"), "copies")
    # by shuffle at every size, as both grow with the data; texts aren't sorted for it, as numbers are looked up
    out = numbered.join(copies.hint("shuffle_hash"), "_rid").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("_doc.*")
