"""Physical layout: which pack an object goes to, the index over packs, and when packs are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.common import sums_before

# The merge rules.
MANY_PACKS, SMALL_PACKS, SMALL_PERCENT = 32, 8, 30


def first_byte(hash_: str = "hash") -> F.Column:
    return F.conv(F.substring(hash_, 1, 2), 16, 10).cast("int")


def assign(objects: DataFrame, pack_bytes: int, slice_digits: int = 3) -> DataFrame:
    """Objects in order of hash, in packs of about ``pack_bytes``: pack_num (from 1), entry_index, dat_offset."""
    s = sums_before(objects, F.conv(F.substring("hash", 1, slice_digits), 16, 10).cast("int"), ["hash"], {"before": "compressed_size"})
    s = s.withColumn("pack_num", (F.expr(f"before div {pack_bytes}") + 1).cast("long"))
    in_pack = Window.partitionBy("pack_num")
    return s.withColumn("entry_index", (F.row_number().over(in_pack.orderBy("hash")) - 1).cast("long")).withColumn("dat_offset", F.col("before") - F.min("before").over(in_pack))


def meta(entries: DataFrame) -> DataFrame:
    return entries.groupBy("pack_num").agg(F.count("*").alias("entries"), F.sum("compressed_size").alias("bytes"))


def fanout(entries: DataFrame) -> DataFrame:
    """256 rows: how many hashes have that first byte or a lower one."""
    counts = entries.groupBy(first_byte().cast("long").alias("byte")).agg(F.count("*").alias("n"))
    every = entries.sparkSession.range(256).withColumnRenamed("id", "byte")
    return every.join(counts, "byte", "left").select("byte", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("byte")).cast("long").alias("cumulative"))


def merge_due(packs: DataFrame, small: int) -> DataFrame:
    """One row: whether packs should be merged."""
    m = packs.agg(F.count("*").alias("packs"), F.coalesce(F.sum(F.when(F.col("bytes") < small, 1).otherwise(0)), F.lit(0)).cast("long").alias("small_packs"))
    return m.withColumn("due", (F.col("packs") > MANY_PACKS) | ((F.col("small_packs") >= SMALL_PACKS) & (F.col("small_packs") * 100 >= F.col("packs") * SMALL_PERCENT)))


def merge_candidates(packs: DataFrame, small: int, budget: int) -> DataFrame:
    """Small packs from the smallest on while their bytes fit the budget; the two newest are left alone.

    A table of packs has a row per pack file, so a window over all of it is small.
    """
    newest = packs.agg(F.max("pack_num").alias("_newest"))
    p = packs.crossJoin(F.broadcast(newest)).where(F.col("pack_num") + 1 < F.col("_newest")).where(F.col("bytes") < small).drop("_newest")
    p = p.withColumn("running_bytes", F.sum("bytes").over(Window.orderBy("bytes", "pack_num").rowsBetween(Window.unboundedPreceding, 0)))
    p = p.where(F.col("running_bytes") <= budget)
    return p.withColumn("_n", F.count("*").over(Window.partitionBy())).where("_n >= 2").drop("_n")


def gc_plan(entries: DataFrame, live: DataFrame) -> DataFrame:
    """Per pack: entries that are live and dead, and whether it is kept, deleted or rewritten."""
    marked = entries.join(live.withColumn("_live", F.lit(1)), "hash", "left")
    g = marked.groupBy("pack_num").agg(F.count("*").alias("entries"), F.count("_live").alias("live"))
    plan = F.when(F.col("live") == F.col("entries"), "keep").when(F.col("live") == 0, "delete").otherwise("rewrite")
    return g.withColumn("dead", F.col("entries") - F.col("live")).withColumn("plan", plan)
