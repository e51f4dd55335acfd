"""Embedding near-dedup by spherical-cap filters with structured random product codes.

A filter is a direction f; a unit vector v passes it if <v, f> is at least v's bound. The directions are
product codes: after a random rotation the dimensions are cut into two blocks, each with its own random code,
and a filter is a pair of codewords, one of each block. A vector's bound is such that it passes as many
filters of each code as ``planned`` says: one bound for all would leave some vectors without any, and lose their links. Its
filters are list-decoded: the best sums come from the best codewords of either block, whatever the size of
the code. Vectors that pass a filter meet in its bucket, and pairs there are verified.

The share of pairs missed at the threshold is estimated from simulated pairs and kept below ``MISSED`` at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import components, discard, forest, stage

COSINE = 0.95
#: The least number of codes, and the filters of each that a vector passes.
CODES, LISTED = 4, 4
#: The chance that a pair at the threshold shares no filter stays below this; pairs by which it is estimated.
MISSED, TRIALS = 1e-6, 4096
#: Vectors at random in a bucket, which sets how many filters there are; vectors of a bucket that a task has at once.
BUCKET, BLOCK = 64, 4096
#: Rows of blocks that a task has at once, as a mean; rows of a block that are multiplied at once.
ROWS_PER_TASK, STRIP = 2 * BLOCK, 512
SEED = 20240607


def codes(dimensions: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A product code: for each block its codewords, as directions in all dimensions."""
    rng = np.random.default_rng(seed)
    turned = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0]
    cut = dimensions - dimensions // 2
    blocks = []
    for part in (turned[:, :cut], turned[:, cut:]):
        n = max(part.shape[1], 1)
        w = rng.standard_normal((words, n))
        w *= (n / (w * w).sum(1, keepdims=True)) ** 0.5
        blocks.append(w[:, : part.shape[1]] @ part.T)
    return blocks[0], blocks[1]


def decode(v: np.ndarray, first: np.ndarray, second: np.ndarray, listed: int = LISTED) -> np.ndarray:
    """The ``listed`` filters with the largest products with each row of ``v``, in ascending order."""

    def best(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.argsort(-x, axis=1, kind="stable")[:, :listed]
        return at, np.take_along_axis(x, at, 1)

    (i, a), (j, b) = best(v @ first.T), best(v @ second.T)
    sums = (a[:, :, None] + b[:, None, :]).reshape(len(v), -1)
    names = (i[:, :, None] * len(second) + j[:, None, :]).reshape(len(v), -1)
    return np.sort(np.take_along_axis(names, np.argsort(-sums, axis=1, kind="stable")[:, :listed], 1), axis=1)


def planned(dimensions: int, n: int, cosine: float = COSINE) -> tuple[int, int, int]:
    """Codewords of a block, codes, and filters of each code a vector passes, for ``n`` vectors.

    All pairs at one cosine are alike to a randomly turned code, and codes are independent: if one code
    misses such a pair with probability p, k codes miss it with p ** k. p is estimated from above by pairs
    drawn at the threshold. Narrow caps have small buckets but need many codes, most of all in few
    dimensions, so of the widths and list lengths the one with the least work is taken.
    """
    most = max(32, int((n * LISTED / BUCKET) ** 0.5))
    if dimensions == 1:  # all vectors are one of two
        return 32, CODES, LISTED
    rng = np.random.default_rng(SEED)
    a, b = (scaled(rng.standard_normal((TRIALS, dimensions))) for _ in range(2))
    b = scaled(b - (a * b).sum(1, keepdims=True) * a)
    b = cosine * a + (1 - cosine * cosine) ** 0.5 * b
    plans, words = [], 32
    while True:
        for listed in (LISTED, 2 * LISTED, 4 * LISTED):
            missed = 0
            for seed, at in enumerate(range(0, TRIALS, TRIALS // 4)):
                code = codes(dimensions, words, SEED - 1 - seed)
                x, y = (decode(v[at : at + TRIALS // 4], *code, listed) for v in (a, b))
                missed += int((~(x[:, :, None] == y[:, None, :]).any((1, 2))).sum())
            p = (missed + 3 * missed**0.5 + 5) / TRIALS
            if p < 1:
                k = max(CODES, int(np.ceil(np.log(MISSED) / np.log(p))))
                # a row for each filter, and what it is compared with there
                plans.append((k * listed * (1 + n * listed / (BUCKET * words * words)), words, k, listed))
        if words == most:
            break
        words = min(2 * words, most)
    return min(plans)[1:]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of finite numbers, not all zero, scaled to length 1 in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine_links(df: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept, first.

    Vectors of the most frequent length take part; those of other lengths are compared among themselves in
    the same way, length by length. A vector that is null, empty or zero, or has null or non-finite components
    links with nothing. Rows with equal vectors link; they are one class, verified once. Links are verified
    by cosine in double precision. Large buckets are cut into blocks that are compared two at a time, so that
    no task holds a bucket; a pair that shares several filters is counted in the first of them. Blocks give
    out no pairs, but each vector's number of links and a forest that joins what is linked, so what comes
    out of a bucket grows with its vectors, not with their pairs. ``component_id`` is the least non-null id reachable, ``kept`` is id = component_id,
    ``first`` is true for one row of each component. Other columns aren't read. An empty table gives none.
    """
    given = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = stage(given.withColumn("class", F.when(usable, F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))), 256))).withColumn("size", F.size("v")), "vectors")
    heads = rows.where("class IS NOT NULL").groupBy("class", "size").agg(F.min("rid").alias("node"), F.min("id").alias("low"), F.count("*").alias("c"))
    heads = stage(heads, "classes")
    met, narrow = None, df.schema[vector].dataType.simpleString() == "array<float>"
    # one row per length of vectors, as a rule one
    for size, n in sorted(heads.groupBy("size").agg(F.count("*").alias("n")).collect()):
        found = _links(rows.select(F.col("rid").alias("node"), "v").join(heads.where(F.col("size") == size).select("node", "c"), "node"), size, planned(size, n, cosine), cosine, narrow)
        met = found if met is None else met.union(found)
    met = stage(met, "links") if met is not None else df.sparkSession.createDataFrame([], "node long, root long, n long")
    number = met.where("n > 0").groupBy("node").agg(F.sum("n").alias("other"))
    found = components(met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    labels = heads.join(found, "node", "left").join(number, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labels.groupBy("component").agg(F.min("low").alias("component_id"), F.min(F.struct(F.col("low").isNull().alias("z"), "low", "node"))["node"].alias("head"))
    labels = labels.join(least, "component").select("class", (F.coalesce("other", F.lit(0)) + F.col("c") - 1).alias("n_links"), "component_id", "node", "head", "low")
    out = rows.select("rid", "id", "class").join(labels, "class", "left")
    stays = out.where(F.expr("node = head AND id <=> low")).groupBy("class").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("stays"))
    out = out.join(stays, "rid", "left")
    lone = F.col("class").isNull()
    component = F.when(lone, F.col("id")).otherwise(F.col("component_id"))
    return out.select("rid", "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), (lone | F.coalesce("stays", F.lit(False))).alias("first"))


def _links(vectors: DataFrame, dimensions: int, plan: tuple[int, int, int], cosine: float, narrow: bool) -> DataFrame:
    """What each block finds of the classes of ``vectors`` (node, v, c): rows (node, root, n).

    ``n`` is how many rows ``node`` links with that no other block counts, ``root`` a node that links reach.
    """
    words, number, listed = plan
    every = [codes(dimensions, words, SEED + i) for i in range(number)]
    kind = "<f4" if narrow else "<f8"

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                unit = scaled(v)
                f = np.concatenate([decode(unit, *code, listed) + i * words * words for i, code in enumerate(every)], axis=1)
                edges = np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("c"), pa.array([x.astype(kind).tobytes() for x in v], pa.binary()), pa.ListArray.from_arrays(edges, pa.array(f.ravel(), pa.int64()))], ["node", "c", "v", "filters"])

    coded = stage(vectors.mapInArrow(filters, "node long, c long, v binary, filters array<long>"), "filters")
    sizes = coded.select(F.explode("filters").alias("f")).groupBy("f").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = coded.select("node", F.explode("filters").alias("f")).join(sizes, "f").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("node", "f", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # by the rows that blocks hold: small buckets share a task, a pair of large blocks has one for itself
    held = sizes.agg(F.coalesce(F.sum(F.col("n") * blocks), F.lit(0))).first()[0]
    groups = max(1, int(held) // ROWS_PER_TASK)
    met = met.withColumn("g", F.pmod(F.xxhash64("f", "i", "j"), F.lit(groups)))

    def verify(table: pa.Table) -> pa.Table:
        f, i, j, own, node, count = (table.column(c).to_numpy() for c in ("f", "i", "j", "own", "node", "c"))
        v = scaled(np.frombuffer(b"".join(table.column("v").to_pylist()), kind).reshape(len(f), dimensions))
        passed = table.column("filters").combine_chunks().flatten().to_numpy().reshape(len(f), -1)
        order = np.lexsort((own, j, i, f))
        edge = np.flatnonzero(np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in (f, i, j)], axis=0)])
        out = [[], [], []]
        for start, end in zip(edge, np.r_[edge[1:], len(order)], strict=True):
            part = order[start:end]
            same = i[part[0]] == j[part[0]]
            a, b = np.flatnonzero(own[part] == i[part[0]]), np.flatnonzero(own[part] == j[part[0]])
            if not len(a) or not len(b):
                continue
            near, fresh = linked(v[part], passed[part], int(f[part[0]]), a, b, cosine)
            if not near.any():
                continue
            # each pair of a block with itself is seen from both sides
            n = np.zeros(len(part), np.int64)
            n[a] += fresh @ count[part][b]
            if not same:
                n[b] += fresh.T @ count[part][a]
            root = forest(near, a, b, len(part))
            told = np.flatnonzero((n > 0) | (root != np.arange(len(part))))
            for column, values in zip(out, (node[part][told], node[part][root[told]], n[told]), strict=True):
                column.append(values)
        return pa.table({name: pa.array(np.concatenate([*column, np.zeros(0, np.int64)]), pa.int64()) for name, column in zip(("node", "root", "n"), out, strict=True)})

    return met.join(coded, "node").groupBy("g").applyInArrow(verify, "node long, root long, n long")


def linked(v: np.ndarray, passed: np.ndarray, f: int, a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``a`` links with which of ``b``, and which of those share no filter before ``f``.

    Pairs that share an earlier filter are counted there: a product of which vector passes which filter.
    """
    early = [np.where(passed[p] < f, passed[p], -1) for p in (a, b)]
    both = np.intersect1d(early[0], early[1])
    sides = []
    for e in early:
        at = np.searchsorted(both, e)
        here = (e >= 0) & (np.r_[both, -2][at] == e)
        side = np.zeros((len(e), len(both) + 1), np.float32)
        side[np.nonzero(here)[0], at[here]] = 1
        sides.append(side)
    near, fresh = (np.zeros((len(a), len(b)), bool) for _ in range(2))
    for at in range(0, len(a), STRIP):
        strip = slice(at, at + STRIP)
        near[strip] = v[a[strip]] @ v[b].T >= cosine
        near[strip] &= a[strip, None] != b
        fresh[strip] = near[strip] & (sides[0][strip] @ sides[1].T == 0)
    return near, fresh


def op4_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cosine_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v WHERE list_dot_product(v, v) > 0 AND isfinite(list_dot_product(v, v))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k ON a = vec_id
"""
