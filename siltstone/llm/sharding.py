"""Sharding: rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import running, uniform_key

BITS = 52


def rendezvous(key: F.Column, weights: Sequence[float]) -> F.Column:
    """The shard that wins ``key``: each shard draws u in (0, 1) from md5(key:shard); least -ln(u) / weight wins.

    A shard's draw doesn't depend on the others, so a shard that is added, removed or reweighted only
    takes or gives up records itself. Ties go to the lower shard. A null key is a key of its own.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit("~"))

    def entry(j: int, w: float) -> F.Column:
        drawn = F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{j}"))), 1, BITS // 4), 16, 10).cast("double")
        return F.struct((-F.log((drawn + 0.5) / F.lit(2.0**BITS)) / F.lit(float(w))).alias("s"), F.lit(j).alias("j"))

    return F.array_min(F.array(*[entry(j, w) for j, w in enumerate(weights)]))["j"]


def shard(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row's ``key``; needs no shuffle. An existing column ``out`` is replaced.

    Rows with equal keys share a shard. An empty table stays empty. Texts don't matter, however long.
    """
    return df.withColumn(out, rendezvous(F.col(key), weights))


def slots(df: DataFrame, columns: Sequence[str], out: str = "slot") -> DataFrame:
    """``df`` with each row's place in its shard, gapless from 0, in the order of a hash of ``columns``.

    Repeated rows take places beside each other. No task holds a shard: see ``running``.
    """
    df = df.withColumn("_key", uniform_key(*columns))
    return running(df, ["shard"], ["_key", *columns], None, out).drop("_key")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards of equal weight by doc_id, and where each row would go with a 17th."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    docs = shard(shard(docs, "doc_id", [1.0] * 16), "doc_id", [1.0] * 17, "grown_shard")
    return slots(docs, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '~') AS k FROM documents),
tbl AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(i))),
b AS (SELECT doc_id, k, octet_length(encode(text)) AS n,
  list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM d),
c AS (SELECT doc_id, k, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
  lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS crc FROM b, tbl),
draws AS (SELECT c.*, j, -ln((CAST('0x' || substr(md5(k || ':' || j), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS s
  FROM c, range(17) r(j)),
won AS (SELECT doc_id, k, n, crc, arg_min(j, s) FILTER (j < 16) AS shard, arg_min(j, s) AS grown
  FROM draws GROUP BY doc_id, k, n, crc),
o AS (SELECT *, CAST('0x' || substr(md5(k || ':' || (n + 1) || ':' || crc), 1, 15) AS BIGINT) AS h FROM won)
SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, n, crc) - 1 AS BIGINT) AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM o
"""
