"""Queries on the physical layout: packs, their index, merging, parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import objects as o
from siltstone.operators import packs as p
from siltstone.sources.fixtures import PACK_BYTES, Repo, cte

SMALL, BUDGET = 2 * PACK_BYTES, 4 * PACK_BYTES


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return p.assign(Repo(spark, sf).objects.where("storage = 'pack'"), PACK_BYTES)


def pack_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).select("hash", "pack_num", "entry_index", "dat_offset")


def pack_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).where("pack_num = 2").select("entry_index", "hash", "type", "compression", "uncompressed_size", "compressed_size", "dat_offset").orderBy("entry_index")


def pack_index_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).select("hash", "pack_num", "dat_offset", "entry_index").orderBy("hash")


def pack_index_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the index, as the interface gives it: 100 from the 30th on."""
    return pack_index_rows(spark, sf).offset(30).limit(100)


def pack_meta(spark: SparkSession, sf: str) -> DataFrame:
    return p.meta(_entries(spark, sf)).withColumn("small", F.col("bytes") < SMALL)


def pack_fanout(spark: SparkSession, sf: str) -> DataFrame:
    return p.fanout(_entries(spark, sf))


def pack_fanout_stats(spark: SparkSession, sf: str) -> DataFrame:
    own = F.col("cumulative") - F.coalesce(F.lag("cumulative").over(Window.orderBy("byte")), F.lit(0))
    return p.fanout(_entries(spark, sf)).withColumn("own", own).agg(F.max("own").alias("most"), F.min("own").alias("least"), F.sum("own").alias("entries"))


def pack_resolve(spark: SparkSession, sf: str) -> DataFrame:
    wanted = o.live(Repo(spark, sf).nodes.where("snap_id = 2"))
    return wanted.join(_entries(spark, sf).select("hash", "pack_num", "dat_offset"), "hash")


def coalesce_trigger(spark: SparkSession, sf: str) -> DataFrame:
    return p.merge_due(p.meta(_entries(spark, sf)), SMALL)


def coalesce_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return p.merge_candidates(p.meta(_entries(spark, sf)), SMALL, BUDGET)


def pack_gc_plan(spark: SparkSession, sf: str) -> DataFrame:
    return p.gc_plan(_entries(spark, sf), o.live(Repo(spark, sf).nodes.where("snap_id = 1")))


def parity_overhead(spark: SparkSession, sf: str) -> DataFrame:
    ob = Repo(spark, sf).objects
    size = F.expr("(compressed_size + 15295) div 15296 * 1024")
    return ob.groupBy("type").agg(F.sum(size).alias("parity_bytes"), F.sum("compressed_size").alias("bytes"))


_P = cte("packed")
_M = _P + ", m AS (SELECT CAST(pack_num AS BIGINT) AS pack_num, count(*) AS entries, CAST(sum(compressed_size) AS BIGINT) AS bytes FROM packed GROUP BY 1)"
_I = "SELECT hash, CAST(pack_num AS BIGINT) AS pack_num, CAST(dat_offset AS BIGINT) AS dat_offset, entry_index FROM packed ORDER BY hash"
_F = _P + ", f AS (SELECT i AS byte, count(hash) AS own FROM range(256) r(i) LEFT JOIN packed ON CAST('0x' || substr(hash, 1, 2) AS BIGINT) = i GROUP BY i)"

PLANS = {
    "pack_assign": (pack_assign, _P + " SELECT hash, CAST(pack_num AS BIGINT) AS pack_num, entry_index, CAST(dat_offset AS BIGINT) AS dat_offset FROM packed"),
    "pack_entries": (pack_entries, _P + " SELECT entry_index, hash, type, compression, uncompressed_size, compressed_size, CAST(dat_offset AS BIGINT) AS dat_offset FROM packed WHERE pack_num = 2 ORDER BY 1"),
    "pack_index_rows": (pack_index_rows, f"{_P} {_I}"),
    "pack_index_page": (pack_index_page, f"{_P} {_I} LIMIT 100 OFFSET 30"),
    "pack_meta": (pack_meta, f"{_M} SELECT *, bytes < {SMALL} AS small FROM m"),
    "pack_fanout": (pack_fanout, _F + " SELECT byte, CAST(sum(own) OVER (ORDER BY byte) AS BIGINT) AS cumulative FROM f"),
    "pack_fanout_stats": (pack_fanout_stats, _F + " SELECT max(own) AS most, min(own) AS least, CAST(sum(own) AS BIGINT) AS entries FROM f"),
    "pack_resolve": (pack_resolve, cte("packed", "refs") + " SELECT hash, CAST(pack_num AS BIGINT) AS pack_num, CAST(dat_offset AS BIGINT) AS dat_offset FROM packed WHERE hash IN (SELECT hash FROM refs WHERE snap_id = 2)"),
    "coalesce_trigger": (coalesce_trigger, f"{_M} SELECT count(*) AS packs, count(*) FILTER (bytes < {SMALL}) AS small_packs, count(*) > 32 OR (count(*) FILTER (bytes < {SMALL}) >= 8 AND count(*) FILTER (bytes < {SMALL}) * 100 >= count(*) * 30) AS due FROM m"),
    "coalesce_candidates": (coalesce_candidates, f"""{_M}, c AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY bytes, pack_num) AS BIGINT) AS running_bytes FROM m WHERE bytes < {SMALL} AND pack_num + 1 < (SELECT max(pack_num) FROM m))
      SELECT * FROM c WHERE running_bytes <= {BUDGET} AND (SELECT count(*) FROM c WHERE running_bytes <= {BUDGET}) >= 2"""),
    "pack_gc_plan": (pack_gc_plan, cte("packed", "refs") + """, l AS (SELECT DISTINCT hash FROM refs WHERE snap_id = 1) SELECT CAST(pack_num AS BIGINT) AS pack_num, count(*) AS entries, count(l.hash) AS live, count(*) - count(l.hash) AS dead,
      CASE WHEN count(l.hash) = count(*) THEN 'keep' WHEN count(l.hash) = 0 THEN 'delete' ELSE 'rewrite' END AS plan FROM packed p LEFT JOIN l ON l.hash = p.hash GROUP BY 1"""),
    "parity_overhead": (parity_overhead, cte("objects") + " SELECT type, CAST(sum((compressed_size + 15295) // 15296 * 1024) AS BIGINT) AS parity_bytes, CAST(sum(compressed_size) AS BIGINT) AS bytes FROM objects GROUP BY type"),
}
