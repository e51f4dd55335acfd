"""Queries on objects: references, garbage, integrity, lookup, sizes by type."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.codecs import compressed_fraction
from siltstone.operators import objects as o
from siltstone.sources.fixtures import Repo, cte

#: A payload whose beginning shrinks by less than a tenth isn't worth compressing.
PROBE, WORTH = 1 << 16, 0.9


def refs_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return o.live(Repo(spark, sf).nodes)


def _first(r: Repo) -> DataFrame:
    return r.nodes.where("snap_id = 2")


def gc_dead(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    return o.dead(r.objects, _first(r)).select("hash", "storage", "compressed_size")


def gc_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    marked = r.objects.join(o.live(_first(r)).withColumn("live", F.lit(True)), "hash", "left")
    return marked.agg(F.count("live").alias("kept"), (F.count("*") - F.count("live")).alias("deleted"), F.sum(F.when(F.col("live").isNull(), F.col("compressed_size")).otherwise(0)).alias("freed_bytes"))


def verify(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    return o.verify(r.nodes, r.objects, r.payloads)


def verify_provenance(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    bad = o.verify(r.nodes, r.objects, r.payloads).where("status <> 'ok'").select("hash", "status")
    return bad.join(o.first_reference(r.nodes), "hash")


def verify_after(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    return o.references(_first(r)).join(r.objects.select("hash"), "hash", "left_anti").groupBy("field").agg(F.count("*").alias("missing"), F.countDistinct("hash").alias("hashes"))


def object_refs(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes that refer to each hash, with the first field by which they do: content, attributes, access list."""
    return o.references(Repo(spark, sf).nodes).groupBy("hash", "snap_id", "node_id").agg(F.min("field").alias("field"))


def object_lookup(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    return o.locate(o.live(_first(r)), r.objects).select("hash", F.coalesce("storage", F.lit("none")).alias("found"), "type", "uncompressed_size")


def object_exists(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    return o.live(_first(r)).join(r.objects.select("hash"), "hash", "left_semi")


def object_locate(spark: SparkSession, sf: str) -> DataFrame:
    return Repo(spark, sf).objects.select("hash", "type", "storage", "uncompressed_size", "compressed_size")


def object_content_prefix(spark: SparkSession, sf: str) -> DataFrame:
    p = Repo(spark, sf).payloads
    return p.select("hash", F.lower(F.hex(F.substring("payload", 1, 64))).alias("prefix"), (F.octet_length("payload") > 64).alias("truncated"), F.octet_length("payload").cast("long").alias("full_size"))


def import_new_objects(spark: SparkSession, sf: str) -> DataFrame:
    """A bundle of snapshot 2's contents brought to a store that has the loose objects."""
    r = Repo(spark, sf)
    bundle = r.files.where("snap_id = 2").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    return o.store(bundle, r.objects.where("storage = 'loose'"))


def export_objects(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    return o.live(r.nodes.where("snap_id = 1")).join(r.objects, "hash").select("hash", "type", "uncompressed_size", "storage")


def bundle_verify(spark: SparkSession, sf: str) -> DataFrame:
    p = Repo(spark, sf).payloads
    bad = F.sha2("payload", 256) != F.col("hash")
    return p.agg(F.count("*").alias("records"), F.sum(F.octet_length("payload").cast("long")).alias("bytes"), F.sum(F.when(bad, 1).otherwise(0)).alias("mismatches"))


def incompressible(spark: SparkSession, sf: str) -> DataFrame:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ratio = [compressed_fraction(x) for x in b.column("head").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("hash"), pa.array(ratio, pa.float64())], ["hash", "ratio"])

    heads = Repo(spark, sf).payloads.select("hash", F.substring("payload", 1, PROBE).alias("head"))
    return heads.mapInArrow(probe, "hash string, ratio double").withColumn("skip", F.col("ratio") >= WORTH)


def sparse_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads with holes where a text has blank lines: their regions between runs of zero bytes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, i, s, n) for h, p in zip(b.column("hash").to_pylist(), b.column("payload").to_pylist(), strict=True) for i, (s, n) in enumerate(o.zero_runs(p.replace(b"\n", b"\0" * 8), 8))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["hash", "region", "offset", "length"])

    return Repo(spark, sf).payloads.mapInArrow(find, "hash string, region long, offset long, length long")


def _sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count("*").alias("n"), F.sum("uncompressed_size").alias("uncompressed"), F.sum("compressed_size").alias("compressed"))


def _types(df: DataFrame) -> DataFrame:
    """All four types, those without rows as zeros."""
    every = df.sparkSession.range(1, 5).withColumnRenamed("id", "type")
    return every.join(df, "type", "left").fillna(0)


def repo_stats(spark: SparkSession, sf: str) -> DataFrame:
    ob = Repo(spark, sf).objects
    pack, loose = F.col("storage") == "pack", F.col("storage") == "loose"
    ratio = (F.col("uncompressed_size") > 0) & (F.expr("compressed_size * 100 div uncompressed_size") >= 90)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return _types(ob.groupBy("type").agg(F.count("*").alias("objects"), n(pack).alias("packed"), n(loose).alias("loose"), F.sum("uncompressed_size").alias("uncompressed"), F.sum("compressed_size").alias("compressed"), n(loose & (F.col("pack_skip_ver") == 1)).alias("skipped"), n(pack & ratio).alias("high_ratio")))


def loose_stats(spark: SparkSession, sf: str) -> DataFrame:
    ob = Repo(spark, sf).objects.where("storage = 'loose'")
    return _types(ob.groupBy("type").agg(F.count("*").alias("objects"), F.sum("compressed_size").alias("compressed"), F.sum("pack_skip_ver").alias("skipped")))


def compression_summary(spark: SparkSession, sf: str) -> DataFrame:
    ob = Repo(spark, sf).objects
    u, c, total = F.sum("uncompressed_size"), F.sum("compressed_size"), F.count("*")
    loose = F.sum(F.when(F.col("storage") == "loose", F.col("compressed_size")).otherwise(0))
    return ob.agg(total.alias("objects"), u.alias("uncompressed"), c.alias("compressed"), (u - c).alias("saved"), F.expr("sum(compressed_size) * 1000 div sum(uncompressed_size)").alias("ratio_permille"), F.expr("sum(CASE WHEN storage = 'loose' THEN compressed_size ELSE 0 END) * 1000 div sum(compressed_size)").alias("loose_permille"), loose.alias("loose_bytes"))


def loose_list(spark: SparkSession, sf: str) -> DataFrame:
    """A page of loose objects, as the interface gives it: 200 from the 50th on."""
    return Repo(spark, sf).objects.where("storage = 'loose'").select("hash", "type", "compressed_size").orderBy("hash").offset(50).limit(200)


_V = cte("refs", "objects", "payloads") + """, v AS (SELECT h.hash, CASE WHEN payload IS NULL THEN 'missing' WHEN sha256(payload) <> h.hash THEN 'corrupt' ELSE 'ok' END AS status, type, CAST(octet_length(payload) AS BIGINT) AS bytes
  FROM (SELECT DISTINCT hash FROM refs) h LEFT JOIN objects o ON o.hash = h.hash LEFT JOIN payloads p ON p.hash = h.hash)"""
_LIVE = cte("refs", "objects") + ", live AS (SELECT DISTINCT hash FROM refs WHERE snap_id = 2)"

PLANS = {
    "refs_distinct": (refs_distinct, cte("refs") + " SELECT DISTINCT hash FROM refs"),
    "gc_dead": (gc_dead, _LIVE + " SELECT hash, storage, compressed_size FROM objects WHERE hash NOT IN (SELECT hash FROM live)"),
    "gc_summary": (gc_summary, _LIVE + """ SELECT count(l.hash) AS kept, count(*) - count(l.hash) AS deleted, CAST(sum(CASE WHEN l.hash IS NULL THEN compressed_size ELSE 0 END) AS BIGINT) AS freed_bytes
      FROM objects o LEFT JOIN live l ON l.hash = o.hash"""),
    "verify": (verify, _V + " SELECT * FROM v"),
    "verify_provenance": (verify_provenance, _V + """ SELECT hash, status, snap_id, node_id, field FROM (SELECT v.hash, status, snap_id, node_id, field, row_number() OVER (PARTITION BY v.hash ORDER BY snap_id, node_id, field) AS r
      FROM v JOIN refs ON refs.hash = v.hash WHERE status <> 'ok') WHERE r = 1"""),
    "verify_after": (verify_after, _LIVE + " SELECT field::BIGINT AS field, count(*) AS missing, count(DISTINCT hash) AS hashes FROM refs WHERE snap_id = 2 AND hash NOT IN (SELECT hash FROM objects) GROUP BY 1"),
    "object_refs": (object_refs, cte("refs") + " SELECT hash, snap_id, node_id, CAST(min(field) AS BIGINT) AS field FROM refs GROUP BY 1, 2, 3"),
    "object_lookup": (object_lookup, _LIVE + " SELECT l.hash, coalesce(storage, 'none') AS found, type, uncompressed_size FROM live l LEFT JOIN objects o ON o.hash = l.hash"),
    "object_exists": (object_exists, _LIVE + " SELECT hash FROM live WHERE hash IN (SELECT hash FROM objects)"),
    "object_locate": (object_locate, cte("objects") + " SELECT hash, type, storage, uncompressed_size, compressed_size FROM objects"),
    "object_content_prefix": (object_content_prefix, cte("payloads") + " SELECT hash, lower(substr(hex(payload), 1, 128)) AS prefix, octet_length(payload) > 64 AS truncated, CAST(octet_length(payload) AS BIGINT) AS full_size FROM payloads"),
    "import_new_objects": (import_new_objects, cte("files", "objects") + """ SELECT sha256(text) AS hash, CAST(max(octet_length(encode(text))) AS BIGINT) AS size FROM files WHERE snap_id = 2
      AND sha256(text) NOT IN (SELECT hash FROM objects WHERE storage = 'loose') GROUP BY 1"""),
    "export_objects": (export_objects, cte("refs", "objects") + " SELECT hash, type, uncompressed_size, storage FROM objects WHERE hash IN (SELECT hash FROM refs WHERE snap_id = 1)"),
    "bundle_verify": (bundle_verify, cte("payloads") + " SELECT count(*) AS records, CAST(sum(octet_length(payload)) AS BIGINT) AS bytes, count(*) FILTER (sha256(payload) <> hash) AS mismatches FROM payloads"),
    "incompressible": (incompressible, None),
    "sparse_regions": (sparse_regions, None),
    "repo_stats": (repo_stats, cte("objects") + """ SELECT t AS type, count(hash) AS objects, count(*) FILTER (storage = 'pack') AS packed, count(*) FILTER (storage = 'loose') AS loose,
      CAST(coalesce(sum(uncompressed_size), 0) AS BIGINT) AS uncompressed, CAST(coalesce(sum(compressed_size), 0) AS BIGINT) AS compressed, count(*) FILTER (storage = 'loose' AND pack_skip_ver = 1) AS skipped,
      count(*) FILTER (storage = 'pack' AND uncompressed_size > 0 AND compressed_size * 100 // uncompressed_size >= 90) AS high_ratio FROM range(1, 5) r(t) LEFT JOIN objects ON type = t GROUP BY t"""),
    "loose_stats": (loose_stats, cte("objects") + """ SELECT t AS type, count(hash) AS objects, CAST(coalesce(sum(compressed_size), 0) AS BIGINT) AS compressed, CAST(coalesce(sum(pack_skip_ver), 0) AS BIGINT) AS skipped
      FROM range(1, 5) r(t) LEFT JOIN objects ON type = t AND storage = 'loose' GROUP BY t"""),
    "compression_summary": (compression_summary, cte("objects") + """ SELECT count(*) AS objects, CAST(sum(uncompressed_size) AS BIGINT) AS uncompressed, CAST(sum(compressed_size) AS BIGINT) AS compressed,
      CAST(sum(uncompressed_size) - sum(compressed_size) AS BIGINT) AS saved, CAST(sum(compressed_size) * 1000 // sum(uncompressed_size) AS BIGINT) AS ratio_permille,
      CAST(coalesce(sum(compressed_size) FILTER (storage = 'loose'), 0) * 1000 // sum(compressed_size) AS BIGINT) AS loose_permille, CAST(coalesce(sum(compressed_size) FILTER (storage = 'loose'), 0) AS BIGINT) AS loose_bytes FROM objects"""),
    "loose_list": (loose_list, cte("objects") + " SELECT hash, type, compressed_size FROM objects WHERE storage = 'loose' ORDER BY hash LIMIT 200 OFFSET 50"),
}
