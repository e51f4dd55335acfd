"""The content-addressed side: references, garbage, integrity, lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fields in the order in which they claim an object.
FIELDS = ("content_hash", "xattr_hash", "acl_hash")


def references(nodes: DataFrame) -> DataFrame:
    """snap_id, node_id, field (1 content, 2 xattr, 3 acl) and hash of all that nodes refer to."""
    pairs = F.array(*[F.struct(F.lit(i).cast("long").alias("field"), F.col(c).alias("hash")) for i, c in enumerate(FIELDS, 1)])
    return nodes.select("snap_id", "node_id", F.explode(pairs).alias("r")).select("snap_id", "node_id", "r.field", "r.hash").where("hash IS NOT NULL")


def live(nodes: DataFrame) -> DataFrame:
    return references(nodes).select("hash").distinct()


def dead(objects: DataFrame, nodes: DataFrame) -> DataFrame:
    """Objects that nothing refers to."""
    return objects.join(live(nodes), "hash", "left_anti")


def first_reference(nodes: DataFrame) -> DataFrame:
    """For each hash the reference that comes first, by snapshot, node and field: an aggregate, not a window."""
    r = references(nodes).groupBy("hash").agg(F.min(F.struct("snap_id", "node_id", "field")).alias("r"))
    return r.select("hash", "r.*")


def verify(nodes: DataFrame, objects: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each hash referred to: ok, missing, or corrupt if its payload has another hash."""
    # the payload is digested where it lies; only digests are joined
    digests = payloads.select("hash", F.sha2("payload", 256).alias("actual"), F.octet_length("payload").cast("long").alias("bytes"))
    found = live(nodes).join(objects.select("hash", "type"), "hash", "left").join(digests, "hash", "left")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("hash"), "corrupt").otherwise("ok")
    return found.select("hash", status.alias("status"), "type", "bytes")


def store(incoming: DataFrame, objects: DataFrame) -> DataFrame:
    """Of incoming contents (hash, size), those that are new; each once."""
    return incoming.groupBy("hash").agg(F.max("size").alias("size")).join(objects.select("hash"), "hash", "left_anti")


def first_seen(nodes: DataFrame) -> DataFrame:
    """Bytes that each snapshot brought in: sizes of contents that no earlier one had."""
    seen = nodes.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("snap_id").alias("snap_id"), F.max("size").alias("size"))
    return seen.groupBy("snap_id").agg(F.count("*").alias("new_objects"), F.sum("size").alias("new_bytes"))


def locate(hashes: DataFrame, objects: DataFrame) -> DataFrame:
    """Where each hash is found, loose objects before packed ones; null if nowhere."""
    by = Window.partitionBy("hash").orderBy(F.col("storage") != "loose")
    best = objects.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")
    return hashes.join(best, "hash", "left")


def zero_runs(payload: bytes, least: int) -> list[tuple[int, int]]:
    """Regions (offset, length) of a payload between runs of at least ``least`` zero bytes."""
    import re

    out, at = [], 0
    for m in re.finditer(rb"\0{%d,}" % least, payload):
        if m.start() > at:
            out.append((at, m.start() - at))
        at = m.end()
    if at < len(payload):
        out.append((at, len(payload) - at))
    return out
