"""What changed between two versions of a tree: full outer joins on the path and their classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = ("mode", "uid", "gid", "mtime_sec")
HASHES = ("content_hash", "xattr_hash", "acl_hash")
#: What an ingest holds against the snapshot before, beside contents; a diff tells of META alone.
INGEST_META = (*META, "mtime_nsec", "xattr_hash", "acl_hash")
#: What a row of a comparison carries of either side.
SIDE = ("content_hash", *META, "size")


def matched(old: DataFrame, new: DataFrame, columns: tuple[str, ...] = SIDE) -> DataFrame:
    """One row per path of either side; its columns as old_* and new_*, and whether it is there."""
    side = lambda df, name: df.select("path", *[F.col(c).alias(f"{name}_{c}") for c in columns], F.lit(True).alias(f"in_{name}"))
    return side(old, "old").join(side(new, "new"), "path", "full_outer")


def same(columns: tuple[str, ...]) -> F.Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    return out


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """A added, D deleted, M content, m metadata; unchanged paths don't appear."""
    change = F.when(F.col("in_old").isNull(), "A").when(F.col("in_new").isNull(), "D").when(~same(("content_hash",)), "M").when(~same(META), "m")
    return matched(old, new).withColumn("change", change).where("change IS NOT NULL").drop("in_old", "in_new")


def classify(previous: DataFrame, scanned: DataFrame) -> DataFrame:
    """An ingest's view: new, modified, metadata, unchanged and deleted paths.

    Attributes, access lists and the nanoseconds of times count as metadata here.
    """
    meta = tuple(c for c in INGEST_META if c in previous.columns and c in scanned.columns)
    change = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "deleted").when(~same(("content_hash",)), "modified").when(~same(meta), "metadata").otherwise("unchanged")
    return matched(previous, scanned, ("content_hash", *meta, "size")).select("path", change.alias("change"), "old_size", "new_size")


def size_delta() -> F.Column:
    """Bytes that a change adds: all of what came, minus all of what went."""
    return (F.when(F.col("change") == "A", F.col("new_size")).when(F.col("change") == "D", -F.col("old_size")).otherwise(F.col("new_size") - F.col("old_size"))).cast("long")


def meta_lines() -> F.Column:
    """For a metadata change, the fields that differ, as text."""
    told = [F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.concat(F.lit(f"{c}: "), F.col(f"old_{c}").cast("string"), F.lit(" -> "), F.col(f"new_{c}").cast("string"))) for c in META]
    return F.concat_ws("; ", *told)


def line_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines side by side by their number, of texts (path, text) on both sides; equal lines don't appear."""
    lines = lambda df, name: df.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", name))
    both = lines(old, "old_line").join(lines(new, "new_line"), ["path", "line_no"], "full_outer")
    return both.where(~F.col("old_line").eqNullSafe(F.col("new_line"))).select("path", (F.col("line_no") + 1).cast("long").alias("line_no"), "old_line", "new_line")
