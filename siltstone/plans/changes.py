"""Queries on what changed: diffs, ingests, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as t
from siltstone.operators import diff as d
from siltstone.operators import objects as o
from siltstone.sources.fixtures import Repo, cte


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All names of two snapshots, of every type, with their nodes."""
    r = Repo(spark, sf)
    return r.tree.where("snap_id = 1"), r.tree.where("snap_id = 2")


def diff(spark: SparkSession, sf: str) -> DataFrame:
    return d.diff(*_sides(spark, sf)).select("path", "change", "old_content_hash", "new_content_hash", "old_mode", "new_mode", "old_size", "new_size")


def diff_counts(spark: SparkSession, sf: str) -> DataFrame:
    return d.diff(*_sides(spark, sf)).groupBy("change").agg(F.count("*").alias("n"))


def diff_sorted(spark: SparkSession, sf: str) -> DataFrame:
    x = d.diff(*_sides(spark, sf)).withColumn("delta", d.size_delta()).withColumn("fields", F.when(F.col("change") == "m", d.meta_lines()).otherwise(""))
    return x.select("path", "change", "delta", "fields").orderBy(F.col("delta").desc(), "path")


def diff_lines(spark: SparkSession, sf: str) -> DataFrame:
    f = Repo(spark, sf).files.select("snap_id", F.concat_ws("/", "parent", "name").alias("path"), "text")
    both = f.where("snap_id = 1").join(f.where("snap_id = 2").select("path", F.col("text").alias("new")), "path").where("text <> new")
    return d.line_diff(both.select("path", "text"), both.select("path", F.col("new").alias("text")))


def backup_changes(spark: SparkSession, sf: str) -> DataFrame:
    return d.classify(*_sides(spark, sf))


def backup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return d.classify(*_sides(spark, sf)).groupBy("change").agg(F.count("*").alias("n"), F.sum(F.coalesce("new_size", F.lit(0))).alias("bytes"))


def deleted_paths(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _sides(spark, sf)
    return old.select("path", "size").join(new.select("path"), "path", "left_anti")


def scan_exclude(spark: SparkSession, sf: str) -> DataFrame:
    p = Repo(spark, sf).file_paths.where("snap_id = 2")
    return p.where(~(t.below(F.col("path"), "home/de") | t.below(F.col("path"), "home/en/src1"))).select("path", "size")


def scan_node_type(spark: SparkSession, sf: str) -> DataFrame:
    n = Repo(spark, sf).nodes
    kind = t.node_type(F.col("mode")).cast("long")
    return n.groupBy("snap_id", kind.alias("kind"), t.mode_string(kind, F.col("mode")).alias("shown")).agg(F.count("*").alias("n"))


def scan_union(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    a = r.file_paths.where("snap_id = 2").select(F.lit("files").alias("root"), "path", "size")
    return a.unionByName(r.incoming.select(F.lit("pages").alias("root"), "path", "size")).groupBy("root").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def hardlink_groups(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    linked = r.nodes.where("link_count > 1").select("snap_id", "node_id", "inode_identity")
    g = r.dirents.join(linked, ["snap_id", "node_id"]).groupBy("snap_id", "inode_identity")
    return g.agg(F.min("node_id").alias("primary_node"), F.count("*").alias("names"), F.min("name").alias("first_name"))


def store_new_objects(spark: SparkSession, sf: str) -> DataFrame:
    n = Repo(spark, sf).nodes
    new = n.where("snap_id = 2 AND content_hash IS NOT NULL").select(F.col("content_hash").alias("hash"), "size")
    return o.store(new, n.where("snap_id = 1 AND content_hash IS NOT NULL").select(F.col("content_hash").alias("hash")).distinct())


def phys_new_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return o.first_seen(Repo(spark, sf).nodes)


_BOTH = cte("tree") + """, o AS (SELECT * FROM tree WHERE snap_id = 1), n AS (SELECT * FROM tree WHERE snap_id = 2),
c AS (SELECT coalesce(o.path, n.path) AS path, o.content_hash AS old_content_hash, n.content_hash AS new_content_hash, o.mode AS old_mode, n.mode AS new_mode,
  o.size AS old_size, n.size AS new_size,
  CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' WHEN o.content_hash IS DISTINCT FROM n.content_hash THEN 'M'
    WHEN o.mode <> n.mode OR o.uid <> n.uid OR o.gid <> n.gid OR o.mtime_sec <> n.mtime_sec THEN 'm' ELSE '' END AS change,
  o.mtime_nsec IS DISTINCT FROM n.mtime_nsec OR o.xattr_hash IS DISTINCT FROM n.xattr_hash OR o.acl_hash IS DISTINCT FROM n.acl_hash AS more
  FROM o FULL JOIN n ON o.path = n.path)"""
_NAMES = "CASE change WHEN 'A' THEN 'new' WHEN 'D' THEN 'deleted' WHEN 'M' THEN 'modified' WHEN 'm' THEN 'metadata' ELSE CASE WHEN more THEN 'metadata' ELSE 'unchanged' END END"

PLANS = {
    "diff": (diff, f"{_BOTH} SELECT path, change, old_content_hash, new_content_hash, old_mode, new_mode, old_size, new_size FROM c WHERE change <> ''"),
    "diff_counts": (diff_counts, f"{_BOTH} SELECT change, count(*) AS n FROM c WHERE change <> '' GROUP BY change"),
    "diff_sorted": (diff_sorted, f"""{_BOTH} SELECT path, change, coalesce(new_size, 0) - coalesce(old_size, 0) AS delta,
      CASE WHEN change = 'm' THEN 'mode: ' || old_mode || ' -> ' || new_mode ELSE '' END AS fields FROM c WHERE change <> '' ORDER BY delta DESC, path"""),
    "diff_lines": (diff_lines, cte("files") + """, p AS (SELECT a.parent || '/' || a.name AS path, a.text AS x, b.text AS y FROM files a JOIN files b ON a.doc_id = b.doc_id AND a.snap_id = 1 AND b.snap_id = 2 WHERE a.text <> b.text),
      x AS (SELECT path, l, i FROM p, unnest(string_split(x, chr(10))) WITH ORDINALITY u(l, i)), y AS (SELECT path, l, i FROM p, unnest(string_split(y, chr(10))) WITH ORDINALITY u(l, i))
      SELECT coalesce(x.path, y.path) AS path, coalesce(x.i, y.i) AS line_no, x.l AS old_line, y.l AS new_line FROM x FULL JOIN y ON x.path = y.path AND x.i = y.i WHERE x.l IS DISTINCT FROM y.l"""),
    "backup_changes": (backup_changes, f"{_BOTH} SELECT path, {_NAMES} AS change, old_size, new_size FROM c"),
    "backup_counts": (backup_counts, f"{_BOTH} SELECT {_NAMES} AS change, count(*) AS n, CAST(sum(coalesce(new_size, 0)) AS BIGINT) AS bytes FROM c GROUP BY 1"),
    "deleted_paths": (deleted_paths, f"{_BOTH} SELECT path, old_size AS size FROM c WHERE change = 'D'"),
    "scan_exclude": (scan_exclude, cte("file_paths") + " SELECT path, size FROM file_paths WHERE snap_id = 2 AND NOT regexp_matches(path, '^home/(de|en/src1)(/|$)')"),
    "scan_node_type": (scan_node_type, cte("nodes") + """ SELECT snap_id, CASE mode & 61440 WHEN 16384 THEN 2 WHEN 40960 THEN 3 ELSE 1 END::BIGINT AS kind,
      CASE mode WHEN 33188 THEN '-rw-r--r--' WHEN 33184 THEN '-rw-r-----' WHEN 41471 THEN 'lrwxrwxrwx' WHEN 16832 THEN 'drwx------' ELSE 'drwxr-xr-x' END AS shown, count(*) AS n FROM nodes GROUP BY ALL"""),
    "scan_union": (scan_union, cte("file_paths", "incoming") + """ SELECT 'files' AS root, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM file_paths WHERE snap_id = 2
      UNION ALL SELECT 'pages', count(*), CAST(sum(size) AS BIGINT) FROM incoming"""),
    "hardlink_groups": (hardlink_groups, cte("nodes", "dirents") + """ SELECT d.snap_id, inode_identity, min(n.node_id) AS primary_node, count(*) AS names, min(name) AS first_name
      FROM dirents d JOIN nodes n ON n.snap_id = d.snap_id AND n.node_id = d.node_id WHERE link_count > 1 GROUP BY d.snap_id, inode_identity"""),
    "store_new_objects": (store_new_objects, cte("nodes") + """ SELECT content_hash AS hash, max(size) AS size FROM nodes WHERE snap_id = 2 AND content_hash IS NOT NULL
      AND content_hash NOT IN (SELECT content_hash FROM nodes WHERE snap_id = 1 AND content_hash IS NOT NULL) GROUP BY 1"""),
    "phys_new_bytes": (phys_new_bytes, cte("nodes") + """ SELECT snap_id, count(*) AS new_objects, CAST(sum(size) AS BIGINT) AS new_bytes FROM (
      SELECT content_hash, min(snap_id) AS snap_id, max(size) AS size FROM nodes WHERE content_hash IS NOT NULL GROUP BY 1) GROUP BY snap_id"""),
}
