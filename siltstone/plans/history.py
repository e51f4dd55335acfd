"""Queries on the history of snapshots: retention, headers, sizes, tags and notes beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import retention as g
from siltstone.sources.fixtures import Repo, cte

KEEP = g.Keep(snaps=5, daily=7, weekly=4, monthly=12, yearly=3)


def _elected(spark: SparkSession, sf: str) -> DataFrame:
    return g.elect(Repo(spark, sf).snapshots)


def _tier(tier: str):
    def build(spark: SparkSession, sf: str) -> DataFrame:
        return _elected(spark, sf).where(tier).select("snap_id", "created")

    return build


def gfs_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _elected(spark, sf).where("elected > 0").select("snap_id", "elected")


def gfs_label(spark: SparkSession, sf: str) -> DataFrame:
    return Repo(spark, sf).snapshots.select("snap_id", g.label(F.col("gfs_flags")).alias("label"))


def gfs_counts(spark: SparkSession, sf: str) -> DataFrame:
    has = {name: F.sum(F.when(F.col("gfs_flags").bitwiseAND(bit) != 0, 1).otherwise(0)).alias(name) for name, bit in g.TIERS}
    return Repo(spark, sf).snapshots.agg(*has.values(), F.sum(F.when(F.col("gfs_flags") == 0, 1).otherwise(0)).alias("untagged"), F.count("*").alias("snapshots"))


def gfs_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Flags that a run adds which looks at snapshots from the first closed, unflagged one on."""
    s = Repo(spark, sf).snapshots.withColumn("gfs_flags", F.when(F.year("created") < 2000, F.col("gfs_flags")).otherwise(0))
    e = g.elect(s)
    start = s.where("gfs_flags = 0").agg(F.to_date(F.min("created")).alias("start"))
    e = e.crossJoin(F.broadcast(start)).where(F.to_date("created") >= F.col("start"))  # one row
    return e.withColumn("flags", F.col("gfs_flags").bitwiseOR(F.col("elected"))).where("flags <> gfs_flags").select("snap_id", "gfs_flags", "flags")


def gfs_prune(spark: SparkSession, sf: str) -> DataFrame:
    s = _elected(spark, sf).select("snap_id", F.col("elected").alias("flags"), "preserved")
    kept = Repo(spark, sf).tags.where("preserve").select("snap_id").distinct().withColumn("_kept", F.lit(True))
    s = s.join(kept, "snap_id", "left").withColumn("preserved", F.col("preserved") | F.coalesce("_kept", F.lit(False))).drop("_kept")
    return g.prune(s, KEEP).select("snap_id", "flags", "tier", "rank", "pruned")


def head_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """For snapshots that tags name, the latest that is there at or below, if those of odd days are gone."""
    r = Repo(spark, sf)
    left = r.snapshots.where(F.dayofmonth("created") % 2 == 0).select("snap_id")
    asked = r.tags.select(F.col("snap_id").alias("asked")).distinct()
    # ids asked for and ids there, in one order: the last one there so far, slice by slice
    from pyspark.sql import Window

    both = left.select(F.col("snap_id").alias("at"), F.col("snap_id").alias("there"), F.lit(None).cast("long").alias("asked")).union(asked.select("asked", F.lit(None).cast("long"), "asked"))
    both = both.withColumn("slice", F.expr("at div 4096"))
    tops = both.groupBy("slice").agg(F.max("there").alias("top"))
    tops = tops.select("slice", F.max("top").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("below"))
    inner = F.max("there").over(Window.partitionBy("slice").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("own", inner).join(tops, "slice").where("asked IS NOT NULL").select("asked", F.coalesce("own", "below").alias("found"))


def snap_list(spark: SparkSession, sf: str) -> DataFrame:
    return Repo(spark, sf).snapshots.select("snap_id", "created", "logical_bytes", g.label(F.col("gfs_flags")).alias("label")).orderBy("snap_id")


def snap_full(spark: SparkSession, sf: str) -> DataFrame:
    return Repo(spark, sf).nodes.where("snap_id = 2").drop("snap_id")


def snap_header(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    n = r.nodes.groupBy("snap_id").agg(F.count("*").alias("node_count"), F.sum(F.when(F.col("type") == 1, F.col("size")).otherwise(0)).alias("logical_bytes"))
    return n.join(r.dirents.groupBy("snap_id").agg(F.count("*").alias("dirent_count")), "snap_id")


def snap_logical_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return Repo(spark, sf).nodes.where("type = 1").groupBy("snap_id").agg(F.sum("size").alias("logical_bytes"))


def recent_snaps(spark: SparkSession, sf: str) -> DataFrame:
    """The ten newest, as the overview shows them."""
    return Repo(spark, sf).snapshots.select("snap_id", "created").orderBy(F.col("created").desc(), F.col("snap_id").desc()).limit(10)


def list_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """All ids up to the newest, with those missing that were pruned: here every one divisible by 9."""
    s = Repo(spark, sf).snapshots.where("snap_id % 9 <> 0")
    # a row, from which the ids are made as the query runs
    ids = s.agg(F.max("snap_id").alias("head")).where("head >= 1").select(F.explode(F.sequence(F.lit(1).cast("long"), "head")).alias("snap_id"))
    return ids.join(s.select("snap_id", "created"), "snap_id", "left").withColumn("pruned", F.col("created").isNull())


def list_with_tags(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    names = r.tags.groupBy("snap_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("tags"))
    return r.snapshots.select("snap_id").join(names, "snap_id", "left").select("snap_id", F.coalesce("tags", F.lit("-")).alias("tags"))


def resolve_ref(spark: SparkSession, sf: str) -> DataFrame:
    """References by HEAD, number or tag, to the snapshots they mean; null for none."""
    r = Repo(spark, sf)
    asked = r.tags.select(F.explode(F.array("name", F.col("snap_id").cast("string"), F.concat(F.lit("no-"), "name"))).alias("ref")).union(spark.createDataFrame([("HEAD",), ("head",)], "ref string")).distinct()
    head = r.snapshots.agg(F.max("snap_id").alias("_head"))
    number = F.when(F.col("ref").rlike("^[0-9]+$"), F.col("ref").cast("long"))
    found = asked.join(r.tags.select(F.col("name").alias("ref"), F.col("snap_id").alias("_tag")), "ref", "left").crossJoin(F.broadcast(head))  # one row
    return found.select("ref", F.when(F.lower("ref") == "head", F.col("_head")).otherwise(F.coalesce(number, "_tag")).alias("snap_id"))


def stats(spark: SparkSession, sf: str) -> DataFrame:
    """One row over the whole repository."""
    r = Repo(spark, sf)
    s = r.snapshots.agg(F.count("*").alias("snapshots"), F.max("snap_id").alias("head"))
    size = F.col("compressed_size")
    o = r.objects.agg(F.sum(F.when(F.col("storage") == "loose", 1).otherwise(0)).alias("loose_objects"), F.sum(F.when(F.col("storage") == "loose", size).otherwise(0)).alias("loose_bytes"), F.sum(F.when(F.col("storage") == "pack", 1).otherwise(0)).alias("packed_objects"), F.sum(F.when(F.col("storage") == "pack", size).otherwise(0)).alias("packed_bytes"))
    n = r.nodes.where("snap_id = 2 AND type = 1").agg(F.sum("size").alias("head_logical_bytes"))
    return s.crossJoin(o).crossJoin(n).withColumn("total_bytes", F.col("loose_bytes") + F.col("packed_bytes"))  # a row each


def repo_scan(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    counts = [(r.snapshots, "snapshots"), (r.objects.where("storage = 'loose'"), "loose"), (r.objects.where("storage = 'pack'"), "packed"), (r.tags, "tags")]
    out = None
    for df, kind in counts:
        row = df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


def repo_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    notes = r.notes.where("trim(text) <> ''").agg(F.lit("notes").alias("kind"), F.count("*").alias("n"))
    orphans = r.journal.groupBy("op_id").agg(F.count("*").alias("n")).where("n = 1").agg(F.lit("unfinished").alias("kind"), F.count("*").alias("n"))
    tasks = r.tasks.agg(F.lit("tasks").alias("kind"), F.count("*").alias("n"))
    return repo_scan(spark, sf).union(notes).union(orphans).union(tasks)


_E = cte("snapshots") + """, t0 AS (SELECT *, CAST(created AS DATE) AS d, CAST((SELECT created FROM snapshots ORDER BY snap_id DESC LIMIT 1) AS DATE) AS today FROM snapshots),
t1 AS (SELECT *, d < today AND row_number() OVER (PARTITION BY d ORDER BY created DESC, snap_id DESC) = 1 AS daily FROM t0),
t2 AS (SELECT *, daily AND CAST(date_trunc('week', d) AS DATE) + 6 < today AND row_number() OVER (PARTITION BY daily, date_trunc('week', d) ORDER BY created DESC, snap_id DESC) = 1 AS weekly FROM t1),
t3 AS (SELECT *, weekly AND last_day(d) < today AND row_number() OVER (PARTITION BY weekly, last_day(d) ORDER BY created DESC, snap_id DESC) = 1 AS monthly FROM t2),
t4 AS (SELECT *, monthly AND make_date(year(d), 12, 31) < today AND row_number() OVER (PARTITION BY monthly, year(d) ORDER BY created DESC, snap_id DESC) = 1 AS yearly FROM t3),
e AS (SELECT *, CAST(daily AS BIGINT) + 2 * CAST(weekly AS BIGINT) + 4 * CAST(monthly AS BIGINT) + 8 * CAST(yearly AS BIGINT) AS elected FROM t4)"""
_LABEL = """CASE WHEN gfs_flags = 0 THEN 'none' ELSE array_to_string(list_filter([CASE WHEN gfs_flags & 1 > 0 THEN 'daily' END, CASE WHEN gfs_flags & 2 > 0 THEN 'weekly' END,
  CASE WHEN gfs_flags & 4 > 0 THEN 'monthly' END, CASE WHEN gfs_flags & 8 > 0 THEN 'yearly' END], lambda x: x IS NOT NULL), '+') END AS label"""
_SCAN = """SELECT 'snapshots' AS kind, count(*) AS n FROM snapshots UNION ALL SELECT 'loose', count(*) FROM objects WHERE storage = 'loose'
  UNION ALL SELECT 'packed', count(*) FROM objects WHERE storage = 'pack' UNION ALL SELECT 'tags', count(*) FROM tags"""

PLANS = {
    **{f"gfs_{t}": (_tier(t), f"{_E} SELECT snap_id, created FROM e WHERE {t}") for t, _ in g.TIERS},
    "gfs_flags": (gfs_flags, _E + " SELECT snap_id, elected FROM e WHERE elected > 0"),
    "gfs_label": (gfs_label, cte("snapshots") + f" SELECT snap_id, {_LABEL} FROM snapshots"),
    "gfs_counts": (gfs_counts, cte("snapshots") + """ SELECT count(*) FILTER (gfs_flags & 1 > 0) AS daily, count(*) FILTER (gfs_flags & 2 > 0) AS weekly, count(*) FILTER (gfs_flags & 4 > 0) AS monthly,
      count(*) FILTER (gfs_flags & 8 > 0) AS yearly, count(*) FILTER (gfs_flags = 0) AS untagged, count(*) AS snapshots FROM snapshots"""),
    "gfs_incremental": (gfs_incremental, _E + """, i AS (SELECT *, CASE WHEN year(created) < 2000 THEN gfs_flags ELSE 0 END AS old FROM e)
      SELECT snap_id, old AS gfs_flags, old | elected AS flags FROM i WHERE CAST(created AS DATE) >= (SELECT CAST(min(created) AS DATE) FROM i WHERE old = 0) AND old | elected <> old"""),
    "gfs_prune": (gfs_prune, _E.replace("WITH RECURSIVE ", cte("tags") + ", ", 1) + f""", p AS (SELECT snap_id, elected AS flags, CASE WHEN yearly THEN 8 WHEN monthly THEN 4 WHEN weekly THEN 2 WHEN daily THEN 1 ELSE 0 END::BIGINT AS tier,
      preserved OR snap_id IN (SELECT snap_id FROM tags WHERE preserve) AS pres, max(snap_id) OVER () AS head FROM e),
      q AS (SELECT *, CASE WHEN tier > 0 THEN row_number() OVER (PARTITION BY tier ORDER BY snap_id DESC) - 1 END AS rank FROM p)
      SELECT snap_id, flags, tier, rank, snap_id <> head AND NOT (tier > 0 AND rank < CASE tier WHEN 8 THEN {KEEP.yearly} WHEN 4 THEN {KEEP.monthly} WHEN 2 THEN {KEEP.weekly} ELSE {KEEP.daily} END)
      AND snap_id < greatest(head - {KEEP.snaps - 1}, 1) AND NOT pres AS pruned FROM q"""),
    "head_fallback": (head_fallback, cte("snapshots", "tags") + """, s AS (SELECT snap_id FROM snapshots WHERE day(created) % 2 = 0), a AS (SELECT DISTINCT snap_id AS asked FROM tags)
      SELECT asked, s.snap_id AS found FROM a ASOF LEFT JOIN s ON a.asked >= s.snap_id"""),
    "snap_list": (snap_list, cte("snapshots") + f" SELECT snap_id, created, logical_bytes, {_LABEL} FROM snapshots ORDER BY snap_id"),
    "snap_full": (snap_full, cte("nodes") + " SELECT * EXCLUDE (snap_id) FROM nodes WHERE snap_id = 2"),
    "snap_header": (snap_header, cte("nodes", "dirents") + """ SELECT snap_id, count(*) AS node_count, CAST(sum(CASE WHEN type = 1 THEN size ELSE 0 END) AS BIGINT) AS logical_bytes,
      (SELECT count(*) FROM dirents d WHERE d.snap_id = n.snap_id) AS dirent_count FROM nodes n GROUP BY snap_id"""),
    "snap_logical_bytes": (snap_logical_bytes, cte("nodes") + " SELECT snap_id, CAST(sum(size) AS BIGINT) AS logical_bytes FROM nodes WHERE type = 1 GROUP BY snap_id"),
    "recent_snaps": (recent_snaps, cte("snapshots") + " SELECT snap_id, created FROM snapshots ORDER BY created DESC, snap_id DESC LIMIT 10"),
    "list_with_gaps": (list_with_gaps, cte("snapshots") + """, s AS (SELECT * FROM snapshots WHERE snap_id % 9 <> 0) SELECT i AS snap_id, created, created IS NULL AS pruned
      FROM range(1, (SELECT max(snap_id) FROM s) + 1) r(i) LEFT JOIN s ON s.snap_id = i"""),
    "list_with_tags": (list_with_tags, cte("snapshots", "tags") + " SELECT s.snap_id, coalesce(string_agg(name, ',' ORDER BY name), '-') AS tags FROM snapshots s LEFT JOIN tags t ON t.snap_id = s.snap_id GROUP BY s.snap_id"),
    "resolve_ref": (resolve_ref, cte("snapshots", "tags") + """, a AS (SELECT name AS ref FROM tags UNION SELECT CAST(snap_id AS VARCHAR) FROM tags UNION SELECT 'no-' || name FROM tags UNION SELECT 'HEAD' UNION SELECT 'head')
      SELECT ref, CASE WHEN lower(ref) = 'head' THEN (SELECT max(snap_id) FROM snapshots) WHEN regexp_full_match(ref, '[0-9]+') THEN CAST(ref AS BIGINT) ELSE (SELECT max(snap_id) FROM tags WHERE name = ref) END AS snap_id FROM a"""),
    "stats": (stats, cte("snapshots", "objects", "nodes") + """ SELECT (SELECT count(*) FROM snapshots) AS snapshots, (SELECT max(snap_id) FROM snapshots) AS head, count(*) FILTER (storage = 'loose') AS loose_objects,
      CAST(coalesce(sum(compressed_size) FILTER (storage = 'loose'), 0) AS BIGINT) AS loose_bytes, count(*) FILTER (storage = 'pack') AS packed_objects, CAST(coalesce(sum(compressed_size) FILTER (storage = 'pack'), 0) AS BIGINT) AS packed_bytes,
      (SELECT CAST(sum(size) AS BIGINT) FROM nodes WHERE snap_id = 2 AND type = 1) AS head_logical_bytes, CAST(sum(compressed_size) AS BIGINT) AS total_bytes FROM objects"""),
    "repo_scan": (repo_scan, cte("snapshots", "objects", "tags") + " " + _SCAN),
    "repo_summary": (repo_summary, cte("snapshots", "objects", "tags", "notes", "journal", "tasks") + f""" {_SCAN} UNION ALL SELECT 'notes', count(*) FROM notes WHERE trim(text) <> ''
      UNION ALL SELECT 'unfinished', count(*) FROM (SELECT op_id FROM journal GROUP BY op_id HAVING count(*) = 1) UNION ALL SELECT 'tasks', count(*) FROM tasks"""),
}
