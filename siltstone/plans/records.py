"""Queries on records beside the snapshots: the journal, tasks, tags, notes, the policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import journal as j
from siltstone.sources.fixtures import Repo, cte
from siltstone.sources.policy import effective

SINCE = "2024-01-20T00:00:00.000Z"
TAG_NAME = "^[A-Za-z0-9._-]+$"
POLICY = 'keep_daily = 7\nkeep_weekly = "four"\nkeep_monthly = -1\nauto_gc = false\npaths = ["/home", "/etc"]\n'


def journal_query(spark: SparkSession, sf: str) -> DataFrame:
    """The newest hundred failures since a time: a page, as the interface gives it."""
    x = j.query(Repo(spark, sf).journal, result="failed", since=SINCE)
    return j.page(x.select("line_no", "op_id", "timestamp", "result", "duration_ms"), 0, 100, F.col("line_no").desc())


def journal_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return j.orphans(Repo(spark, sf).journal).select("op_id", "line_no", "timestamp", "operation", "source")


def journal_ops(spark: SparkSession, sf: str) -> DataFrame:
    return j.operations(Repo(spark, sf).journal)


def task_list(spark: SparkSession, sf: str) -> DataFrame:
    return Repo(spark, sf).tasks.orderBy(F.col("state") != "running", F.col("started").desc(), "task_id")


def task_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How many run, and how many failed in the last hour before the newest entry."""
    t = Repo(spark, sf).tasks
    now = t.agg(F.max(F.greatest("started", F.coalesce("ended", "started"))).alias("_now"))
    recent = (F.col("state") == "failed") & (F.col("ended") >= F.col("_now") - F.expr("INTERVAL 1 HOUR"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return t.crossJoin(F.broadcast(now)).agg(n(F.col("state") == "running").alias("running"), n(recent).alias("recent_failures"), F.count("*").alias("tasks"))  # one row


def tags_list(spark: SparkSession, sf: str) -> DataFrame:
    return Repo(spark, sf).tags.orderBy("name")


def tags_with_snap(spark: SparkSession, sf: str) -> DataFrame:
    r = Repo(spark, sf)
    return r.tags.join(r.snapshots.select("snap_id", "created", "logical_bytes"), "snap_id", "left")


def tag_valid(spark: SparkSession, sf: str) -> DataFrame:
    names = Repo(spark, sf).table("orders").select(F.col("o_orderpriority").alias("name")).union(Repo(spark, sf).tags.select("name")).distinct()
    return names.withColumn("valid", F.col("name").rlike(TAG_NAME))


def notes_list(spark: SparkSession, sf: str) -> DataFrame:
    return Repo(spark, sf).notes.where("trim(text) <> ''").select("snap_id", F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "").alias("text")).orderBy("snap_id")


def policy_effective(spark: SparkSession, sf: str) -> DataFrame:
    p = effective(POLICY)
    return spark.createDataFrame([(k, ",".join(v) if isinstance(v, list) else str(v).lower()) for k, v in p.items()], "key string, value string")


PLANS = {
    "journal_query": (journal_query, cte("journal") + f" SELECT line_no, op_id, timestamp, result, duration_ms FROM journal WHERE result = 'failed' AND timestamp >= '{SINCE}' ORDER BY line_no DESC LIMIT 100"),
    "journal_orphans": (journal_orphans, cte("journal") + " SELECT op_id, line_no, timestamp, operation, source FROM journal s WHERE state = 'started' AND NOT EXISTS (SELECT 1 FROM journal c WHERE c.state = 'completed' AND c.op_id = s.op_id)"),
    "journal_ops": (journal_ops, cte("journal") + """ SELECT op_id, min(ts) FILTER (state = 'started') AS started, max(ts) FILTER (state = 'completed') AS completed, max(operation) AS operation, max(result) AS result,
      max(duration_ms) AS duration_ms, count(*) FILTER (state = 'completed') = 0 AS running FROM journal GROUP BY op_id"""),
    "task_list": (task_list, cte("tasks") + " SELECT * FROM tasks ORDER BY state <> 'running', started DESC, task_id"),
    "task_summary": (task_summary, cte("tasks") + """ SELECT count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'failed' AND ended >= (SELECT max(greatest(started, coalesce(ended, started))) FROM tasks) - INTERVAL 1 HOUR) AS recent_failures,
      count(*) AS tasks FROM tasks"""),
    "tags_list": (tags_list, cte("tags") + " SELECT * FROM tags ORDER BY name"),
    "tags_with_snap": (tags_with_snap, cte("tags", "snapshots") + " SELECT t.*, created, logical_bytes FROM tags t LEFT JOIN snapshots s ON s.snap_id = t.snap_id"),
    "tag_valid": (tag_valid, cte("tags") + " SELECT name, regexp_full_match(name, '[A-Za-z0-9._-]+') AS valid FROM (SELECT o_orderpriority AS name FROM orders UNION SELECT name FROM tags)"),
    "notes_list": (notes_list, cte("notes") + " SELECT snap_id, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS text FROM notes WHERE trim(text) <> '' ORDER BY snap_id"),
    "policy_effective": (policy_effective, """SELECT * FROM (VALUES ('paths', '/home,/etc'), ('exclude', ''), ('keep_snaps', '1'), ('keep_daily', '7'), ('keep_weekly', '0'), ('keep_monthly', '0'), ('keep_yearly', '0'),
      ('auto_pack', 'true'), ('auto_gc', 'false'), ('auto_prune', 'true'), ('verify_after', 'false'), ('strict_meta', 'false')) p(key, value)"""),
}
