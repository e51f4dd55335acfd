"""The operation journal: filters and pages, operations put together, those that never ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query(journal: DataFrame, operation: str | None = None, result: str | None = None, state: str | None = None, since: str | None = None) -> DataFrame:
    """Entries that meet all conditions given; ``since`` compares ISO timestamps as text."""
    for column, value in (("operation", operation), ("result", result), ("state", state)):
        if value:
            journal = journal.where(F.col(column) == value)
    return journal.where(F.col("timestamp") >= since) if since else journal


def page(df: DataFrame, offset: int, limit: int, *order: F.Column) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in an order: a top-k, of which no task keeps more than that."""
    return df.orderBy(*order).offset(offset).limit(limit)


def orphans(journal: DataFrame) -> DataFrame:
    """Operations that were started and never completed."""
    done = journal.where("state = 'completed'").select("op_id")
    return journal.where("state = 'started'").join(done, "op_id", "left_anti")


def operations(journal: DataFrame) -> DataFrame:
    """One row per operation, of its start and its end, whichever there are."""
    started = F.when(F.col("state") == "started", F.col("ts"))
    g = journal.groupBy("op_id").agg(F.min(started).alias("started"), F.max(F.when(F.col("state") == "completed", F.col("ts"))).alias("completed"), F.max("operation").alias("operation"), F.max("result").alias("result"), F.max("duration_ms").alias("duration_ms"))
    return g.withColumn("running", F.col("completed").isNull())
