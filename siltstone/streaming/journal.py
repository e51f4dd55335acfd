"""The journal as a stream (an extension): operations that end in time, and those that don't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "op_id string, state string, timestamp string, operation string, source string, result string, duration_ms long, error string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Entries as they come, with their time as ``ts``."""
    return spark.readStream.schema(SCHEMA).json(folder).withColumn("ts", F.to_timestamp("timestamp"))


def rates(entries: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Completed operations per window and result; entries later than ``late`` are left out."""
    done = entries.where("state = 'completed'").withWatermark("ts", late)
    return done.groupBy(F.window("ts", window), "result").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"))


def finished(entries: DataFrame, within: str = "1 hour") -> DataFrame:
    """Starts joined with their ends; a start without an end in time comes with nulls, and its state is dropped."""
    started = entries.where("state = 'started'").select("op_id", "operation", F.col("ts").alias("began")).withWatermark("began", within)
    ended = entries.where("state = 'completed'").select(F.col("op_id").alias("end_id"), "result", F.col("ts").alias("ended")).withWatermark("ended", within)
    return started.join(ended, F.expr(f"op_id = end_id AND ended >= began AND ended <= began + INTERVAL {within}"), "leftOuter").drop("end_id")
