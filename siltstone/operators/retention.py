"""Calendar retention: daily, weekly, monthly and yearly snapshots, and what is pruned.

Each tier elects, among those of the tier below, the latest of each window that has closed before the day of
the newest snapshot. Windows are ranked by time, then by id. All times are the session's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The tiers' bits.
DAILY, WEEKLY, MONTHLY, YEARLY = 1, 2, 4, 8
TIERS = (("daily", DAILY), ("weekly", WEEKLY), ("monthly", MONTHLY), ("yearly", YEARLY))


@dataclass(frozen=True)
class Keep:
    """How many of each tier stay; 0 keeps all of it. ``snaps`` is the width of the window of newest ids."""

    snaps: int = 1
    daily: int = 0
    weekly: int = 0
    monthly: int = 0
    yearly: int = 0


def elect(snapshots: DataFrame) -> DataFrame:
    """``snapshots`` (snap_id, created, ...) with the boolean columns daily, weekly, monthly, yearly and ``elected``.

    A window function ranks a day's snapshots; the other tiers rank one snapshot a day at most, so no
    task holds more than a window of the calendar.
    """
    day = F.to_date("created")
    head = snapshots.select(F.max(F.struct("snap_id", day.alias("day")))["day"].alias("_today"))
    s = snapshots.crossJoin(F.broadcast(head)).withColumn("_day", day)  # one row
    ends = {"daily": F.col("_day"), "weekly": F.date_add(F.date_trunc("week", "_day").cast("date"), 6), "monthly": F.last_day("_day"), "yearly": F.make_date(F.year("_day"), F.lit(12), F.lit(31))}
    under = F.lit(True)
    for tier, end in ends.items():
        rank = F.row_number().over(Window.partitionBy(under, end).orderBy(F.col("created").desc(), F.col("snap_id").desc()))
        s = s.withColumn(tier, under & (end < F.col("_today")) & (rank == 1))
        under = F.col(tier)
    bits = F.lit(0)
    for tier, bit in TIERS:
        bits = bits + F.when(F.col(tier), bit).otherwise(0)
    return s.withColumn("elected", bits.cast("long")).drop("_day", "_today")


def label(flags: F.Column) -> F.Column:
    names = F.concat_ws("+", *[F.when(flags.bitwiseAND(bit) != 0, name) for name, bit in TIERS])
    return F.when(names == "", "none").otherwise(names)


def highest(flags: F.Column) -> F.Column:
    out = F.lit(0)
    for _, bit in TIERS:
        out = F.when(flags.bitwiseAND(bit) != 0, bit).otherwise(out)
    return out.cast("long")


def prune(snapshots: DataFrame, keep: Keep) -> DataFrame:
    """``snapshots`` (snap_id, flags, preserved) with tier, rank in it (from 0), and whether it goes.

    The newest stays, as do preserved ones, the newest ids, and those whose tier isn't full.
    """
    s = snapshots.withColumn("tier", highest(F.col("flags")))
    s = s.withColumn("rank", F.when(F.col("tier") > 0, F.row_number().over(Window.partitionBy("tier").orderBy(F.col("snap_id").desc())) - 1).cast("long"))
    limit = F.lit(0)
    for tier, bit in TIERS:
        limit = F.when(F.col("tier") == bit, getattr(keep, tier)).otherwise(limit)
    head = snapshots.agg(F.max("snap_id").alias("_head"))
    start = F.when(F.lit(keep.snaps) <= 0, 1).otherwise(F.greatest(F.col("_head") - (keep.snaps - 1), F.lit(1)))
    stays = (F.col("tier") > 0) & ((limit == 0) | (F.col("rank") < limit))
    goes = (F.col("snap_id") != F.col("_head")) & ~stays & (F.col("snap_id") < start) & ~F.col("preserved")
    return s.crossJoin(F.broadcast(head)).withColumn("pruned", goes).drop("_head")  # one row
