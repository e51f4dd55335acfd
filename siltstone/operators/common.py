"""Prefix sums that no single task makes, and lineage that ends in the shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read from there: a lost executor costs nothing of it.

    Without that setting a folder of this machine is taken, and only where all of Spark runs on it.
    """
    context = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltstone-"))
    return df.checkpoint()


def sums_before(df: DataFrame, slice_: F.Column, order: Sequence[str], values: dict[str, str | None]) -> DataFrame:
    """``df`` with, for each column named in ``values``, the sum of its value (None: 1) over all rows before.

    ``slice_`` must not decrease along ``order``; its values, a few hundred or thousand, are what is summed
    in one place. Rows are ranked within their slice.
    """
    one = {out: F.lit(1).cast("long") if v is None else F.col(v).cast("long") for out, v in values.items()}
    df = df.withColumn("_slice", slice_)
    totals = df.groupBy("_slice").agg(*[F.sum(v).alias(f"_t_{out}") for out, v in one.items()])
    over = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_slice", *[F.coalesce(F.sum(f"_t_{out}").over(over), F.lit(0)).alias(f"_t_{out}") for out in one])
    inner = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for out, v in one.items():
        df = df.withColumn(f"_o_{out}", F.coalesce(F.sum(v).over(inner), F.lit(0)))
    df = df.join(totals, "_slice")
    for out in one:
        df = df.withColumn(out, (F.col(f"_o_{out}") + F.col(f"_t_{out}")).cast("long"))
    return df.drop("_slice", *[f"_{k}_{out}" for k in "ot" for out in one])
