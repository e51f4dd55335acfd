"""Every query of the engine by name, and the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import changes, content, history, layout, listing, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (changes, content, history, layout, listing, records):
    for name, (build, oracle) in module.PLANS.items():
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
