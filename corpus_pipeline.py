"""A training corpus from raw documents: quality rules, near-dedup, redaction, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns
of ``documents``; the last returns pieces of packed sequences. Between stages documents are written as
Parquet to the folder that ``spark.checkpoint.dir`` names and read again, so a stage can be repeated alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import mixing, neardup, packing, pii, repetition
from siltstone.llm.common import stage

STAGES = [
    ("quality", repetition.filter_documents),
    ("neardup", neardup.keep_first),
    ("pii", pii.redact_documents),
    ("mixing", mixing.repeat_documents),
    ("packing", packing.pack_documents),
]

#: Token ids aren't to be had in SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
