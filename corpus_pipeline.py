"""The corpus pipeline: documents in, token files out."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linewright.llm import stages  # noqa: E402
from linewright.session import fresh_path  # noqa: E402

STAGES = stages.STAGES

#: Language ID by compression, LSH and tokenization are not SQL; tests/llm compares the whole
#: run with a plain-Python model instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage on all that the one before it kept, written out in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
