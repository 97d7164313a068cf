"""Reviews are whole or they fail: a detector that fails is never left out of one."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from linewright.operators import lint, plugins, review, scan
from linewright.plans import review_queries  # noqa: F401
from linewright.plans.registry import QUERIES
from linewright.sources import ingest

CANNED = (
    "filename string, category string, severity string, message string, line_start int, line_end int, "
    "suggested_fix string, confidence double, position long"
)


def _unplanned(_):
    raise ValueError("out of order")


def _failing(files):
    return scan.scan(files).withColumn("message", F.raise_error(F.lit("out of order")).cast("string"))


@pytest.mark.parametrize("call, cause", [(_unplanned, ValueError), (_failing, PySparkException)])
def test_a_failing_detector_fails_the_review(spark, call, cause):
    rows = [(1, 1, "a.ts", "eval(x)\nconsole.log(1)"), (1, 2, "b.py", "eval(x)")]
    files = ingest.prepare(spark.createDataFrame(rows, "review_id long, file_id long, filename string, content string"))
    registry = plugins.default_registry().register(plugins.Analyzer("odd", call))
    with pytest.raises(RuntimeError, match="analyzer odd failed") as caught:
        review.run_review(files, spark.createDataFrame([], CANNED), registry)
    assert isinstance(caught.value.__cause__, cause)


@pytest.mark.parametrize("name, call", [("review_findings", _failing), ("review_pipeline", _unplanned)])
def test_the_queries_give_no_part_of_a_review(spark, tmp_path, monkeypatch, name, call):
    documents = spark.createDataFrame([(n, f"line one\nline {n}") for n in range(1, 25)], "doc_id long, text string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(lint, "span_findings", call)
    with pytest.raises(RuntimeError, match="analyzer eslint-spans failed"):
        QUERIES[name](spark, str(tmp_path))
