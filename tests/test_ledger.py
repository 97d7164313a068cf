"""The ledger in buckets: runs append, later entries win, and joins do not move it."""

import re

from pyspark.sql import functions as F

from linewright.operators import reuse, scan

FOUND = "source STRING, category STRING, severity STRING, message STRING, line_start INT, line_end INT, rule_id STRING, ord BIGINT"
FILES = "review_id long, file_id long, filename string, content string"


def hashed(spark, contents):
    rows = [(1, n, f"f{n}.py", c) for n, c in enumerate(contents)]
    return spark.createDataFrame(rows, FILES).withColumn("content_hash", F.sha2("content", 256))


def entries(files, seq):
    keys = [F.col("content_hash"), F.lit(reuse.rule_version()).alias("rule_version"), F.lit(seq).cast("long").alias("seq")]
    found = scan.scan(files).join(files.select("file_id", "content_hash"), "file_id")
    return files.select(*keys).distinct(), found.select(*keys, *reuse._FOUND)


def test_runs_append_and_the_last_entry_counts(spark, tmp_path):
    contents = ["r = eval(x)", "k = 1", "r = eval(x)\nr = eval(y)", "new = eval(z)"]
    files = hashed(spark, contents)
    ledger = reuse.HashLedger(spark, "ledger_test_a", f"file://{tmp_path}/l", FOUND, buckets=4)
    ledger.append(*entries(files.where("file_id < 2"), 1))
    ledger.append(*entries(files.where("file_id = 2"), 2))
    # The first content once more, this time without findings.
    heads, _ = entries(files.where("file_id = 0"), 3)
    ledger.append(heads, ledger.findings().limit(0))
    got = reuse.incremental_scan(files, ledger.heads(), ledger.findings())
    told = sorted((r.file_id, r.line_start, r.cached) for r in got.where("rule_id LIKE '%eval%'").collect())
    assert told == [(2, 1, True), (2, 2, True), (3, 1, False)]
    first, third = (files.where(f"file_id = {n}").first().content_hash for n in (0, 2))
    assert {(r.content_hash, r.line_start) for r in ledger.find([first, third]).collect()} == {(third, 1), (third, 2)}
    again = reuse.HashLedger(spark, "ledger_test_a", f"file://{tmp_path}/l", FOUND, buckets=4)
    assert again.heads().count() == 4


def test_the_ledger_is_read_where_it_lies(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = hashed(spark, [f"r = eval({n})" for n in range(50)])
        ledger = reuse.HashLedger(spark, "ledger_test_b", f"file://{tmp_path}/l", FOUND, buckets=8)
        ledger.append(*entries(files, 1))
        got = reuse.incremental_scan(files, ledger.heads(), ledger.findings()).where("cached")
        assert got.count() == 50
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The only exchange is that of the run's own hashes.
    assert "Bucketed: true" in plan and plan.count("SortMergeJoin") >= 2
    initial = plan[plan.index("== Initial Plan ==") :] if "== Initial Plan ==" in plan else plan
    assert len(re.findall(r"Exchange hashpartitioning\(content_hash", initial)) == 1
