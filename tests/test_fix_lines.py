"""What a fix check reads and keeps of lines."""

from linewright.operators import fixes, scan
from linewright.operators.groups import gather


def test_lines_without_brackets_tell_none(spark):
    files = spark.createDataFrame([(0, 1, "javascript", "a\nf(x)\n{\nplain")], "review_id long, file_id long, language string, content string")
    facts = fixes._line_facts(files, lambda line, *_: scan.rule_numbers(line))
    assert [(r.line_no, r.brackets) for r in facts.orderBy("line_no").collect()] == [(3, [0, 0, 1])]
    every = fixes._line_facts(files, lambda line, *_: fixes.F.array(fixes.F.lit(1)))
    assert [(r.line_no, r.brackets) for r in every.orderBy("line_no").collect()] == [
        (1, None), (2, [0, 0, 0]), (3, [0, 0, 1]), (4, None)]


def test_findings_are_made_once_for_both_ways(spark):
    files = spark.createDataFrame([(0, 1, "a.js", "javascript", "x = 1 // TODO: y\nr = eval(x)")],
                                  "review_id long, file_id long, filename string, language string, content string")
    found = scan.scan(files).withColumn("suggested_fix", fixes.F.when(fixes.F.col("ord") % 2 == 0, "b"))
    status = fixes.fix_status(found, files)
    assert status.count() == found.count() > 0
    # The plan reads the findings from where they were written; no line is tested in it again.
    assert "commented-out" not in status._jdf.queryExecution().optimizedPlan().toString()


def test_gathered_numbers_stay_on_all_partitions(spark):
    rows = gather(spark.range(1000).selectExpr("id % 100 AS k", "id"), ["k"], "id")
    used = rows.select(fixes.F.spark_partition_id().alias("p"), "k").distinct().collect()
    assert len({r.p for r in used}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(used) == 100
