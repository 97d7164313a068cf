"""Queries on the line scan and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import patterns, text
from linewright.operators import scan, scoring
from linewright.plans.ingest_queries import LANGUAGE, LOC
from linewright.plans.registry import over, query, sql_text
from linewright.sources import ingest
from linewright.sources.corpus import view


def rule_test(position: int, line: str) -> str:
    """DuckDB predicate of one rule; the look-ahead of one rule is written out."""
    name, pattern, ignore_case, *_ = fv.LINE_RULES[position]
    if name == "dangerous-deserialize":
        plain = r"\b(?:pickle\.loads?|unserialize|Marshal\.load|ObjectInputStream)\b"
        return (
            f"(regexp_matches({line}, {sql_text(plain)}) OR (regexp_matches({line}, "
            f"{sql_text(patterns.re2(r'\byaml\.load\s*\(\b'))}) AND NOT regexp_matches({line}, "
            f"{sql_text(patterns.re2(r'yaml\.load\s*\(.*Loader'))})))"
        )
    return f"regexp_matches({line}, {sql_text(patterns.re2(pattern, ignore_case))})"


def lines_step(files: str = "files", name: str = "lines") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (ls, content), ls[line_no] AS line FROM (
      SELECT *, unnest(range(1, len(ls) + 1)) AS line_no FROM (
        SELECT *, string_split(content, chr(10)) AS ls FROM {files} WHERE content <> '')))"""


def hits_step(lines: str = "lines", name: str = "hits", rules=None) -> str:
    keep = [i for i, r in enumerate(fv.LINE_RULES) if rules is None or r[0] in rules]
    tests = ", ".join(f"CASE WHEN {rule_test(i, 'line')} THEN {i} END" for i in keep)
    return f"""{name} AS (SELECT * EXCLUDE (line, found), CAST(unnest(found) AS INT) AS rule_ord FROM (
      SELECT *, list_filter([{tests}], lambda x: x IS NOT NULL) AS found FROM {lines}))"""


def catalogue_step() -> str:
    rows = ", ".join(
        f"({i}, {sql_text(r[0])}, {sql_text(r[3])}, {sql_text(r[4])}, {sql_text(r[5])})"
        for i, r in enumerate(fv.LINE_RULES)
    )
    return f"catalogue(rule_ord, rule_id, severity, category, message) AS (VALUES {rows})"


SCAN_STEPS = (lines_step(), hits_step(), catalogue_step())


@query(
    "explode_lines",
    over("files", "SELECT file_id, CAST(line_no AS INT) AS line_no, line FROM lines", lines_step()),
)
def explode_lines(spark, sf_dir):
    return scan.explode_lines(view(spark, sf_dir, "files"), "file_id")


@query(
    "pattern_scan",
    over("files", """SELECT review_id, file_id, filename, 'pattern' AS source, category, severity, message,
         CAST(line_no AS INT) AS line_start, CAST(line_no AS INT) AS line_end, rule_id,
         CAST(line_no * 16 + rule_ord AS BIGINT) AS ord
         FROM hits JOIN catalogue USING (rule_ord)""", *SCAN_STEPS),
)
def pattern_scan(spark, sf_dir):
    return scan.scan(view(spark, sf_dir, "files")).drop(
        "code_snippet", "suggested_fix", "fix_status", "confidence"
    )


@query(
    "rule_catalogue",
    over("files", """SELECT rule_ord, rule_id, severity, category, message, CAST(count(line_no) AS BIGINT) AS hits
         FROM catalogue LEFT JOIN hits USING (rule_ord) GROUP BY ALL""", *SCAN_STEPS),
)
def rule_catalogue(spark, sf_dir):
    """The catalogue with the number of lines each rule fires on in the whole corpus."""
    hits = scan.line_hits(view(spark, sf_dir, "files")).groupBy("rule_ord").agg(
        F.count(F.lit(1)).alias("hits")
    )
    rules = scan.catalogue(spark).join(hits, "rule_ord", "left")
    return rules.withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))


@query(
    "rule_counts",
    over("files", f"""SELECT rule_id, severity, category, {LANGUAGE} AS language, CAST(count(*) AS BIGINT) AS hits
         FROM hits JOIN catalogue USING (rule_ord) GROUP BY ALL""", *SCAN_STEPS),
)
def rule_counts(spark, sf_dir):
    return scan.rule_counts(scan.scan(view(spark, sf_dir, "files")))


HEALTH = """CAST(greatest(0, least(100, 100 - coalesce(sum(CASE severity WHEN 'critical' THEN 25
  WHEN 'warning' THEN 10 WHEN 'info' THEN 2 ELSE 0 END), 0))) AS INT)"""

SCORE = "CAST(CASE WHEN sum({loc}) = 0 THEN 100 ELSE floor(sum({health} * {loc}) / sum({loc}) + 0.5) END AS INT)"


@query(
    "project_audit",
    over("files", f"""SELECT review_id, CAST(count(*) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS findings,
         {SCORE.format(loc='loc', health='health')} AS project_score FROM health GROUP BY review_id""",
         *SCAN_STEPS,
         f"health AS (SELECT f.review_id, f.file_id, {LOC} AS loc, count(h.severity) AS n, {HEALTH} AS health "
         "FROM files f LEFT JOIN (SELECT file_id, severity FROM hits JOIN catalogue USING (rule_ord)) h "
         "USING (file_id) GROUP BY f.review_id, f.file_id, f.content)"),
)
def project_audit(spark, sf_dir):
    """Flagship: scan every file, score files, score projects.

    The lines of a file are tested and summed in the task that reads it, so the exchange
    on files carries one small row per file, and the one on reviews one row per task.
    """
    files = ingest.prepare(view(spark, sf_dir, "files"))
    lines = files.select(
        "review_id", "file_id", "lines_of_code",
        F.explode_outer(text.split_lines(F.col("content"))).alias("line"),
    )
    # One number per line: costs in the high half, hits in the low half, so that every
    # rule is tested once.
    marks = sum(
        (
            F.when(scan.rule_match(F.col("line"), rule[0]), F.lit((fv.HEALTH_COST[rule[3]] << 32) + 1))
            .otherwise(F.lit(0))
            for rule in fv.LINE_RULES
        ),
        F.lit(0),
    )
    per_file = lines.groupBy("review_id", "file_id", "lines_of_code").agg(F.sum(marks.cast("long")).alias("marks"))
    per_file = per_file.withColumn("n", F.col("marks").bitwiseAND(F.lit((1 << 32) - 1))).withColumn(
        "cost", F.shiftright("marks", 32)
    )
    scored = per_file.withColumn("health_score", scoring.health(F.col("cost")))
    loc = F.sum(F.col("lines_of_code").cast("long"))
    weighted = F.sum(F.col("health_score").cast("long") * F.col("lines_of_code"))
    return scored.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("n").alias("findings"),
        F.when(loc == 0, 100).otherwise(F.floor(weighted / loc + 0.5)).cast("int").alias("project_score"),
    )
