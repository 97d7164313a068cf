"""Queries on merging findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.operators import merging, scan
from linewright.plans.ingest_queries import SNIPPET
from linewright.plans.registry import over, query, sql_case
from linewright.plans.scan_queries import SCAN_STEPS
from linewright.sources.corpus import view

_FIELDS = (
    "review_id, file_id, filename, source, category, severity, message, line_start, line_end, "
    "rule_id, suggested_fix, confidence, ord"
)


def severity_rank(column: str) -> str:
    return f"coalesce({sql_case(fv.SEVERITY_RANK, column)}, 0)"


def source_rank(column: str) -> str:
    return f"coalesce({sql_case(fv.SOURCE_RANK, column)}, 0)"


_PARTS = "pattern", "eslint", "llm"


@query(
    "union_findings",
    over("findings", f"""SELECT review_id, file_id, source, message, rule_id, confidence,
         (CASE source WHEN 'pattern' THEN 0 WHEN 'eslint' THEN 1 ELSE 2 END) * 281474976710656 + ord AS ord
         FROM findings"""),
)
def union_findings(spark, sf_dir):
    findings = view(spark, sf_dir, "findings").select(
        "review_id", "file_id", "source", "message", "rule_id", "confidence", "ord"
    )
    pattern, eslint, llm = (findings.where(F.col("source") == part) for part in _PARTS)
    return merging.union_findings(pattern.drop("confidence"), eslint.drop("confidence"), llm.drop("rule_id"))


@query(
    "cross_source_agreement",
    over("findings", """SELECT ord, EXISTS (SELECT 1 FROM findings g WHERE g.review_id = f.review_id
         AND g.file_id = f.file_id AND g.source <> f.source AND abs(g.line_start - f.line_start) <= 3)
         AS confirmed FROM findings f"""),
)
def cross_source_agreement(spark, sf_dir):
    findings = view(spark, sf_dir, "findings")
    return merging.cross_source_agreement(findings).select("ord", "confirmed")


def _pairs(spark, sf_dir):
    """Findings 2k and 2k+1 side by side."""
    findings = view(spark, sf_dir, "findings")
    whole = F.struct(*findings.columns)
    return findings.groupBy(F.floor(F.col("ord") / 2).alias("pair")).agg(
        F.max(F.when(F.col("ord") % 2 == 0, whole)).alias("a"),
        F.max(F.when(F.col("ord") % 2 == 1, whole)).alias("b"),
    ).where("a IS NOT NULL AND b IS NOT NULL")


_PAIRS = "FROM findings a JOIN findings b ON a.ord % 2 = 0 AND b.ord = a.ord + 1"
_HIGHER = (
    f"CASE WHEN {severity_rank('a.severity')} >= {severity_rank('b.severity')} THEN a.severity ELSE b.severity END"
)
_BOOSTED = f"CASE WHEN {_HIGHER} = 'warning' THEN 'critical' ELSE {_HIGHER} END"


@query(
    "severity_boost",
    over("findings", f"SELECT CAST(a.ord // 2 AS BIGINT) AS pair, {_BOOSTED} AS severity {_PAIRS}"),
)
def severity_boost(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "pair", merging.merged_severity(F.col("a.severity"), F.col("b.severity")).alias("severity")
    )


@query(
    "merge_pairs",
    over("findings", f"""SELECT CAST(a.ord // 2 AS BIGINT) AS pair, 'merged' AS source, {_BOOSTED} AS severity,
         if(p, a.category, b.category) AS category, if(p, a.message, b.message) AS message,
         if(p, a.line_start, b.line_start) AS line_start, if(p, a.line_end, b.line_end) AS line_end,
         coalesce(nullif(a.rule_id, ''), b.rule_id) AS rule_id,
         if(p, coalesce(a.suggested_fix, b.suggested_fix), coalesce(b.suggested_fix, a.suggested_fix)) AS suggested_fix,
         if(p, coalesce(a.confidence, b.confidence), coalesce(b.confidence, a.confidence)) AS confidence,
         if(p, a.filename, b.filename) AS filename
         FROM (SELECT *, {source_rank('source')} AS r FROM findings) a
         JOIN (SELECT *, {source_rank('source')} AS r FROM findings) b ON a.ord % 2 = 0 AND b.ord = a.ord + 1,
         LATERAL (SELECT a.r >= b.r AS p)"""),
)
def merge_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair", *merging.merge_pair("a", "b"))


# The loop of one file as a recursion over its positions, all files side by side.
GREEDY_STEPS = (
    """base AS (SELECT review_id, file_id, list(ord ORDER BY ord) AS o, list(line_start ORDER BY ord) AS l,
        list(source ORDER BY ord) AS s FROM findings GROUP BY review_id, file_id)""",
    f"""walk AS (
      SELECT review_id, file_id, 1 AS i, o, l, s, [0 for x in o] AS owner, [0 for x in o] AS lead FROM base
      UNION ALL
      SELECT review_id, file_id, i + 1, o, l, s,
        CASE WHEN owner[i] <> 0 THEN owner WHEN j IS NULL
             THEN list_transform(owner, lambda x, k: CASE WHEN k = i THEN i ELSE x END)
             ELSE list_transform(owner, lambda x, k: CASE WHEN k = i THEN i WHEN k >= j AND x = 0 AND s[k] <> s[i]
                  AND abs(l[k] - l[m]) <= 3 THEN i ELSE x END) END,
        CASE WHEN owner[i] <> 0 THEN lead WHEN j IS NULL
             THEN list_transform(lead, lambda x, k: CASE WHEN k = i THEN i ELSE x END)
             ELSE list_transform(lead, lambda x, k: CASE WHEN k = i THEN m WHEN k >= j AND owner[k] = 0 AND s[k] <> s[i]
                  AND abs(l[k] - l[m]) <= 3 THEN m ELSE x END) END
      FROM (SELECT *, CASE WHEN j IS NOT NULL AND {source_rank('s[i]')} >= {source_rank('s[j]')} THEN i ELSE j END AS m
            FROM (SELECT *, list_min(list_filter(range(i + 1, len(o) + 1), lambda x: owner[x] = 0 AND s[x] <> s[i]
                         AND abs(l[x] - l[i]) <= 3)) AS j
                  FROM walk WHERE i <= len(o))))""",
    """owned AS (SELECT review_id, file_id, o[k] AS ord, o[owner[k]] AS own, o[lead[k]] AS main
        FROM (SELECT *, unnest(range(1, len(o) + 1)) AS k FROM walk WHERE i = len(o) + 1))""",
    """merged AS (SELECT f.review_id, f.file_id, w.own AS ord, CAST(count(*) AS BIGINT) AS members,
        arg_min(filename, (f.ord <> main, f.ord)) AS filename,
        CASE WHEN count(*) = 1 THEN any_value(source) ELSE 'merged' END AS source,
        arg_min(category, (f.ord <> main, f.ord)) AS category,
        CASE WHEN count(*) = 1 THEN any_value(severity) WHEN bool_or(severity <> 'info') THEN 'critical'
             ELSE 'info' END AS severity,
        arg_min(message, (f.ord <> main, f.ord)) AS message,
        arg_min(line_start, (f.ord <> main, f.ord)) AS line_start,
        arg_min(line_end, (f.ord <> main, f.ord)) AS line_end,
        arg_min(rule_id, f.ord) FILTER (rule_id <> '') AS rule_id,
        arg_min(suggested_fix, (f.ord <> main, f.ord)) FILTER (suggested_fix <> '') AS suggested_fix,
        arg_min(confidence, (f.ord <> main, f.ord)) FILTER (confidence IS NOT NULL) AS confidence
        FROM findings f JOIN owned w USING (review_id, file_id, ord) GROUP BY f.review_id, f.file_id, w.own)""",
)


@query("merge_findings", over("findings", f"SELECT {_FIELDS}, members FROM merged", *GREEDY_STEPS, recursive=True))
def merge_findings(spark, sf_dir):
    return merging.merge_findings(view(spark, sf_dir, "findings"))


@query(
    "merge_findings_large",
    over("findings", f"SELECT {_FIELDS}, members FROM merged", *GREEDY_STEPS, recursive=True),
)
def merge_findings_large(spark, sf_dir):
    """The merge once more: one form serves files with any number of findings."""
    return merging.merge_findings(view(spark, sf_dir, "findings"))


@query(
    "snippets",
    over("files", f"""SELECT file_id, CAST(line_no AS INT) AS line_start, rule_id,
         {SNIPPET.format('line_no', 'line_no')} AS code_snippet
         FROM hits JOIN catalogue USING (rule_ord) JOIN files USING (file_id)""", *SCAN_STEPS),
)
def snippets(spark, sf_dir):
    files = view(spark, sf_dir, "files")
    findings = scan.scan(files)
    return merging.attach_snippets(findings, files).select(
        "file_id", "line_start", "rule_id", "code_snippet"
    )


@query(
    "ordered_findings",
    over("findings", f"""SELECT review_id, ord, severity, line_start, row_number() OVER (PARTITION BY review_id
         ORDER BY {severity_rank('severity')} DESC, line_start, ord) AS position FROM findings"""),
)
def ordered_findings(spark, sf_dir):
    findings = view(spark, sf_dir, "findings")
    return merging.order_findings(merging.finding_positions(findings)).select(
        "review_id", "ord", "severity", "line_start", "position"
    )
