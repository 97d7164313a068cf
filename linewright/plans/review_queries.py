"""The review pipeline as a whole, on sources whose contents are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.operators import lint, review
from linewright.operators.merging import TURN as _TURN
from linewright.plans.fix_queries import PATTERN_STEPS, SYNTAX, lint_fix_hits, script_import
from linewright.plans.ingest_queries import LOC, SNIPPET
from linewright.plans.merge_queries import GREEDY_STEPS
from linewright.plans.registry import over, query, sql_text
from linewright.plans.scan_queries import HEALTH, SCAN_STEPS, SCORE, lines_step
from linewright.plans.structure_queries import LINT_STEPS, LINTED, SOURCE
from linewright.sources import ingest
from linewright.sources.code_corpus import expected_step
from linewright.sources.corpus import view

_MODEL = ("logic", "warning", "Check this.", 2, 3)
#: What the model suggests, in turn: fixes that change nothing else, that break brackets, bring a secret,
#: import a module twice or move what lies behind, and none.
_FIXES = (
    None, "const one = 1\nconst two = 2", "if (a) {", 'password = "hunter2hunter2"',
    'import y from "./again"\nimport z from "./again"', "const one = 1", "const one = 1\nconst two = 2\nconst three = 3",
)


def _canned(spark, sf_dir):
    """What a model said about every third file, by file name."""
    kind, grade, message, first, last = _MODEL
    named = view(spark, sf_dir, "source_files").where("file_id % 3 = 0")
    fixes = F.array(*[F.lit(f).cast("string") for f in _FIXES])
    return named.select(
        "filename", F.lit(kind).alias("category"), F.lit(grade).alias("severity"), F.lit(message).alias("message"),
        F.lit(first).alias("line_start"), F.lit(last).alias("line_end"),
        F.element_at(fixes, (F.floor(F.col("file_id") / 3) % len(_FIXES) + 1).cast("int")).alias("suggested_fix"),
        F.lit(0.5).alias("confidence"), F.lit(0).alias("position"),
    )


_FIX_SQL = "CASE (file_id // 3) % {} {} END".format(
    len(_FIXES), " ".join(f"WHEN {i} THEN {sql_text(f)}" for i, f in enumerate(_FIXES) if f is not None)
)


def _span(rule: str, position: int, first: str, last: str, rows: str) -> str:
    level, message = lint.LINT_SPAN_RULES[rule]
    return (
        f"SELECT review_id, file_id, filename, 'eslint', {sql_text(lint.category(rule))}, {sql_text(lint.severity(level))}, "
        f"{sql_text(f'{rule}: {message}')}, {first}, {last}, {sql_text(rule)}, NULL::VARCHAR, NULL::DOUBLE, "
        f"CAST(2 * {_TURN} + {first} * 16 + {position} AS BIGINT) FROM {rows}"
    )


_STEPS = (
    SOURCE, lines_step("code"), *SCAN_STEPS[1:], *LINT_STEPS, expected_step("function"),
    expected_step("deep", "known_deep"), expected_step("import", "known_imports"),
    f"""findings(review_id, file_id, filename, source, category, severity, message, line_start, line_end, rule_id, suggested_fix, confidence, ord) AS (
      SELECT review_id, file_id, filename, 'pattern', category, severity, message, line_no, line_no, rule_id, NULL::VARCHAR, NULL::DOUBLE,
        CAST(line_no * 16 + rule_ord AS BIGINT) FROM hits JOIN catalogue USING (rule_ord)
      UNION ALL SELECT review_id, file_id, filename, 'eslint', category, severity, message, line_no, line_no, rule_id, NULL::VARCHAR, NULL::DOUBLE,
        CAST({_TURN} + line_no * 16 + n AS BIGINT) FROM lint_hits JOIN lint_rules USING (n)
      UNION ALL {_span("max-lines-per-function", 9, "a", "b", f"expected WHERE language IN {LINTED} AND b - a + 1 > 50")}
      UNION ALL {_span("complexity", 10, "a", "b", f"expected WHERE language IN {LINTED} AND complexity > 10")}
      UNION ALL {_span("max-depth", 11, "a", "a", f"known_deep WHERE language IN {LINTED}")}
      UNION ALL {_span("no-duplicate-imports", 8, "a", "a", f'''(SELECT *, row_number() OVER (PARTITION BY file_id, source ORDER BY a, part) AS nth
        FROM known_imports WHERE language IN {LINTED}) WHERE nth > 1''')}
      UNION ALL SELECT review_id, file_id, filename, 'llm', {sql_text(_MODEL[0])}, {sql_text(_MODEL[1])}, {sql_text(_MODEL[2])},
        {_MODEL[3]}, {_MODEL[4]}, NULL, {_FIX_SQL}, 0.5::DOUBLE, 3 * {_TURN} FROM code WHERE file_id % 3 = 0)""",
    *GREEDY_STEPS,
)
#: Each merged finding's fix, spliced into its file, and what the checks then find that was not there before.
_CHECKED = (
    """fixed AS (SELECT *, front + len(fs) - upto AS shift, array_to_string(list_concat(list_concat(ls[1:front], fs), ls[upto + 1:]), chr(10)) AS after
      FROM (SELECT *, least(greatest(0, line_start - 1), len(ls)) AS front, least(len(ls), line_end) AS upto, string_split(fix, chr(10)) AS fs
        FROM (SELECT m.review_id, m.file_id, m.ord, m.line_start, m.line_end, m.suggested_fix AS fix, c.language, c.content,
          string_split(c.content, chr(10)) AS ls FROM merged m JOIN code c USING (review_id, file_id)) WHERE fix <> ''))""",
    *PATTERN_STEPS,
    lint_fix_hits("lines", "lint_before"),
    lint_fix_hits("after_lines", "lint_after"),
    f"""import_before AS (SELECT file_id, a AS line_no FROM (
        SELECT *, row_number() OVER (PARTITION BY file_id, source ORDER BY a, part) AS nth FROM known_imports WHERE language IN {LINTED})
      WHERE nth > 1)""",
    f"""import_after AS (SELECT file_id, ord, line_no FROM (
        SELECT *, row_number() OVER (PARTITION BY file_id, ord, source ORDER BY line_no, part) AS nth FROM (
          SELECT f.file_id, f.ord, i.source, i.part, CASE WHEN i.a <= f.front THEN i.a ELSE i.a + f.shift END AS line_no
            FROM fixed f JOIN known_imports i USING (file_id) WHERE f.language IN {LINTED} AND (i.a <= f.front OR i.a > f.upto)
          UNION ALL SELECT file_id, ord, source, 0, line_no FROM (
            SELECT file_id, ord, front + k AS line_no, {script_import('fs[k]')} AS source FROM (
              SELECT *, unnest(range(1, len(fs) + 1)) AS k FROM fixed WHERE language IN {LINTED})) WHERE source IS NOT NULL))
      WHERE nth > 1)""",
    """lint_bad AS (SELECT DISTINCT ord, file_id FROM lint_after a WHERE NOT EXISTS (SELECT 1 FROM lint_before h
        WHERE h.file_id = a.file_id AND h.line_no = a.line_no AND h.n = a.n)
      UNION SELECT DISTINCT ord, file_id FROM import_after a WHERE NOT EXISTS (SELECT 1 FROM import_before h
        WHERE h.file_id = a.file_id AND h.line_no = a.line_no))""",
    f"""checked AS (SELECT file_id, ord, CASE WHEN {SYNTAX} OR EXISTS (SELECT 1 FROM pattern_bad b WHERE b.ord = f.ord AND b.file_id = f.file_id)
        OR EXISTS (SELECT 1 FROM lint_bad b WHERE b.ord = f.ord AND b.file_id = f.file_id) THEN 'unavailable' ELSE 'verified' END AS fix_status
      FROM fixed f)""",
)


def _run(spark, sf_dir):
    return review.run_review(ingest.prepare(view(spark, sf_dir, "source_files")), _canned(spark, sf_dir))


@query(
    "review_pipeline",
    over("source_files", f"""SELECT review_id, CAST(count(*) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS findings,
           CAST(sum(critical) AS BIGINT) AS critical, {SCORE.format(loc='loc', health='health')} AS project_score FROM (
           SELECT c.review_id, c.file_id, {LOC} AS loc, count(m.severity) AS n, count_if(m.severity = 'critical') AS critical,
             {HEALTH} AS health FROM code c LEFT JOIN merged m USING (review_id, file_id) GROUP BY c.review_id, c.file_id, c.content)
         GROUP BY review_id""", *_STEPS, recursive=True),
)
def review_pipeline(spark, sf_dir):
    """Flagship: detect, merge, check and score every file, then score the reviews."""
    return _run(spark, sf_dir).scores


@query(
    "review_findings",
    over("source_files", f"""SELECT m.review_id, m.file_id, m.source, m.severity, m.category, CAST(m.line_start AS INT) AS line_start,
           CAST(m.line_end AS INT) AS line_end, m.rule_id, coalesce(k.fix_status, 'unavailable') AS fix_status,
           {SNIPPET.format('m.line_start', 'm.line_end')} AS code_snippet
         FROM merged m JOIN code USING (review_id, file_id) LEFT JOIN checked k ON k.file_id = m.file_id AND k.ord = m.ord""",
         *_STEPS, *_CHECKED, recursive=True),
)
def review_findings(spark, sf_dir):
    return _run(spark, sf_dir).findings.select(
        "review_id", "file_id", "source", "severity", "category", "line_start", "line_end", "rule_id", "fix_status", "code_snippet"
    )
