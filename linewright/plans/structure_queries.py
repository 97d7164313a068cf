"""Queries on lint rules and code structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import patterns, text
from linewright.operators import lint, structure
from linewright.plans.ingest_queries import LANGUAGE
from linewright.plans.registry import over, query, sql_list, sql_text
from linewright.plans.scan_queries import lines_step
from linewright.sources.code_corpus import expected_step
from linewright.sources.corpus import view

TYPED = f"code AS (SELECT *, {LANGUAGE} AS language FROM code_files)"
TYPED_FILES = f"code AS (SELECT *, {LANGUAGE} AS language FROM files)"
LINTED = sql_list(fv.LINT_LANGUAGES)


def code(spark, sf_dir, name="code_files"):
    return view(spark, sf_dir, name).withColumn("language", text.detect_language(F.col("filename")))


def _re(pattern: str) -> str:
    return sql_text(patterns.re2(pattern))


_BARE = (
    f"regexp_replace(regexp_replace(line, {sql_text(lint.STRIP_STRINGS)}, '\"\"', 'g'), "
    f"{_re(lint.STRIP_COMMENT)}, '')"
)


def lint_test(position: int, line: str = "line", bare: str = "bare") -> str:
    _, _, pattern, on_bare, typed_only, _ = lint.LINT_LINE_RULES[position]
    test = f"regexp_matches({bare if on_bare else line}, {_re(pattern)})"
    return f"({test} AND language <> 'javascript')" if typed_only else test


_LINT_TESTS = ", ".join(
    f"CASE WHEN {lint_test(i)} THEN {i} END" for i in range(len(lint.LINT_LINE_RULES))
)
LINT_STEPS = (
    f"""lint_hits AS (SELECT review_id, file_id, filename, line_no, unnest(list_filter([{_LINT_TESTS}],
        lambda x: x IS NOT NULL)) AS n FROM (SELECT *, {_BARE} AS bare FROM lines WHERE language IN {LINTED}))""",
    "lint_rules(n, rule_id, severity, category, message) AS (VALUES "
    + ", ".join(
        f"({i}, {sql_text(r[0])}, {sql_text(lint.severity(r[1]))}, {sql_text(lint.category(r[0]))}, "
        f"{sql_text(f'{r[0]}: {r[5]}')})"
        for i, r in enumerate(lint.LINT_LINE_RULES)
    )
    + ")",
)


@query(
    "lint_line_rules",
    over("code_files", """SELECT review_id, file_id, filename, 'eslint' AS source, category, severity, message,
         CAST(line_no AS INT) AS line_start, CAST(line_no AS INT) AS line_end, rule_id,
         CAST(line_no * 16 + n AS BIGINT) AS ord FROM lint_hits JOIN lint_rules USING (n)""",
         TYPED, lines_step("code"), *LINT_STEPS),
)
def lint_line_rules(spark, sf_dir):
    return lint.line_findings(code(spark, sf_dir))


# --- what the sources are known to hold ---------------------------------------------

SOURCE = f"code AS (SELECT *, {LANGUAGE} AS language FROM source_files)"


def sources(spark, sf_dir):
    return code(spark, sf_dir, "source_files")


def expected(kind: str, body: str) -> str:
    """Oracle text over the rows that the corpus is known to hold; no pattern takes part."""
    return over("source_files", body, SOURCE, expected_step(kind))


_FUNCTIONS = """SELECT review_id, file_id, filename, language, name, CAST(part AS INT) AS part, CAST(a AS INT) AS line_start,
  CAST(b AS INT) AS line_end{more} FROM expected"""


@query("extract_functions", expected("function", _FUNCTIONS.format(more="")))
def extract_functions(spark, sf_dir):
    return structure.functions(sources(spark, sf_dir)).drop("complexity", "params")


@query("function_complexity", expected("function", _FUNCTIONS.format(more=", CAST(complexity AS INT) AS complexity")))
def function_complexity(spark, sf_dir):
    return structure.functions(sources(spark, sf_dir)).drop("params")


@query(
    "file_complexity",
    expected("function", f"""SELECT review_id, file_id, filename, language,
         CASE WHEN language IN {sql_list(fv.PARSED_LANGUAGES)} THEN coalesce(nullif(n, 0), 1) END AS complexity
         FROM code LEFT JOIN (SELECT file_id, CAST(sum(complexity) AS BIGINT) AS n FROM expected
         GROUP BY file_id) USING (file_id)"""),
)
def file_complexity(spark, sf_dir):
    return structure.file_complexity(sources(spark, sf_dir))


@query(
    "extract_classes",
    expected("class", """SELECT review_id, file_id, filename, language, name, CAST(a AS INT) AS line_start,
         CAST(b AS INT) AS line_end, array_to_string(methods, ',') AS methods FROM expected"""),
)
def extract_classes(spark, sf_dir):
    found = structure.classes(sources(spark, sf_dir))
    return found.withColumn("methods", F.array_join("methods", ","))


@query(
    "extract_params",
    expected("function", """SELECT review_id, file_id, CAST(a AS INT) AS line_no, CAST(part AS INT) AS part, name AS function,
         CAST(unnest(range(0, len(params))) AS INT) AS position, unnest(params) AS param FROM expected"""),
)
def extract_params(spark, sf_dir):
    return structure.parameters(sources(spark, sf_dir))


# Headers of single lines, for the corpora whose imports stand one to a line.
IMPORT_HEADERS = {
    "script": r"^\s*import\b[^'\"]*['\"]([^'\"]+)['\"]",
    "python_from": r"^\s*from\s+([.\w]+)\s+import\b",
    "python_plain": r"^\s*import\s+(.+)$",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)",
    "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$",
    "rust": r"^\s*(?:pub\s+)?use\s+([^;]+);",
}


def _found(name: str, line: str = "line") -> str:
    pattern = _re(IMPORT_HEADERS[name])
    return f"CASE WHEN regexp_matches({line}, {pattern}) THEN regexp_extract({line}, {pattern}, 1) END"


def imports_step(files: str = "code", lines: str = "lines") -> str:
    script = sql_list(fv.SCRIPT_LANGUAGES)
    trim = f"regexp_replace(p, '^{patterns.SPACE}+|{patterns.SPACE}+$', '', 'g')"
    return f"""imports AS (SELECT *, CASE WHEN language IN {sql_list((*fv.SCRIPT_LANGUAGES, 'python'))} THEN starts_with(source, '.')
        WHEN language = 'go' THEN starts_with(source, '.') OR starts_with(source, '/')
        WHEN language = 'rust' THEN starts_with(source, 'self::') OR starts_with(source, 'super::') ELSE false END AS is_relative
      FROM (
        SELECT review_id, file_id, filename, language, line_no, unnest(range(0, len(ss))) AS part, unnest(ss) AS source FROM (
          SELECT *, list_filter(CASE WHEN language IN {script} THEN [{_found('script')}]
            WHEN language = 'python' THEN CASE WHEN {_found('python_from')} IS NOT NULL THEN [{_found('python_from')}]
              ELSE list_filter(list_transform(string_split({_found('python_plain')}, ','), lambda p: {trim}),
                lambda p: NOT contains(p, ' as ') AND p <> '') END
            WHEN language = 'java' THEN [{_found('java')}]
            WHEN language = 'go' AND contains(line, 'import') THEN [{_found('go')}]
            WHEN language = 'rust' THEN [{_found('rust')}] END, lambda x: x IS NOT NULL) AS ss FROM {lines})
        UNION ALL
        SELECT review_id, file_id, filename, language, first_line + k - 1, 0, {_found('go', 'bl[k]')} FROM (
          SELECT *, unnest(range(2, len(bl) + 1)) AS k FROM (
            SELECT *, string_split(block, chr(10)) AS bl,
              len(string_split(substr(content, 1, instr(content, block) - 1), chr(10))) AS first_line FROM (
              SELECT *, unnest(regexp_extract_all(content, '(?m)^[ \\t]*(import[ \\t]*\\([^)]*)\\)', 1)) AS block
              FROM {files} WHERE language = 'go'))) WHERE {_found('go', 'bl[k]')} IS NOT NULL))"""


@query(
    "extract_imports",
    expected("import", """SELECT review_id, file_id, filename, language, CAST(a AS INT) AS line_no,
         CAST(part AS INT) AS part, source, is_relative FROM expected"""),
)
def extract_imports(spark, sf_dir):
    return structure.imports(sources(spark, sf_dir))


def _export(name: str) -> str:
    pattern = _re(structure.EXPORT_HEADERS[name])
    return f"CASE WHEN regexp_matches(line, {pattern}) THEN regexp_extract(line, {pattern}, 1) END"


EXPORTS = f"""CASE WHEN language IN {sql_list(fv.SCRIPT_LANGUAGES)} THEN {_export('script')}
  WHEN language = 'python' THEN {_export('python')}
  WHEN language = 'java' THEN coalesce({_export('java_class')}, {_export('java_method')})
  WHEN language = 'go' THEN {_export('go')} END"""


@query(
    "extract_exports",
    over("code_files", f"""SELECT * FROM (SELECT review_id, file_id, filename, CAST(line_no AS INT) AS line_no,
         {EXPORTS} AS name FROM lines) WHERE name IS NOT NULL""", TYPED, lines_step("code")),
)
def extract_exports(spark, sf_dir):
    return structure.exports(code(spark, sf_dir))


def _count(column: str, char: str) -> str:
    return f"(length({column}) - length(replace({column}, '{char}', '')))"


IMBALANCE = " + ".join(
    f"abs({_count('{0}', a)} - {_count('{0}', b)})".replace("{0}", "{c}") for a, b in ("()", "[]")
) + " + abs((length({c}) - length(replace({c}, chr(123), ''))) - (length({c}) - length(replace({c}, chr(125), ''))))"


def imbalance(column: str) -> str:
    return "(" + IMBALANCE.replace("{c}", column) + ")"


@query(
    "bracket_imbalance",
    over("files", f"SELECT file_id, CAST({imbalance('content')} AS INT) AS imbalance FROM files"),
)
def bracket_imbalance(spark, sf_dir):
    files = view(spark, sf_dir, "files")
    return files.select("file_id", structure.bracket_imbalance(F.col("content")).cast("int").alias("imbalance"))


def _span_rule(rule: str, position: int, start: str, end: str) -> str:
    level, message = lint.LINT_SPAN_RULES[rule]
    return (
        f"SELECT review_id, file_id, filename, 'eslint' AS source, {sql_text(lint.category(rule))} AS category, "
        f"{sql_text(lint.severity(level))} AS severity, {sql_text(f'{rule}: {message}')} AS message, "
        f"CAST({start} AS INT) AS line_start, CAST({end} AS INT) AS line_end, {sql_text(rule)} AS rule_id, "
        f"CAST({start} * 16 + {position} AS BIGINT) AS ord"
    )


@query(
    "lint_duplicate_imports",
    over("code_files", _span_rule("no-duplicate-imports", 8, "line_no", "line_no")
         + f""" FROM (SELECT *, row_number() OVER (PARTITION BY file_id, source ORDER BY line_no) AS rn
           FROM imports WHERE language IN {LINTED}) WHERE rn > 1""",
         TYPED, lines_step("code"), imports_step()),
)
def lint_duplicate_imports(spark, sf_dir):
    return lint.duplicate_imports(structure.imports(code(spark, sf_dir)))


@query(
    "lint_long_functions",
    expected("function", _span_rule("max-lines-per-function", 9, "a", "b")
             + f" FROM expected WHERE language IN {LINTED} AND b - a + 1 > 50"),
)
def lint_long_functions(spark, sf_dir):
    return lint.long_functions(structure.functions(sources(spark, sf_dir)))


@query(
    "lint_complexity",
    expected("function", _span_rule("complexity", 10, "a", "b")
             + f" FROM expected WHERE language IN {LINTED} AND complexity > 10"),
)
def lint_complexity(spark, sf_dir):
    return lint.complex_functions(structure.functions(sources(spark, sf_dir)))


@query(
    "lint_max_depth",
    expected("deep", _span_rule("max-depth", 11, "a", "a") + f" FROM expected WHERE language IN {LINTED}"),
)
def lint_max_depth(spark, sf_dir):
    return lint.deep_blocks(sources(spark, sf_dir))
