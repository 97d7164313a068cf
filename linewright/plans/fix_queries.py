"""Queries on fix validation, reuse, plug-ins and text datasets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import text
from linewright.operators import batching, fixes, lint, plugins, prompts, reuse, scan, structure
from linewright.plans.graph_queries import BUDGET, GRAPH_STEPS, SIZED, SUMS, ffd_steps, linked
from linewright.plans.ingest_queries import FENCE, LANGUAGE
from linewright.plans.registry import over, query, sql_list, sql_text, tokens, utf16
from linewright.plans.scan_queries import SCAN_STEPS, hits_step, lines_step
from linewright.plans.structure_queries import (
    _BARE, _found, EXPORTS, LINT_STEPS, LINTED, SOURCE, TYPED, TYPED_FILES, code, imbalance,
    lint_test,
)
from linewright.session import cut_lineage, fresh_path
from linewright.sources.code_corpus import expected_step
from linewright.sources.corpus import view, view_sql

# --- fixes ---------------------------------------------------------------------------

_FIXES = (
    "'JSON.parse(x)'", "'password = \"hunter2hunter2\"'", "'a();'||chr(10)||'b();'", "'if (a) {'", "NULL",
    "'eval(x)'", "'const a = b == c'", "''", "'import z from \"lib\"'",
    "'import y from \"./n\"'||chr(10)||'import w from \"./n\"'",
)
_FIX_CASE = f"CASE CAST(ord % {len(_FIXES)} AS INT) " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FIXES)) + " END"
_FOUND = f"""found AS (SELECT review_id, file_id, ord, line_no AS line_start, line_no + ord % 2 AS line_end, {_FIX_CASE} AS fix
  FROM (SELECT *, CAST(line_no * 16 + rule_ord AS BIGINT) + file_id AS ord FROM hits))"""
_FIXED = (
    *SCAN_STEPS,
    _FOUND,
    f"""fixed AS (SELECT *, {LANGUAGE} AS language, array_to_string(list_concat(list_concat(ls[1:greatest(0, line_start - 1)],
        string_split(fix, chr(10))), ls[least(len(ls), line_end) + 1:]), chr(10)) AS after
      FROM (SELECT n.*, filename, content, string_split(content, chr(10)) AS ls FROM found n JOIN files USING (review_id, file_id))
      WHERE fix <> '')""",
)
_AFTER_LINES = """after_lines AS (SELECT review_id, file_id, ord, language, ls[line_no] AS line, line_no FROM (
  SELECT *, unnest(range(1, len(ls) + 1)) AS line_no FROM (
    SELECT review_id, file_id, ord, language, string_split(after, chr(10)) AS ls FROM fixed)))"""
_CRITICAL = [i for i, r in enumerate(fv.LINE_RULES) if r[3] == "critical"]
PATTERN_STEPS = (
    _AFTER_LINES,
    hits_step("after_lines", "after_hits", [fv.LINE_RULES[i][0] for i in _CRITICAL]),
    """pattern_bad AS (SELECT DISTINCT ord, file_id FROM after_hits a WHERE NOT EXISTS (SELECT 1 FROM hits h
        WHERE h.file_id = a.file_id AND h.line_no = a.line_no AND h.rule_ord = a.rule_ord))""",
)
_ERRORS = [i for i, r in enumerate(lint.LINT_LINE_RULES) if r[1] == "error"]
_ERROR_TESTS = ", ".join(f"CASE WHEN {lint_test(i)} THEN {i} END" for i in _ERRORS)


def lint_fix_hits(lines: str, name: str) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (line, bare), unnest(list_filter([{_ERROR_TESTS}], lambda x: x IS NOT NULL)) AS n
      FROM (SELECT *, {_BARE} AS bare FROM {lines} WHERE language IN {LINTED}))"""


def script_import(line: str) -> str:
    """The module that a line of a script imports, or null."""
    return _found("script", line)


def _repeats(name: str, lines: str, keys: str) -> str:
    """Lines that import a module again."""
    return f"""{name} AS (SELECT {keys}, line_no FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys}, source ORDER BY line_no) AS rn FROM (
          SELECT {keys}, line_no, {_found('script')} AS source FROM {lines} WHERE language IN {LINTED}) WHERE source IS NOT NULL)
      WHERE rn > 1)"""


_LINT_FIX_STEPS = (
    f"typed_lines AS (SELECT *, {LANGUAGE} AS language FROM lines)",
    lint_fix_hits("typed_lines", "lint_before"),
    lint_fix_hits("after_lines", "lint_after"),
    _repeats("import_before", "typed_lines", "file_id"),
    _repeats("import_after", "after_lines", "file_id, ord"),
    """lint_bad AS (SELECT DISTINCT ord, file_id FROM lint_after a WHERE NOT EXISTS (SELECT 1 FROM lint_before h
        WHERE h.file_id = a.file_id AND h.line_no = a.line_no AND h.n = a.n)
      UNION SELECT DISTINCT ord, file_id FROM import_after a WHERE NOT EXISTS (SELECT 1 FROM import_before h
        WHERE h.file_id = a.file_id AND h.line_no = a.line_no))""",
)
SYNTAX = (
    f"(language IN {sql_list(fv.PARSED_LANGUAGES)} AND {imbalance('after')} > {imbalance('content')})"
)


def _fix_inputs(spark, sf_dir):
    files = code(spark, sf_dir, "files")
    found = scan.scan(files).withColumn("ord", F.col("ord") + F.col("file_id"))
    options = [None if f == "NULL" else f.replace("'||chr(10)||'", "\n").strip("'") for f in _FIXES]
    choice = F.element_at(F.array(*[F.lit(o).cast("string") for o in options]), (F.col("ord") % len(_FIXES) + 1).cast("int"))
    found = found.withColumn("suggested_fix", choice).withColumn(
        "line_end", (F.col("line_start") + F.col("ord") % 2).cast("int")
    )
    return found, files


@query("apply_fix", over("files", "SELECT file_id, ord, sha256(after) AS hash FROM fixed", *_FIXED))
def apply_fix(spark, sf_dir):
    return fixes.apply_fix(*_fix_inputs(spark, sf_dir)).select(
        "file_id", "ord", F.sha2("fixed_content", 256).alias("hash")
    )


@query(
    "fix_syntax_check",
    over("files", f"SELECT file_id, ord, {SYNTAX} AS regressed FROM fixed", *_FIXED),
)
def fix_syntax_check(spark, sf_dir):
    return fixes.syntax_check(*_fix_inputs(spark, sf_dir)).select("file_id", "ord", "regressed")


@query(
    "fix_pattern_check",
    over("files", """SELECT file_id, ord, EXISTS (SELECT 1 FROM pattern_bad b WHERE b.ord = f.ord AND b.file_id = f.file_id)
         AS regressed FROM fixed f""", *_FIXED, *PATTERN_STEPS),
)
def fix_pattern_check(spark, sf_dir):
    return fixes.pattern_check(*_fix_inputs(spark, sf_dir)).select("file_id", "ord", "regressed")


@query(
    "fix_lint_check",
    over("files", f"""SELECT file_id, ord, EXISTS (SELECT 1 FROM lint_bad b WHERE b.ord = f.ord AND b.file_id = f.file_id)
         AS regressed FROM fixed f WHERE language IN {LINTED}""", *_FIXED, _AFTER_LINES, *_LINT_FIX_STEPS),
)
def fix_lint_check(spark, sf_dir):
    return fixes.lint_check(*_fix_inputs(spark, sf_dir)).select("file_id", "ord", "regressed")


@query(
    "fix_status",
    over("files", f"""SELECT n.file_id, n.ord, CASE WHEN coalesce(n.fix, '') = '' THEN 'unavailable'
         WHEN f.file_id IS NULL THEN 'unverified'
         WHEN {SYNTAX} OR EXISTS (SELECT 1 FROM pattern_bad b WHERE b.ord = n.ord AND b.file_id = n.file_id)
           OR EXISTS (SELECT 1 FROM lint_bad b WHERE b.ord = n.ord AND b.file_id = n.file_id) THEN 'unavailable'
         ELSE 'verified' END AS fix_status FROM found n LEFT JOIN fixed f USING (file_id, ord)""",
         *_FIXED, *PATTERN_STEPS, *_LINT_FIX_STEPS),
)
def fix_status(spark, sf_dir):
    found, files = _fix_inputs(spark, sf_dir)
    return fixes.fix_status(found, files).select("file_id", "ord", "fix_status")


# --- reuse ---------------------------------------------------------------------------


def _hashed(spark, sf_dir):
    """Plain documents as files: they hold exact copies of each other."""
    docs = view(spark, sf_dir, "hashed_docs")
    return docs.select(
        F.floor(F.col("doc_id") / 20).alias("review_id"),
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("text").alias("content"),
        text.content_hash(F.col("text")).alias("content_hash"),
        "lang",
    )


_LEDGER = ["source", "category", "severity", "message", "line_start", "line_end", "rule_id", "ord"]


def _ledger(files):
    """What an earlier run over the English documents left behind."""
    english = files.where("lang = 'en'")
    version = F.lit(reuse.rule_version()).alias("rule_version")
    seq = F.col("file_id").alias("seq")
    heads = english.select("content_hash", version, seq)
    found = scan.scan(english).join(files.select("file_id", "content_hash"), "file_id")
    return heads, found.select("content_hash", version, seq, *_LEDGER)


_HASHED = (
    f"hashed_docs AS ({view_sql('hashed_docs', 'duckdb')}), "
    "hashed AS (SELECT doc_id AS file_id, text AS content, sha256(text) AS content_hash, lang FROM hashed_docs)"
)
_KNOWN = "content_hash IN (SELECT content_hash FROM hashed WHERE lang = 'en')"
_LATER = 1_000_000_000_000


@query(
    "hash_reuse",
    f"WITH {_HASHED} SELECT file_id, content_hash, {_KNOWN} AS cached FROM hashed",
)
def hash_reuse(spark, sf_dir):
    files = _hashed(spark, sf_dir)
    heads, _ = _ledger(files)
    narrow = files.select("file_id", "content_hash")
    return reuse.known(narrow, heads).withColumn("cached", F.lit(True)).unionByName(
        reuse.unknown(narrow, heads).withColumn("cached", F.lit(False))
    )


@query(
    "hash_ledger",
    f"""WITH {_HASHED}, {lines_step('hashed')}, {hits_step()}, {SCAN_STEPS[2]},
        kept AS (SELECT content_hash, max(seq) AS seq FROM (SELECT content_hash, file_id AS seq FROM hashed WHERE lang = 'en'
          UNION ALL SELECT content_hash, file_id + {_LATER} FROM hashed WHERE lang = 'en' AND length(content) > 1000) GROUP BY content_hash)
        SELECT k.content_hash, k.seq, rule_id, CAST(line_no AS INT) AS line_start
        FROM kept k LEFT JOIN hits h ON h.file_id = k.seq % {_LATER} LEFT JOIN catalogue USING (rule_ord)""",
)
def hash_ledger(spark, sf_dir):
    """A second write, for the contents over 1,000 characters, replaces the first."""
    files = _hashed(spark, sf_dir)
    heads, rows = _ledger(files)
    long_heads, long_rows = _ledger(files.where(F.length("content") > 1000))
    later = F.col("seq") + _LATER
    kept, found = reuse.put(
        heads, rows, long_heads.withColumn("seq", later), long_rows.withColumn("seq", later)
    )
    return kept.join(found, ["content_hash", "rule_version", "seq"], "left").select(
        "content_hash", "seq", "rule_id", "line_start"
    )


_SCANNED = "SELECT file_id, rule_id, CAST(line_no AS INT) AS line_start{more} FROM hits JOIN catalogue USING (rule_ord)"
_HASHED_SCAN = f"WITH {_HASHED}, {lines_step('hashed')}, {hits_step()}, {SCAN_STEPS[2]} "


@query("scan_distinct", _HASHED_SCAN + _SCANNED.format(more=", content_hash"))
def scan_distinct(spark, sf_dir):
    return reuse.scan_distinct(_hashed(spark, sf_dir)).select("file_id", "rule_id", "line_start", "content_hash")


@query(
    "incremental_scan",
    _HASHED_SCAN + _SCANNED.format(
        more=f", {_KNOWN} AS cached"
    ),
)
def incremental_scan(spark, sf_dir):
    """Two earlier runs, over short and over long English documents, have appended to the ledger."""
    files = _hashed(spark, sf_dir)
    found = "source STRING, category STRING, severity STRING, message STRING, line_start INT, line_end INT, rule_id STRING, ord BIGINT"
    folder = fresh_path(spark, "ledger")
    ledger = reuse.HashLedger(spark, folder.rsplit("/", 1)[1].replace("-", "_"), folder, found, buckets=16)
    for run in (F.length("content") <= 1000, F.length("content") > 1000):
        ledger.append(*_ledger(files.where(run)))
    return reuse.incremental_scan(files, ledger.heads(), ledger.findings()).select("file_id", "rule_id", "line_start", "cached")


# --- plug-ins ------------------------------------------------------------------------


@query(
    "analyzer_registry",
    over("source_files", f"""SELECT file_id, 'pattern' AS source, rule_id, CAST(line_no AS INT) AS line_start
           FROM hits JOIN catalogue USING (rule_ord)
         UNION ALL SELECT file_id, 'eslint', rule_id, CAST(line_no AS INT) FROM lint_hits JOIN lint_rules USING (n)
         UNION ALL SELECT file_id, 'eslint', 'max-lines-per-function', CAST(a AS INT) FROM expected
           WHERE language IN {LINTED} AND b - a + 1 > 50
         UNION ALL SELECT file_id, 'eslint', 'complexity', CAST(a AS INT) FROM expected
           WHERE language IN {LINTED} AND complexity > 10
         UNION ALL SELECT file_id, 'eslint', 'max-depth', CAST(a AS INT) FROM known_deep WHERE language IN {LINTED}
         UNION ALL SELECT file_id, 'eslint', 'no-duplicate-imports', CAST(a AS INT) FROM (
           SELECT *, row_number() OVER (PARTITION BY file_id, source ORDER BY a, part) AS nth FROM known_imports WHERE language IN {LINTED})
           WHERE nth > 1""",
         SOURCE, lines_step("code"), *SCAN_STEPS[1:], *LINT_STEPS, expected_step("function"),
         expected_step("deep", "known_deep"), expected_step("import", "known_imports")),
)
def analyzer_registry(spark, sf_dir):
    """The built-in detectors, one that cannot be planned and one that fails when it runs."""

    def unplanned(files):
        raise RuntimeError("out of order")

    def failing(files):
        return scan.scan(files).withColumn("message", F.raise_error(F.lit("out of order")).cast("string"))

    registry = plugins.default_registry()
    registry.register(plugins.Analyzer("unplanned", unplanned)).register(plugins.Analyzer("failing", failing))
    return registry.analyze(code(spark, sf_dir, "source_files")).select("file_id", "source", "rule_id", "line_start")


def _long_lines(frame: pd.DataFrame, profile: str) -> pd.DataFrame:
    """Marks the longest line of a file if it has more than 300 characters."""
    rows = []
    for review_id, file_id, filename, content in zip(
        frame.review_id, frame.file_id, frame.filename, frame.content
    ):
        sizes = [len(line) for line in content.split("\n")]
        if max(sizes) > 300:
            line = sizes.index(max(sizes)) + 1
            rows.append((review_id, file_id, filename, "style", "info", f"{profile}: {max(sizes)} of {len(frame)} files", line, line, None, 0.5))
    columns = [c.split()[0] for c in plugins.SCORER_SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=columns)


plugins.SCORERS["long-lines"] = _long_lines


@query(
    "scorer_plugin",
    over("files", """SELECT review_id, file_id, filename, 'quality: '||longest||' of '||n||' files' AS message,
         CAST(list_position(sizes, longest) AS INT) AS line_start, 'llm' AS source
         FROM (SELECT *, list_max(sizes) AS longest FROM (SELECT *, count(*) OVER (PARTITION BY review_id) AS n, list_transform(string_split(content, chr(10)),
           lambda l: length(l)) AS sizes FROM files)) WHERE longest > 300"""),
)
def scorer_plugin(spark, sf_dir):
    files = view(spark, sf_dir, "files")
    canned = view(spark, sf_dir, "findings")
    return plugins.score_batches(files, "long-lines", canned, "quality").select(
        "review_id", "file_id", "filename", "message", "line_start", "source"
    )


@query(
    "scorer_progress",
    over("files", """SELECT review_id, CAST(count(*) AS BIGINT) AS files, CAST(count_if(longest > 300) AS BIGINT) AS findings
         FROM (SELECT *, list_max(list_transform(string_split(content, chr(10)), lambda l: length(l))) AS longest FROM files)
         GROUP BY review_id"""),
)
def scorer_progress(spark, sf_dir):
    files = view(spark, sf_dir, "files")
    found = plugins.score_batches(files, "long-lines", view(spark, sf_dir, "findings"), "quality")
    return plugins.batch_progress(files, found)


@query(
    "batch_metrics",
    over("files", f"""SELECT review_id, CAST(count(*) AS BIGINT) AS files, CAST(sum({tokens('content')}) AS BIGINT) AS tokens,
         CAST(count_if(longest > 300) AS BIGINT) AS findings, true AS timed
         FROM (SELECT *, list_max(list_transform(string_split(content, chr(10)), lambda l: length(l))) AS longest FROM files)
         GROUP BY review_id"""),
)
def batch_metrics(spark, sf_dir):
    """One row per batch of a scorer; the duration differs from run to run, so it only has to be there."""
    files = view(spark, sf_dir, "files")
    _, told = plugins.score_with_metrics(files, "long-lines", view(spark, sf_dir, "findings"), "quality")
    return told.select("review_id", "files", "tokens", "findings", (F.col("millis") >= 0).alias("timed"))


# --- text datasets -------------------------------------------------------------------

_BATCHED = (TYPED, *GRAPH_STEPS, SIZED, SUMS, *ffd_steps(BUDGET))
_PLACED = f"""placed AS (SELECT b.*, filename, language, coalesce(c.content, s.content) AS content,
    (b.chunk_ord IS NULL, CASE WHEN component_tokens > {BUDGET} THEN -b.tokens ELSE 0 END, b.file_id) AS place
  FROM batches b JOIN sized s ON s.file_id = b.file_id JOIN sums u ON u.component_id = b.component_id
  LEFT JOIN chunks c ON c.file_id = b.file_id AND c.chunk_ord = b.chunk_ord)"""


def _batched(spark, sf_dir, name="code_files", found=None, texts=True):
    """Files in their batches. What places them is narrow; contents are read as they lie, and
    cut once. Without ``texts`` the pieces of cut files are known by their sizes, and no text is kept."""
    contents = code(spark, sf_dir, name)
    sized = cut_lineage(linked(spark, sf_dir, name, found).drop("content"), "linked")
    pieces = batching.file_chunks(sized, contents, BUDGET)
    chunks = cut_lineage(pieces if texts else pieces.drop("content"), "chunks")
    batches = batching.create_batches(sized, BUDGET, chunks)
    return prompts.batch_files(batches, contents, chunks if texts else None)


def _filled(profile: str) -> str:
    before, _, rest = fv.SYSTEM_TEXT.partition("<languages>")
    rest = rest.replace("<profile>", fv.PROFILE_TEXT[profile])
    return f"{sql_text(before)}||languages||{sql_text(rest)}"


@query(
    "system_prompts",
    over("code_files", f"""SELECT review_id, component_id, batch_ord, {_filled('security')} AS prompt FROM (
      SELECT review_id, component_id, batch_ord, string_agg(language, ', ' ORDER BY first) AS languages FROM (
        SELECT review_id, component_id, batch_ord, language, min(place) AS first FROM placed GROUP BY ALL) GROUP BY ALL)""",
         *_BATCHED, _PLACED, recursive=True),
)
def system_prompts(spark, sf_dir):
    return prompts.system_prompts(_batched(spark, sf_dir, texts=False), "security")


_DESCRIBED = (
    f"exported AS (SELECT file_id, string_agg(name, ', ' ORDER BY line_no) AS e FROM (SELECT *, {EXPORTS} AS name FROM lines) "
    "WHERE name IS NOT NULL GROUP BY file_id)",
    "imported AS (SELECT file_id, string_agg(source, ', ' ORDER BY a, part) AS i FROM known_imports GROUP BY file_id)",
    """defined AS (SELECT file_id, string_agg(name||'('||array_to_string(params, ', ')||') [complexity: '||complexity||']', ', ' ORDER BY part) AS f
      FROM expected GROUP BY file_id)""",
)
# The corpus knows its imports and functions; the steps of the graph run on what it knows.
_KNOWN_IMPORTS = expected_step("import", "known_imports")
_AS_IMPORTS = "imports AS (SELECT *, a AS line_no FROM known_imports)"


@query(
    "user_messages",
    over("source_files", """SELECT review_id, component_id, batch_ord, 'Review the following '||count(*)||' files:'||chr(10)||chr(10)||
      string_agg(concat_ws(chr(10), '--- FILE: '||filename||' ---', 'Language: '||language, 'Exports: '||e, 'Imports: '||i,
        'Functions: '||f, '', content, '--- END FILE ---'||chr(10)), chr(10) ORDER BY place) AS message
      FROM placed LEFT JOIN exported USING (file_id) LEFT JOIN imported USING (file_id) LEFT JOIN defined USING (file_id)
      GROUP BY ALL""", SOURCE, lines_step("code"), expected_step("function"), _KNOWN_IMPORTS, _AS_IMPORTS, *GRAPH_STEPS[2:],
         SIZED, SUMS, *ffd_steps(BUDGET), _PLACED, *_DESCRIBED, recursive=True),
)
def user_messages(spark, sf_dir):
    files = code(spark, sf_dir, "source_files")
    # One pass over the contents serves the graph and the descriptions.
    found = cut_lineage(structure.facts(files, "function", "import"), "facts")
    return prompts.user_messages(_batched(spark, sf_dir, "source_files", found), prompts.describe(files, found))


_QUESTION = "What does this do?"
_BLOCK = f"'### '||filename||chr(10)||'```'||{FENCE}||chr(10)||content||chr(10)||'```'||chr(10)"
_TAIL = sql_text(prompts.question_tail(_QUESTION))


def _tasks(spark, sf_dir, make):
    files = view(spark, sf_dir, "files").withColumn("file_ord", F.col("file_id"))
    parts = [make(files, task, _QUESTION if task == "ask" else None) for task in fv.TASK_TEXT]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "task_segments",
    over("files", f"""SELECT review_id, task, file_id AS part, {_BLOCK} AS text
         FROM files, (SELECT unnest([{", ".join(sql_text(t) for t in fv.TASK_TEXT)}]) AS task)
         UNION ALL SELECT DISTINCT review_id, 'ask', 4611686018427387904, {_TAIL} FROM files"""),
)
def task_segments(spark, sf_dir):
    return _tasks(spark, sf_dir, prompts.task_segments)


_SYSTEM = "CASE task " + " ".join(f"WHEN {sql_text(t)} THEN {sql_text(s)}" for t, s in fv.TASK_TEXT.items()) + " END"


@query(
    "task_documents",
    over("files", f"""SELECT review_id, task, files, system, user_chars,
         CAST(ceil((user_chars + length(system)) / 4.0) AS BIGINT) AS tokens FROM (
           SELECT review_id, task, CAST(count(*) AS BIGINT) AS files, {_SYSTEM} AS system,
             CAST({utf16('doc')} AS BIGINT) AS user_chars FROM (
             SELECT review_id, file_id, task, string_agg({_BLOCK}, chr(10) ORDER BY file_id) OVER (PARTITION BY review_id, task
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)||CASE task WHEN 'ask' THEN {_TAIL} ELSE '' END AS doc
             FROM files, (SELECT unnest([{", ".join(sql_text(t) for t in fv.TASK_TEXT)}]) AS task)) GROUP BY review_id, task, doc)"""),
)
def task_documents(spark, sf_dir):
    return _tasks(spark, sf_dir, prompts.task_documents)
