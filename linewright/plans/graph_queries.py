"""Queries on the import graph and on batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import text
from linewright.operators import batching, graph, structure
from linewright.plans.registry import over, query, sql_text, tokens, utf16
from linewright.plans.scan_queries import lines_step
from linewright.plans.structure_queries import TYPED, TYPED_FILES, code, imports_step

_BASE = "regexp_replace(regexp_replace(source, '^\\./', ''), '^\\.\\./', '')"
_LAST = "string_split(source, '.')[-1]"
_CANDIDATES = ", ".join(
    [f"{_BASE}||{sql_text(s)}" for s in fv.IMPORT_SUFFIXES]
    + [
        f"CASE WHEN contains(source, '.') AND {_LAST} <> '' THEN {_LAST}||{sql_text(s)} END"
        for s in fv.IMPORT_LAST_PART_SUFFIXES
    ]
    + ["CASE WHEN starts_with(source, '.') THEN regexp_replace(source, '^\\.+', '')||'.py' END"]
)
RESOLVED_STEP = f"""resolved AS (SELECT i.review_id, i.file_id, i.line_no, i.source, arg_min(f.filename, k) AS target,
    arg_min(f.file_id, k) AS target_id
  FROM (SELECT *, unnest(cs) AS c, unnest(range(0, len(cs))) AS k FROM (SELECT *, [{_CANDIDATES}] AS cs
        FROM imports WHERE is_relative)) i
  JOIN code f ON f.review_id = i.review_id AND f.filename = i.c GROUP BY ALL)"""
REACH_STEPS = (
    """links AS (SELECT file_id AS a, target_id AS b FROM resolved UNION SELECT target_id, file_id FROM resolved)""",
    """reach AS (SELECT file_id AS a, file_id AS b FROM code UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)""",
    """components AS (SELECT a AS file_id, min(b) AS component_id FROM reach GROUP BY a)""",
)
GRAPH_STEPS = (lines_step("code"), imports_step(), RESOLVED_STEP, *REACH_STEPS)


def linked(spark, sf_dir, name="files", found=None):
    """Files with component and tokens; ``found`` are their facts where they are known."""
    files = code(spark, sf_dir, name)
    resolved = graph.resolve_imports(structure.imports(files, found), files)
    edges = resolved.select(F.col("file_id").alias("src"), F.col("target_id").alias("dst"))
    components = graph.connected_components(files, edges)
    # Counted where a file is read, so that contents are pruned from this join where only
    # their size is asked for.
    sized = files.withColumn("tokens", text.token_estimate(F.col("content")))
    return sized.join(components, ["review_id", "file_id"]).select(
        "review_id", "component_id", "file_id", F.col("file_id").alias("file_ord"), "filename", "language",
        "tokens", "content",
    )


@query(
    "resolve_imports",
    over("code_files", "SELECT review_id, file_id, CAST(line_no AS INT) AS line_no, source, target, target_id FROM resolved",
         TYPED, lines_step("code"), imports_step(), RESOLVED_STEP),
)
def resolve_imports(spark, sf_dir):
    files = code(spark, sf_dir)
    return graph.resolve_imports(structure.imports(files), files).select(
        "review_id", "file_id", "line_no", "source", "target", "target_id"
    )


@query(
    "connected_components",
    over("files", "SELECT review_id, file_id, component_id FROM code JOIN components USING (file_id)",
         TYPED_FILES, *GRAPH_STEPS, recursive=True),
)
def connected_components(spark, sf_dir):
    return linked(spark, sf_dir).select("review_id", "file_id", "component_id")


SIZED = f"""sized AS (SELECT review_id, component_id, file_id, filename, language, content, {tokens('content')} AS tokens
  FROM code JOIN components USING (file_id))"""
SUMS = """sums AS (SELECT review_id, component_id, CAST(sum(tokens) AS BIGINT) AS component_tokens,
  CAST(count(*) AS BIGINT) AS file_count FROM sized GROUP BY ALL)"""


def _batched(views: str, body: str, *more: str, typed: str = TYPED_FILES) -> str:
    return over(views, body, typed, *GRAPH_STEPS, SIZED, SUMS, *more, recursive=True)


@query("component_tokens", _batched("files", "SELECT * FROM sums"))
def component_tokens(spark, sf_dir):
    return batching.component_tokens(linked(spark, sf_dir))


# A budget small enough for many files and components of the test data to be over it.
BUDGET = 900


@query(
    "whole_batches",
    _batched("files", f"""SELECT review_id, component_id, file_id, tokens FROM sized JOIN sums
      USING (review_id, component_id) WHERE component_tokens <= {BUDGET}"""),
)
def whole_batches(spark, sf_dir):
    whole, _ = batching.split_by_budget(linked(spark, sf_dir), BUDGET)
    return whole.select("review_id", "component_id", "file_id", "tokens")


def chunk_steps(budget: int, source: str) -> tuple[str, ...]:
    room = 4 * budget
    return (
        f"""lens AS (SELECT file_id, ls, list_transform(ls, lambda l: {utf16('l')}) AS ns FROM (
          SELECT file_id, string_split(content, chr(10)) AS ls FROM {source} WHERE tokens > {budget}))""",
        f"""cut AS (SELECT file_id, ls, ns, 1 AS i, 0 AS chunk, ns[1] + 1 AS chars FROM lens
          UNION ALL SELECT file_id, ls, ns, i + 1, CASE WHEN chars + ns[i + 1] > {room} THEN chunk + 1 ELSE chunk END,
            CASE WHEN chars + ns[i + 1] > {room} THEN 0 ELSE chars END + ns[i + 1] + 1
          FROM cut WHERE i < len(ls))""",
        f"""chunks AS (SELECT file_id, CAST(chunk AS BIGINT) AS chunk_ord, min(i) AS first_line, max(i) AS last_line,
          {tokens('content')} AS chunk_tokens, content FROM (
            SELECT file_id, chunk, i, string_agg(ls[i], chr(10) ORDER BY i) OVER (PARTITION BY file_id, chunk
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS content FROM cut)
          GROUP BY file_id, chunk, content)""",
    )


_CHUNK_SOURCE = f"sized AS (SELECT review_id, file_id, content, {tokens('content')} AS tokens FROM files)"


@query(
    "chunk_large_files",
    over("files", """SELECT file_id, chunk_ord, CAST(first_line AS BIGINT) AS first_line, CAST(last_line AS BIGINT) AS last_line,
         CAST(chunk_tokens AS BIGINT) AS chunk_tokens, sha256(content) AS hash FROM chunks""",
         _CHUNK_SOURCE, *chunk_steps(BUDGET, "sized"), recursive=True),
)
def chunk_large_files(spark, sf_dir):
    files = code(spark, sf_dir, "files").select(
        "file_id", "content", text.token_estimate(F.col("content")).alias("tokens")
    )
    return batching.chunk_large_files(files, BUDGET).select(
        "file_id", "chunk_ord", "first_line", "last_line", "chunk_tokens", F.sha2("content", 256).alias("hash")
    )


def ffd_steps(budget: int) -> tuple[str, ...]:
    """First-fit-decreasing file by file, all components side by side."""
    return (
        *chunk_steps(budget, "sized"),
        f"""items AS (SELECT review_id, component_id, list(CAST(tokens AS BIGINT) ORDER BY tokens DESC, file_id) AS ts,
          list(file_id ORDER BY tokens DESC, file_id) AS ids,
          list(coalesce(cs, []) ORDER BY tokens DESC, file_id) AS cs
          FROM sized JOIN sums USING (review_id, component_id) LEFT JOIN (
            SELECT file_id, list(CAST(chunk_tokens AS BIGINT) ORDER BY chunk_ord) AS cs FROM chunks GROUP BY file_id) USING (file_id)
          WHERE component_tokens > {budget} GROUP BY ALL)""",
        f"""pack AS (SELECT review_id, component_id, ts, ids, cs, 1 AS i, CAST([] AS BIGINT[]) AS bins, CAST([] AS BIGINT[]) AS spots FROM items
          UNION ALL SELECT review_id, component_id, ts, ids, cs, i + 1,
            CASE WHEN ts[i] > {budget} THEN list_concat(bins, cs[i]) WHEN b IS NULL THEN list_append(bins, ts[i])
              ELSE list_transform(bins, lambda x, k: CASE WHEN k = b THEN x + ts[i] ELSE x END) END,
            list_append(spots, CASE WHEN ts[i] > {budget} OR b IS NULL THEN len(bins) ELSE b - 1 END) AS spots
          FROM (SELECT *, list_min(list_filter(range(1, len(bins) + 1), lambda k: bins[k] + ts[i] <= {budget})) AS b
                FROM pack WHERE i <= len(ts)))""",
        f"""packed AS (SELECT review_id, component_id, spots[k] AS first_bin, ids[k] AS file_id, ts[k] AS tokens
          FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS k FROM pack WHERE i = len(ts) + 1))""",
        f"""batches AS (
          SELECT review_id, component_id, CAST(0 AS BIGINT) AS batch_ord, file_id, CAST(NULL AS BIGINT) AS chunk_ord,
            CAST(tokens AS BIGINT) AS tokens FROM sized JOIN sums USING (review_id, component_id) WHERE component_tokens <= {budget}
          UNION ALL SELECT review_id, component_id, first_bin, file_id, NULL, tokens FROM packed WHERE tokens <= {budget}
          UNION ALL SELECT review_id, component_id, first_bin + chunk_ord, file_id, chunk_ord, chunk_tokens
            FROM packed JOIN chunks USING (file_id))""",
    )


@query(
    "ffd_batches",
    _batched("files", "SELECT review_id, component_id, batch_ord, file_id, chunk_ord, tokens FROM batches",
             *ffd_steps(BUDGET)),
)
def ffd_batches(spark, sf_dir):
    return batching.create_batches(linked(spark, sf_dir), BUDGET).drop("file_ord")


@query(
    "batch_stats",
    _batched("files", """SELECT review_id, component_id, batch_ord, row_number() OVER (PARTITION BY review_id
      ORDER BY component_id, batch_ord) - 1 AS batch_index, file_count, tokens FROM (
      SELECT review_id, component_id, batch_ord, CAST(count(*) AS BIGINT) AS file_count, CAST(sum(tokens) AS BIGINT) AS tokens
      FROM batches GROUP BY ALL)""", *ffd_steps(BUDGET)),
)
def batch_stats(spark, sf_dir):
    return batching.batch_stats(batching.create_batches(linked(spark, sf_dir), BUDGET))
