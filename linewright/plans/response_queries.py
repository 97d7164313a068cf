"""Queries on model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import patterns
from linewright.operators import responses
from linewright.plans.registry import over, query, sql_list
from linewright.sources.corpus import view

_NUMBERS = "('UBIGINT', 'BIGINT', 'DOUBLE')"


def _integer(field: str) -> str:
    value = f"CAST(json_extract_string(x, '$.{field}') AS DOUBLE)"
    return (
        f"CASE WHEN json_type(x, '$.{field}') IN {_NUMBERS} THEN {value} > 0 AND {value} = floor({value}) ELSE false END"
    )


def _text(field: str) -> str:
    return f"coalesce(json_type(x, '$.{field}') = 'VARCHAR', false)"


_VALID_ITEM = f"""({_text('filename')} AND {_text('message')} AND {_integer('lineStart')} AND {_integer('lineEnd')}
  AND {_text('severity')} AND coalesce(json_extract_string(x, '$.severity') IN {sql_list(fv.SEVERITIES)}, false)
  AND {_text('category')} AND coalesce(json_extract_string(x, '$.category') IN {sql_list(fv.CATEGORIES)}, false)
  AND coalesce(json_type(x, '$.suggestedFix') IN ('VARCHAR', 'NULL'), true)
  AND CASE WHEN json_type(x, '$.confidence') IN {_NUMBERS}
      THEN CAST(json_extract_string(x, '$.confidence') AS DOUBLE) BETWEEN 0 AND 1 ELSE false END)"""

_PARSED = (
    f"""cleaned AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '```json{patterns.SPACE}*', '', 'g'),
        '```{patterns.SPACE}*', '', 'g'), '^{patterns.SPACE}+|{patterns.SPACE}+$', '', 'g') AS cleaned FROM model_responses)""",
    """parsed AS (SELECT *, json_valid(cleaned) AS is_json, CASE WHEN json_valid(cleaned) AND json_type(cleaned) = 'ARRAY'
        THEN json_extract(cleaned, '$[*]') END AS xs FROM cleaned)""",
    f"""judged AS (SELECT *, coalesce(len(list_filter(xs, lambda x: NOT {_VALID_ITEM})) = 0, false) AS valid FROM parsed)""",
    """found AS (SELECT review_id, conv_id, turn, position, json_extract_string(x, '$.filename') AS filename,
        json_extract_string(x, '$.category') AS category, json_extract_string(x, '$.severity') AS severity,
        json_extract_string(x, '$.message') AS message, CAST(json_extract_string(x, '$.lineStart') AS INT) AS line_start,
        CAST(json_extract_string(x, '$.lineEnd') AS INT) AS line_end,
        json_extract_string(x, '$.suggestedFix') AS suggested_fix,
        CAST(json_extract_string(x, '$.confidence') AS DOUBLE) AS confidence
        FROM (SELECT *, unnest(range(0, len(xs))) AS position, unnest(xs) AS x FROM judged WHERE valid))""",
)


@query(
    "parse_responses",
    over("model_responses", "SELECT conv_id, turn, is_json, CAST(coalesce(len(xs), -1) AS INT) AS items FROM parsed", *_PARSED),
)
def parse_responses(spark, sf_dir):
    parsed = responses.parse(view(spark, sf_dir, "model_responses"))
    return parsed.select(
        "conv_id", "turn",
        F.col("parsed").isNotNull().alias("is_json"),
        F.coalesce(F.size(responses.items(F.col("parsed"))), F.lit(-1)).alias("items"),
    )


@query(
    "validate_responses",
    over("model_responses", "SELECT conv_id, turn, valid FROM judged", *_PARSED),
)
def validate_responses(spark, sf_dir):
    return responses.validate(view(spark, sf_dir, "model_responses")).select("conv_id", "turn", "valid")


@query(
    "response_findings",
    over("model_responses", "SELECT *, 'llm' AS source FROM found", *_PARSED),
)
def response_findings(spark, sf_dir):
    return responses.findings(view(spark, sf_dir, "model_responses"))


@query(
    "response_status",
    over("model_responses", """SELECT review_id, conv_id, turn, CASE WHEN NOT is_json THEN 'not json' WHEN valid THEN 'accepted'
         ELSE 'rejected' END AS status, CAST(CASE WHEN valid THEN len(xs) ELSE 0 END AS BIGINT) AS findings FROM judged""",
         *_PARSED),
)
def response_status(spark, sf_dir):
    return responses.status(view(spark, sf_dir, "model_responses"))


@query(
    "attribute_findings",
    over("model_responses files", """SELECT f.review_id, conv_id, turn, f.filename, g.file_id, g.file_id IS NOT NULL AS known
         FROM found f LEFT JOIN files g ON g.review_id = f.review_id AND g.filename = f.filename""", *_PARSED),
)
def attribute_findings(spark, sf_dir):
    found = responses.findings(view(spark, sf_dir, "model_responses"))
    placed = responses.attribute(found, view(spark, sf_dir, "files"))
    return placed.select(
        "review_id", "conv_id", "turn", "filename", "file_id", F.col("file_id").isNotNull().alias("known")
    )


@query(
    "unknown_files",
    over("model_responses files", """SELECT f.review_id, f.filename, CAST(count(*) AS BIGINT) AS findings FROM found f
         WHERE NOT EXISTS (SELECT 1 FROM files g WHERE g.review_id = f.review_id AND g.filename = f.filename)
         GROUP BY f.review_id, f.filename""", *_PARSED),
)
def unknown_files(spark, sf_dir):
    """Names that a model made up: findings that no file of the review can take."""
    found = responses.findings(view(spark, sf_dir, "model_responses"))
    return responses.unattributed(responses.attribute(found, view(spark, sf_dir, "files")))


@query(
    "canned_findings",
    over("findings files", """SELECT f.review_id, f.file_id, f.filename, c.message, c.line_start, 'llm' AS source
         FROM files f JOIN findings c ON c.filename = f.filename AND c.source = 'llm'"""),
)
def canned_findings(spark, sf_dir):
    canned = view(spark, sf_dir, "findings").where("source = 'llm'").withColumn("position", F.col("ord"))
    found = responses.canned_findings(view(spark, sf_dir, "files"), canned)
    return found.select("review_id", "file_id", "filename", "message", "line_start", "source")
