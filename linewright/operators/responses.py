"""Findings out of model responses.

Responses are parsed to VARIANT, which keeps the JSON types apart; reading into a struct
would quietly turn a quoted number into a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import patterns, text

_SAFE_INTEGER = float(2**53 - 1)


def clean(raw: Column) -> Column:
    """The response without code fences and outer white space."""
    opened = F.regexp_replace(raw, f"```json{patterns.SPACE}*", "")
    return text.trim_space(F.regexp_replace(opened, f"```{patterns.SPACE}*", ""))


def items(parsed: Column) -> Column:
    """Elements of a JSON array; null for anything else."""
    return F.try_variant_get(parsed, "$", "array<variant>")


def parse(responses: DataFrame) -> DataFrame:
    """Adds ``parsed`` (VARIANT, null where the text is no JSON)."""
    return responses.withColumn("parsed", F.try_parse_json(clean(F.col("raw"))))


def _kind(item: Column, field: str) -> Column:
    """JSON type of a field: null if absent, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))


def _is_text(item: Column, field: str) -> Column:
    return _kind(item, field) == "STRING"


def _is_number(item: Column, field: str) -> Column:
    kind = _kind(item, field)
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _number(item: Column, field: str) -> Column:
    return F.try_variant_get(item, f"$.{field}", "double")


def _text(item: Column, field: str) -> Column:
    return F.try_variant_get(item, f"$.{field}", "string")


def _positive_integer(item: Column, field: str) -> Column:
    value = _number(item, field)
    return _is_number(item, field) & (value > 0) & (value == F.floor(value)) & (value <= _SAFE_INTEGER)


def _is_finding(item: Column) -> Column:
    fix, sure = _kind(item, "suggestedFix"), _number(item, "confidence")
    return F.coalesce(
        _is_text(item, "filename")
        & _is_text(item, "message")
        & _positive_integer(item, "lineStart")
        & _positive_integer(item, "lineEnd")
        & _is_text(item, "severity") & _text(item, "severity").isin(*fv.SEVERITIES)
        & _is_text(item, "category") & _text(item, "category").isin(*fv.CATEGORIES)
        & (fix.isNull() | fix.isin("STRING", "VOID"))
        & _is_number(item, "confidence") & (sure >= 0) & (sure <= 1),
        F.lit(False),
    )


def validate(responses: DataFrame) -> DataFrame:
    """Adds ``valid``: every element fits; one bad element rejects the whole response."""
    parsed = parse(responses)
    return parsed.withColumn("valid", F.coalesce(F.forall(items(F.col("parsed")), _is_finding), F.lit(False)))


def findings(responses: DataFrame) -> DataFrame:
    """Findings of the accepted responses, in response order."""
    keys = responses.columns
    good = validate(responses).where("valid")
    item = F.col("item")
    return good.select(
        *[k for k in keys if k != "raw"], F.posexplode(items(F.col("parsed"))).alias("position", "item")
    ).select(
        *[k for k in keys if k != "raw"],
        F.lit("llm").alias("source"),
        _text(item, "filename").alias("filename"),
        _text(item, "category").alias("category"),
        _text(item, "severity").alias("severity"),
        _text(item, "message").alias("message"),
        _number(item, "lineStart").cast("int").alias("line_start"),
        _number(item, "lineEnd").cast("int").alias("line_end"),
        F.when(_kind(item, "suggestedFix") == "STRING", _text(item, "suggestedFix")).alias("suggested_fix"),
        _number(item, "confidence").alias("confidence"),
        F.col("position").cast("long").alias("position"),
    )


def status(responses: DataFrame) -> DataFrame:
    """What became of each response; a bad one adds no findings and stops nothing."""
    judged = validate(responses)
    return judged.withColumn(
        "status",
        F.when(F.col("parsed").isNull(), "not json").when(F.col("valid"), "accepted").otherwise("rejected"),
    ).withColumn(
        "findings", F.when(F.col("valid"), F.size(items(F.col("parsed")))).otherwise(0).cast("long")
    ).drop("parsed", "valid", "raw")


def attribute(found: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``file_id`` by name within the review; null for files the review lacks.

    A name that several files of a review share means the first of them, so no finding doubles.
    """
    names = files.groupBy("review_id", "filename").agg(F.min("file_id").alias("file_id"))
    return found.join(names, ["review_id", "filename"], "left")


def unattributed(attributed: DataFrame) -> DataFrame:
    """Findings that name no file of their review, counted per name."""
    lost = attributed.where(F.col("file_id").isNull())
    return lost.groupBy("review_id", "filename").agg(F.count(F.lit(1)).alias("findings"))


def canned_findings(files: DataFrame, canned: DataFrame) -> DataFrame:
    """Stored findings of files by name; files without an entry have none."""
    stored = canned.select(
        "filename", "category", "severity", "message", "line_start", "line_end",
        "suggested_fix", "confidence", "position",
    )
    return files.select("review_id", "file_id", "filename").join(stored, "filename").withColumn(
        "source", F.lit("llm")
    )
