"""Line scan with the fixed rule catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import patterns, text

# Literals a line must hold for a rule to have a chance: one out of each inner tuple.
# Looking for literals is a byte search; only lines that pass pay for the regex.
_DIGITS = tuple("0123456789")
_NEEDS: dict[str, tuple[tuple[str, ...], ...]] = {
    "hardcoded-aws-key": (("AKIA", "ASIA"),),
    "hardcoded-generic-secret": (("'", '"'), ("=", ":")),
    "hardcoded-private-key": (("-----BEGIN ",),),
    "hardcoded-jwt-secret": (("jwt", "JWT"), ("'", '"')),
    "sql-string-concat": (
        ("+", "${", "%s", "%S", "%d", "%D", ".f", ".F", "f'", "F'", 'f"', 'F"'),
    ),
    "dangerous-eval": (("(",), ("eval", "exec")),
    "dangerous-deserialize": (("pickle", "yaml", "unserialize", "Marshal", "ObjectInputStream"),),
    "innerHTML-xss": (("nnerHTML", "v-html"),),
    "shell-injection": (("(",), ("os.system", "subprocess", "Runtime", "exec.Command")),
    "todo-fixme": (("//", "#", "/*"),),
    "console-log": (("console.log", "System.out.println", "fmt.Println"),),
    "magic-number": (_DIGITS, ("if", "while", "for", "return", "=", "<", ">")),
    "commented-out-code": (("//", "#"),),
    "empty-catch": (("catch",), ("{",)),
    "hardcoded-ip": (("'", '"'), _DIGITS),
    "hardcoded-url": (("'", '"'), ("://",)),
}

RULE_ORDER = {rule[0]: i for i, rule in enumerate(fv.LINE_RULES)}

FINDING_COLUMNS = (
    "review_id", "file_id", "filename", "source", "category", "severity", "message",
    "line_start", "line_end", "rule_id", "code_snippet", "suggested_fix", "fix_status",
    "confidence", "ord",
)


def has_literals(line: Column, needs: tuple[tuple[str, ...], ...]) -> Column:
    groups = [reduce(lambda a, b: a | b, [line.contains(word) for word in group]) for group in needs]
    return reduce(lambda a, b: a & b, groups)


def rule_match(line: Column, rule: str) -> Column:
    """True where one catalogue rule fires on a line."""
    _, pattern, ignore_case, *_ = fv.LINE_RULES[RULE_ORDER[rule]]
    return has_literals(line, _NEEDS[rule]) & line.rlike(patterns.jvm(pattern, ignore_case))


def rule_numbers(line: Column, rules=None) -> Column:
    """Array of the positions of the rules that fire on a line, in rule order."""
    hits = [
        F.when(rule_match(line, name), F.lit(position))
        for name, position in RULE_ORDER.items()
        if rules is None or name in rules
    ]
    return F.array_compact(F.array(*hits))


def explode_lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line, numbered from 1; empty contents have no lines to look at."""
    return files.where(F.col("content") != "").select(
        *keep, F.posexplode(text.split_lines(F.col("content"))).alias("pos", "line")
    ).select(*keep, (F.col("pos") + 1).alias("line_no"), "line")


def catalogue(spark: SparkSession) -> DataFrame:
    """The rules as a table of sixteen rows."""
    rows = [
        (position, name, severity, category, message)
        for position, (name, _, _, severity, category, message) in enumerate(fv.LINE_RULES)
    ]
    return spark.createDataFrame(
        rows, "rule_ord int, rule_id string, severity string, category string, message string"
    )


def line_hits(files: DataFrame, *keep: str, rules=None) -> DataFrame:
    """Rows ``(*keep, line_no, rule_ord)``, one per rule and line; no shuffle."""
    lines = explode_lines(files, *keep)
    return lines.select(*keep, "line_no", F.explode(rule_numbers(F.col("line"), rules)).alias("rule_ord"))


def scan(files: DataFrame) -> DataFrame:
    """Pattern findings of files in the canonical schema.

    Narrow from the scan to the findings: lines are generated, tested and dropped inside
    one stage, and the rule texts come from constants instead of a join.
    ``ord`` grows by line, then by rule.
    """
    hits = line_hits(files, "review_id", "file_id", "filename")
    names, severities, categories, messages = (
        F.array(*[F.lit(rule[field]) for rule in fv.LINE_RULES]) for field in (0, 3, 4, 5)
    )
    place = F.col("rule_ord") + 1
    return hits.select(
        "review_id",
        "file_id",
        "filename",
        F.lit("pattern").alias("source"),
        F.element_at(categories, place).alias("category"),
        F.element_at(severities, place).alias("severity"),
        F.element_at(messages, place).alias("message"),
        F.col("line_no").alias("line_start"),
        F.col("line_no").alias("line_end"),
        F.element_at(names, place).alias("rule_id"),
        F.lit(None).cast("string").alias("code_snippet"),
        F.lit(None).cast("string").alias("suggested_fix"),
        F.lit(None).cast("string").alias("fix_status"),
        F.lit(None).cast("double").alias("confidence"),
        (F.col("line_no").cast("long") * len(fv.LINE_RULES) + F.col("rule_ord")).alias("ord"),
    )


def rule_counts(findings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Hits per rule, severity, category and language; summed map-side first."""
    if files is not None:
        findings = findings.join(files.select("file_id", "language"), "file_id")
    elif "language" not in findings.columns:
        findings = findings.withColumn("language", text.detect_language(F.col("filename")))
    return findings.groupBy("rule_id", "severity", "category", "language").agg(
        F.count(F.lit(1)).alias("hits")
    )
