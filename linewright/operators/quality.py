"""Detection quality against expected bugs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright import fixed_values as fv

FILE = ["review_id", "file_id"]
#: A block and the tolerance on both sides of it fit into the 63 bits of a positive long.
BLOCK_LINES = 32


def _near(rows: DataFrame, others: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``: some of ``others`` lies within tolerance in the same file and category.

    Lines are cut into blocks of ``BLOCK_LINES``. The others shrink map-side to one number per block, whose
    bits are the lines taken in the block and within tolerance of it; a row finds the one of its own block and
    tests the bits around its line. So no row is spread over lines or paired with another.
    """
    reach = fv.BUG_TOLERANCE
    line = F.col("line_start").cast("long")

    def block(at: F.Column) -> F.Column:
        return F.floor(at / BLOCK_LINES).cast("long")

    def shifted(value: int, by: F.Column) -> F.Column:
        return F.call_function("shiftleft", F.lit(value).cast("long"), by.cast("int"))

    taken = (
        others.select(*FILE, "category", line.alias("_line"), F.explode(F.sequence(block(line - reach), block(line + reach))).alias("_block"))
        .groupBy(*FILE, "category", "_block")
        .agg(F.bit_or(shifted(1, F.col("_line") - F.col("_block") * BLOCK_LINES + reach)).alias("_taken"))
    )
    window = shifted((1 << (2 * reach + 1)) - 1, line - F.col("_block") * BLOCK_LINES)
    near = F.coalesce(F.col("_taken").bitwiseAND(window) != 0, F.lit(False))
    return (
        rows.withColumn("_block", block(line))
        .join(taken, [*FILE, "category", "_block"], "left")
        .select(*[F.col(c) for c in rows.columns], near.alias(out))
    )


def judged_bugs(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """Expected bugs with ``found``; bugs of files without findings are not found."""
    return _near(expected, findings, "found")


def recall_counts(expected: DataFrame, findings: DataFrame) -> DataFrame:
    return judged_bugs(expected, findings).groupBy("review_id").agg(
        F.count_if("found").alias("true_positives"),
        F.count_if(~F.col("found")).alias("false_negatives"),
    )


def false_positives(findings: DataFrame, expected: DataFrame, known_files: DataFrame | None = None) -> DataFrame:
    """Findings of known files that fit no bug; mere infos do not count.

    ``known_files`` are the files named in the expectation, also those without any bug.
    """
    named = (expected if known_files is None else known_files).select(*FILE).distinct()
    told = findings.where(F.col("severity") != "info").join(named, FILE, "left_semi")
    return _near(told, expected, "_fits").where(~F.col("_fits")).drop("_fits")


def precision_recall(expected: DataFrame, findings: DataFrame, known_files: DataFrame | None = None) -> DataFrame:
    """One row of counts and ratios; a ratio without a base is 0."""
    counts = [
        judged_bugs(expected, findings).agg(
            F.count_if("found").alias("true_positives"),
            F.count_if(~F.col("found")).alias("false_negatives"),
            F.count(F.lit(1)).alias("planted"),
        ),
        false_positives(findings, expected, known_files).agg(F.count(F.lit(1)).alias("false_positives")),
        findings.agg(F.count(F.lit(1)).alias("generated")),
    ]
    names = ("true_positives", "false_negatives", "planted", "false_positives", "generated")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts)
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return (
        rows.agg(*[F.sum(name).alias(name) for name in names])
        .withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)))
        .withColumn("recall", F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)))
    )
