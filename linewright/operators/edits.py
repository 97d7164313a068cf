"""Line shifts by applied edits, feedback and deletes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions import text
from linewright.operators.groups import gather, whole_groups
from linewright.operators.spread import BLOCK, running_sum_before
from linewright.session import cut_lineage

DIGITS = 256
#: Questions come before the fix of their own turn.
START, END, FILED = 0, 1, 2


def adjust_lines(lines: DataFrame, edits: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Adds ``adjusted``: the line after all edits strictly above it.

    Edits shrink to one delta per file and line, map-side; the running sum over those goes
    block by block, so neither a hot file nor a hot line ends in one task.
    """
    deltas = edits.select(
        *keys, F.col("original_line").alias("_line"), (F.col("inserted") - F.col("removed")).cast("long").alias("_d")
    )
    asked = lines.select(*keys, F.col(line).alias("_line"), F.lit(0).cast("long").alias("_d"))
    points = deltas.unionByName(asked).groupBy(*keys, "_line").agg(F.sum("_d").alias("_d"))
    shifts = running_sum_before(points, keys, "_line", "_d", "_shift").drop("_d")
    return (
        lines.withColumn("_line", F.col(line))
        .join(shifts, [*keys, "_line"])
        .withColumn("adjusted", F.col(line) + F.col("_shift"))
        .drop("_line", "_shift")
    )


def _sums_below(digit: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """Per row, the sum over the rows before it with a smaller digit, in steps of as many rows as there are digits."""
    out = np.zeros(len(digit), np.int64)
    held = np.zeros(DIGITS, np.int64)
    for a in range(0, len(digit), DIGITS):
        d, v = digit[a : a + DIGITS], delta[a : a + DIGITS]
        below = np.concatenate([[0], np.cumsum(held)[:-1]])
        smaller = np.tril(d[None, :] < d[:, None], -1)
        out[a : a + DIGITS] = below[d] + smaller @ v
        np.add.at(held, d, v)
    return out


def _sum_batches(keys: list[str]):
    """Answers of the questions in whole blocks of nodes, ordered by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, [*keys, "_level", "_prefix", "_block"]):
            digit, delta, side = (table.column(c).to_numpy() for c in ("_digit", "_d", "_side"))
            sums = np.zeros(table.num_rows, np.int64)
            for a, b in bounds:
                sums[a:b] = _sums_below(digit[a:b], delta[a:b])
            told = np.flatnonzero((side != FILED) & (sums != 0))
            picked = table.select([*keys, "_seq", "_side"]).take(pa.array(told)).append_column("_sum", pa.array(sums[told]))
            yield from picked.to_batches()

    return run


def apply_in_sequence(findings: DataFrame, keys: list[str], seq: str = "ord") -> DataFrame:
    """Adds ``new_start`` and ``new_end``: lines after the fixes applied earlier above them.

    The shift of a finding is a sum over two orders at once, an earlier turn and a smaller line. Lines are read
    as digits to the base 256. A smaller line agrees with the asked one down to some digit, where its own is
    smaller; so every fix is filed under its prefix at each digit, every question looks there, and
    under one prefix what is left is a sum over earlier turns with smaller digits. That costs one row
    per digit, of which the longest line of the file has at most four.

    A key with many findings is cut into blocks of turns; each block begins with what the ones before it sum
    up to per digit, so no task holds more than a block of one prefix. ``keys`` are whole numbers.
    """
    fix_lines = text.line_count(F.col("suggested_fix"))
    has_fix = F.coalesce("suggested_fix", F.lit("")) != ""
    base = findings.select(
        *keys,
        F.col(seq).cast("long").alias("_seq"),
        F.col("line_start").cast("long").alias("_start"),
        F.col("line_end").cast("long").alias("_end"),
        F.when(has_fix, fix_lines - (F.col("line_end") - F.col("line_start") + 1)).cast("long").alias("_d"),
    )
    # Digits above the highest one of a file's lines are zero in all of them.
    highest = F.length(F.bin(F.max(F.greatest("_start", "_end")))) - 1
    sizes = base.groupBy(*keys).agg(F.floor(highest / 8).cast("int").alias("_top"), F.count(F.lit(1)).alias("_n"))
    block = F.when(F.col("_n") > BLOCK, F.floor(F.col("_seq") / BLOCK)).otherwise(0).cast("long")
    # Fixes and questions are read from it several times; written once, none of them joins and sorts it again.
    base = cut_lineage(base.join(sizes, keys).withColumn("_block", block).withColumn("_many", F.col("_n") > BLOCK).drop("_n"), "turns")

    def under(line: str):
        def place(k: Column) -> Column:
            node = F.call_function("shiftright", F.col(line), (k * 8).cast("int"))
            return F.struct(
                k.alias("_level"), F.call_function("shiftright", node, F.lit(8)).alias("_prefix"), F.pmod(node, F.lit(DIGITS)).cast("int").alias("_digit")
            )

        return F.transform(F.sequence(F.lit(0), F.col("_top")), place)

    def rows(df: DataFrame, line: str, side: int, delta: Column) -> DataFrame:
        spread = df.select(*keys, "_block", "_seq", F.explode(under(line)).alias("_at"), delta.alias("_d"))
        return spread.select(*keys, "_at.*", "_block", "_seq", F.lit(side).alias("_side"), "_d")

    none = F.lit(0).cast("long")
    def points_of(turns: DataFrame) -> list[DataFrame]:
        asked = [rows(turns, line, side, none).where("_digit > 0") for line, side in (("_start", START), ("_end", END))]
        return [rows(turns.where("_d <> 0"), "_start", FILED, F.col("_d")), *asked]

    # What earlier blocks of a node come to, for each digit that it has anywhere.
    node = [*keys, "_level", "_prefix"]
    filed, *asked = points_of(base.where("_many"))
    per_digit = filed.groupBy(*node, "_digit", "_block").agg(F.sum("_d").alias("_d"))
    blocks = asked[0].select(*node, "_block").unionByName(asked[1].select(*node, "_block")).distinct()
    every = per_digit.select(*node, "_digit").distinct().join(blocks, node).withColumn("_d", none).unionByName(
        per_digit.select(*node, "_digit", "_block", "_d")
    )
    grid = every.groupBy(*node, "_digit", "_block").agg(F.sum("_d").alias("_d"))
    begins = running_sum_before(grid, [*node, "_digit"], "_block", "_d", "_held").where("_held <> 0")
    carried = begins.select(*node, "_digit", "_block", F.lit(-(2**63) + 1).alias("_seq"), F.lit(FILED).alias("_side"), F.col("_held").alias("_d"))
    filed, *asked = points_of(base)
    points = filed.unionByName(asked[0]).unionByName(asked[1]).unionByName(carried)
    # A finding asks before its own fix counts.
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    sums = gather(points, [*node, "_block"], "_seq", "_side").mapInArrow(_sum_batches(keys), f"{kinds}, _seq long, _side int, _sum long")
    shifts = sums.groupBy(*keys, "_seq").agg(
        F.sum(F.when(F.col("_side") == START, F.col("_sum"))).alias("_ds"), F.sum(F.when(F.col("_side") == END, F.col("_sum"))).alias("_de")
    )
    return (
        findings.withColumn("_seq", F.col(seq).cast("long"))
        .join(shifts, [*keys, "_seq"], "left")
        .withColumn("new_start", F.col("line_start") + F.coalesce("_ds", F.lit(0)))
        .withColumn("new_end", F.col("line_end") + F.coalesce("_de", F.lit(0)))
        .drop("_seq", "_ds", "_de")
    )


def latest_feedback(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """Each finding with the feedback that came last."""
    last = feedback.groupBy(F.col("finding_ord").alias("ord")).agg(
        F.max_by("feedback", "seq").alias("feedback")
    )
    return findings.join(last, "ord", "left")


def cascade_delete(
    removed: DataFrame, reviews: DataFrame, files: DataFrame, findings: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of the three tables once the ``removed`` reviews are gone."""
    gone = removed.select("review_id").distinct()
    files_left = files.join(gone, "review_id", "left_anti")
    files_gone = files.join(gone, "review_id", "left_semi").select("review_id", "file_ord")
    return (
        reviews.join(gone, "review_id", "left_anti"),
        files_left,
        findings.join(files_gone, ["review_id", "file_ord"], "left_anti"),
    )
