"""Running sums and ranks that no single key can turn into one task.

A window over a key puts all its rows into one task. Here the rows of a key are cut into
blocks of the order column; each block is summed alone, and the block totals are summed up
the same way one level higher.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

BLOCK = 1 << 15


def running_sum_before(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, levels: int | None = None
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the key with a smaller ``order``.

    ``order`` is a number from 0, unique per key, so a block holds at most ``BLOCK`` rows
    however hot the key is. One level leaves at most 2**16 block totals per key for an
    int, two levels 2**15 for a long up to 2**45.
    """
    if levels is None:
        levels = 1 if isinstance(df.schema[order].dataType, IntegerType) else 2
    before = (Window.unboundedPreceding, -1)
    if levels == 0:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(*before)
        return df.withColumn(out, F.coalesce(F.sum(value).over(window), F.lit(0)))
    block, local, base, total = (f"_{name}{levels}" for name in ("block", "local", "base", "total"))
    blocked = df.withColumn(block, F.floor(F.col(order) / F.lit(BLOCK)).cast("long"))
    totals = blocked.groupBy(*keys, block).agg(F.sum(value).alias(total))
    bases = running_sum_before(totals, keys, block, total, base, levels - 1).drop(total)
    window = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(*before)
    summed = blocked.withColumn(local, F.coalesce(F.sum(value).over(window), F.lit(0)))
    return (
        summed.join(bases, [*keys, block])
        .withColumn(out, F.col(base) + F.col(local))
        .drop(block, base, local)
    )


def running_rank(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Adds ``out``: the 1-based position of a row in its key by a unique integer ``order``."""
    counted = running_sum_before(df.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", out)
    return counted.withColumn(out, F.col(out) + 1).drop("_one")
