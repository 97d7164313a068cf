"""Groups inside the Arrow batches of a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gather(df: DataFrame, keys: list[str], *order: str, spread: bool = True) -> DataFrame:
    """Each key's rows in one partition, sorted by ``keys`` and ``order``.

    An Arrow map asks nothing of its input, so a plain repartition by ``keys`` below it may
    be planned away where a join or union already has that layout, and the layout is lost
    when AQE turns the join into a broadcast or merges partitions. A hash of the keys is
    an expression of its own, and this exchange always stays.

    With ``spread`` the number of partitions is given: without it AQE merges them by their bytes, and
    narrow rows of numbers, over which the map does its work, end up in one task.
    """
    parts = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if spread else []
    return df.repartition(*parts, F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables that hold whole groups only, with the bounds of each group.

    Rows arrive sorted by ``keys``. Handling many small groups per batch avoids the fixed
    cost a grouped pandas call has for each; only a group that runs over the end of a
    batch is kept for the next one.
    """

    def changes(rows) -> np.ndarray:
        differs = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
        for key in keys:
            values = rows.column(key).to_numpy(zero_copy_only=False) if isinstance(
                rows, pa.RecordBatch
            ) else rows.column(key).to_numpy()
            differs |= values[1:] != values[:-1]
        return np.flatnonzero(differs) + 1

    def head(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(key)[row].as_py() for key in keys)

    def emit(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        edges = [0, *changes(table).tolist(), table.num_rows]
        return table, list(zip(edges, edges[1:]))

    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        edges = changes(batch)
        if pending and head(pending[-1], pending[-1].num_rows - 1) != head(batch, 0):
            yield emit(pending)
            pending = []
        if len(edges):
            last = int(edges[-1])
            yield emit([*pending, batch.slice(0, last)])
            pending = [batch.slice(last)]
        else:
            pending.append(batch)
    if pending:
        yield emit(pending)
