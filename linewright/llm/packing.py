"""Whole documents packed into sequences: linear grouping for the large, best fit for the small.

The plan depends on how many pieces there are of each length, and on nothing else. So the driver
solves it on at most ``capacity`` counts, whatever the number of documents, and says for each length
which ranks go to which sequences; tasks then look up the rank of each piece.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.llm.registry import query, table
from linewright.llm.token_files import _encoder, default_tokenizer, id_type
from linewright.session import cut_lineage

CAPACITY = 4096
#: Groups of equal cardinality; all pieces of a group count as long as its longest.
GROUPS = 100
#: Pieces longer than this share of a sequence are large; of these shares the best one is taken.
LARGE = (1 / 4, 1 / 3, 1 / 2)
#: Rows of a batch of pieces.
BATCH_PIECES = 4096

PIECES = "task int, doc_id long, piece int, start long, length int, nth long, ids binary"
PLACED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def configurations(sizes: list[int], demands: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Whole numbers of copies of configurations that cover no more than the demands.

    The linear programme over all configurations is solved by adding columns: a knapsack over the
    current prices gives the best new one, and where none is worth more than a sequence the
    basis is optimal. Copies are rounded down; what that leaves is at most one sequence for
    each size.
    """
    k = len(sizes)
    demand = np.array(demands, np.float64)
    basis = np.diag([float(capacity // s) for s in sizes])
    fits = capacity // min(sizes) if sizes else 0
    for _ in range(200 * k):
        copies = np.linalg.solve(basis, demand)
        prices = np.linalg.solve(basis.T, np.ones(k))
        value = np.zeros(capacity + 1)
        picks: list[np.ndarray] = []
        for _ in range(fits):
            best, pick = value.copy(), np.full(capacity + 1, -1)
            for i in range(k):
                if prices[i] > 0:
                    gained = value[: capacity + 1 - sizes[i]] + prices[i]
                    better = gained > best[sizes[i] :] + 1e-12
                    best[sizes[i] :][better] = gained[better]
                    pick[sizes[i] :][better] = i
            picks.append(pick)
            value = best
        if not k or value[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(picks):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        # A value is carried from level to level, so the walk down may leave room: still a valid column.
        step = np.linalg.solve(basis, column)
        out = np.where(step > 1e-9, copies / np.where(step > 1e-9, step, 1), np.inf)
        if column @ prices <= 1 + 1e-9 or not np.isfinite(out).any():
            break
        basis[:, int(out.argmin())] = column
    copies = np.linalg.solve(basis, demand) if k else np.zeros(0)
    left, found = list(demands), []
    for j in np.argsort(-copies, kind="stable"):
        column = basis[:, j].astype(int).tolist()
        n = int(math.floor(copies[j] + 1e-6))
        n = min([n, *[left[i] // a for i, a in enumerate(column) if a]])
        if n > 0:
            found.append((column, n))
            left = [x - n * a for x, a in zip(left, column)]
    return found


@dataclass
class Plan:
    """Rows ``length, first rank, after the last rank, first sequence, pieces a sequence, offset``.

    Of the pieces of one length, that of rank ``r`` is the ``r - first``-th of its row: sequences
    take ``per`` of them each, one behind the other from ``offset``.
    """

    capacity: int
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, n: int, first_sequence: int, per: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.rows.append((length, rank, rank + n, first_sequence, per, offset))
        self.used[length] = rank + n

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n


def _take(runs: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The next ``n`` pieces of a group as ``(length, count)``."""
    out = []
    while n:
        length, count = runs[-1]
        some = min(n, count)
        out.append((length, some))
        n -= some
        runs[-1][1] -= some
        if not runs[-1][1]:
            runs.pop()
    return out


def equal_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Groups of equal cardinality in falling length: the longest length, and the runs of lengths
    with the longest last."""
    total = sum(counts.values())
    ends = [total * (g + 1) // groups for g in range(groups)]
    out: list[tuple[int, list[list[int]]]] = []
    lengths = [[n, counts[n]] for n in sorted(counts)]
    at = 0
    for end in ends:
        if end > at:
            runs = _take(lengths, end - at)
            if out and out[-1][0] == runs[0][0]:
                out[-1] = (out[-1][0], [[n, c] for n, c in reversed(runs)] + out[-1][1])
            else:
                out.append((runs[0][0], [[n, c] for n, c in reversed(runs)]))
            at = end
    return out


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> Plan:
    """The plan with the fewest sequences over the shares in ``large``.

    A low share puts more pieces under the linear programme and leaves fewer to fill its gaps, so
    which one is best depends on how many small pieces there are. Stops where no plan can be better.
    """
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    best = None
    for share in large:
        plan = plan_packing(counts, capacity, groups, share)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == least:
            break
    return best


def plan_packing(counts: dict[int, int], capacity: int, groups: int, large: float) -> Plan:
    """Places for ``counts[length]`` pieces of each length from 1 to ``capacity``.

    Sequences are handled as bundles of equal ones. The large pieces make at most one bundle for each
    length and place of a configuration, the rest at most two new ones for each length, and each
    time a bundle takes a length its room at least halves: so the plan has less than ``4 * capacity *
    log2(capacity)`` rows, whatever the counts are.
    """
    plan = Plan(capacity)
    counts = {n: c for n, c in counts.items() if c}
    full = counts.pop(capacity, 0)
    if full:
        plan.put(capacity, full, plan.open(full), 1, 0)
    grouped = equal_groups({n: c for n, c in counts.items() if n > capacity * large}, groups)
    #: Room -> bundles of that room, as (first sequence, sequences).
    bundles: dict[int, list[tuple[int, int]]] = {}
    pools = [runs for _, runs in grouped]
    for column, copies in configurations([n for n, _ in grouped], [sum(c for _, c in runs) for runs in pools], capacity):
        # Actual pieces take the places; where any place changes its length a new bundle begins.
        places = [_take(pools[g], copies) for g, a in enumerate(column) for _ in range(a)]
        first = plan.open(copies)
        edges = sorted({0, *(int(e) for p in places for e in np.cumsum([c for _, c in p]))})
        inside = [0] * len(places)
        ends = [p[0][1] for p in places]
        for a, b in zip(edges, edges[1:]):
            offset = 0
            for i, place in enumerate(places):
                while ends[i] <= a:
                    inside[i] += 1
                    ends[i] += place[inside[i]][1]
                length = place[inside[i]][0]
                plan.put(length, b - a, first + a, 1, offset)
                offset += length
            bundles.setdefault(capacity - offset, []).append((first + a, b - a))
    rest = {n: c for n, c in counts.items() if n <= capacity * large}
    for runs in pools:
        for n, c in runs:
            rest[n] = rest.get(n, 0) + c
    rooms = sorted(bundles)
    for length in sorted(rest, reverse=True):
        left = rest[length]
        fresh: dict[int, list[tuple[int, int]]] = {}
        keep = [r for r in rooms if r < length]
        for room in rooms[len(keep) :]:
            waiting = bundles.pop(room)
            per = room // length
            while waiting and left:
                first, n = waiting.pop()
                whole = min(n, left // per)
                if whole:
                    plan.put(length, whole * per, first, per, capacity - room)
                    fresh.setdefault(room - per * length, []).append((first, whole))
                    left -= whole * per
                if whole < n and left:
                    # Fewer than one sequence of this bundle takes.
                    plan.put(length, left, first + whole, left, capacity - room)
                    fresh.setdefault(room - left * length, []).append((first + whole, 1))
                    whole, left = whole + 1, 0
                if whole < n:
                    waiting.append((first + whole, n - whole))
            if waiting:
                bundles[room] = waiting
                insort(keep, room)
            if not left:
                keep = sorted({*keep, *(r for r in rooms if r > room)})
                break
        if left:
            per = capacity // length
            for some, each in ((left // per, per), (int(left % per > 0), left % per)):
                if some:
                    first = plan.open(some)
                    plan.put(length, some * each, first, each, 0)
                    fresh.setdefault(capacity - each * length, []).append((first, some))
        for room, some in fresh.items():
            bundles.setdefault(room, []).extend(some)
        rooms = sorted({*keep, *fresh})
    return plan


def _piece_batches(tokenizer_file: str, dtype: str, end_id: int, capacity: int):
    schema = pa.schema([("task", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer_file, dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        width, span = len(end), len(end) * capacity
        seen = [0] * (capacity + 1)
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            arrays = [pa.array([task] * len(columns[0]), pa.int32())]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encoder.encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(data), span)):
                    ids = data[at : at + span]
                    n = len(ids) // width
                    rows.append((doc_id, piece, at // width, n, seen[n], ids))
                    seen[n] += 1
                    if len(rows) == BATCH_PIECES:
                        yield made()
        if rows:
            yield made()

    return run


def _place_batches(plan_rows: np.ndarray, dtype: str):
    """Sequence and offset of each piece; ids become 32 bits wide."""
    length, first, _, sequence, per, offset = plan_rows.T
    # Ranks are below 2**50, so length and rank make one sortable number.
    keys = (length << 50) + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            row = np.searchsorted(keys, (n << 50) + rank, side="right") - 1
            nth = rank - first[row]
            ids = [np.frombuffer(b, dtype).astype("<u4").tobytes() for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("piece"), batch.column("start"), pa.array(n),
                 pa.array(ids, pa.binary()), pa.array(sequence[row] + nth // per[row]), pa.array(offset[row] + nth % per[row] * n)],
                names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 1, groups: int = GROUPS,
    large: tuple[float, ...] = LARGE,
) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``, one row per piece.

    ``ids`` are little-endian unsigned 32-bit numbers. Documents of up to ``capacity`` ids, with their
    end id, stay whole; longer ones are cut into pieces of ``capacity``, of which the last may be
    shorter. Pieces of a sequence follow each other without gaps from 0.

    Each task numbers its pieces of one length as it writes them. A piece's rank is that number plus
    the pieces of that length in the tasks before it, so no length needs a sort or a window over its pieces,
    however many there are. What a window reads is one row per task and length.

    Needs ``doc_id, text``; other columns are not read. Null and empty texts are the end id alone.
    Null ids are kept; rows that repeat are packed each. An empty table gives no rows. Which of
    several pieces of one length goes where follows the order of the input files.
    """
    dtype = id_type(tokenizer_file)
    pieces = cut_lineage(
        docs.select("doc_id", "text").mapInArrow(_piece_batches(tokenizer_file, dtype, end_id, capacity), PIECES), "pieces"
    )
    counted = cut_lineage(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_plan(counts, capacity, groups, large)
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", (F.col("base") + F.col("nth")).alias("rank"), "ids"
    )
    return ranked.mapInArrow(_place_batches(rows, dtype), PLACED)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, pieces``: the ids of each sequence, and which pieces they are.

    A sequence holds at most ``capacity`` ids, which bounds its row.
    """
    part = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    grouped = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("_parts"))
    return grouped.select(
        "sequence_id", "n_tokens",
        F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["ids"])), "")).alias("ids"),
        F.transform("_parts", lambda p: p.dropFields("ids")).alias("pieces"),
    )


@query("op12_best_fit_packing")
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
