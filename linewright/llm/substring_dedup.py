"""Repeated substrings by doubling hashes and sampled positions.

The string of 2h bytes at a position gets its number from the pair (number of h bytes there, number of h
bytes h further on), as in prefix doubling; but the numbers are 64-bit hashes, made inside the task
for all positions of its own texts and for 8, 16, ... 256 bytes. Nothing is sorted or ranked again
between lengths. Spark groups hashes of strings, in three fixed steps.

Comparing every position would move several times the text at every length. Each string of
``length`` bytes therefore has one of its positions stand for it: the one with the smallest
rank of ``ANCHOR`` bytes inside it, which equal strings have at the same place. An anchor
stands for a run of strings that start one after the other. At first the run is compared as a
whole, then in parts of ``PART`` starts, then start by start. At every step

* a part whose outer string (the union of its strings) has a partner is repeated throughout,
* a part whose inner string (what its strings share) is unique is repeated nowhere,
* any other part is taken on, and of equal parts one is enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm.registry import query, table
from linewright.session import Steps, cut_lineage

#: Bytes of the string whose rank picks anchors, and the longest string ranked directly.
ANCHOR = 128
RANKED = 256
#: Starts in a part of a run.
PART = 32
#: Bytes that are ranked together; longer texts are cut with an overlap.
BUFFER = 1 << 20

_TEXT = "t1 long, t2 long"
ANCHORS = f"{_TEXT}, pos int, lo int, hi int, c1 long, q1 long, q2 long"
REGIONS = f"{_TEXT}, pos int, lo int, hi int, settled boolean, body binary"
PARTS = f"{_TEXT}, pos int, lo int, o1 int, o2 int, settled boolean, body binary, c1 long, c2 long, q1 long, q2 long"
STARTS = f"{_TEXT}, start int, settled boolean, c1 long, c2 long, q1 long, q2 long"
KEPT = f"{_TEXT}, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _mix(x: np.ndarray) -> np.ndarray:
    """``mixed`` in the array's own memory, with one more array for all steps."""
    spare = x >> np.uint64(33)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= spare
        x *= np.uint64(factor)
        np.right_shift(x, np.uint64(33), out=spare)
    x ^= spare
    return x


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of a pair of ranks."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    return _mix(x)


def ranks(data: np.ndarray, up_to: int = RANKED) -> dict[int, np.ndarray]:
    """Ranks of the strings of 8, 16, ... ``up_to`` bytes at every position that has them."""
    n = len(data)
    first = np.zeros(max(0, n - 7), np.uint64)
    for i in range(min(8, len(first))):
        # Every eighth position at once: the bytes from there on, read as numbers.
        first[i::8] = np.frombuffer(data, "<u8", (n - i) // 8, i)
    first += np.uint64(1)
    made = {8: _mix(first)}
    h = 8
    while h < up_to:
        shorter = made[h]
        count = max(0, n - 2 * h + 1)
        made[2 * h] = _pair(shorter[:count], shorter[h : h + count])
        h *= 2
    return made


def _long_rank(rank: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two ranks that cover ``length`` bytes from ``at``, for up to 3 * RANKED bytes."""
    middle = np.minimum(RANKED, length - RANKED)
    return _pair(rank[at], rank[at + middle]), rank[at + length - RANKED]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _windows_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, from running minima inside blocks."""
    count = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    square = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(square, axis=1).ravel()
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:count], forward[width - 1 : width - 1 + count])


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int):
    """Anchors of the texts in a buffer: position, first and last start they stand for, and the
    ranks of the anchor string and of the run's outer string. ``starts`` are ascending."""
    ranked = ranks(data)
    short, long = ranked[ANCHOR], ranked[RANKED]
    low = np.uint64((1 << 24) - 1)
    keys = (short & ~low) | np.arange(len(short), dtype=np.uint64)
    owner = (_windows_min(keys, length - ANCHOR + 1) & low).astype(np.int64)
    inside = np.zeros(len(owner) + 1, np.int64)
    fits = sizes >= length
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, starts[fits] + sizes[fits] - length + 1, -1)
    begin = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(begin):
        return None
    own = owner[begin]
    edge = np.flatnonzero(own[1:] != own[:-1]) + 1
    lo = begin[np.concatenate([[0], edge])]
    hi = begin[np.concatenate([edge - 1, [len(begin) - 1]])]
    at = own[np.concatenate([[0], edge])]
    q1, q2 = _long_rank(long, lo, length + hi - lo)
    # The place of the anchor in its run belongs to what must be equal.
    q1 = _pair(q1, (at - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64))
    return at, lo, hi, short[at], q1, q2


def _buffers(bodies: list[bytes], overlap: int) -> Iterator[tuple]:
    """Texts put one after the other into buffers: data, starts, sizes, row numbers, offsets."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def made():
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        sizes = np.array([len(p) for _, _, p in held], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return data, starts, sizes, np.array([r for r, _, _ in held]), np.array([o for _, o, _ in held])

    for row, body in enumerate(bodies):
        for offset in range(0, max(1, len(body) - overlap), BUFFER):
            piece = body[offset : offset + BUFFER + overlap]
            if held and size + len(piece) > BUFFER + overlap:
                yield made()
                held, size = [], 0
            held.append((row, offset, piece))
            size += len(piece)
    if held:
        yield made()


def _anchor_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(i).to_numpy() for i in (0, 1))
            bodies = batch.column(2).to_pylist()
            wanted = [i for i, b in enumerate(bodies) if len(b) >= length]
            seen = {(t1[i], t2[i]): i for i in wanted}
            wanted = sorted(seen.values())
            for data, starts, sizes, rows, offsets in _buffers([bodies[i] for i in wanted], length - 1):
                if len(data) < length:
                    continue
                found = anchors(data, starts, sizes, length)
                if found is None:
                    continue
                at, lo, hi, c1, q1, q2 = found
                piece = np.searchsorted(starts, lo, side="right") - 1
                base = offsets[piece] - starts[piece]
                row = np.array(wanted)[rows[piece]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(t1[row]), pa.array(t2[row]),
                        *[pa.array((x + base).astype(np.int32)) for x in (at, lo, hi)],
                        _signed(c1), _signed(q1), _signed(q2),
                    ],
                    names=["t1", "t2", "pos", "lo", "hi", "c1", "q1", "q2"],
                )

    return run


def _region_batches(length: int):
    """Cut out of each text the bytes of the runs that go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, runs, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                # A text may come more than once; each run is one row of its text.
                rows = [
                    {"t1": t1, "t2": t2, **r, "body": body[r["lo"] : r["hi"] + length]} for r in runs
                ]
                yield pa.RecordBatch.from_pylist(
                    rows,
                    schema=pa.schema(
                        [("t1", pa.int64()), ("t2", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()),
                         ("hi", pa.int32()), ("settled", pa.bool_()), ("body", pa.binary())]
                    ),
                )

    return run


def _part_batches(length: int):
    """Parts of ``PART`` starts with the ranks of their inner and outer strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("t1", "t2", "pos", "lo", "hi", "settled")}
            for data, starts, _, rows, _ in _buffers(bodies, 3 * RANKED):
                rank = ranks(data)[RANKED]
                c = {n: v[rows] for n, v in columns.items()}
                place = c["pos"].astype(np.int64) - c["lo"]
                least = c["pos"].astype(np.int64) - c["hi"]
                first, last = least // PART, place // PART
                count = last - first + 1
                i = np.repeat(np.arange(len(rows)), count)
                g = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + first[i]
                o1, o2 = np.maximum(g * PART, least[i]), np.minimum(g * PART + PART - 1, place[i])
                inner = starts[i] + place[i] - g * PART
                c1 = _pair(rank[inner], g.astype(np.uint64))
                c2 = rank[inner + length - PART + 1 - RANKED]
                q1, q2 = _long_rank(rank, starts[i] + place[i] - o2, length + o2 - o1)
                q1 = _pair(q1, o1.astype(np.uint64) << np.uint64(32) | o2.astype(np.uint64))
                body = [bodies[rows[k]][p - b : p - a + length] for k, p, a, b in zip(i.tolist(), place[i].tolist(), o1.tolist(), o2.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c["t1"][i]), pa.array(c["t2"][i]), pa.array(c["pos"][i]), pa.array(c["lo"][i]),
                        pa.array(o1.astype(np.int32)), pa.array(o2.astype(np.int32)),
                        pa.array(c["settled"][i].astype(bool)), pa.array(body, pa.binary()),
                        _signed(c1), _signed(c2), _signed(q1), _signed(q2),
                    ],
                    names=["t1", "t2", "pos", "lo", "o1", "o2", "settled", "body", "c1", "c2", "q1", "q2"],
                )

    return run


def _start_batches(length: int):
    """Single starts with the ranks of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("t1", "t2", "pos", "o1", "o2", "settled")}
            for data, starts, _, rows, _ in _buffers(bodies, 3 * RANKED):
                rank = ranks(data)[RANKED]
                c = {n: v[rows] for n, v in columns.items()}
                count = (c["o2"] - c["o1"] + 1).astype(np.int64)
                i = np.repeat(np.arange(len(rows)), count)
                step = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
                at = starts[i] + step
                offset = c["o2"][i] - step
                ends = rank[at + length - RANKED]
                ahead = _pair(rank[at], offset.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c["t1"][i]), pa.array(c["t2"][i]), pa.array((c["pos"][i] - offset).astype(np.int32)),
                        pa.array(c["settled"][i].astype(bool)), _signed(ahead), _signed(ends), _signed(ahead), _signed(ends),
                    ],
                    names=["t1", "t2", "start", "settled", "c1", "c2", "q1", "q2"],
                )

    return run


def _ranked(parts: DataFrame, identity: list[str], within: tuple[str, ...] = ("c1", "c2")) -> DataFrame:
    """Parts that are repeated or go on, with ``repeated`` and ``goes_on``; ``within`` names the inner string.

    Outer strings are counted first, each task's rows summed before the shuffle. ``settled``
    parts are repeated for other reasons and only there as partners. Of the outer strings with
    one inner string, all go on if one of them has no partner, each by one part.
    """
    marked = parts.withColumn("x", F.xxhash64(*identity))
    outer = (
        marked.groupBy(*within, "q1", "q2")
        .agg(F.min("x").alias("one"), F.max("x").alias("other"), F.max("settled").alias("_settled"))
        .withColumn("repeated", F.col("_settled") | (F.col("one") != F.col("other")))
    )
    inner = (
        outer.groupBy(*within)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("repeated"), 0).otherwise(1)).alias("_open"))
        .where("_n > 1 and _open > 0")
        .select(*within, F.lit(True).alias("_go"))
    )
    decided = (
        outer.join(inner, [*within], "left")
        .where("repeated or _go")
        .select(*within, "q1", "q2", "one", "repeated", F.coalesce("_go", F.lit(False)).alias("_go"))
    )
    return marked.join(decided, [*within, "q1", "q2"]).withColumn(
        "goes_on", F.col("_go") & (F.col("x") == F.col("one"))
    ).drop("x", "one", "_go")


def _text_keys(text: Column) -> dict[str, Column]:
    """128 bits that stand for a text."""
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}


def _with_bodies(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.encode(text, "UTF-8").alias("body"), *[c.alias(n) for n, c in _text_keys(text).items()])


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """``t1, t2, start, stop``: byte ranges of texts in which every string of ``length`` bytes
    starts somewhere else too. Ranges of a text may overlap."""
    if not 2 * RANKED > length >= RANKED + PART:
        raise ValueError(f"length must be from {RANKED + PART} to {2 * RANKED - 1}")
    bodies = _with_bodies(docs)
    with Steps(docs.sparkSession) as steps:
        sampled = steps.write(
            bodies.where(F.octet_length("body") >= length).select("t1", "t2", "body").mapInArrow(_anchor_batches(length), ANCHORS),
            "sub-anchors",
        )
        runs = steps.write(
            _ranked(sampled.withColumn("settled", F.lit(False)), ["t1", "t2", "pos", "lo"], ("c1",))
            .select("t1", "t2", "pos", "lo", "hi", "repeated", "goes_on"),
            "sub-runs",
        )
        steps.drop("sub-anchors")
        # One row of each text is read again, and only where some run of it goes on.
        again = runs.where("goes_on").groupBy("t1", "t2").agg(
            F.collect_list(F.struct("pos", "lo", "hi", F.col("repeated").alias("settled"))).alias("runs")
        )
        owners = (
            bodies.groupBy("t1", "t2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"))
            .select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("first.doc_id").alias("_id"))
        )
        wanted = again.join(owners, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))).select("t1", "t2", "runs", "_id")
        picked = (
            bodies.join(wanted, ["t1", "t2"])
            .where(F.col("doc_id").eqNullSafe(F.col("_id")))
            .select("t1", "t2", "runs", "body")
        )
        regions = steps.write(picked.mapInArrow(_region_batches(length), REGIONS), "sub-regions")
        parts = steps.write(
            _ranked(regions.mapInArrow(_part_batches(length), PARTS), ["t1", "t2", "pos", "lo", "o1"])
            .select("t1", "t2", "pos", "o1", "o2", "settled", "repeated", "goes_on", F.when(F.col("goes_on"), F.col("body")).alias("body")),
            "sub-parts",
        )
        steps.drop("sub-regions")
        starts = _ranked(
            parts.where("goes_on")
            .select("t1", "t2", "pos", "o1", "o2", F.col("repeated").alias("settled"), "body")
            .mapInArrow(_start_batches(length), STARTS),
            ["t1", "t2", "start"],
        )
        spans = (
            runs.where("repeated").select("t1", "t2", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))
            .unionByName(
                parts.where("repeated and not settled").select(
                    "t1", "t2", (F.col("pos") - F.col("o2")).alias("start"), (F.col("pos") - F.col("o1") + length).alias("stop")
                )
            )
            .unionByName(
                starts.where("repeated and not settled").select("t1", "t2", "start", (F.col("start") + length).alias("stop"))
            )
        )
        return cut_lineage(spans, "sub-spans")


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal covered ranges."""
    merged: list[list[int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    return [(a, b) for a, b in merged]


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t1, t2, spans, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
            ranges = merged_spans([(s["start"], s["stop"]) for s in spans])
            edges = [0, *[x for r in ranges for x in r], len(body)]
            kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append(
                {"t1": t1, "t2": t2, "n_removed": len(body) - len(kept), "n_spans": len(ranges), "kept": kept,
                 "kept_sha256": sha256(kept).hexdigest()}
            )
        yield pa.RecordBatch.from_pylist(
            rows,
            schema=pa.schema(
                [("t1", pa.int64()), ("t2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                 ("kept", pa.binary()), ("kept_sha256", pa.string())]
            ),
        )


def remove_repeats(docs: DataFrame, length: int = 400, texts: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``texts``, ``kept`` bytes.

    Removed is every byte of a text, as UTF-8, that a string of ``length`` bytes covers which
    also starts anywhere else, in another row or at another place of the same text. Strings
    may overlap, they never run over the end of a text, and they are judged on the input.

    Texts that occur in more than one row are repeated from end to end if they have
    ``length`` bytes; among themselves, different texts are compared once however often
    they occur. Strings are held equal if 128 bits made from their bytes are.

    Needs ``doc_id, text``; other columns are not read. Null texts are empty; texts shorter than
    ``length`` lose nothing; repeated rows and rows without id count as places like all others.
    An empty table gives no rows.
    """
    spans = repeated_spans(docs, length)
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("_sha"),
        *[c.alias(n) for n, c in _text_keys(text).items()], *([F.encode(text, "UTF-8").alias("_all")] if texts else []),
    )
    copied = plain.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    listed = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    partly = listed.join(copied, ["t1", "t2"], "left_anti")
    cut = (
        _with_bodies(docs).join(partly, ["t1", "t2"]).select("t1", "t2", "spans", "body").mapInArrow(_cut_batches, KEPT)
    )
    if not texts:
        cut = cut.drop("kept")
    whole = F.col("_copies").isNotNull() & (F.col("n_bytes") >= length)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return (
        plain.join(copied, ["t1", "t2"], "left")
        .join(cut, ["t1", "t2"], "left")
        .select(
            "doc_id", "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, none).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
            *([F.when(whole, F.lit("").cast("binary")).otherwise(F.coalesce("kept", "_all")).alias("kept")] if texts else []),
        )
    )


@query("op8_repeated_substrings")
def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)
