"""Streams over several micro-batches."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linewright.streaming import streams
from linewright.streaming.state import EventNumbers


@pytest.fixture()
def batches(spark, tmp_path):
    """Forty events in four files, one file per micro-batch."""
    rng = random.Random(1)
    rows = [(rng.randint(1, 3), n, rng.choice(["BATCH_COMPLETED", "REVIEW_FAILED"]), n % 5) for n in range(40)]
    for part in range(4):
        df = spark.createDataFrame(rows[part * 10:part * 10 + 10], "review_id long, ord long, type string, new_findings int")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), df.schema, "*.parquet", per_trigger=1)
    return rows, stream


def test_sequence(batches):
    rows, stream = batches
    got = streams.sequence_events(stream).orderBy("review_id", "ord").collect()
    count: dict[int, int] = {}
    want = []
    for review_id, ord, *_ in sorted(rows):
        count[review_id] = count.get(review_id, 0) + 1
        want.append((review_id, ord, count[review_id]))
    assert sorted(r.sequence_number for r in got) == sorted(w[2] for w in want)
    assert {(r.review_id, r.ord) for r in got} == {w[:2] for w in want}


def test_progress(batches):
    rows, stream = batches
    got = {r.review_id: (r.last_type, r.batches_done, r.findings) for r in streams.progress(stream).collect()}
    for review_id, state in got.items():
        mine = [r for r in rows if r[0] == review_id]
        assert state == (mine[-1][2], sum(r[2] == "BATCH_COMPLETED" for r in mine), sum(r[3] for r in mine))


def test_subscribe(batches):
    rows, stream = batches
    got = streams.append(streams.subscribe(stream, 2), "one")
    assert sorted(r.ord for r in got.collect()) == [r[1] for r in rows if r[0] == 2]


def test_unseen(spark, tmp_path):
    for part in range(3):
        spark.createDataFrame([(f"h{n % 4}", part * 10 + n) for n in range(part, part + 3)], "content_hash string, file_id long").coalesce(
            1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "content_hash string, file_id long"
    stream = streams.read_files(spark, str(tmp_path / "in"), schema, "*.parquet", per_trigger=1)
    assert sorted(r.content_hash for r in streams.unseen_contents(stream).collect()) == ["h0", "h1", "h2", "h3"]


def test_sequence_goes_on_after_a_restart(spark, tmp_path):
    schema = "review_id long, ord long, type string, total_batches int"
    parts = [
        [(1, 5, "a", None), (1, 3, "b", 7), (2, 1, "c", None), (None, 9, "x", 1)],
        [(1, 4, "late", 2), (1, 8, "d", None), (3, 2, "e", 1), (None, 2, "y", None)],
        [(1, 9, "f", 3)],
    ]
    got = None
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, "*.parquet")
        got = streams.sequence_events(stream, f"{tmp_path}/out")
    want = {
        (1, 3, "b", 7, 1), (1, 5, "a", None, 2), (1, 4, "late", 2, 3), (1, 8, "d", None, 4), (1, 9, "f", 3, 5),
        (2, 1, "c", None, 1), (3, 2, "e", 1, 1), (None, 9, "x", 1, 1), (None, 2, "y", None, 2),
    }
    assert {tuple(r) for r in got.collect()} == want
    # Only the counters went from batch to batch: the second run read the new file alone.
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_large_numbers_stay_whole_beside_nulls(spark, tmp_path):
    schema = "review_id long, ord long, size long"
    big = 2**53 + 1
    rows = [(7, big, None), (7, big + 1, big + 2), (7, None, 5), (big, 1, big)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, "*.parquet")
    got = streams.sequence_events(stream, f"{tmp_path}/out")
    assert {tuple(r) for r in got.collect()} == {(7, big, None, 1), (7, big + 1, big + 2, 2), (7, None, 5, 3), (big, 1, big, 1)}


def test_reviews_of_a_slice_are_numbered_in_one_call():
    class Used(dict):
        getValue, updateValue = dict.get, dict.__setitem__

    used = Used({("2",): (10,)})
    numbers = EventNumbers()
    numbers.init(type("Handle", (), {"getMapState": lambda *_: used})())
    chunks = [
        pd.DataFrame({"review_id": [2, 1, 1], "ord": [5, 9, 0], "of_review": ["2", "1", "1"], "of_last": [False, False, True]}),
        pd.DataFrame({"review_id": [1, 2], "ord": [3, 4], "of_review": ["1", "2"], "of_last": [False, False]}),
    ]
    (got,) = numbers.handleInputRows((0,), iter(chunks), None)
    assert set(got.itertuples(index=False, name=None)) == {(1, 3, 1), (1, 9, 2), (1, 0, 3), (2, 4, 11), (2, 5, 12)}
    assert used == {("1",): (3,), ("2",): (12,)}


def test_arrivals_hold_every_row_once_in_order(spark):
    rows = spark.createDataFrame([(n % 50,) for n in range(200)] + [(None,)], "k long")
    parts = [sorted((r.k is None, r.k or 0) for r in p.collect()) for p in streams.arrivals(rows, "k", 4)]
    assert sum(parts, []) == sorted((r.k is None, r.k or 0) for r in rows.collect()) and len(parts) == 4
    assert [p.count() for p in streams.arrivals(rows.limit(0), "k", 4)] == [0]
    assert sum(p.count() for p in streams.arrivals(spark.createDataFrame([(1,), (1,)], "k long"), "k", 3)) == 2


def test_progress_stores_a_row_per_review(spark, batches, tmp_path):
    rows, stream = batches
    folder = str(tmp_path / "out")
    assert streams.progress(stream, folder, buckets=2).count() == len({r[0] for r in rows})
    stored = spark.read.parquet(f"{folder}/snapshot/rows/state")
    # The newest change and the one before it, whatever the number of batches.
    assert stored.count() <= 2 * len({r[0] for r in rows})
    again = streams.progress(stream, folder, buckets=2)
    assert again.count() == len({r[0] for r in rows})


SEEN = "content_hash string, file_id long, event_time timestamp"


def arrive(spark, tmp_path, rows, delay):
    """One more file of the stream, run on from where it stopped."""
    timed = [(h, i, None if t is None else 1_700_000_000 + t) for h, i, t in rows]
    df = spark.createDataFrame(timed, "content_hash string, file_id long, t long").selectExpr(
        "content_hash", "file_id", "timestamp_seconds(t) AS event_time"
    )
    df.repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.read_files(spark, f"{tmp_path}/in", df.schema, "*.parquet")
    table, late = streams.unseen_within(stream, delay, f"{tmp_path}/out")
    return {(r.content_hash, r.file_id) for r in table.collect()}, late


def test_contents_are_forgotten_and_late_ones_are_counted(spark, tmp_path):
    first = [("a", 3, 5), ("a", 1, 9), ("a", 2, 7), ("b", 4, 0), (None, 5, 3)]
    seen, late = arrive(spark, tmp_path, first, "100 seconds")
    assert seen == {("a", 1), ("b", 4), (None, 5)} and late == 0
    more, late = arrive(spark, tmp_path, [("a", 0, 50), ("b", 9, 60), ("c", 6, 500)], "100 seconds")
    assert more - seen == {("c", 6)} and late == 0
    # The watermark is now at 400: what is older is late, and "a", known from 9, was forgotten at 109.
    newer, late = arrive(spark, tmp_path, [("d", 7, 300), ("a", 8, 450), ("c", 9, 520), ("e", 1, 10), ("e", 2, 460), ("f", 3, None)], "100 seconds")
    assert newer - more == {("a", 8), ("e", 1)} and late == 1


def test_common_content_is_combined_before_the_shuffle(spark, tmp_path):
    rows = [("hot", n, n % 50) for n in range(3000)] + [(f"h{n}", n, 1) for n in range(20)]
    seen, _ = arrive(spark, tmp_path, rows, "1 hour")
    assert ("hot", 0) in seen and len(seen) == 21
