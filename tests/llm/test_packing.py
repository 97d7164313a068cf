"""Packing: plans next to plain checks of every piece, and the query next to the library's ids."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from linewright.llm import packing
from linewright.llm.token_files import default_tokenizer

FILE = default_tokenizer()


def best_fit(counts, capacity):
    rooms, opened = [], 0
    for length in sorted(Counter(counts).elements(), reverse=True):
        i = bisect.bisect_left(rooms, length)
        if i == len(rooms):
            opened += 1
        room = rooms.pop(i) if i < len(rooms) else capacity
        bisect.insort(rooms, room - length)
    return opened


def filled(plan, counts):
    """Checks that each rank has one place and that sequences have no gaps; returns their number."""
    places, ranks = defaultdict(list), defaultdict(list)
    for length, first, after, sequence, per, offset in plan.rows:
        ranks[length] += range(first, after)
        for r in range(after - first):
            places[sequence + r // per].append((offset + r % per * length, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= plan.capacity
    assert sorted(places) == list(range(plan.sequences))
    return plan.sequences


@pytest.mark.parametrize(
    "capacity, n, length",
    [
        (10, 60, lambda r: r.randint(1, 10)), (100, 3000, lambda r: r.randint(1, 100)), (7, 0, None), (4096, 1, lambda r: 5),
        (4096, 4000, lambda r: r.randint(1000, 2000)), (4096, 4000, lambda r: 2049), (4096, 4000, lambda r: r.choice([1365, 1366, 2048])),
        (4096, 6000, lambda r: min(4096, int(r.lognormvariate(5.5, 1.5)) + 1)), (1, 9, lambda r: 1), (4096, 500, lambda r: 4096),
    ],
)
def test_plans_place_every_piece_once(capacity, n, length):
    rng = random.Random(n)
    counts = Counter(length(rng) for _ in range(n))
    for groups, large in ((100, 1 / 4), (3, 1 / 8), (1, 0.01), (20, 1 / 2)):
        filled(packing.plan_packing(dict(counts), capacity, groups, large), counts)
    assert filled(packing.best_plan(dict(counts), capacity), counts) <= best_fit(counts, capacity)


def test_configurations_beat_best_fit():
    rng = random.Random(5)
    counts = Counter(rng.randint(1000, 2000) for _ in range(20_000))
    plan = packing.best_plan(dict(counts))
    assert filled(plan, counts) < 0.95 * best_fit(counts, 4096)
    assert len(plan.rows) < 4 * 4096 * 12


def test_counts_beyond_memory():
    counts = {n: 10**9 + n for n in range(1, 4097, 7)}
    plan = packing.best_plan(counts)
    least = sum(n * c for n, c in counts.items()) / 4096
    assert plan.sequences < 1.01 * least and len(plan.rows) < 4 * 4096 * 12
    assert Counter({n: sum(r[2] - r[1] for r in plan.rows if r[0] == n) for n in list(counts)[::50]}) == {
        n: counts[n] for n in list(counts)[::50]
    }


def test_equal_groups_hold_all_pieces_once():
    counts = {5: 10, 6: 1, 9: 4, 20: 25}
    for groups in (1, 3, 8, 100):
        made = packing.equal_groups(counts, groups)
        assert [n for n, _ in made] == sorted({n for n, _ in made}, reverse=True)
        assert sum((Counter({n: c}) for _, runs in made for n, c in runs), Counter()) == counts
        assert all(n == max(x for x, _ in runs) for n, runs in made)


def expected(rows, capacity):
    library, out = Tokenizer.from_file(FILE), []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            out.append((doc_id, piece, at, tuple(ids[at : at + capacity])))
    return sorted(out, key=repr)


def test_documents_are_packed_without_gaps(spark):
    rng = random.Random(3)
    words = ["hello", "wörld", "x1", "!?", "中", "it's"]
    rows = [(i, " ".join(rng.choices(words, k=int(rng.lognormvariate(2, 1.3))))) for i in range(500)]
    rows += [(None, None), (None, "no id"), (7, "again"), (7, "again"), (900, ""), (901, " \n "), (902, "word " * 9_999)]
    schema = "doc_id long, text string, piece string, length int, task string, nth string"
    docs = spark.createDataFrame([(*r, "x", 3, "t", "n") for r in rows], schema).repartition(5)
    placed = packing.pack_documents(docs, FILE, capacity=64)
    got = placed.collect()
    as_ids = lambda b: tuple(np.frombuffer(b, "<u4").tolist())
    assert sorted(((r["doc_id"], r["piece"], r["start"], as_ids(r["ids"])) for r in got), key=repr) == expected(rows, 64)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], as_ids(r["ids"]), r["length"]))
    whole = {r["sequence_id"]: r for r in packing.sequences(placed).collect()}
    assert whole.keys() == by_sequence.keys()
    for k, parts in by_sequence.items():
        ids = ()
        for offset, some, length in sorted(parts):
            assert offset == len(ids) and length == len(some)
            ids += some
        assert len(ids) <= 64 and as_ids(whole[k]["ids"]) == ids and whole[k]["n_tokens"] == len(ids)
        assert [p["offset"] for p in whole[k]["pieces"]] == sorted(p[0] for p in parts)


def test_query_over_tables(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{source}/documents.parquet").collect()]
    got = packing.op12_best_fit_packing(spark, source).collect()
    want = [(d, p, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, p, s, ids in expected(rows, 4096)]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 4096
    assert len(used) == -(-sum(w[3] for w in want) // 4096)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert packing.op12_best_fit_packing(spark, str(tmp_path)).count() == 0
