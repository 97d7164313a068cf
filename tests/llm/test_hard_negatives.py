"""Hard negatives next to a plain search over all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import hard_negatives
from tests.llm.test_vectors import SCHEMA, fitting, odd_rows


def plain_search(rows, is_anchor, scale=256, positives=5, negatives=10, low=30, high=90):
    kept = fitting([r for r in rows if r[0] is not None and r[2] is not None], scale)
    out = []
    for vec_id, v, label in {(r[0], tuple(r[1]), r[2]) for r in kept if is_anchor(r[0])}:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i, other) for i, w, other in kept if i != vec_id), key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(vec_id, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mine(spark, rows, every, **settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % every == 0, **settings).collect()))


@pytest.mark.parametrize("list_block, member_block, reach, clusters", [(1024, 256, 8, 8), (7, 5, 2, 3), (16, 1000, 3, 1)])
def test_negatives_equal_plain_search(spark, monkeypatch, list_block, member_block, reach, clusters):
    for name, value in (("LIST_BLOCK", list_block), ("MEMBER_BLOCK", member_block), ("REACH", reach)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = odd_rows(random.Random(list_block))
    got = mine(spark, rows, 10, clusters=clusters)
    assert got == plain_search(rows, lambda i: i % 10 == 0) and len(got) > 300


def test_ties_and_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LIST_BLOCK", 8)
    monkeypatch.setattr(hard_negatives, "REACH", 2)
    rng = random.Random(8)
    spots = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(6)] + [[0.0] * 4]
    rows = [(i, spots[0] if i % 3 else rng.choice(spots), rng.randrange(3), "", "", 0) for i in range(240)]
    got = mine(spark, rows, 12, low=0, high=100, positives=3, negatives=4, clusters=4)
    assert got == plain_search(rows, lambda i: i % 12 == 0, positives=3, negatives=4, low=0, high=100) and got


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(2.0**18, 2.0**19) for _ in range(3)], i % 2, "", "", 0) for i in range(80)]
    got = mine(spark, rows, 8, low=0, high=100)
    assert got == plain_search(rows, lambda i: i % 8 == 0, low=0, high=100) and max(r[4] for r in got) > 1 << 53


def test_walks_end_early_where_bounds_allow_it(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LIST_BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "REACH", 2)
    rng = np.random.default_rng(1)
    axes = np.eye(6)
    rows = [(i, (axes[i % 6] + rng.normal(0, 0.02, 6)).tolist(), int(rng.integers(0, 2)), "", "", 0) for i in range(1200)]
    met = []
    meet = hard_negatives.SharedLists.meet

    def counted(self, members, round_, *rest):
        met.append((members.count(), round_, self.rounds))
        return meet(self, members, round_, *rest)

    monkeypatch.setattr(hard_negatives.SharedLists, "meet", counted)
    got = mine(spark, rows, 30, low=0, high=100, clusters=6)
    assert got == plain_search(rows, lambda i: i % 30 == 0, low=0, high=100)
    rounds = met[0][2]
    assert rounds >= 6 and all(r < rounds - 1 for _, r, _ in met), met


def test_nothing_to_mine(spark, tmp_path):
    for rows in ([], [(100, None, 1, "", "", 0)], [(1, [1.0, 2.0], 1, "", "", 0)], [(100, [1.0], 1, "", "", 0)]):
        assert mine(spark, rows, 100) == []
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert hard_negatives.op11_hard_negatives(spark, str(tmp_path)).count() == 0


def test_query_relabels_by_id(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)], rng.choice([0, 1, 2, 9, None]), "", "", 0) for i in range(600)]
    rows += [(None, [1.0] * 5, 1, "", "", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    relabeled = [(i, v, (label + 1) % 10 if label is not None and i is not None and i % 7 == 0 else label) for i, v, label, *_ in rows]
    got = sorted(map(tuple, hard_negatives.op11_hard_negatives(spark, str(tmp_path)).collect()))
    assert got == plain_search(relabeled, lambda i: i % 100 == 0) and got
