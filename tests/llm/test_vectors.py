"""Vector operators next to plain-Python models on small tables with every odd case."""

import math
import random

import numpy as np
import pytest

from linewright.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, _id int"


def odd_rows(rng, n=300, width=8):
    rows = []
    for i in range(n):
        spot = rng.randrange(6)
        rows.append((i * 3 - 20, [rng.gauss(spot - 3, 0.3) for _ in range(width)], rng.choice([0, 1, 2, 3, None])))
    rows += [rows[5], rows[5], (None, rows[9][1], 1), (None, rows[9][1], 1), (8001, rows[3][1], 2)]
    bad = [None, [], [None] * width, [1.0] * (width - 1) + [None], [math.nan] * width, [math.inf] + [0.0] * (width - 1),
           [1.0] * (width + 4), [1e30] * width]
    rows += [(9000 + i, v, 1) for i, v in enumerate(bad)]
    rng.shuffle(rows)
    return [(*r, "x", "y", 7) for r in rows]


def fitting(rows, scale, multiple=1):
    """Rows that take part, as whole numbers."""
    kept = []
    for vec_id, v, label, *_ in rows:
        if v and all(x is not None and math.isfinite(x) and abs(x) * scale < 1 << 28 for x in v):
            kept.append((vec_id, [math.floor(scale * x) for x in v], label))
    if not kept:
        return []
    by_id = sorted((r for r in kept if len(r[1]) % multiple == 0), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [r for r in by_id if len(r[1]) == len(by_id[0][1])]


def nearest(point, book):
    squares = [sum((a - b) ** 2 for a, b in zip(point, entry)) for entry in book]
    return squares.index(min(squares)), min(squares)


def plain_codes(rows, scale, parts, entries, rounds):
    kept = fitting(rows, scale, parts)
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[0], []).append(c[p])
            books[p] = [
                [sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else entry for e, entry in enumerate(books[p])
            ]
    out = []
    for (vec_id, _, label), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((vec_id, label, tuple(f[0] for f in found), sum(f[1] for f in found)))
    return out, books


@pytest.mark.parametrize("entries, tree_rows", [(12, 2048), (40, 64), (1, 5), (1000, 2048)])
def test_codes_equal_plain_lloyd(spark, monkeypatch, entries, tree_rows):
    monkeypatch.setattr(vector_codes, "TREE_ROWS", tree_rows)
    rows = odd_rows(random.Random(entries))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, books = vector_codes.product_codes(df, scale=64, parts=2, entries=entries, rounds=3)
    want, want_books = plain_codes(rows, 64, 2, entries, 3)
    assert sorted(((r[0], r[1], tuple(r[2]), r[3]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert books.tolist() == want_books


def test_codes_of_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(2.0**25, 2.0**26) for _ in range(4)], 0, "", "", 0) for i in range(60)]
    got, _ = vector_codes.product_codes(spark.createDataFrame(rows, SCHEMA), scale=4, parts=2, entries=5, rounds=2)
    want, _ = plain_codes(rows, 4, 2, 5, 2)
    assert want and sorted((r[0], r[1], tuple(r[2]), r[3]) for r in got.collect()) == sorted(want)


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 2, "", "", 0), (2, [], 2, "", "", 0), (3, [1.0], 2, "", "", 0)]):
        got, books = vector_codes.product_codes(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == ["vec_id", "label", "code", "error"] and got.count() == 0 and books.size == 0


def test_query_on_nulls_and_an_empty_table(spark, tmp_path):
    rng = random.Random(3)
    rows = odd_rows(rng, 400, 8)
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got = vector_codes.op13_vector_codes(spark, f"{tmp_path}/{name}").collect()
        want, books = plain_codes(some, 1024, 4, 256, 4) if some else ([], [])
        totals = {}
        for _, label, _, error in want:
            totals[label] = totals.get(label, 0) + error
        digest = vector_codes.books_digest(np.array(books))
        assert sorted(map(tuple, got), key=repr) == sorted(
            ((i, "".join(f"{c:02x}" for c in code), e, totals[label], digest) for i, label, code, e in want), key=repr
        )


def test_cover_tree_invariants():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(-50, 50, (400, 3)), rng.integers(0, 2, (50, 3)) * 1000])
    tree = vector_codes.CoverTree.build(rows)
    assert (tree.points[tree.place] == rows).all() and tree.counts[-1] == len(rows)
    for node in range(len(tree.center)):
        own = tree.points[tree.lo[node] : tree.hi[node]]
        middle = tree.points[tree.center[node]]
        assert np.sqrt(((own - middle) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-9
        children = range(tree.first[node], tree.last[node])
        if not children:
            assert len(own) == 1
            continue
        assert [tree.lo[c] for c in children] == [tree.lo[node], *[tree.hi[c] for c in children][:-1]]
        assert tree.hi[children[-1]] == tree.hi[node] and (tree.center[children[0]] == tree.center[node])
        centers = tree.points[tree.center[children[0] : children[-1] + 1]]
        apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2)) + np.eye(len(centers)) * 1e9
        scale = 2.0 ** (math.ceil(math.log2(tree.radius[node])) - 1)
        assert apart.min() > scale and all(tree.radius[c] <= scale for c in children)


def test_clustered_subtrees_are_settled_whole():
    rng = np.random.default_rng(2)
    spots = rng.integers(-4000, 4000, (20, 4))
    rows = (spots[rng.integers(0, 20, 2000)] + rng.integers(-5, 6, (2000, 4))).astype(np.int64)
    tree = vector_codes.CoverTree.build(rows)
    lo, hi, entry = tree.assign(spots.astype(np.int64))
    assert len(lo) < len(tree.points) / 10
    want = ((tree.points[:, None] - spots[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (np.repeat(entry, hi - lo) == want).all()
