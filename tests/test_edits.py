"""Fix sequences next to a plain run, over several digits and blocks."""

import random

import pytest

from linewright.operators import edits

SCHEMA = "review_id long, file_id long, line_start int, line_end int, suggested_fix string, ord long"


def plain(rows):
    out, done = {}, {}
    for review, file, start, end, fix, ord in sorted(rows, key=lambda r: r[5]):
        earlier = done.setdefault((review, file), [])
        out[review, file, ord] = tuple(x + sum(d for line, d in earlier if line < x) for x in (start, end))
        if fix:
            earlier.append((start, len(fix.split("\n")) - (end - start + 1)))
    return out


@pytest.mark.parametrize("top, block", [(30, 1 << 15), (300, 16), (70_000, 16), (2_000_000_000, 64), (300, 1)])
def test_sequences_equal_a_plain_run(spark, monkeypatch, top, block):
    monkeypatch.setattr(edits, "BLOCK", block)
    rng = random.Random(top + block)
    places = [rng.randint(0, top) for _ in range(25)]
    rows = []
    for file in range(5):
        for ord in range(rng.choice([1, 10, 150])):
            start = rng.choice([rng.choice(places), rng.randint(1, top)])
            rows.append((file % 2, file, start, start + rng.choice([0, 1, 3, 255]), rng.choice([None, "", "a", "a\nb\nc", "x\n" * 9]), ord * 3 + 1))
    got = edits.apply_in_sequence(spark.createDataFrame(rows, SCHEMA), ["review_id", "file_id"])
    assert {(r.review_id, r.file_id, r.ord): (r.new_start, r.new_end) for r in got.collect()} == plain(rows)


def test_the_longest_lines(spark):
    rows = [(1, 1, 2_000_000_000, 2_000_000_001, "a\nb", 1), (1, 1, 5, 6, "a", 2)]
    plan = edits.apply_in_sequence(spark.createDataFrame(rows, SCHEMA), ["review_id", "file_id"])
    assert {(r.ord, r.new_start) for r in plan.collect()} == {(1, 2_000_000_000), (2, 5)}


def test_turns_are_joined_once(spark):
    """One join gives the shifts back to the findings, one the sums of earlier blocks; every other reading is a scan."""
    rows = [(1, 1, 5, 6, "a", 1), (1, 1, 9, 9, "a\nb", 2)]
    plan = edits.apply_in_sequence(spark.createDataFrame(rows, SCHEMA), ["review_id", "file_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan


def test_sums_below():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 1000):
        digit, delta = rng.integers(0, 256, n), rng.integers(-5, 6, n)
        want = [int(delta[:i][digit[:i] < digit[i]].sum()) for i in range(n)]
        assert edits._sums_below(digit, delta).tolist() == want
