"""Blocks of lines and what is read from them, next to plain slices."""

import random

import pytest
from pyspark.sql import functions as F

from linewright.operators import line_blocks, merging

CONTENTS = ["", "\n", "a", "a\n", "\n\n\n", "a\nb\nc", "a\r\nb\r\n", "x" * 5000, "\n".join(f"l{n}" for n in range(9)),
            "\n".join(f"l{n}" for n in range(8)) + "\n", "\n" * 8, "ü\n漢\n😀\n" * 7, None]


@pytest.mark.parametrize("size", [1, 2, 4, 8, 64])
def test_blocks_hold_all_lines_in_order(spark, size):
    files = spark.createDataFrame([(1, i, c) for i, c in enumerate(CONTENTS)], "review_id long, file_id long, content string")
    blocks = line_blocks.line_blocks(files, lines=size).select(
        "file_id", "block", line_blocks.block_lines(F.col("text"), size).alias("lines")
    )
    got = {}
    for r in sorted(blocks.collect()):
        assert r.block == len(got.setdefault(r.file_id, [])) / size and 0 < len(r.lines) <= size
        got[r.file_id] += r.lines
    assert got == {i: c.split("\n") for i, c in enumerate(CONTENTS) if c is not None}


def test_a_long_content_is_cut_whole(spark):
    content = "\n".join(["", "x" * 70_000, *(str(n) for n in range(200_000))])
    files = spark.createDataFrame([(1, 1, content)], "review_id long, file_id long, content string")
    blocks = line_blocks.line_blocks(files)
    assert blocks.count() == -(-200_002 // 64)
    last = blocks.orderBy(F.desc("block")).first()
    assert last.text.split("\n") == content.split("\n")[last.block * 64 :]


def plain_snippet(content, start, end):
    if not content:
        return None
    lines = content.split("\n")
    first, last = max(0, start - 3), min(len(lines), end + 2)
    return "\n".join(lines[first:last]) if last > first else ""


def test_snippets_equal_plain_slices(spark):
    rng = random.Random(1)
    contents = [*CONTENTS, *("\n".join(rng.choice(["", "aa", "b"]) for _ in range(rng.randrange(400))) for _ in range(10))]
    files = spark.createDataFrame([(f % 3, f, c) for f, c in enumerate(contents)], "review_id long, file_id long, content string")
    rows = []
    for n in range(600):
        f = rng.randrange(len(contents) + 2)
        start = rng.choice([0, 1, 2, 62, 63, 64, 65, 66, 67, rng.randrange(450)])
        rows.append((f % 3, f, n, start, start + rng.choice([-1, 0, 0, 1, 5, 200])))
    findings = spark.createDataFrame(rows, "review_id long, file_id long, ord long, line_start int, line_end int")
    got = merging.attach_snippets(findings, files)
    assert {r.ord: r.code_snippet for r in got.collect()} == {
        n: plain_snippet(contents[f], a, b) if f < len(contents) else None for _, f, n, a, b in rows
    }
    assert got.columns == [*findings.columns, "code_snippet"]


def test_no_plan_joins_contents_to_findings(spark):
    files = spark.createDataFrame([(1, 1, "a\nb")], "review_id long, file_id long, content string")
    findings = spark.createDataFrame([(1, 1, 0, 1, 1)], "review_id long, file_id long, ord long, line_start int, line_end int")
    plan = merging.attach_snippets(findings, files)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and "content" not in "".join(joins)
