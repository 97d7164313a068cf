import random

import numpy as np
import pytest

from linewright.llm import substring_dedup as sub
from tests.llm import models

SCHEMA = "doc_id long, text string"


def run(spark, rows, length, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    return [
        (r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]), r["kept"])
        for r in sub.remove_repeats(docs, length).collect()
    ]


def check(spark, texts, length=300):
    got = {k: v for k, v, _ in run(spark, list(texts.items()), length)}
    assert got == models.repeats(texts, length)


def test_overlapping_copies_with_edits(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdef é\n") for _ in range(2500))
    texts = {}
    for i in range(40):
        a = rng.randrange(0, 1500)
        part = list(base[a : a + rng.randrange(100, 1500)])
        for _ in range(rng.randrange(0, 4)):
            part[rng.randrange(len(part))] = rng.choice("XYZ")
        texts[i] = "".join(rng.choice("mnop") for _ in range(rng.randrange(0, 60))) + "".join(part)
    texts[100] = None
    texts[101] = ""
    texts[102] = texts[3]
    check(spark, texts)


def test_periodic_and_small_alphabet_texts(spark):
    rng = random.Random(6)
    texts = {
        1: "a" * 301, 2: "a" * 299, 3: "b" * 300, 4: "ab" * 200, 5: "the same line\n" * 60,
        6: "".join(rng.choice("ab") for _ in range(900)), 7: "x" + "c" * 700 + "y" + "c" * 310,
    }
    texts[8] = texts[6][100:450] + "q" + texts[6][300:800]
    check(spark, texts)


def test_one_byte_decides(spark):
    rng = random.Random(7)
    core = "".join(rng.choice("abcdefgh") for _ in range(300))
    for length in (299, 300):
        texts = {1: "1" + core[:length] + "2", 2: "3" + core[:length] + "4"}
        got = {k: v for k, v, _ in run(spark, list(texts.items()), 300)}
        assert got == models.repeats(texts, 300)
        assert (got[1][1] > 0) == (length == 300)


def test_text_longer_than_a_buffer(spark, monkeypatch):
    monkeypatch.setattr(sub, "BUFFER", 1000)
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghijkl") for _ in range(9000))
    texts = {1: long, 2: long[2500:5200] + "#" + long[700:1100], 3: "-" * 17 + long[6000:]}
    bodies = {k: np.frombuffer(t.encode(), np.uint8) for k, t in texts.items()}
    # The buffers of one text cover every start once.
    for body in bodies.values():
        starts = 0
        for data, begin, sizes, _, _ in sub._buffers([body.tobytes()], 299):
            starts += int((sizes - 299).clip(0).sum())
        assert starts == len(body) - 299
    check(spark, texts)


def test_rows_without_id_extra_columns_and_empty_tables(spark):
    text = "".join(random.Random(9).choice("abcd") for _ in range(400))
    rows = [(None, text, 1), (1, text, 2), (1, text, 3), (2, "short", 4)]
    got = run(spark, rows, 300, "doc_id long, text string, t1 int")
    assert sorted((k is None, k or 0, v[1]) for k, v, _ in got) == [(False, 1, 400), (False, 1, 400), (False, 2, 0), (True, 0, 400)]
    assert {k: kept for k, _, kept in got}[2] == b"short"
    assert run(spark, [], 300) == []


@pytest.mark.parametrize("length", [288, 400, 511])
def test_ranks_tell_strings_apart(length):
    data = np.frombuffer(bytes(random.Random(length).choices(b"ab", k=3000)) * 2, np.uint8)
    found = sub.anchors(data, np.array([0]), np.array([len(data)]), length)
    at, lo, hi, *_ = found
    assert (lo[1:] == hi[:-1] + 1).all() and lo[0] == 0 and hi[-1] == len(data) - length
    assert ((at >= hi) & (at + sub.ANCHOR <= lo + length)).all()
