import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linewright.llm import decontamination, mixing
from tests.llm import models


def mixed(spark, rows, **settings):
    docs = spark.createDataFrame(
        [(d, s, " ".join(["w"] * n) if n is not None else None) for d, s, n in rows],
        "doc_id long, source string, text string",
    ).selectExpr("*", "1 AS size", "2 AS _id").repartition(3)
    return docs, mixing.mix(docs, **settings).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_the_model(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "Z", "tiny"]
    rows = [(i, rng.choice(sources[:5]), rng.randrange(0, 90)) for i in range(400)] + [(900, "tiny", 3), (901, "tiny", 4)]
    rows += [(None, "a", 5), (None, "a", 5), (902, "empty", None), (903, None, 700)]
    docs, got = mixed(spark, rows)
    want = Counter(zip([str(r[0]) for r in rows], [str(r[1]) for r in rows], [r[2] or 0 for r in rows],
                       models.mix([(d, s, n or 0) for d, s, n in rows])))
    assert Counter((str(r["doc_id"]), str(r["source"]), r["size"], r["copies"]) for r in got) == want
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
        if source not in ("empty", "tiny"):
            assert abs(sum(r["taken"] for r in mine) / mine[0]["target"] - 1) < 0.01
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(str(r["doc_id"]) for r in out.collect()) == Counter(
        {k: v for k, v in sum((Counter({str(r["doc_id"]): r["copies"]}) for r in got), Counter()).items() if v}
    )


def test_a_few_very_long_documents_leave_no_gap(spark):
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        rows = [(i, rng.choice("ab"), rng.choice([rng.randrange(0, 60), rng.randrange(200, 3000)])) for i in range(240)]
        rows += [(7, "a", 40), (7, "a", 40), (500, "b", 70_000), (501, "b", 1000), (502, None, 90), (503, None, 100)]
        _, got = mixed(spark, rows, weights=(1, 2))
        want = Counter(zip([r[0] for r in rows], [r[2] for r in rows], models.mix(rows, weights=(1, 2))))
        assert Counter((r["doc_id"], r["size"], r["copies"]) for r in got) == want
        for source in "a", "b", None:
            mine = [r for r in got if r["source"] == source]
            miss = abs(sum(r["taken"] for r in mine) - mine[0]["target"])
            left = [r["size"] for r in mine if r["size"] and r["copies"] == min(x["copies"] for x in mine)]
            assert miss <= 1 + min(left, default=0) / 2, (source, miss)


def test_longer_documents_are_drawn_more_readily(spark):
    rows = [(i, "a", 3 if i % 2 else 1000) for i in range(600)] + [(i, "b", 500) for i in range(600, 1200)]
    copies: dict = {3: [], 1000: []}
    for r in mixed(spark, rows, weights=(1, 2))[1]:
        if r["source"] == "a":
            copies[r["size"]].append(r["copies"])
    mean = {size: sum(c) / len(c) for size, c in copies.items()}
    # With one probability for all both would be near 2/3.
    assert 0.6 < mean[1000] < 0.75 and mean[3] < 0.4
    assert {c for r in copies.values() for c in r} <= {0, 1}


def test_mix_of_nothing(spark):
    docs, got = mixed(spark, [(1, "a", None), (2, "b", 0)])
    assert [(r["taken"], r["target"]) for r in got] == [(0, 0.0), (0, 0.0)]
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed_documents(docs).collect() == []


def vocabulary(rng, n):
    return [f"t{rng.randrange(4000)}" for _ in range(n)]


def test_leaks_equal_all_windows(spark):
    rng = random.Random(3)
    items = {i: vocabulary(rng, n) for i, n in enumerate([60, 45, 45, 20, 9, 5, 4, 3, 1])}
    items[9] = items[0][:30]
    texts = {}
    for i in range(120):
        w = vocabulary(rng, rng.randrange(0, 200))
        source = items[rng.randrange(10)]
        passage = list(source)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            passage[rng.randrange(len(passage))] = "changed"
        if rng.random() < 0.1:
            passage = passage[: len(passage) * 3 // 4]
        if rng.random() < 0.6:
            at = rng.randrange(len(w) + 1)
            w = w[:at] + passage + w[at:]
        texts[i] = " ".join(w)
    texts |= {100: None, 101: "", 102: (" ".join(items[0])).upper().replace(" ", ",  "), 103: " ".join(items[1] * 3)}
    item_texts = {i: " ".join(w) for i, w in items.items()} | {10: None, 11: "!!", 12: " ".join(items[1])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 AS t1", "'x' AS words")
    bench = spark.createDataFrame([*item_texts.items(), (12, item_texts[12])], "item_id long, text string").selectExpr("*", "1 AS h")
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, bench).collect()}
    want = models.leaks(texts, {k: t for k, t in item_texts.items()})
    assert sum(map(bool, want.values())) > 20
    for key, best in want.items():
        # Fingerprints of pairs just at the threshold may lie outside the radius.
        sure = {i for i, s in best.items() if s >= 0.85}
        assert sure <= set(got[key]["item_ids"]) <= set(best), key
    missed = sum(len(set(best) - set(got[k]["item_ids"])) for k, best in want.items())
    assert missed <= 1


def test_hits_ahead_equal_a_count_by_hand(spark):
    rng = random.Random(5)
    sizes = {1: 1, 3: 3, 9: 5, 40: 5}
    hits = {(t, n): sorted(rng.sample(range(300), rng.randrange(1, 200))) for t in range(6) for n in sizes}
    rows = [(t, 0, n, sizes[n], at) for (t, n), places in hits.items() for at in places]
    frame = spark.createDataFrame(rows, "t1 long, t2 long, n int, k int, at int").repartition(3)
    got = {(r["t1"], r["n"], r["at"]): r["_hits"] for r in decontamination._ahead(frame, F.col("n") - F.col("k")).collect()}
    assert got == {
        (t, n, at): sum(at <= x <= at + n - sizes[n] for x in places) for (t, n), places in hits.items() for at in places
    }


def test_leaks_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (None, "a b c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "A b, c d e f")], "item_id long, text string")
    assert [r["item_ids"] for r in decontamination.contamination(docs, bench).collect()] == [[5], [5]]
    assert [r["contaminated"] for r in decontamination.contamination(docs, bench.limit(0)).collect()] == [False, False]
    assert decontamination.contamination(docs.limit(0), bench).collect() == []


def test_many_items_are_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "x y")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "b c d e f")], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 0)
    got = {r["doc_id"]: r["contaminated"] for r in decontamination.contamination(docs, bench).collect()}
    assert got == {1: True, 2: False}


def test_native_plans_have_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for frame in (mixing.mix(docs), mixing.mixed_documents(docs)):
        assert "Python" not in frame._jdf.queryExecution().toString() and "InArrow" not in frame._jdf.queryExecution().toString()
