import random

from linewright.llm import near_dup
from tests.llm import models


def run(spark, texts, **settings):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r for r in near_dup.near_duplicates(docs, **settings).collect()}


def family(rng, n, words=120, edits=3):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(own)


def test_classes_and_links_equal_all_pairs_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 7)
    rng = random.Random(1)
    texts = {}
    for size in (40, 12, 5, 2, 1, 1):
        for text in family(rng, size):
            texts[len(texts)] = text
    texts |= {100 + i: texts[i] for i in range(15)}
    texts[200] = texts[3].upper()
    texts[201] = "one two three"
    texts[202] = "One, two; three!"
    got, want = run(spark, texts), models.similar_classes(texts)
    assert {k: (r["class_id"], r["n_links"]) for k, r in got.items()} == want
    classes = {r["class_id"] for r in got.values()}
    assert {k for k, r in got.items() if r["kept"]} == classes
    assert got[100]["n_copies"] >= 2 and got[202]["n_links"] == 1


def test_documents_without_words_and_repeated_rows(spark):
    text = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame(
        [(None, text, 1), (7, text, 2), (7, text, 3), (8, None, 4), (9, "", 5), (9, "...", 6), (None, None, 7)],
        "doc_id long, text string, rep int",
    )
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == 7
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"] or 0, r["n_links"], r["kept"]) for r in rows) == [
        (False, 7, 7, 2, True), (False, 7, 7, 2, True), (False, 8, 8, 0, True), (False, 9, 9, 0, True),
        (False, 9, 9, 0, True), (True, 0, 0, 0, True), (True, 0, 7, 2, False),
    ]
    assert near_dup.near_duplicates(docs.limit(0)).collect() == []


def test_depth_is_shortened_until_the_recall_is_met():
    assert near_dup.depth_for(0.5, 0.8) > near_dup.depth_for(0.99, 0.8) >= near_dup.depth_for(0.999, 0.8)
    assert near_dup.recall_at(near_dup.depth_for(0.999, 0.8), near_dup.TREES, 0.8) >= 0.999


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_dup.near_duplicates(docs).collect()}
    assert got == models.similar_classes(texts)


def test_links_inside_a_component_need_no_common_path(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "depth_for", lambda *a, **b: near_dup.DEPTH)
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 20)
    texts = dict(enumerate(family(random.Random(5), 60, words=200, edits=4)))
    got = {k: (r["class_id"], r["n_links"]) for k, r in run(spark, texts).items()}
    assert got == models.similar_classes(texts)
