import math
import unicodedata
import zlib

import xxhash
import zstandard
from pyspark.sql import functions as F

from linewright.llm import language

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    found = language.fit_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.where(language.held_out()).select("doc_id", "lang", "lang_pred", "rejected").collect()
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.02


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = spark.read.parquet(DOCS)
    spoiled = docs.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang")))
    assert language.learn(docs.where(~language.held_out())) == language.learn(spoiled.where(~language.held_out()))


def test_bounded_sample(spark):
    docs = spark.read.parquet(DOCS)
    learned = language.learn(docs, docs_per_language=5, chars_per_doc=40)
    assert set(learned) == {"en", "fr", "de", "es"}
    assert all(len(c) <= 5 * 41 * 2 for c in learned.values())


def test_nulls_ties_and_empty_tables(spark):
    rows = [
        (1, None, "en", 1), (2, "", "en", 2), (3, "123 !? 45", "fr", 3), (None, "the and of", None, 4),
        (4, "zzz", "en", 5), (4, "zzz", "en", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in language.identify(docs, {"a": b"same words here", "b": b"same words here"}).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (1, 2, 3))
    assert got[4]["lang_pred"] == "a" and got[4]["rejected"] and abs(got[4]["score"] - 0.5) < 1e-9
    assert language.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert language.identify(docs, {"a": b"x"}).where("rejected").count() == 3
    assert language.learn(docs.limit(0)) == {} and language.fit_and_identify(docs.limit(0)).collect() == []
    kept = language.keep_identified(docs, {"a": b"alpha", "b": b"zzz zzz zzz zzz"})
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {None, 4}


def test_long_text_counts_whole():
    contents = (("a", b"lorem ipsum dolor " * 20), ("b", b"other words stand here " * 20))
    tail = "the quick brown fox jumps"
    lang, score, margin, rejected, other, size = language.classify("lorem ipsum dolor " * 50_000 + tail, contents, 5, 0.002)
    assert size > 0 and 0 <= score <= 1 and other in ("a", "b") and lang != other


def test_margin_does_not_fall_with_the_length(spark):
    docs = spark.read.parquet(DOCS)
    learned = language.learn(docs.where(~language.held_out()))
    texts = [r["text"] for r in docs.where("lang = 'en' and text is not null").orderBy("doc_id").select("text").collect()]
    joined = " ".join(texts)
    long = joined * (8_000_000 // len(joined) + 1)
    rows = [(n, long[:n], "en") for n in (4_000, 1_000_000, 8_000_000)]
    kept = language.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), learned)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {n for n, _, _ in rows}
    contents = tuple(sorted(learned.items()))
    found = [language.classify(text, contents, language.LEVEL, language.LEAST_MARGIN) for _, text, _ in rows]
    assert all(f[0] == "en" for f in found)
    assert found[2][2] > 0.5 * found[0][2]


def _words(text):
    """Letters by their Unicode category, everything else a space."""
    return " ".join("".join(c if unicodedata.category(c).startswith("L") else " " for c in text.lower()).split())


def _ready(content):
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=6)
    return dictionary


def test_query_equals_an_independent_run(spark):
    source = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{source}/documents.parquet").select("doc_id", "text", "lang").collect()]
    sample = {}
    for doc_id, text, lang in rows:
        if zlib.crc32(str(doc_id).encode()) % 5 and lang is not None and text is not None and _words(text[:600]):
            seed = xxhash.xxh64(doc_id.to_bytes(8, "little", signed=True), seed=42).intdigest()
            sample.setdefault(lang, []).append((seed - (1 << 64) * (seed >> 63), text[:600]))
    contents = {}
    for lang, found in sample.items():
        pieces = [_words(t).encode()[:300] for _, t in sorted(found)[:900]]
        contents[lang] = b" ".join(dict.fromkeys(pieces))
    made = {
        lang: zstandard.ZstdCompressor(
            level=6, write_content_size=False, write_dict_id=False,
            dict_data=_ready(content),
        )
        for lang, content in contents.items()
    }
    got = {r["doc_id"]: r for r in language.op2_language_id(spark, source).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _ in rows[::3]:
        r, body = got[doc_id], _words(text or "").encode()
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        if not body:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        blocks = [body[a : a + 4096] for a in range(0, len(body), 4096)]
        sizes = {lang: sum(len(c.compress(b)) for b in blocks) for lang, c in made.items()}
        least = min(sizes.values())
        assert r["lang_pred"] == min((s, lang) for lang, s in sizes.items())[1], doc_id
        assert abs(r["score"] - 1 / sum(math.exp(-100 * (s - least) / least) for s in sizes.values())) < 1e-9, doc_id


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(1, "½ ² Ⅷ ①"), (2, "12 ৩৪ _"), (3, "a"), (4, "中"), (5, "ʰ")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, {"x": b"some words", "y": b"other words"}).collect()}
    assert [got[n] == "und" for n in range(1, 6)] == [True, True, False, False, False]
    assert [bool(docs.where(f"doc_id = {n}").where(F.col("text").rlike(language.LETTER)).count()) for n in range(1, 6)] == [False, False, True, True, True]


def test_common_language_is_sampled_as_by_one_window(spark):
    rows = [(n, f"word{n % 700} text {'abc'[n % 3]}", "en" if n % 10 else "fr") for n in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {}
    for doc_id, text, lang in rows:
        seed = xxhash.xxh64(doc_id.to_bytes(8, "little"), seed=42).intdigest()
        want.setdefault(lang, []).append((seed - (1 << 64) * (seed >> 63), text))
    got = language.learn(docs, docs_per_language=50, chars_per_doc=40)
    assert got == {lang: b" ".join(dict.fromkeys(_words(t).encode() for _, t in sorted(found)[:50])) for lang, found in want.items()}
