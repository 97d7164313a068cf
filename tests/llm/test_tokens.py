import gc
import random
import weakref
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from linewright.llm import language, shingles, token_counts, token_files
from linewright.llm.elias_fano import EliasFano, encode
from linewright.session import fresh_path

FILE = token_files.default_tokenizer()


@pytest.mark.parametrize("n, top", [(0, 1), (1, 0), (1, 10**12), (700, 3), (700, 10**9), (5000, 5001), (2000, 10**12)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n + 1).integers(0, top + 1, n))
    data = encode(values)
    read = EliasFano(data)
    assert len(read) == n and [read.get(i) for i in range(n)] == values.tolist()
    for a, b in ((0, n), (n // 3, n // 2), (n, n)):
        assert read.slice(a, b).tolist() == values[a:b].tolist()
    if n >= 2000:
        assert len(data) * 8 < n * (2.3 + np.log2(max(2, values[-1] / n)))
    with pytest.raises(IndexError):
        read.select(n)


def test_cached_encoder_gives_the_library_ids():
    library, cached = Tokenizer.from_file(FILE), token_files.CachedEncoder(FILE, "<u2")
    rng = random.Random(1)
    letters = "éßÀñœŒab'st. ,!AB1é<|>́ \n\t_-Σİ中ﬁ "
    texts = ["", "don't It's we'll!!'s <|endoftext|>a b<|startoftext|> A.B.C. x'S \r\n<| endoftext|>", "12ab3 (the) ..."]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        got = np.frombuffer(cached.encode(text), "<u2").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    cached, library = token_files.CachedEncoder(FILE, "<u4"), Tokenizer.from_file(FILE)
    for text in ("a b c d e f g a b", "h a i b j, c", "a"):
        assert np.frombuffer(cached.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def expected(rows):
    library, start, out = Tokenizer.from_file(FILE), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_over_several_files(spark):
    rng = random.Random(2)
    rows = [(i * 7 - 500, " ".join(rng.choices(["hello", "wörld", "x1", "!?"], k=rng.randrange(40)))) for i in range(300)]
    rows += [(None, "no id"), (None, None), (-500, "again"), (3, None), (4, ""), (5, "word " * 30_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS shard").repartition(4)
    got = token_files.round_trip(docs, FILE, shard_chars=40_000).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)
    assert token_files.round_trip(docs.limit(0), FILE).collect() == []


def test_direct_access_to_one_document(spark):
    rows = [(i, "a b c " * (i % 9)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards = token_files.write_tokens(docs, fresh_path(spark, "tok"), FILE, shard_chars=10_000).orderBy("shard").collect()
    want = expected(rows)
    assert len(shards) > 1
    for shard in shards:
        file = token_files.TokenShard(shard["path"], shard["first_id"])
        for i in (0, len(file) // 2, len(file) - 1):
            doc_id = file.doc_id(i)
            a, b = file.bounds(i)
            assert (doc_id, a + shard["base"], b - a, zlib.crc32(file.tokens(a, b).astype("<u4").tobytes())) == want[doc_id]


def test_trie_counts_equal_the_library_model(spark):
    model = token_counts.default_model()
    scores = token_counts.unigram_scores(model)
    vocab = [("<unk>", 0.0), *scores.items()]
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    assert pieces.get_piece_size() > len(scores) > 30_000
    rng = random.Random(3)
    words = {"".join(rng.choices("abcdeèñ,.tio", k=rng.randrange(1, 14))) for _ in range(4000)}
    words |= {r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect() for r in [r]}
    words = {w for text in words for w in text.split()}
    marked = sorted(token_counts.MARK + w for w in words)
    got = dict(token_counts.trie_counts(marked, scores))
    assert len(got) == len(marked)
    known = {c for s in scores if len(s) == 1 for c in s}
    plain = [w for w in marked if set(w) <= known]
    assert len(plain) > 3000
    for word in plain:
        score, tokens = _best(word, scores)
        assert got[word] == tokens, word
        # The library has a best path of the same score; where several have it, ours is among the shortest.
        found = library.encode(word).tokens
        assert sum(scores[t] for t in found) == pytest.approx(score) and len(found) >= tokens, word


def _best(word, scores):
    """Highest score and, of the paths with it, the fewest tokens, over all paths one after the other."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        ways = [(best[a][0] + scores[word[a:end]], best[a][1] - 1) for a in range(end) if word[a:end] in scores]
        best.append(max(ways))
    return best[-1][0], -best[-1][1]


def test_token_counts_of_documents(spark):
    rows = [(1, "the cat the"), (2, None), (None, " \t\n"), (3, "中 the"), (3, "中 the"), (4, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS n_tokens")
    model = token_counts.default_model()
    got = token_counts.count_tokens(docs, model).collect()
    scores = token_counts.unigram_scores(model)

    def count(word):
        return dict(token_counts.trie_counts([token_counts.MARK + word], scores))[token_counts.MARK + word]

    want = [
        (d, sum(count(w.decode()) for w in (t or "").encode().split()), len((t or "").encode().split()), len((t or "").encode()))
        for d, t in rows
    ]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.count_tokens(docs.limit(0), model).collect() == []


def test_uncovered_characters_cost_their_bytes():
    scores = {"▁": -1.0, "a": -2.0, "▁a": -2.5}
    got = dict(token_counts.trie_counts(["▁a", "▁ab", "▁é"], scores))
    assert got == {"▁a": 1, "▁ab": 2, "▁é": 3}


def test_a_worker_holds_the_tables_of_one_operator():
    contents = (("a", b"some words to learn"), ("b", b"andere Worte zum Lernen"))
    shingles.shingle_set("one two three four five six")
    words = weakref.ref(shingles._hashes())
    language.classify("some words", contents, 6, 0.002)
    gc.collect()
    assert words() is None
    encoder = weakref.ref(token_files._encoder(FILE, "<u2"))
    assert token_files._encoder(FILE, "<u2") is encoder()
    language.classify("some words", contents, 6, 0.002)
    gc.collect()
    assert encoder() is None


def test_chunks_and_pieces_share_one_bound(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 100)
    cached, library = token_files.CachedEncoder(FILE, "<u2"), Tokenizer.from_file(FILE)
    text = " ".join(f"word{i}, Name{i % 7} x{i}" for i in range(2000))
    assert np.frombuffer(cached.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    held = sum(len(v) for v in vars(cached).values() if isinstance(v, dict))
    assert held <= 100
