"""Token counts under a unigram model, shared along a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from linewright.llm.registry import query, table

MARK = "▁"
#: Log score that a character no piece covers loses against the weakest piece.
UNKNOWN_PENALTY = 10.0
#: Distinct pre-tokens whose counts a worker keeps; beyond it they are worked out again.
REMEMBERED = 400_000

RESULT = "doc_id long, n_tokens long, n_words long, n_bytes long"


@lru_cache(maxsize=2)
def unigram_scores(model_file: str) -> dict[str, float]:
    """Log probabilities of the pieces of a vocabulary file.

    The file ranks its pieces by frequency and gives no probabilities, so they follow Zipf's
    law in the rank. Control, unknown and byte pieces are no pieces of a text.
    """
    pieces = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = [
        pieces.id_to_piece(i)
        for i in range(pieces.get_piece_size())
        if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i))
    ]
    norm = math.log(sum(1.0 / rank for rank in range(1, len(names) + 1)))
    return {name: -math.log(rank) - norm for rank, name in enumerate(names, 1)}


def trie_counts(words: Iterable[str], scores: dict[str, float]) -> Iterator[tuple[str, int]]:
    """Tokens on the best path through each word; ``words`` are distinct and sorted.

    Sorted words are the depth-first order of their trie. The stack holds the forward scores
    of the nodes on the path to the current word, so a node is scored once for all words
    below it, and memory is one path however many words there are. The best path has
    the highest log score, then the fewest tokens. A character without a piece of its own is
    one step that costs a token for each of its UTF-8 bytes.
    """
    longest = max(map(len, scores), default=1)
    unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
    path = ""
    stack: list[tuple[float, int]] = [(0.0, 0)]
    for word in words:
        shared = 0
        limit = min(len(path), len(word))
        while shared < limit and path[shared] == word[shared]:
            shared += 1
        del stack[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best, fewest = -math.inf, 0
            for start in range(max(0, end - longest), end):
                score = scores.get(word[start:end])
                if score is None:
                    continue
                before, tokens = stack[start]
                total = before + score
                if total > best or (total == best and tokens + 1 < fewest):
                    best, fewest = total, tokens + 1
            if word[end - 1] not in scores:
                before, tokens = stack[end - 1]
                total, tokens = before + unknown, tokens + len(word[end - 1].encode("utf-8", "replace"))
                if total > best or (total == best and tokens < fewest):
                    best, fewest = total, tokens
            stack.append((best, fewest))
        path = word
        yield word, stack[-1][1]


def _count_batches(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = unigram_scores(model_file)
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8") for t in batch.column(1)]
            split = [t.split() for t in texts]
            new = set().union(*split).difference(known)
            if len(known) > REMEMBERED:
                known = {}
                new = set().union(*split)
            marked = sorted(MARK + w.decode("utf-8") for w in new)
            known.update((word[1:].encode("utf-8"), n) for word, n in trie_counts(marked, scores))
            count = known.__getitem__
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([sum(map(count, words)) for words in split], pa.int64()),
                    pa.array([len(words) for words in split], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["doc_id", "n_tokens", "n_words", "n_bytes"],
            )

    return run


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, n_words, n_bytes`` for every row of ``docs``.

    Pre-tokens are the runs between ASCII white space, each with the mark of a word start in
    front, so a text's count is the sum over its pre-tokens. Each task puts the distinct
    pre-tokens of its own rows in a trie and never passes one on: no shuffle, and memory
    follows the Arrow batch and the fixed number of counts remembered.

    Needs ``doc_id, text``; other columns are not read. Null and blank texts count 0 tokens;
    null ids and repeated rows are kept as they are; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_count_batches(model_file), RESULT)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_model())
