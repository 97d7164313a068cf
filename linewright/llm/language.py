"""Language identification by compression with one dictionary per language."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.llm.registry import query, table
from linewright.llm.store import held

UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
LETTER = r"\p{L}"
#: Compression level, and the share of the runner-up that a clear winner saves at least.
LEVEL = 6
LEAST_MARGIN = 0.002
#: Bytes that are compressed at a time. What a dictionary saves is bounded, so each block starts
#: from the dictionary again and the margin does not fall with the length of a text.
BLOCK_BYTES = 4096
#: Slices of a language in which its sample is looked for.
SLICES = 16

RESULT = (
    "doc_id long, lang_pred string, score double, margin double, rejected boolean, runner_up string, "
    "best_bytes long"
)


def letters(text: str) -> bytes:
    """What is compressed: words in lower case, single spaces between them."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if words and not words.replace(" ", "").isalpha():
        # Numerals that are no digits, as in fractions and circled numbers, belong to words in patterns.
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return words.encode("utf-8", "replace")


def learn(
    labelled: DataFrame, docs_per_language: int = 900, chars_per_doc: int = 300
) -> dict[str, bytes]:
    """Raw dictionary content for every language of ``labelled`` (``doc_id, text, lang``).

    The fit uses a bounded sample: ``docs_per_language`` documents, those whose ids have the
    smallest hashes, and ``chars_per_doc`` characters of each, so at most their product per
    language reaches the driver however large the table is. Rows without text, letters or
    label are not learned from; repeated texts count once. Ties on the hash go by text.
    """
    # The smallest hashes of each slice first, so that a common language is no window of one task;
    # what is left for the second is at most SLICES times the sample.
    order = ["_hash", "_piece"]
    sample = (
        labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", F.xxhash64("doc_id").alias("_hash"), F.substring("text", 1, 2 * chars_per_doc).alias("_piece"))
        .where(F.col("_piece").rlike(LETTER))
        .withColumn("_slice", F.pmod(F.xxhash64("_hash", "_piece"), F.lit(SLICES)))
        .withColumn("_no", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order)))
        .where(F.col("_no") <= docs_per_language)
        .withColumn("_no", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        .where(F.col("_no") <= docs_per_language)
    )
    pieces: dict[str, dict[bytes, None]] = {}
    for row in sample.orderBy("lang", "_no").collect():
        pieces.setdefault(row["lang"], {})[letters(row["_piece"])[:chars_per_doc]] = None
    return {lang: b" ".join(texts) for lang, texts in pieces.items()}


def _compressors(contents: tuple[tuple[str, bytes], ...], level: int):
    return held(("compressors", contents, level), lambda: _made(contents, level))


def _made(contents: tuple[tuple[str, bytes], ...], level: int):
    made = []
    for lang, content in contents:
        # The library takes content from eight bytes on.
        dictionary = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=level)
        made.append(
            (lang, zstandard.ZstdCompressor(
                level=level, dict_data=dictionary, write_content_size=False, write_dict_id=False
            ))
        )
    return made


def classify(text: str | None, contents: tuple[tuple[str, bytes], ...], level: int, least_margin: float):
    """``(lang, score, margin, rejected, runner_up, bytes)`` of one text.

    Sizes are summed over the blocks of the whole text. The margin is the share of the second-smallest size that the smallest one saves. The score
    is a softmax over relative sizes, so one clear winner scores near 1 and equal sizes share.
    """
    body = letters(text) if text else b""
    if not body or not contents:
        return UNDETERMINED, 0.0, 0.0, True, None, None
    blocks = [body[at : at + BLOCK_BYTES] for at in range(0, len(body), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in _compressors(contents, level))
    best, lang = sizes[0]
    score = 1.0 / sum(math.exp(-100.0 * (size - best) / best) for size, _ in sizes)
    if len(sizes) == 1:
        return lang, score, 1.0, False, None, best
    margin = (sizes[1][0] - best) / sizes[1][0]
    return lang, score, margin, margin < least_margin, sizes[1][1], best


def _classify_batches(contents: tuple[tuple[str, bytes], ...], level: int, least_margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(t.as_py(), contents, level, least_margin) for t in batch.column(1)]
            columns = list(zip(*found)) if found else [[]] * 6
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "lang_pred", "score", "margin", "rejected", "runner_up", "best_bytes"],
            )

    return run


def identify(
    docs: DataFrame, contents: dict[str, bytes], level: int = LEVEL, least_margin: float = LEAST_MARGIN
) -> DataFrame:
    """Language of every whole text: ``doc_id, lang_pred, score, margin, rejected, …``.

    Each text is encoded once with the dictionary of each language, in blocks of
    ``BLOCK_BYTES`` that each start from the dictionary, and gets the language of the smallest
    summed size; ties go to the first name by code point. A row is ``rejected`` if the
    margin is narrower than ``least_margin`` or nothing could be decided. Rows are settled
    alone, without a shuffle.

    Needs ``doc_id, text``; other columns are not read. Null texts and texts without letters
    are ``und`` with score 0, and so is everything when no language was learned. Null ids and
    repeated rows are kept as they are; an empty table gives no rows.
    """
    fixed = tuple(sorted(contents.items()))
    return docs.select("doc_id", "text").mapInArrow(_classify_batches(fixed, level, least_margin), RESULT)


def _keep_batches(contents: tuple[tuple[str, bytes], ...], level: int, least_margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            rejected = [classify(t.as_py(), contents, level, least_margin)[3] for t in texts]
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return run


def keep_identified(
    docs: DataFrame, contents: dict[str, bytes], level: int = LEVEL, least_margin: float = LEAST_MARGIN
) -> DataFrame:
    """The rows of ``docs`` that ``identify`` would not reject, with all their columns."""
    fixed = tuple(sorted(contents.items()))
    return docs.mapInArrow(_keep_batches(fixed, level, least_margin), docs.schema)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def fit_and_identify(docs: DataFrame, **settings) -> DataFrame:
    """Learns from the labelled documents outside the held-out fold, then settles all rows."""
    return identify(docs, learn(docs.where(~held_out())), **settings)


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fit_and_identify(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )
