"""The stages of the corpus pipeline; each calls one operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import decontamination, language, mixing, near_dup, token_files
from linewright.llm.registry import free_name, table


def settle_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could be told; the label they came with is not touched.

    Null texts and texts without letters go, as no language can be told. Null ids and labels stay, rows that
    repeat stay as often as they occur, and columns of any name are handed on. Of an empty table, or one
    without labels to learn from, nothing stays.
    """
    return language.keep_identified(docs, language.learn(docs.where(~language.held_out())))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept document of each near-duplicate class; of rows equal in id and text, one.

    Null texts count as empty; texts without words are in no class and all stay. A null id is an id like
    others, behind them in order. An empty table gives no rows; columns of any name are handed on.
    """
    names = [free_name(docs, n) for n in ("_id", "_none", "_hash")]
    identity = [F.coalesce("doc_id", F.lit(0)).alias(names[0]), F.col("doc_id").isNull().alias(names[1])]
    kept = near_dup.near_duplicates(docs).where("kept").select(*identity, F.col("text_hash").alias(names[2])).distinct()
    hashed = docs.select("*", *identity, F.xxhash64(F.coalesce("text", F.lit(""))).alias(names[2]))
    # The join leaves its rows dealt and sorted by these names, so equal rows already meet.
    return hashed.join(kept, names, "left_semi").dropDuplicates(names).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, which is settled once per text.

    Null and empty texts have no passage and stay, as do null ids and rows that repeat. Empty tables, of documents or
    of the benchmark, are no error; columns of any name are handed on.
    """
    keys = decontamination.text_keys()
    names = [free_name(docs, f"_{n}") for n in keys]
    found = decontamination.find_items(docs, table(spark, sf_dir, "benchmark"))
    hit = found.select(*[F.col(k).alias(n) for k, n in zip(keys, names)]).distinct()
    marked = docs.select("*", *[c.alias(n) for c, n in zip(keys.values(), names)])
    return marked.join(hit, names, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; see ``mixed_documents`` for nulls, ties and repeated rows."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: ``doc_id, start, n_tokens, ids_crc32``.

    Null texts are the end id alone, null ids come first, rows that repeat are written each, and an
    empty table writes no file. Other columns are not read.
    """
    return token_files.round_trip(docs, token_files.default_tokenizer())


STAGES = [
    ("language", settle_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("tokens", token_output),
]
