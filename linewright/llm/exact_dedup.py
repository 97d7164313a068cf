"""Exact duplicates through an extendible-hash index on shared files."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from linewright.llm.registry import query, table
from linewright.session import fresh_path

SPACE = " \t\n\x0b\x0c\r"
#: Distinct texts a bucket should hold at most; a fuller one splits.
BUCKET_ROWS = 4096
#: Bits of the hash that the directory may use, so at most a million entries.
MOST_BITS = 20
#: Bytes of distinct text that a task holds while it folds equal rows of its own.
FOLD_BYTES = 24 << 20

ENTRY = (
    "doc_id long, gid long, uid long, hash long, points long, sha string, body binary, n long, "
    "best_points long, best_id long, best_uid long"
)
CHAIN = "bucket int, hash long, gid long, class_size long, keep_points long, keep_id long, keep_uid long"


def normal(text: Column) -> Column:
    """The text without white space, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _better(a: tuple, b: tuple) -> bool:
    """Which of two (points, id, uid) stays: more code points, smaller id (null last), smaller uid."""
    return _rank(a) < _rank(b)


def _rank(c: tuple) -> tuple:
    points, doc_id, uid = c
    return -points, doc_id is None, doc_id or 0, uid


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a number of their own and of the local group of equal texts.

    The group's first row carries the text and speaks for all of them, so a text that a third
    of all rows have leaves a task once. Equal hashes are told apart by their bytes. Groups
    are closed when they hold ``FOLD_BYTES`` of text; the index joins what was cut.
    """
    uid = TaskContext.get().partitionId() << 40
    for batch in _pieces(batches):
        chains: dict[int, list[dict]] = {}
        rows = []
        for doc_id, key, points, sha, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
            me = (points, doc_id, uid)
            chain = chains.setdefault(key, [])
            group = next((g for g in chain if g["body"] == body), None)
            row = {"doc_id": doc_id, "uid": uid, "hash": key, "points": points, "sha": sha}
            if group is None:
                row |= {"gid": uid, "body": body, "n": 1, "_best": me}
                chain.append(row)
            else:
                row["gid"] = group["gid"]
                group["n"] += 1
                if _better(me, group["_best"]):
                    group["_best"] = me
            rows.append(row)
            uid += 1
        for row in rows:
            if "_best" in row:
                row["best_points"], row["best_id"], row["best_uid"] = row.pop("_best")
        yield pa.RecordBatch.from_pylist(rows, schema=_schema(ENTRY))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together up to ``FOLD_BYTES``, and those above it cut."""
    held, size = [], 0
    for batch in batches:
        if size + batch.nbytes > FOLD_BYTES and held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        rows = max(1, int(batch.num_rows * FOLD_BYTES / max(1, batch.nbytes)))
        if rows < batch.num_rows:
            yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
        elif batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Directory:
    """Extendible-hash directory over the leading bits of a hash.

    It has ``2 ** depth`` entries, one per prefix, and every entry names a bucket. A bucket with
    local depth d is named by all entries that share its first d bits. A bucket above its
    capacity splits on the next bit; if its depth is that of the directory, the directory
    doubles first. Rows are known by their count per prefix of ``bits`` bits only.
    """

    def __init__(self, counts: dict[int, int], bits: int, capacity: int):
        self.bits, self.depth = bits, 0
        #: Entry -> bucket; bucket -> (local depth, first bits).
        self.entries = [0]
        self.buckets = [(0, 0)]
        sums = [dict() for _ in range(bits + 1)]
        for prefix, n in counts.items():
            for depth in range(bits + 1):
                head = prefix >> (bits - depth)
                sums[depth][head] = sums[depth].get(head, 0) + n
        open_buckets = [0]
        while open_buckets:
            bucket = open_buckets.pop()
            depth, head = self.buckets[bucket]
            if depth < bits and sums[depth].get(head, 0) > capacity:
                open_buckets += self._split(bucket)

    def _split(self, bucket: int) -> tuple[int, int]:
        depth, head = self.buckets[bucket]
        if depth == self.depth:
            self.entries = [b for b in self.entries for _ in (0, 1)]
            self.depth += 1
        new = len(self.buckets)
        self.buckets[bucket] = (depth + 1, head << 1)
        self.buckets.append((depth + 1, head << 1 | 1))
        shift = self.depth - depth - 1
        first = (head << 1 | 1) << shift
        self.entries[first : first + (1 << shift)] = [new] * (1 << shift)
        return bucket, new


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)


def build_directory(entries: DataFrame, capacity: int = BUCKET_ROWS) -> Directory:
    """The directory for the texts of ``entries``; the driver sees counts per prefix, at most
    ``2 ** MOST_BITS`` of them."""
    n = entries.count()
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, n / capacity)))) + 3)
    counts = entries.groupBy(_prefix(bits).alias("p")).count().collect()
    return Directory({r["p"]: r["count"] for r in counts}, bits, capacity)


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle one hash after the other; rows arrive sorted by bucket and hash.

    Texts with one hash hang in a chain and are told apart by their bytes. What is held is one
    chain: each distinct text once, and the numbers of the groups that have it.
    """
    current, chain, done = None, [], []

    def settle() -> None:
        for c in chain:
            points, doc_id, uid = c["best"]
            done.extend(
                {"bucket": current[0], "hash": current[1], "gid": gid, "class_size": c["n"],
                 "keep_points": points, "keep_id": doc_id, "keep_uid": uid}
                for gid in c["gids"]
            )

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
            bucket, key, gid, body, n, *best = row
            best = tuple(best)
            if (bucket, key) != current:
                settle()
                current, chain = (bucket, key), []
            for c in chain:
                if c["body"] == body:
                    c["n"] += n
                    c["gids"].append(gid)
                    if _better(best, c["best"]):
                        c["best"] = best
                    break
            else:
                chain.append({"body": body, "n": n, "gids": [gid], "best": best})
        if len(done) >= 10_000:
            yield pa.RecordBatch.from_pylist(done, schema=_schema(CHAIN))
            done = []
    settle()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=_schema(CHAIN))


def build_index(docs: DataFrame, folder: str, capacity: int = BUCKET_ROWS) -> DataFrame:
    """Write the index of ``docs`` under ``folder`` and return the rows with their class.

    ``entries`` holds a row per document and each local group's text, ``directory`` the bucket of
    every prefix, ``buckets`` the settled chains sorted by bucket and hash. Buckets are
    ranges of the hash, and each is owned by one task, so the bytes of a text are compared
    in one place only.
    """
    spark = docs.sparkSession
    body = normal(F.col("text"))
    folded = (
        docs.select("doc_id", body.alias("body"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"))
        .select(
            "doc_id", F.xxhash64("body").alias("hash"), "points",
            F.sha2(F.encode("body", "UTF-8"), 256).alias("sha"), F.encode("body", "UTF-8").alias("body"),
        )
        .mapInArrow(_fold_batches, ENTRY)
    )
    folded.write.option("compression", "zstd").parquet(f"{folder}/entries")
    entries = spark.read.parquet(f"{folder}/entries")
    texts = entries.where(F.col("body").isNotNull())
    directory = build_directory(texts.select("hash"), capacity)
    spark.createDataFrame(
        list(enumerate(directory.entries)),
        StructType([StructField("p", IntegerType()), StructField("bucket", IntegerType())]),
    ).write.parquet(f"{folder}/directory")
    # At most 2 ** MOST_BITS rows of two numbers.
    owners = F.broadcast(spark.read.parquet(f"{folder}/directory"))
    settled = (
        texts.withColumn("p", _prefix(directory.depth))
        .join(owners, "p")
        .select("bucket", "hash", "gid", "body", "n", "best_points", "best_id", "best_uid")
        .repartition(F.col("bucket"))
        .sortWithinPartitions("bucket", "hash")
        .mapInArrow(_chain_batches, CHAIN)
    )
    settled.write.parquet(f"{folder}/buckets")
    classes = spark.read.parquet(f"{folder}/buckets").select("gid", "class_size", "keep_id", "keep_uid")
    return entries.select("doc_id", "gid", "uid", "sha").join(classes, "gid")


def exact_duplicates(docs: DataFrame, capacity: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal if they are the same without white space. Of equal ones stays the row
    with the most code points, then the smallest id.

    Needs ``doc_id, text``; other columns are not read. Null texts are empty and equal to
    blank ones. A null id loses every tie, and of rows that agree in length and id one stays.
    Texts of any length are compared whole. An empty table gives no rows.
    """
    rows = build_index(docs, fresh_path(docs.sparkSession, "exact-index"), capacity)
    return rows.select(
        "doc_id", "keep_id", F.col("class_size").alias("group_size"),
        (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
r AS (SELECT doc_id, body,
        row_number() OVER (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST) AS n,
        first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
        count(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(body) AS text_sha256 FROM r
"""


@query("op9_exact_dedup", ORACLE)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
