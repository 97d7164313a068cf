"""Sources, sinks and the filters that decide which files enter a run."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright import fixed_values as fv
from linewright.session import fresh_path
from linewright.functions import text

REVIEW_BUCKETS = 64
FILE_END = "\x00"
FOLDER_FILES = 500
READ_FOLDERS = 64
#: Tasks of one turn of a read at most; a row number in a task has 33 bits.
READ_TASKS = 1 << 13

FINDING_MAP = T.MapType(
    T.StringType(),
    T.ArrayType(
        T.StructType(
            [
                T.StructField("filename", T.StringType()),
                T.StructField("lineStart", T.IntegerType()),
                T.StructField("lineEnd", T.IntegerType()),
                T.StructField("severity", T.StringType()),
                T.StructField("category", T.StringType()),
                T.StructField("message", T.StringType()),
                T.StructField("description", T.StringType()),
                T.StructField("suggestedFix", T.StringType()),
                T.StructField("confidence", T.DoubleType()),
            ]
        )
    ),
)


def write_text_files(files: DataFrame, path: str) -> list[str]:
    """One file per row of ``files`` (``name``, ``content``; null is an empty text) below ``path``; returns the folders.

    Tasks write the files themselves, so there is no rename per file and no commit in the driver. A file is called by
    its quoted name and its number in the task, so equal names stay apart. A folder holds at most
    ``FOLDER_FILES`` files and belongs to one attempt of a task: what a lost attempt left is in none of
    the folders that are returned.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, root = fs.FileSystem.from_uri(path)
        folder, number = "", 0
        for batch in batches:
            made = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number % FOLDER_FILES == 0:
                    folder = uuid.uuid4().hex
                    file_system.create_dir(f"{root}/{folder}")
                    made.append(f"{path}/{folder}")
                with file_system.open_output_stream(f"{root}/{folder}/{number}@{quote(name, safe='')}") as out:
                    out.write(((content or "") + FILE_END).encode())
                number += 1
            yield pa.RecordBatch.from_pydict({"folder": pa.array(made, pa.string())})

    return [row.folder for row in files.select("name", "content").mapInArrow(write, "folder string").collect()]


def written_text_files(read: DataFrame) -> DataFrame:
    """Rows of ``read_text_files`` with the names and contents that ``write_text_files`` was given."""
    # The paths that the reader tells are quoted once more.
    name = F.url_decode(F.url_decode(F.substring_index(F.substring_index("path", "/", -1), "@", -1)))
    return read.withColumn("filename", name).withColumn("content", F.expr("substr(content, 1, length(content) - 1)"))


def read_text_files(spark: SparkSession, path: str | list[str], base: str = "", review_id: int = 0) -> DataFrame:
    """Every file below ``path`` as one row of review ``review_id``; the name is the path behind ``base``.

    ``path`` tells files apart. ``file_id`` numbers the files of this read, so the rows are
    written out once and keep their numbers. A list of folders is read ``READ_FOLDERS`` at a time: the list of files
    that the driver holds does not grow with their number, and the executors list the folders.
    """
    name = F.col("_metadata.file_path")
    if base:
        name = F.substring_index(name, base.rstrip("/") + "/", -1)
    folders = [path] if isinstance(path, str) else path
    tasks = min(4 * spark.sparkContext.defaultParallelism, READ_TASKS)
    out = fresh_path(spark, "text-files")
    for turn in range(max(-(-len(folders) // READ_FOLDERS), 1)):
        part = folders[turn * READ_FOLDERS : (turn + 1) * READ_FOLDERS]
        raw = spark.read.option("recursiveFileLookup", "true").schema("value string").text(part, wholetext=True)
        # Small files make a split of a few each; these many tasks take the splits one after another.
        raw.coalesce(tasks).select(
            F.lit(review_id).cast("long").alias("review_id"),
            (F.lit(turn).cast("long") * (READ_TASKS << 33) + F.monotonically_increasing_id()).alias("file_id"),
            F.col("_metadata.file_path").alias("path"),
            name.alias("filename"),
            F.col("value").alias("content"),
        ).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def ingest(files: DataFrame) -> DataFrame:
    """A file list in the canonical schema; ``file_id`` rises in input order."""
    return files.select(
        F.col("review_id").cast("long"),
        F.col("file_id").cast("long"),
        F.col("file_id").cast("long").alias("file_ord"),
        "filename",
        "content",
    )


def prepare(files: DataFrame) -> DataFrame:
    """Clean names, classify, hash and count; binary files leave here.

    The language comes from the raw name, before the name is cleaned.
    """
    return files.where(~text.is_binary(F.col("content"))).select(
        *[c for c in files.columns if c not in ("filename", "content")],
        text.sanitize_filename(F.col("filename")).alias("filename"),
        text.detect_language(F.col("filename")).alias("language"),
        text.content_hash(F.col("content")).alias("content_hash"),
        text.lines_of_code(F.col("content")).alias("lines_of_code"),
        "content",
    )


def _in_skipped_folder(path, names) -> F.Column:
    """Some path segment is a skipped folder or starts with a dot."""
    dotted = path.startswith(".") | path.contains("/.")
    wrapped = F.concat(F.lit("/"), path, F.lit("/"))
    named = F.lit(False)
    for name in names:
        if not name.startswith("."):
            named = named | wrapped.contains(f"/{name}/")
    return dotted | named


def listed(
    manifest: DataFrame, base_path: str = "", max_bytes: int = fv.LISTING_MAX_BYTES
) -> DataFrame:
    """Entries of the kinds, folders and sizes that a listing takes; 0 bytes where no size is told."""
    return manifest.where(
        (F.col("type") == "blob")
        & text.one_of(text.extension(F.col("path")), fv.LISTING_EXTENSIONS)
        & ~_in_skipped_folder(F.col("path"), fv.LISTING_SKIP_DIRS)
        & F.col("path").startswith(base_path)
        & (F.coalesce(F.col("size"), F.lit(0)) <= max_bytes)
    )


def filter_manifest(
    manifest: DataFrame, base_path: str = "", max_files: int = fv.LISTING_MAX_FILES, max_bytes: int = fv.LISTING_MAX_BYTES
) -> DataFrame:
    """The first ``max_files`` listed entries per repository in listing order.

    The row number with an upper bound becomes a per-task limit before the shuffle, so a
    repository with very many entries sends that many rows per task and no more.
    ``manifest_cut`` tells how many entries that leaves out.
    """
    kept = listed(manifest, base_path, max_bytes)
    order = Window.partitionBy("repo_id").orderBy("listing_ord")
    return (
        kept.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= max_files)
    )


def manifest_cut(
    manifest: DataFrame, base_path: str = "", max_files: int = fv.LISTING_MAX_FILES, max_bytes: int = fv.LISTING_MAX_BYTES
) -> DataFrame:
    """Per repository: entries listed, and those that ``filter_manifest`` leaves out."""
    counts = listed(manifest, base_path, max_bytes).groupBy("repo_id").agg(F.count(F.lit(1)).alias("listed"))
    return counts.withColumn("left_out", F.greatest(F.col("listed") - max_files, F.lit(0)))


def filter_pull_request(files: DataFrame, max_chars: int = fv.PR_MAX_CHARS) -> DataFrame:
    return files.where(
        (F.col("status") != "removed")
        & text.one_of(text.extension(F.col("filename")), fv.LISTING_EXTENSIONS)
        & ~_in_skipped_folder(F.col("filename"), fv.LISTING_SKIP_DIRS)
        & (text.utf16_length(F.col("content")) <= max_chars)
    )


def filter_folder(paths: DataFrame, max_chars: int = fv.FOLDER_MAX_CHARS) -> DataFrame:
    """Files a user drops as a folder; a name without a dot has no extension at all."""
    return paths.where(
        F.col("path").contains(".")
        & text.one_of(text.extension(F.col("path")), fv.FOLDER_EXTENSIONS)
        & ~_in_skipped_folder(F.col("path"), fv.FOLDER_SKIP_DIRS)
        & (F.col("content") != "")
        & (text.utf16_length(F.col("content")) <= max_chars)
    )


def import_summary(files: DataFrame) -> DataFrame:
    """Per import: file and line totals; both add up map-side before the shuffle."""
    return files.groupBy("repo_id", "type", "owner", "repo").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum(text.line_count(F.col("content")).cast("long")).alias("line_count"),
    )


def read_finding_map(documents: DataFrame, column: str = "json") -> DataFrame:
    """JSON maps ``filename -> findings`` as rows, one per finding, in document order."""
    keys = [c for c in documents.columns if c != column]
    entries = documents.select(
        *keys, F.explode(F.from_json(F.col(column), FINDING_MAP)).alias("filename", "items")
    )
    return entries.select(*keys, "filename", F.posexplode("items").alias("position", "item")).select(
        *keys,
        "filename",
        F.col("position").cast("long"),
        F.col("item.lineStart").alias("line_start"),
        F.col("item.lineEnd").alias("line_end"),
        F.col("item.severity").alias("severity"),
        F.col("item.category").alias("category"),
        F.coalesce("item.message", "item.description").alias("message"),
        F.col("item.suggestedFix").alias("suggested_fix"),
        F.col("item.confidence").alias("confidence"),
    )


def review_bucket(review_id) -> F.Column:
    return F.pmod(F.xxhash64(review_id), F.lit(REVIEW_BUCKETS)).cast("int")


def write_by_review(df: DataFrame, path: str) -> None:
    """Bulk write, laid out by a fixed number of review buckets.

    One folder per review would mean as many tiny files as reviews. The rebalance hint lets
    AQE split a bucket that holds most of the rows and pack small ones together.
    """
    bucketed = df.withColumn("review_bucket", review_bucket(F.col("review_id")))
    bucketed.hint("rebalance", F.col("review_bucket")).write.mode("errorifexists").partitionBy(
        "review_bucket"
    ).parquet(path)


def read_by_review(spark: SparkSession, path: str, review_id: int | None = None) -> DataFrame:
    """Stored rows; one review reads its own bucket only."""
    stored = spark.read.parquet(path)
    if review_id is not None:
        wanted = F.lit(review_id).cast("long")
        stored = stored.where(
            (F.col("review_bucket") == review_bucket(wanted)) & (F.col("review_id") == wanted)
        )
    return stored.drop("review_bucket")


def write_review(path: str, reviews: DataFrame, files: DataFrame, findings: DataFrame) -> None:
    """The three tables of reviews below one folder, each laid out by review bucket."""
    for name, rows in (("reviews", reviews), ("files", files), ("findings", findings)):
        write_by_review(rows, f"{path}/{name}")


def read_review(spark: SparkSession, path: str, review_id: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored reviews, files and findings; one review reads its own buckets only."""
    reviews, files, findings = (
        read_by_review(spark, f"{path}/{name}", review_id) for name in ("reviews", "files", "findings")
    )
    return reviews, files, findings


def review_headers(files: DataFrame) -> DataFrame:
    """``total_files`` counts every input, ``analyzed_files`` only text ones."""
    return files.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(~text.is_binary(F.col("content"))).alias("analyzed_files"),
    )
