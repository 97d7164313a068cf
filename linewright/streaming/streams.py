"""Structured Streaming jobs.

Every job runs until it has read what is there (``availableNow``) and keeps its progress, its state and
its result under one folder. Called again with that folder it goes on where it stopped, with the
state it had; a batch that runs again after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from linewright.operators import scan
from linewright.session import drop_folder, fresh_path
from linewright.sources.keyed import KeyedStore
from linewright.streaming.state import EventNumbers, rocks_state

#: Slices of reviews that are numbered together; the state stays one counter per review.
SLICES = 1024


def read_files(spark: SparkSession, folder: str, schema, pattern: str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is given, never guessed."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def arrivals(rows: DataFrame, order: str, parts: int) -> Iterator[DataFrame]:
    """The rows in ``parts`` slices by ``order``, as they would arrive; null orders come last."""
    column = F.col(order)
    marks = rows.agg(F.percentile_approx(order, [n / parts for n in range(1, parts)], 10_000)).first()[0] or []
    edges = [None, *sorted(set(marks)), None]
    for low, high in zip(edges, edges[1:]):
        part = rows if low is None else rows.where((column > low) | column.isNull() if high is None else column > low)
        yield part if high is None else part.where(column <= high)


def in_arrivals(rows: DataFrame, order: str, parts: int, job: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Land the slices one after the other; after each, ``job(stream, folder)`` runs as a stream that
    starts anew and goes on from its folder. Returns what it gave last."""
    spark = rows.sparkSession
    landing, folder = fresh_path(spark, "landing"), fresh_path(spark, "stream")
    result = None
    for part in arrivals(rows, order, parts):
        part.write.mode("append").parquet(landing)
        result = job(read_files(spark, landing, rows.schema, "*.parquet"), folder)
    return result


def _run(writer, checkpoint: str) -> list:
    """Runs a stream to the end of its input; returns the progress it told."""
    running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return list(running.recentProgress)


def append(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Run a stream into a parquet table and hand the table back."""
    return _append(stream, folder or fresh_path(stream.sparkSession, label))[0]


def _append(stream: DataFrame, folder: str) -> tuple[DataFrame, list]:
    told = _run(stream.writeStream.format("parquet").option("path", f"{folder}/table"), f"{folder}/progress")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table"), told


def scan_stream(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Findings of files as they arrive: the line scan has no state and runs as it is."""
    return append(scan.scan(files), "stream-scan", folder)


def sequence_events(events: DataFrame, folder: str | None = None) -> DataFrame:
    """Numbers the events of each review from 1, batch after batch and by ``ord`` within a batch.

    The state store holds one counter per review, and no batch reads what earlier ones wrote. An
    event that arrives after later ones gets the next free number, as numbers once given stay.
    Events without a review are numbered as a review of their own.
    """
    review = F.col("review_id")
    # A null among whole numbers would turn the column into floats on its way through pandas, where names
    # that begin with an underscore are lost.
    whole = [f.name for f in events.schema.fields if isinstance(f.dataType, IntegralType)]
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    flags = "".join(f", no_{name} boolean" for name in whole)
    sliced = events.select(
        *[F.coalesce(name, F.lit(0)).cast(events.schema[name].dataType).alias(name) if name in whole else F.col(name) for name in events.columns],
        *[F.col(name).isNull().alias(f"no_{name}") for name in whole],
        F.when(review.isNull(), -1).otherwise(F.pmod(F.xxhash64(review), F.lit(SLICES))).cast("int").alias("of_slice"),
        F.coalesce(review.cast("string"), F.lit("")).alias("of_review"),
        F.col("ord").isNull().alias("of_last"),
    )
    with rocks_state(events.sparkSession):
        numbered = sliced.groupBy("of_slice").transformWithStateInPandas(
            EventNumbers(), f"{names}{flags}, of_slice int, sequence_number long", "append", "none"
        )
        told = numbered.select(
            *[F.when(~F.col(f"no_{name}"), F.col(name)).alias(name) if name in whole else F.col(name) for name in events.columns],
            "sequence_number",
        )
        return append(told, "stream-sequence", folder)


def subscribe(events: DataFrame, review_id: int) -> DataFrame:
    """The events of one review, as a stream."""
    return events.where(F.col("review_id") == review_id)


def subscribe_all(events: DataFrame, subscriptions: DataFrame, folder: str | None = None) -> DataFrame:
    """The events of every subscribed review, once per subscriber."""
    return append(events.join(subscriptions, "review_id"), "stream-subscribe", folder)


_PROGRESS = (
    "review_id long, last_type string, batches_done long, findings long, failed_at long, "
    "total_batches int, score int, error_message string"
)


def progress(events: DataFrame, folder: str | None = None, buckets: int = 8) -> DataFrame:
    """Latest state per review: last type, finished and all batches, findings so far, and the
    last score and error text told.

    The aggregate keeps one row of state per review and combines map-side. Each batch merges the
    reviews that changed into a snapshot by review; buckets that no review of the batch falls into are not
    touched, and what the snapshot replaces is deleted. So what is stored, and what a reader
    reads, is one row per review however many batches there were.
    """
    # Events that carry no score, total or error text tell none.
    optional = {"total_batches": "int", "score": "int", "error_message": "string"}
    missing = {n: F.lit(None).cast(t) for n, t in optional.items() if n not in events.columns}
    state = events.withColumns(missing).groupBy("review_id").agg(
        F.max_by("type", "ord").alias("last_type"),
        F.count_if(F.col("type") == "BATCH_COMPLETED").alias("batches_done"),
        F.sum(F.col("new_findings").cast("long")).alias("findings"),
        F.max(F.when(F.col("type") == "REVIEW_FAILED", F.col("ord"))).alias("failed_at"),
        *[
            F.max_by(name, F.when(F.col(name).isNotNull(), F.col("ord"))).alias(name)
            for name in optional
        ],
    )
    folder = folder or fresh_path(events.sparkSession, "stream-progress")

    def store(spark: SparkSession) -> KeyedStore:
        return KeyedStore(spark, f"{folder}/snapshot", {"state": _PROGRESS}, "review_id", buckets)

    def step(batch: DataFrame, number: int) -> None:
        snapshot = store(batch.sparkSession)
        # The merge reads the batch's keys before its rows, and the aggregate should run once.
        changed = f"{folder}/changed-{number}"
        batch.write.mode("overwrite").parquet(changed)
        snapshot.change({"state": (batch.sparkSession.read.schema(_PROGRESS).parquet(changed), ["review_id"])}, commit=number)
        snapshot.vacuum(keep=2)
        drop_folder(changed)

    _run(state.writeStream.outputMode("update").foreachBatch(step), f"{folder}/progress")
    return store(events.sparkSession).read("state")


_SEEN = "content_hash string, file_id long, event_time timestamp"


def _combined(rows: pa.Table) -> pa.Table:
    """One row per content: its smallest file, and its latest time."""
    grouped = rows.group_by("content_hash").aggregate([("file_id", "min"), ("event_time", "max")])
    return grouped.rename_columns(["content_hash", "file_id", "event_time"])


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _combined(pa.Table.from_batches([batch])).to_batches()


def _one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per content of a partition; after the first step there are few of each content."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = _combined(rows if held is None else pa.concat_tables([held, rows]))
    if held is not None:
        yield from held.to_batches()


def _single_copies(files: DataFrame) -> DataFrame:
    """One row per content of a micro-batch. Copies are combined where they are read, so a content
    that makes up most of the stream costs one row per Arrow batch."""
    narrow = files.select("content_hash", "file_id", "event_time")
    return narrow.mapInArrow(_first_copies, _SEEN).repartition("content_hash").mapInArrow(_one_each, _SEEN)


def unseen_contents(files: DataFrame, folder: str | None = None) -> DataFrame:
    """``content_hash, file_id``: the first file of each content; later ones with it are skipped.

    The state store holds every content there ever was; ``unseen_within`` bounds it. Of a content's
    files in its first batch the smallest stands for it.
    """
    single = _single_copies(files.withColumn("event_time", F.lit(None).cast("timestamp")))
    fresh = single.dropDuplicates(["content_hash"]).select("content_hash", "file_id")
    return append(fresh, "stream-dedup", folder)


def unseen_within(files: DataFrame, delay: str, folder: str | None = None) -> tuple[DataFrame, int]:
    """``content_hash, file_id, event_time`` of contents not seen for a while, and the number of late ones.

    ``files`` has ``content_hash, file_id, event_time``; later files with a content are skipped as in
    ``unseen_contents``. A content is forgotten once the watermark, which is the newest event time
    less ``delay`` (such as ``"30 days"``), has passed its time by ``delay``; when it comes back
    after that it is new. So the state is bounded by the contents of that span, not by the history.

    A content all of whose files in a batch are older than the watermark is late: it is skipped
    and counted, since what was known about it may be forgotten; the batch scan of known hashes
    settles it. So are files without an event time, which are not counted.
    """
    single = _single_copies(files.where(F.col("event_time").isNotNull()))
    fresh = single.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["content_hash"])
    table, told = _append(fresh, folder or fresh_path(files.sparkSession, "stream-dedup"))
    late = sum(operator.numRowsDroppedByWatermark for batch in told for operator in batch.stateOperators)
    return table, late
