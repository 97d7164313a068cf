"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.functions import text
from linewright.plans.registry import over, query
from linewright.plans.scan_queries import SCAN_STEPS
from linewright.sources.corpus import table, view, view_sql
from linewright.streaming import streams


#: Slices in which the tables arrive; each one is a micro-batch of a stream that starts anew.
ARRIVALS = 3


def view_of(stream, name, source):
    """A corpus view over a table that arrives as a stream."""
    stream.createOrReplaceTempView(f"linewright_stream_{source}")
    sql = view_sql(name, "spark").replace(f"FROM {source}", f"FROM linewright_stream_{source}")
    return stream.sparkSession.sql(sql)


@query(
    "stream_scan",
    over("files", """SELECT file_id, rule_id, CAST(line_no AS INT) AS line_start FROM hits JOIN catalogue USING (rule_ord)""",
         *SCAN_STEPS),
)
def stream_scan(spark, sf_dir):
    def job(stream, folder):
        return streams.scan_stream(view_of(stream, "files", "documents"), folder)

    found = streams.in_arrivals(table(spark, sf_dir, "documents"), "doc_id", ARRIVALS, job)
    return found.select("file_id", "rule_id", "line_start")


@query(
    "stream_sequence",
    over("review_events", """SELECT review_id, ord, type, row_number() OVER (PARTITION BY review_id ORDER BY ord)
         AS sequence_number FROM review_events"""),
)
def stream_sequence(spark, sf_dir):
    def job(stream, folder):
        return streams.sequence_events(view_of(stream, "review_events", "events").select("review_id", "ord", "type"), folder)

    return streams.in_arrivals(table(spark, sf_dir, "events"), "event_id", ARRIVALS, job)


@query(
    "stream_subscribe",
    over("review_events", """SELECT n_name AS subscriber, review_id, ord, type FROM review_events
         JOIN nation ON n_nationkey = review_id"""),
)
def stream_subscribe(spark, sf_dir):
    """Every nation subscribes to the review of its number."""
    wanted = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("subscriber"), F.col("n_nationkey").cast("long").alias("review_id")
    )

    def job(stream, folder):
        events = view_of(stream, "review_events", "events").select("review_id", "ord", "type")
        return streams.subscribe_all(events, wanted, folder)

    return streams.in_arrivals(table(spark, sf_dir, "events"), "event_id", ARRIVALS, job)


@query(
    "stream_progress",
    over("review_events", """SELECT review_id, arg_max(type, ord) AS last_type,
         CAST(count_if(type = 'BATCH_COMPLETED') AS BIGINT) AS batches_done,
         CAST(sum(new_findings) AS BIGINT) AS findings, max(ord) FILTER (type = 'REVIEW_FAILED') AS failed_at,
         arg_max(total_batches, ord) FILTER (total_batches IS NOT NULL) AS total_batches,
         arg_max(score, ord) FILTER (score IS NOT NULL) AS score,
         arg_max(error_message, ord) FILTER (error_message IS NOT NULL) AS error_message
         FROM review_events GROUP BY review_id"""),
)
def stream_progress(spark, sf_dir):
    def job(stream, folder):
        return streams.progress(view_of(stream, "review_events", "events"), folder)

    return streams.in_arrivals(table(spark, sf_dir, "events"), "event_id", ARRIVALS, job)


@query(
    "stream_dedup",
    "SELECT sha256(text) AS content_hash, min(doc_id) AS file_id FROM documents GROUP BY 1",
)
def stream_dedup(spark, sf_dir):
    """Documents arrive a second apart; contents are remembered for longer than the table spans."""

    def job(stream, folder):
        files = stream.select(
            text.content_hash(F.col("text")).alias("content_hash"), F.col("doc_id").alias("file_id"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("event_time"),
        )
        return streams.unseen_within(files, "36500 days", folder)[0]

    return streams.in_arrivals(table(spark, sf_dir, "documents"), "doc_id", ARRIVALS, job).select("content_hash", "file_id")
