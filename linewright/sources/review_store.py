"""Stored reviews that change: saved, scored, commented on and deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.sources.keyed import KeyedStore

#: Columns that name a row of each table.
NAMES = {"reviews": ["review_id"], "files": ["review_id", "file_ord"], "findings": ["review_id", "file_ord", "ord"]}


class ReviewStore:
    """Reviews, their files and findings, laid out by buckets of ``review_id``.

    Each method is one change: it is there for all three tables or for none, and readers see the state
    before it until it is complete.
    """

    def __init__(self, spark: SparkSession, folder: str, reviews: str, files: str, findings: str, buckets: int = 16):
        """The schemas as DDL; ``reviews`` has ``status`` and ``findings`` has ``feedback``."""
        tables = {"reviews": reviews, "files": files, "findings": findings}
        self._store = KeyedStore(spark, folder, tables, "review_id", buckets)

    def read(self, table: str, review_id: int | None = None) -> DataFrame:
        """Stored rows; those of one review come from its own bucket."""
        return self._store.read(table, review_id)

    def save(self, reviews: DataFrame, files: DataFrame, findings: DataFrame) -> None:
        """Put reviews in with all they hold. What was stored of these reviews goes."""
        new = {"reviews": reviews, "files": files, "findings": findings}
        self._store.change({t: (df, NAMES[t]) for t, df in new.items()}, reviews.select("review_id"))

    def update_reviews(self, changes: DataFrame) -> None:
        """Set the columns of ``changes``, which has one row for a ``review_id``; reviews that are not
        stored, or not any more, are passed over."""
        self._store.update("reviews", changes, NAMES["reviews"])

    def set_feedback(self, feedback: DataFrame) -> None:
        """``review_id, file_ord, ord, feedback, seq``: of several for one finding the last one counts."""
        last = feedback.groupBy(*NAMES["findings"]).agg(F.max_by("feedback", "seq").alias("feedback"))
        self._store.update("findings", last, NAMES["findings"])

    def delete(self, reviews: DataFrame) -> None:
        """Take out reviews by ``review_id`` with their files and findings."""
        self._store.change(deletes=reviews.select("review_id"))

    def vacuum(self) -> None:
        self._store.vacuum()
