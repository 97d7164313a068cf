"""State per key that a stream keeps in its state store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which keyed state variables need; the
    session's own setting is back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class EventNumbers(StatefulProcessor):
    """Counters of a slice of the reviews: events are numbered on from where the last batch of their review stopped.

    The slice's events of one micro-batch are put in order by one task and numbered together, as calls
    and frames for each review cost more than its events; the trigger bounds how many that are. What stays
    between batches is one number per review, and a batch asks for the numbers of its own reviews only.
    """

    def init(self, handle) -> None:
        self._used = handle.getMapState("used", "review string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        """``rows`` have the review as text in ``of_review`` and tell in ``of_last`` which have no ``ord``."""
        events = pd.concat(list(rows), ignore_index=True).sort_values(["of_review", "of_last", "ord"], kind="stable")
        reviews = events.groupby("of_review", sort=False)
        counts = reviews.size()
        used = []
        for review, n in zip(counts.index.tolist(), counts.tolist()):
            known = self._used.getValue((review,))
            used.append(known[0] if known else 0)
            self._used.updateValue((review,), (used[-1] + n,))
        events["sequence_number"] = np.repeat(np.array(used, dtype=np.int64), counts.to_numpy()) + reviews.cumcount().to_numpy() + 1
        yield events.drop(columns=["of_review", "of_last"])

    def close(self) -> None:
        pass
