"""Places to plug in detectors and scorers."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import text
from linewright.operators import lint, responses, scan
from linewright.operators.groups import gather, whole_groups
from linewright.operators.merging import union_findings
from linewright.session import cut_lineage

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Analyzer:
    """A detector: which languages it takes, and how it turns files into findings."""

    name: str
    analyze: Callable[[DataFrame], DataFrame]
    supports: Callable[[Column], Column] = field(default=lambda language: F.lit(True))


@dataclass
class AnalyzerRegistry:
    analyzers: list[Analyzer] = field(default_factory=list)

    def register(self, analyzer: Analyzer) -> "AnalyzerRegistry":
        self.analyzers.append(analyzer)
        return self

    def _runs(self, files: DataFrame, isolated: bool, whole: bool) -> list[DataFrame]:
        found = []
        for analyzer in self.analyzers:
            try:
                result = analyzer.analyze(files.where(analyzer.supports(F.col("language"))))
                found.append(cut_lineage(result, "findings") if isolated else result)
            except Exception as error:  # one detector must not take the others down
                if whole:
                    raise RuntimeError(f"analyzer {analyzer.name} failed: {type(error).__name__}") from error
                log.warning("analyzer %s failed: %s", analyzer.name, type(error).__name__)
        return found

    def analyze(self, files: DataFrame, isolated: bool = True, whole: bool = False) -> DataFrame:
        """Union of all findings in registration order.

        Each detector runs on its own into the shared folder, so one that fails, when it is
        planned or when it runs, is left out and takes no other one down. Without
        ``isolated`` all of them stay one lazy plan, in which only failures of planning
        are caught. With ``whole`` nothing is left out: the first failure is raised and names
        its detector, for callers whose result must not lack a detector's findings.
        """
        return union_findings(*self._runs(files, isolated, whole))


def default_registry() -> AnalyzerRegistry:
    return (
        AnalyzerRegistry()
        .register(Analyzer("pattern-scanner", scan.scan))
        .register(Analyzer("eslint", lint.line_findings, lint.is_linted))
        .register(Analyzer("eslint-spans", lint.span_findings, lint.is_linted))
    )


_SCORED = pa.schema(
    [("review_id", pa.int64()), ("file_id", pa.int64()), ("filename", pa.string()), ("category", pa.string()),
     ("severity", pa.string()), ("message", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()),
     ("suggested_fix", pa.string()), ("confidence", pa.float64())]
)
SCORER_SCHEMA = (
    "review_id long, file_id long, filename string, category string, severity string, message string, "
    "line_start int, line_end int, suggested_fix string, confidence double"
)
Scorer = Callable[[pd.DataFrame, str], pd.DataFrame]
SCORERS: dict[str, Scorer] = {}


def score_batches(
    files: DataFrame, scorer: str, canned: DataFrame, profile: str = "full", batch: tuple[str, ...] = ("review_id",)
) -> DataFrame:
    """Findings of a named scorer, one call per batch; canned ones for an unknown name.

    ``batch`` names the columns that make a batch. A scorer is a Python callable on a pandas
    frame that holds all files of one batch in ``file_id`` order and no others, as a model
    request does; batches are dealt over the tasks. What a call holds is one batch, which
    ``create_batches`` bounds by its token budget.
    """
    if profile not in fv.PROFILE_TEXT:
        raise ValueError(f"unknown profile {profile}")
    call = SCORERS.get(scorer)
    if call is None:
        found = responses.canned_findings(files, canned).drop("source", "position")
    else:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, bounds in whole_groups(batches, list(batch)):
                for low, high in bounds:
                    found = call(rows.slice(low, high - low).to_pandas(), profile)
                    yield from pa.Table.from_pandas(found, _SCORED, preserve_index=False).to_batches()

        found = gather(files, list(batch), "file_id").mapInArrow(run, SCORER_SCHEMA)
    return found.withColumn("source", F.lit("llm"))


_MEASURED = pa.schema([*_SCORED, ("_files", pa.int64()), ("_tokens", pa.int64()), ("_found", pa.int64()), ("_millis", pa.float64())])


def score_with_metrics(
    files: DataFrame, scorer: str, canned: DataFrame, profile: str = "full", batch: tuple[str, ...] = ("review_id",)
) -> tuple[DataFrame, DataFrame]:
    """Findings as of ``score_batches``, and one row per batch: its columns, ``files, tokens, findings, millis``.

    The call that makes the findings measures itself, and both tables come from one run, which is written
    to the shared folder: a batch whose task is repeated tells the time of the attempt that counts.
    ``tokens`` is the estimate for the contents. Canned findings are no call, so their batches have
    no ``millis``.
    """
    if profile not in fv.PROFILE_TEXT:
        raise ValueError(f"unknown profile {profile}")
    keys = list(batch)
    call = SCORERS.get(scorer)
    sized = files.withColumn("_tokens", text.token_estimate(F.col("content")).cast("long"))
    if call is None:
        found = score_batches(files, scorer, canned, profile, batch)
        per_file = found.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n"))
        told = sized.select(*dict.fromkeys([*keys, "file_id"]), "_tokens").join(per_file, "file_id", "left").groupBy(*keys).agg(
            F.count(F.lit(1)).alias("files"), F.sum("_tokens").alias("tokens"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("findings"), F.lit(None).cast("double").alias("millis"),
        )
        return found, told
    key_types = {k: files.schema[k].dataType.simpleString() for k in keys}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, keys):
            for low, high in bounds:
                part = rows.slice(low, high - low)
                frame = part.drop_columns(["_tokens"]).to_pandas()
                began = time.perf_counter()
                found = call(frame, profile)
                spent = (time.perf_counter() - began) * 1000
                table = pa.Table.from_pandas(found, _SCORED, preserve_index=False)
                none = [pa.nulls(len(table), _MEASURED.field(n).type) for n in ("_files", "_tokens", "_found", "_millis")]
                told = [pa.nulls(1, f.type) for f in _SCORED] + [
                    pa.array([high - low], pa.int64()), pa.array([pc.sum(part.column("_tokens")).as_py()], pa.int64()),
                    pa.array([len(table)], pa.int64()), pa.array([spent], pa.float64()),
                ]
                for columns, n in (([*(c.combine_chunks() for c in table.columns), *none], len(table)), (told, 1)):
                    own = [pa.array([part.column(k)[0].as_py()] * n, part.schema.field(k).type) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, *columns], names=[*(f"_{k}" for k in keys), *_MEASURED.names])

    kinds = ", ".join(f"_{k} {t}" for k, t in key_types.items())
    measured = cut_lineage(
        gather(sized, keys, "file_id").mapInArrow(run, f"{kinds}, {SCORER_SCHEMA}, _files long, _tokens long, _found long, _millis double"),
        "scored",
    )
    names = [f.name for f in _SCORED]
    found = measured.where("_files IS NULL").select(*names).withColumn("source", F.lit("llm"))
    told = measured.where("_files IS NOT NULL").select(
        *[F.col(f"_{k}").alias(k) for k in keys], F.col("_files").alias("files"), F.col("_tokens").alias("tokens"),
        F.col("_found").alias("findings"), F.col("_millis").alias("millis"),
    )
    return found, told


def batch_progress(files: DataFrame, found: DataFrame, batch: tuple[str, ...] = ("review_id",)) -> DataFrame:
    """What a batch tells when it is complete: its files and its findings."""
    keys = [*dict.fromkeys([*batch, "file_id"])]
    counted = files.select(*keys).join(
        found.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n")), "file_id", "left"
    )
    done = counted.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("_n"), F.lit(0)).alias("findings")
    )
    return done
