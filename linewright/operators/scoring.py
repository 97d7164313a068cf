"""Scores, roll-ups, pages and nested results."""

from __future__ import annotations

import time
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import text


def severity_count(severity: str) -> Column:
    return F.count_if(F.col("severity") == severity)


def health(costs: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce(costs, F.lit(0)))).cast("int")


def file_health(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Health per file; findings shrink to one row per file before they meet the files."""
    keys = ["review_id", "file_id"]
    costs = findings.groupBy(*keys).agg(
        F.sum(text.rank(fv.HEALTH_COST, F.col("severity")).cast("long")).alias("cost")
    )
    joined = files.join(costs, keys, "left")
    return joined.select(*files.columns, health(F.col("cost")).alias("health_score"))


def project_score(scored: DataFrame) -> DataFrame:
    """Health weighted by lines of code, rounded half up; 100 where there is no code."""
    loc = F.sum(F.col("lines_of_code").cast("long"))
    weighted = F.sum(F.col("health_score").cast("long") * F.col("lines_of_code"))
    score = F.when(loc == 0, 100).otherwise(F.floor(weighted / loc + 0.5))
    return scored.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("files"), score.cast("int").alias("project_score")
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[severity_count(s).alias(s) for s in fv.SEVERITIES],
    )


def history_page(reviews: DataFrame, user_id, limit: int = 20, offset: int = 0) -> DataFrame:
    """One user's page, newest first: a top-k over that user's rows."""
    mine = reviews.where(F.col("user_id") == user_id)
    return mine.orderBy(F.desc("created_at"), "review_id").offset(offset).limit(limit)


def history_pages(reviews: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """The same page for every user at once; the bound on the row number caps what each
    task sends per user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "review_id")
    numbered = reviews.withColumn("position", F.row_number().over(order))
    return numbered.where(F.col("position") <= offset + limit).where(F.col("position") > offset)


def history_rows(
    reviews: DataFrame, files: DataFrame, findings: DataFrame, scores: DataFrame
) -> DataFrame:
    """One line per review: file count, shortened names, counts, score band, status.

    The name line shows 60 characters, and each further name adds at least the two of its
    separator, so 31 names decide it. Only those are gathered; the length of the whole
    line, which decides on the dots, is a sum.
    """
    shown = fv.HISTORY_NAME_CHARS
    needed = shown // 2 + 1
    order = Window.partitionBy("review_id").orderBy("file_ord")
    head = (
        files.select("review_id", "file_ord", "filename")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= needed)
        .groupBy("review_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "filename"))).alias("names"))
    )
    sizes = files.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("file_count"),
        (F.sum(F.length("filename").cast("long")) + 2 * (F.count(F.lit(1)) - 1)).alias("chars"),
    )
    counts = findings.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("findings"), severity_count("critical").alias("critical")
    )
    joined = F.array_join("names.filename", ", ")
    names = F.when(
        F.col("chars") > shown, F.concat(F.substring(joined, 1, shown), F.lit("..."))
    ).otherwise(joined)
    return (
        reviews.join(sizes, "review_id", "left")
        .join(head, "review_id", "left")
        .join(counts, "review_id", "left")
        .join(scores.select("review_id", "project_score"), "review_id", "left")
        .select(
            "review_id",
            "status",
            F.coalesce("file_count", F.lit(0)).alias("file_count"),
            F.coalesce(names, F.lit("")).alias("names"),
            F.coalesce("findings", F.lit(0)).alias("findings"),
            F.coalesce("critical", F.lit(0)).alias("critical"),
            "project_score",
            text.score_band(F.col("project_score")).alias("band"),
        )
    )


def review_detail(reviews: DataFrame, files: DataFrame, findings: DataFrame) -> DataFrame:
    """Review, file and finding columns side by side, heavy columns left out.

    The long form holds what the nested document holds, and a review of any size stays
    spread over rows instead of becoming one huge cell.
    """
    light = files.drop("content", "content_hash", "content_snippet")
    return reviews.join(light, "review_id", "left").join(
        findings, ["review_id", "file_ord"], "left"
    )


def user_reviews(users: DataFrame, reviews: DataFrame) -> DataFrame:
    """Users with their reviews; users without any keep one row."""
    return users.join(reviews, "user_id", "left")


def sorted_in_file(findings: DataFrame) -> DataFrame:
    """Position of each finding in its file: by severity only, arrival breaks ties.

    Ranks are taken per severity of a file and shifted by the counts of the graver ones.
    """
    from linewright.operators.spread import running_rank

    keys = ["review_id", "file_id"]
    graver = {"critical": (), "warning": ("critical",), "info": ("critical", "warning")}
    counts = findings.groupBy(*keys).agg(
        *[severity_count(s).alias(f"n_{s}") for s in fv.SEVERITIES], F.count(F.lit(1)).alias("n_all")
    )
    ranked = running_rank(findings, [*keys, "severity"], "ord", "place")
    shift = F.when(F.lit(False), F.lit(0))
    for severity, before in graver.items():
        total = sum((F.col(f"n_{b}") for b in before), F.lit(0))
        shift = shift.when(F.col("severity") == severity, total)
    return (
        ranked.join(counts, keys)
        .withColumn("position", (F.col("place") + shift).cast("long"))
        .drop("place", "n_all", *[f"n_{s}" for s in fv.SEVERITIES])
    )


def review_status(stages: DataFrame, scores: DataFrame) -> DataFrame:
    """COMPLETED with a score, or FAILED with the first error in stage order."""
    ended = stages.groupBy("review_id").agg(
        F.min(F.when(F.col("error").isNotNull(), F.struct("stage_ord", "error"))).alias("failed"),
        F.sum("millis").alias("total_ms"),
    )
    joined = ended.join(scores.select("review_id", "project_score"), "review_id", "left")
    good = F.col("failed").isNull()
    return joined.select(
        "review_id",
        F.when(good, "COMPLETED").otherwise("FAILED").alias("status"),
        F.col("failed.error").alias("error_message"),
        F.when(good, F.col("project_score")).alias("project_score"),
        F.when(good, F.col("total_ms")).alias("total_ms"),
    )


class StageMetrics:
    """Times and row counts of the stages of one run, as a table at the end.

    Row counts come from ``observe``: they are taken while the stage runs, not by a
    second pass.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._rows: list[tuple] = []
        self._start = time.perf_counter()

    @contextmanager
    def stage(self, name: str):
        observation = Observation(f"{name}-{len(self._rows)}")
        used = []

        def watch(df: DataFrame) -> DataFrame:
            used.append(True)
            return df.observe(observation, F.count(F.lit(1)).alias("rows"))

        began = time.perf_counter()
        started_at = datetime.now(timezone.utc).replace(tzinfo=None)
        yield watch
        spent = round((time.perf_counter() - began) * 1000)
        count = observation.get["rows"] if used else None
        self._rows.append((name, started_at, spent, count))

    def table(self) -> DataFrame:
        total = round((time.perf_counter() - self._start) * 1000)
        rows = [*self._rows, ("total", None, total, None)]
        return self._spark.createDataFrame(
            rows, "stage string, started_at timestamp_ntz, millis long, row_count long"
        )
