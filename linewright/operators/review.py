"""A whole review: detectors, model findings, merge, snippets, fix checks, scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.operators import fixes, merging, plugins, responses, scoring
from linewright.session import cut_lineage


@dataclass(frozen=True)
class Review:
    """Merged findings, files with their health, and one row per review."""

    findings: DataFrame
    files: DataFrame
    scores: DataFrame


def run_review(files: DataFrame, canned: DataFrame, registry: plugins.AnalyzerRegistry | None = None) -> Review:
    """Reviews of prepared ``files``; ``canned`` holds a model's findings by file name.

    The merged findings are written once and read by all that follows. Contents are read by
    the detectors, for the snippets and for the checks of fixes; scores see numbers only.
    A detector that fails fails the review: without its findings, files would look healthier than they are.
    """
    registry = registry or plugins.default_registry()
    static = registry.analyze(files, whole=True)
    # A model's findings arrive after those of all detectors.
    turn = F.lit(len(registry.analyzers)).cast("long") * merging.TURN
    model = responses.canned_findings(files, canned).withColumn("ord", turn + F.col("position")).drop("position")
    everything = static.unionByName(model, allowMissingColumns=True)
    merged = cut_lineage(merging.merge_findings(everything), "merged")
    told = merging.attach_snippets(fixes.fix_status(merged, files), files)
    scored = scoring.file_health(files.drop("content"), merged)
    counts = merged.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("findings"), scoring.severity_count("critical").alias("critical")
    )
    scores = scoring.project_score(scored).join(counts, "review_id", "left").select(
        "review_id", "files", F.coalesce("findings", F.lit(0)).alias("findings"),
        F.coalesce("critical", F.lit(0)).alias("critical"), "project_score",
    )
    return Review(told, scored, scores)
