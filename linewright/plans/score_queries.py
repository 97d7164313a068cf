"""Queries on scores, pages, edits, feedback and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.operators import edits as editing
from linewright.operators import quality, scan, scoring
from linewright.plans.ingest_queries import BAND
from linewright.plans.merge_queries import severity_rank
from linewright.plans.registry import over, query
from linewright.plans.scan_queries import HEALTH, SCAN_STEPS, SCORE, lines_step
from linewright.sources.corpus import table, view

FILE_KEYS = ["review_id", "file_id"]


@query(
    "file_health",
    over("files", f"""SELECT f.review_id, f.file_id, {HEALTH} AS health_score FROM files f
         LEFT JOIN (SELECT file_id, severity FROM hits JOIN catalogue USING (rule_ord)) h USING (file_id)
         GROUP BY f.review_id, f.file_id""", *SCAN_STEPS),
)
def file_health(spark, sf_dir):
    files = view(spark, sf_dir, "files")
    return scoring.file_health(files.select("review_id", "file_id"), scan.scan(files))


_SCORES = f"""scores AS (SELECT review_id, CAST(count(*) AS BIGINT) AS files,
   {SCORE.format(loc='lines_of_code', health='health_score')} AS project_score FROM scored_files GROUP BY review_id)"""


@query("project_score", over("scored_files", "SELECT * FROM scores", _SCORES))
def project_score(spark, sf_dir):
    return scoring.project_score(view(spark, sf_dir, "scored_files"))


@query(
    "severity_counts",
    over("findings", """SELECT review_id, CAST(count(*) AS BIGINT) AS total,
         CAST(count_if(severity = 'critical') AS BIGINT) AS critical,
         CAST(count_if(severity = 'warning') AS BIGINT) AS warning,
         CAST(count_if(severity = 'info') AS BIGINT) AS info FROM findings GROUP BY review_id"""),
)
def severity_counts(spark, sf_dir):
    return scoring.severity_counts(view(spark, sf_dir, "findings"))


@query(
    "review_history",
    over("reviews", """SELECT user_id, review_id, status, CAST(CAST(created_at AS DATE) AS VARCHAR) AS created,
         position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, review_id)
         AS INT) AS position FROM reviews) WHERE position > 2 AND position <= 12"""),
)
def review_history(spark, sf_dir):
    pages = scoring.history_pages(view(spark, sf_dir, "reviews"), limit=10, offset=2)
    return pages.select(
        "user_id", "review_id", "status",
        F.to_date("created_at").cast("string").alias("created"), "position",
    )


@query(
    "user_history_page",
    over("reviews", """SELECT user_id, review_id, status FROM reviews WHERE user_id = 1
         ORDER BY created_at DESC, review_id LIMIT 20 OFFSET 1"""),
)
def user_history_page(spark, sf_dir):
    page = scoring.history_page(view(spark, sf_dir, "reviews"), user_id=1, limit=20, offset=1)
    return page.select("user_id", "review_id", "status")


@query(
    "history_rows",
    over("reviews scored_files stored_findings",
         f"""SELECT r.review_id, status, coalesce(file_count, 0) AS file_count,
         coalesce(CASE WHEN length(names) > 60 THEN substr(names, 1, 60)||'...' ELSE names END, '') AS names,
         coalesce(findings, 0) AS findings, coalesce(critical, 0) AS critical, project_score,
         {BAND.format('project_score')} AS band
         FROM reviews r
         LEFT JOIN (SELECT review_id, CAST(count(*) AS BIGINT) AS file_count,
                    string_agg(filename, ', ' ORDER BY file_ord) AS names FROM scored_files GROUP BY 1) n USING (review_id)
         LEFT JOIN (SELECT review_id, CAST(count(*) AS BIGINT) AS findings,
                    CAST(count_if(severity = 'critical') AS BIGINT) AS critical FROM stored_findings GROUP BY 1) c USING (review_id)
         LEFT JOIN scores s USING (review_id)""", _SCORES),
)
def history_rows(spark, sf_dir):
    files = view(spark, sf_dir, "scored_files")
    return scoring.history_rows(
        view(spark, sf_dir, "reviews"), files, view(spark, sf_dir, "stored_findings"),
        scoring.project_score(files),
    )


@query(
    "review_detail",
    over("reviews scored_files stored_findings",
         """SELECT r.review_id, r.status, f.file_ord, f.filename, f.health_score, s.ord, s.severity, s.line_start
         FROM reviews r LEFT JOIN scored_files f ON f.review_id = r.review_id
         LEFT JOIN stored_findings s ON s.review_id = f.review_id AND s.file_ord = f.file_ord"""),
)
def review_detail(spark, sf_dir):
    detail = scoring.review_detail(
        view(spark, sf_dir, "reviews"), view(spark, sf_dir, "scored_files"), view(spark, sf_dir, "stored_findings")
    )
    return detail.select(
        "review_id", "status", "file_ord", "filename", "health_score", "ord", "severity", "line_start"
    )


@query(
    "user_reviews",
    over("reviews", """SELECT c_custkey AS user_id, c_name AS user_name, review_id, status
         FROM customer LEFT JOIN reviews ON user_id = c_custkey"""),
)
def user_reviews(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name")
    )
    reviews = view(spark, sf_dir, "reviews").select("user_id", "review_id", "status")
    return scoring.user_reviews(users, reviews)


@query(
    "file_findings_sorted",
    over("findings", f"""SELECT review_id, file_id, ord, severity, row_number() OVER (PARTITION BY review_id, file_id
         ORDER BY {severity_rank('severity')} DESC, ord) AS position FROM findings"""),
)
def file_findings_sorted(spark, sf_dir):
    return scoring.sorted_in_file(view(spark, sf_dir, "findings")).select(
        "review_id", "file_id", "ord", "severity", "position"
    )


@query(
    "review_status",
    over("review_events scored_files",
         """SELECT e.review_id, CASE WHEN failed IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status,
         CASE WHEN failed IS NOT NULL THEN 'failed at '||failed END AS error_message,
         CASE WHEN failed IS NULL THEN project_score END AS project_score,
         CASE WHEN failed IS NULL THEN total_ms END AS total_ms
         FROM (SELECT review_id, min(ord) FILTER (type = 'REVIEW_FAILED' AND ord % 5 = 0) AS failed,
               CAST(sum(new_findings) AS BIGINT) AS total_ms FROM review_events GROUP BY review_id) e
         LEFT JOIN scores USING (review_id)""", _SCORES),
)
def review_status(spark, sf_dir):
    events = view(spark, sf_dir, "review_events")
    failed = (F.col("type") == "REVIEW_FAILED") & (F.col("ord") % 5 == 0)
    stages = events.select(
        "review_id",
        F.col("ord").alias("stage_ord"),
        F.when(failed, F.concat(F.lit("failed at "), F.col("ord").cast("string"))).alias("error"),
        F.col("new_findings").cast("long").alias("millis"),
    )
    return scoring.review_status(stages, scoring.project_score(view(spark, sf_dir, "scored_files")))


@query(
    "stage_metrics",
    over("files", """SELECT 'lines' AS stage, CAST(count(*) AS BIGINT) AS row_count FROM lines
         UNION ALL SELECT 'findings', CAST(count(*) AS BIGINT) FROM hits
         UNION ALL SELECT 'scored', CAST(count(*) AS BIGINT) FROM files""", lines_step(), SCAN_STEPS[1]),
)
def stage_metrics(spark, sf_dir):
    """Row counts of three stages; the times of the table differ from run to run."""
    files = view(spark, sf_dir, "files")
    metrics = scoring.StageMetrics(spark)
    findings = scan.scan(files)
    scored = scoring.file_health(files.select(*FILE_KEYS), findings)
    for name, df in (
        ("lines", scan.explode_lines(files, *FILE_KEYS)), ("findings", findings), ("scored", scored)
    ):
        with metrics.stage(name) as watch:
            watch(df).write.format("noop").mode("overwrite").save()
    return metrics.table().where("stage <> 'total'").select("stage", "row_count")


@query(
    "adjust_lines",
    over("findings edits", """SELECT f.ord, f.line_start, f.line_start + coalesce((SELECT sum(inserted - removed)
         FROM edits e WHERE e.file_id = f.file_id AND e.original_line < f.line_start), 0)::BIGINT AS adjusted
         FROM findings f"""),
)
def adjust_lines(spark, sf_dir):
    findings = view(spark, sf_dir, "findings")
    edits = view(spark, sf_dir, "edits")
    return editing.adjust_lines(findings, edits, ["file_id"], "line_start").select(
        "ord", "line_start", "adjusted"
    )


@query(
    "apply_fix_sequence",
    over("findings", """SELECT f.ord, f.line_start + coalesce(sum(CASE WHEN e.l < f.line_start THEN e.d END), 0)::BIGINT AS new_start,
         f.line_end + coalesce(sum(CASE WHEN e.l < f.line_end THEN e.d END), 0)::BIGINT AS new_end
         FROM findings f LEFT JOIN (SELECT review_id, file_id, ord, line_start AS l,
           len(string_split(suggested_fix, chr(10))) - (line_end - line_start + 1) AS d
           FROM findings WHERE suggested_fix <> '') e
         ON e.review_id = f.review_id AND e.file_id = f.file_id AND e.ord < f.ord
         GROUP BY f.ord, f.line_start, f.line_end"""),
)
def apply_fix_sequence(spark, sf_dir):
    moved = editing.apply_in_sequence(view(spark, sf_dir, "findings"), FILE_KEYS)
    return moved.select("ord", "new_start", "new_end")


@query(
    "latest_feedback",
    over("findings feedback", """SELECT ord, message, feedback FROM findings LEFT JOIN (SELECT finding_ord,
         arg_max(feedback, seq) AS feedback FROM feedback GROUP BY 1) ON finding_ord = ord"""),
)
def latest_feedback(spark, sf_dir):
    return editing.latest_feedback(
        view(spark, sf_dir, "findings"), view(spark, sf_dir, "feedback")
    ).select("ord", "message", "feedback")


@query(
    "cascade_delete",
    over("reviews scored_files stored_findings",
         """SELECT 'review' AS kind, review_id, NULL::INT AS file_ord, NULL::BIGINT AS ord FROM reviews WHERE status <> 'FAILED'
         UNION ALL SELECT 'file', review_id, file_ord, NULL FROM scored_files WHERE review_id NOT IN
           (SELECT review_id FROM reviews WHERE status = 'FAILED')
         UNION ALL SELECT 'finding', review_id, file_ord, ord FROM stored_findings WHERE review_id NOT IN
           (SELECT review_id FROM reviews WHERE status = 'FAILED')"""),
)
def cascade_delete(spark, sf_dir):
    reviews = view(spark, sf_dir, "reviews")
    left = editing.cascade_delete(
        reviews.where("status = 'FAILED'"), reviews,
        view(spark, sf_dir, "scored_files"), view(spark, sf_dir, "stored_findings"),
    )
    none_file, none_ord = F.lit(None).cast("int").alias("file_ord"), F.lit(None).cast("long").alias("ord")
    return (
        left[0].select(F.lit("review").alias("kind"), "review_id", none_file, none_ord)
        .unionByName(left[1].select(F.lit("file").alias("kind"), "review_id", "file_ord", none_ord))
        .unionByName(left[2].select(F.lit("finding").alias("kind"), "review_id", "file_ord", "ord"))
    )


_FOUND = """EXISTS (SELECT 1 FROM findings f WHERE f.review_id = b.review_id AND f.file_id = b.file_id
  AND f.category = b.category AND abs(f.line_start - b.line_start) <= 5)"""
_WRONG = """f.severity <> 'info' AND EXISTS (SELECT 1 FROM expected_bugs b WHERE b.review_id = f.review_id
  AND b.file_id = f.file_id) AND NOT EXISTS (SELECT 1 FROM expected_bugs b WHERE b.review_id = f.review_id
  AND b.file_id = f.file_id AND b.category = f.category AND abs(f.line_start - b.line_start) <= 5)"""
@query(
    "recall_counts",
    over("findings expected_bugs", f"""SELECT review_id, CAST(count_if(found) AS BIGINT) AS true_positives,
         CAST(count_if(NOT found) AS BIGINT) AS false_negatives
         FROM (SELECT *, {_FOUND} AS found FROM expected_bugs b) GROUP BY review_id"""),
)
def recall_counts(spark, sf_dir):
    return quality.recall_counts(view(spark, sf_dir, "expected_bugs"), view(spark, sf_dir, "findings"))


@query(
    "false_positives",
    over("findings expected_bugs", f"SELECT ord, severity, category FROM findings f WHERE {_WRONG}"),
)
def false_positives(spark, sf_dir):
    wrong = quality.false_positives(view(spark, sf_dir, "findings"), view(spark, sf_dir, "expected_bugs"))
    return wrong.select("ord", "severity", "category")


@query(
    "precision_recall",
    over("findings expected_bugs", f"""SELECT *, CASE WHEN true_positives + false_positives > 0
         THEN true_positives / (true_positives + false_positives) ELSE 0.0 END AS precision,
         CASE WHEN true_positives + false_negatives > 0
         THEN true_positives / (true_positives + false_negatives) ELSE 0.0 END AS recall
         FROM (SELECT CAST(count_if(found) AS BIGINT) AS true_positives, CAST(count_if(NOT found) AS BIGINT) AS false_negatives,
               CAST(count(*) AS BIGINT) AS planted FROM (SELECT {_FOUND} AS found FROM expected_bugs b)),
              (SELECT CAST(count(*) AS BIGINT) AS false_positives FROM findings f WHERE {_WRONG}),
              (SELECT CAST(count(*) AS BIGINT) AS generated FROM findings)"""),
)
def precision_recall(spark, sf_dir):
    return quality.precision_recall(view(spark, sf_dir, "expected_bugs"), view(spark, sf_dir, "findings"))
