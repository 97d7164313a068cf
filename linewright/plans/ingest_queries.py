"""Queries on sources, scalar functions and input checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import patterns, text
from linewright.operators import validation
from linewright.plans.registry import over, query, sql_case, sql_list, sql_text, tokens, utf16
from linewright.session import fresh_path
from linewright.sources import ingest
from linewright.sources.corpus import view
from linewright.sources.review_store import ReviewStore

EXT = "lower(string_split({0}, '.')[-1])"
SPLIT = "string_split({0}, chr(10))"


def _ext(column: str) -> str:
    return EXT.format(column)


def _dirs(column: str, names) -> str:
    wrapped = [n for n in names]
    return (
        f"len(list_filter(string_split({column}, '/'), lambda p: p IN {sql_list(wrapped)} "
        f"OR starts_with(p, '.'))) > 0"
    )


LOC = (
    f"CAST(len(list_filter(string_split(content, chr(10)), lambda l: "
    f"regexp_replace(l, '^{patterns.SPACE}+', '') <> '' AND NOT regexp_matches("
    f"regexp_replace(l, '^{patterns.SPACE}+', ''), '^(//|#|/\\*|\\*)'))) AS BIGINT)"
)


@query(
    "files_ingest",
    over("files", "SELECT review_id, file_id, file_id AS file_ord, filename, "
         "CAST(length(content) AS BIGINT) AS chars, sha256(content) AS hash FROM files"),
)
def files_ingest(spark, sf_dir):
    files = ingest.ingest(view(spark, sf_dir, "files"))
    return files.select(
        "review_id", "file_id", "file_ord", "filename",
        F.length("content").cast("long").alias("chars"),
        F.sha2("content", 256).alias("hash"),
    )


_MANIFEST_KEEP = (
    f"type = 'blob' AND {_ext('path')} IN {sql_list(fv.LISTING_EXTENSIONS)} "
    f"AND NOT ({_dirs('path', fv.LISTING_SKIP_DIRS)}) AND starts_with(path, 'src/') "
    f"AND coalesce(size, 0) <= {fv.LISTING_MAX_BYTES}"
)


@query(
    "manifest_filter",
    over("manifest",
         f"SELECT repo_id, listing_ord, path, position FROM (SELECT *, CAST(row_number() OVER "
         f"(PARTITION BY repo_id ORDER BY listing_ord) AS INT) AS position FROM manifest "
         f"WHERE {_MANIFEST_KEEP}) WHERE position <= {fv.LISTING_MAX_FILES}"),
)
def manifest_filter(spark, sf_dir):
    kept = ingest.filter_manifest(view(spark, sf_dir, "manifest"), base_path="src/")
    return kept.select("repo_id", "listing_ord", "path", "position")


@query(
    "manifest_cut",
    over("manifest",
         f"SELECT repo_id, CAST(count(*) AS BIGINT) AS listed, CAST(greatest(count(*) - 20, 0) AS BIGINT) AS left_out "
         f"FROM manifest WHERE {_MANIFEST_KEEP} GROUP BY repo_id"),
)
def manifest_cut(spark, sf_dir):
    return ingest.manifest_cut(view(spark, sf_dir, "manifest"), base_path="src/", max_files=20)


@query(
    "pr_filter",
    over("pr_files",
         f"SELECT pr_id, file_id, filename FROM pr_files WHERE status <> 'removed' "
         f"AND {_ext('filename')} IN {sql_list(fv.LISTING_EXTENSIONS)} "
         f"AND NOT ({_dirs('filename', fv.LISTING_SKIP_DIRS)}) "
         f"AND {utf16('content')} <= {fv.PR_MAX_CHARS}"),
)
def pr_filter(spark, sf_dir):
    return ingest.filter_pull_request(view(spark, sf_dir, "pr_files")).select(
        "pr_id", "file_id", "filename"
    )


@query(
    "folder_filter",
    over("folder_paths",
         f"SELECT file_id, path FROM folder_paths WHERE contains(path, '.') "
         f"AND {_ext('path')} IN {sql_list(fv.FOLDER_EXTENSIONS)} "
         f"AND NOT ({_dirs('path', fv.FOLDER_SKIP_DIRS)}) "
         f"AND content <> '' AND {utf16('content')} <= {fv.FOLDER_MAX_CHARS}"),
)
def folder_filter(spark, sf_dir):
    return ingest.filter_folder(view(spark, sf_dir, "folder_paths")).select("file_id", "path")


_URL = sql_text(patterns.re2(fv.REPO_URL_PATTERN))
URL_STEP = f"""urls AS (
 SELECT *, regexp_matches(u, {_URL}) AS known, {", ".join(
     f"regexp_extract(u, {_URL}, {i}) AS g{i}" for i in range(1, 8))}
 FROM (SELECT *, regexp_replace(regexp_replace(url, '^{patterns.SPACE}+|{patterns.SPACE}+$', '', 'g'), '/$', '') AS u
       FROM manifest)),
parsed AS (SELECT *, CASE WHEN NOT known THEN NULL WHEN g3 = 'pull' THEN 'pr'
   WHEN g5 = 'blob' AND g7 <> '' THEN 'file' WHEN g5 = 'tree' THEN 'tree' ELSE 'repo' END AS kind FROM urls)"""


@query(
    "repo_url_parse",
    over("manifest",
         """SELECT listing_ord, CASE WHEN known THEN g1 END AS owner, CASE WHEN known THEN g2 END AS repo,
            kind AS type, CASE WHEN kind IN ('file','tree') THEN g6 WHEN kind = 'repo' THEN 'main' END AS ref,
            CASE WHEN kind IN ('file','tree') THEN g7 END AS path,
            CASE WHEN kind = 'pr' THEN CAST(g4 AS INT) END AS pr_number FROM parsed""",
         URL_STEP),
)
def repo_url_parse(spark, sf_dir):
    manifest = view(spark, sf_dir, "manifest")
    return manifest.select("listing_ord", text.parse_repo_url(F.col("url")).alias("u")).select(
        "listing_ord", "u.*"
    )


@query(
    "base64_decode",
    "SELECT doc_id AS file_id, CAST(length(text) AS BIGINT) AS chars, sha256(text) AS hash FROM documents",
)
def base64_decode(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    payload = docs.select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("payload"))
    decoded = payload.select("doc_id", text.decode_base64(F.col("payload")).alias("content"))
    return decoded.select(
        F.col("doc_id").alias("file_id"),
        F.length("content").cast("long").alias("chars"),
        F.sha2("content", 256).alias("hash"),
    )


@query(
    "import_summary",
    over("manifest",
         """SELECT repo_id, kind AS type, CASE WHEN known THEN g1 END AS owner, CASE WHEN known THEN g2 END AS repo,
            CAST(count(*) AS BIGINT) AS file_count,
            CAST(sum(len(string_split(html, chr(10)))) AS BIGINT) AS line_count
            FROM parsed JOIN pages ON page_id = listing_ord GROUP BY ALL""",
         URL_STEP),
)
def import_summary(spark, sf_dir):
    manifest = view(spark, sf_dir, "manifest")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = manifest.join(pages, manifest.listing_ord == pages.page_id).select(
        "repo_id", text.parse_repo_url(manifest.url).alias("u"), F.col("html").alias("content")
    )
    return ingest.import_summary(
        files.select("repo_id", "u.type", "u.owner", "u.repo", "content")
    )


@query(
    "json_map_source",
    over("findings",
         """SELECT ord, filename, CAST(position AS BIGINT) AS position,
            line_start + CAST(position AS INT) AS line_start, line_end, severity, category, message,
            CASE WHEN position = 1 THEN 'x' END AS suggested_fix, CAST(0.5 AS DOUBLE) AS confidence
            FROM findings, (SELECT unnest([0, 1]) AS position) p"""),
)
def json_map_source(spark, sf_dir):
    findings = view(spark, sf_dir, "findings")

    def item(shift, fix):
        return F.struct(
            "filename",
            (F.col("line_start") + shift).alias("lineStart"),
            F.col("line_end").alias("lineEnd"),
            "severity", "category", "message",
            fix.alias("suggestedFix"),
            F.lit(0.5).alias("confidence"),
        )

    documents = findings.select(
        "ord",
        F.to_json(
            F.create_map(
                F.col("filename"),
                F.array(item(0, F.lit(None).cast("string")), item(1, F.lit("x"))),
            )
        ).alias("json"),
    )
    return ingest.read_finding_map(documents)


@query(
    "findings_sink",
    over("findings", "SELECT review_id, file_id, filename, line_start, line_end, source, severity, "
         "category, message, rule_id, suggested_fix, confidence, ord FROM findings"),
)
def findings_sink(spark, sf_dir):
    path = fresh_path(spark, "findings")
    ingest.write_by_review(view(spark, sf_dir, "findings"), path)
    return ingest.read_by_review(spark, path)


@query(
    "review_sink",
    over("reviews scored_files stored_findings", """SELECT 'review' AS kind, review_id, CAST(count(*) AS BIGINT) AS n,
           CAST(sum(user_id) AS BIGINT) AS mark FROM reviews GROUP BY review_id
         UNION ALL SELECT 'file', review_id, count(*), CAST(sum(health_score) AS BIGINT) FROM scored_files GROUP BY review_id
         UNION ALL SELECT 'finding', review_id, count(*), CAST(sum(line_start) AS BIGINT) FROM stored_findings GROUP BY review_id"""),
)
def review_sink(spark, sf_dir):
    """Reviews, files and findings are written and read back."""
    path = fresh_path(spark, "review")
    ingest.write_review(path, *(view(spark, sf_dir, name) for name in ("reviews", "scored_files", "stored_findings")))
    parts = zip(("review", "file", "finding"), ("user_id", "health_score", "line_start"), ingest.read_review(spark, path))
    told = [
        rows.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(mark).cast("long")).alias("mark"))
        .select(F.lit(kind).alias("kind"), "review_id", "n", "mark")
        for kind, mark, rows in parts
    ]
    return told[0].unionByName(told[1]).unionByName(told[2])


_MARKED = "findings JOIN (SELECT finding_ord, arg_max(feedback, seq) AS feedback FROM feedback GROUP BY 1) ON finding_ord = ord"


@query(
    "stored_reviews",
    over("reviews scored_files findings feedback", f"""SELECT 'review' AS kind, review_id, NULL::BIGINT AS ord,
           CASE WHEN status = 'ANALYZING' AND review_id % 2 = 0 THEN 'COMPLETED' ELSE status END AS told
         FROM reviews WHERE status <> 'FAILED'
         UNION ALL SELECT 'file', review_id, file_ord, filename FROM scored_files
           WHERE review_id IN (SELECT review_id FROM reviews WHERE status <> 'FAILED')
         UNION ALL SELECT 'finding', f.review_id, f.ord, m.feedback
           FROM findings f LEFT JOIN (SELECT ord, feedback FROM {_MARKED}) m USING (ord)
           WHERE review_id IN (SELECT review_id FROM reviews WHERE status <> 'FAILED')"""),
)
def stored_reviews(spark, sf_dir):
    """Reviews are saved; then some end, findings get feedback, failed ones are deleted; what is stored is read."""
    reviews = view(spark, sf_dir, "reviews")
    files = view(spark, sf_dir, "scored_files")
    found = view(spark, sf_dir, "findings").join(reviews.select("review_id"), "review_id", "left_semi").select(
        "review_id", F.col("file_id").cast("int").alias("file_ord"), "ord", "message", F.lit(None).cast("string").alias("feedback")
    )
    ddl = [", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) for df in (reviews, files, found)]
    store = ReviewStore(spark, fresh_path(spark, "stored-reviews"), *ddl)
    store.save(reviews, files, found)
    ended = reviews.where("status = 'ANALYZING' AND review_id % 2 = 0")
    store.update_reviews(ended.select("review_id", F.lit("COMPLETED").alias("status")))
    told = view(spark, sf_dir, "feedback").withColumnRenamed("finding_ord", "ord")
    store.set_feedback(told.join(found.select("review_id", "file_ord", "ord"), "ord"))
    store.delete(reviews.where("status = 'FAILED'"))
    store.vacuum()
    return (
        store.read("reviews").select(F.lit("review").alias("kind"), "review_id", F.lit(None).cast("long").alias("ord"), F.col("status").alias("told"))
        .unionByName(store.read("files").select(F.lit("file").alias("kind"), "review_id", F.col("file_ord").cast("long").alias("ord"), F.col("filename").alias("told")))
        .unionByName(store.read("findings").select(F.lit("finding").alias("kind"), "review_id", "ord", F.col("feedback").alias("told")))
    )


_NUL_FILES = """nul_files AS (SELECT review_id, file_id, filename,
   CASE WHEN file_id % 9 = 0 THEN substr(content, 1, 20) || chr(0) || content
        WHEN file_id % 9 = 1 THEN repeat('a', 8192) || chr(0) ELSE content END AS content FROM files)"""


def _nul_files(spark, sf_dir):
    mark = F.lit("\x00")
    spot = F.col("file_id") % 9
    return view(spark, sf_dir, "files").withColumn(
        "content",
        F.when(spot == 0, F.concat(F.substring("content", 1, 20), mark, F.col("content")))
        .when(spot == 1, F.concat(F.repeat(F.lit("a"), 8192), mark))
        .otherwise(F.col("content")),
    )


_BINARY = "contains(substr(content, 1, 8192), chr(0))"


@query(
    "review_header",
    over("files", f"""SELECT review_id, CAST(count(*) AS BIGINT) AS total_files,
         CAST(count_if(NOT {_BINARY}) AS BIGINT) AS analyzed_files FROM nul_files GROUP BY review_id""",
         _NUL_FILES),
)
def review_header(spark, sf_dir):
    return ingest.review_headers(_nul_files(spark, sf_dir))


@query(
    "drop_binary",
    over("files", f"SELECT file_id, filename FROM nul_files WHERE NOT {_BINARY}", _NUL_FILES),
)
def drop_binary(spark, sf_dir):
    files = _nul_files(spark, sf_dir)
    return files.where(~text.is_binary(F.col("content"))).select("file_id", "filename")


@query(
    "sanitize_filename",
    over("raw_names",
         """SELECT file_id, substr(regexp_replace(replace(replace(filename, '../', ''), '..'||chr(92), ''),
            '[\\x00-\\x1f]', '', 'g'), 1, 255) AS filename FROM raw_names"""),
)
def sanitize_filename(spark, sf_dir):
    names = view(spark, sf_dir, "raw_names")
    return names.select("file_id", text.sanitize_filename(F.col("filename")).alias("filename"))


LANGUAGE = f"coalesce({sql_case(fv.LANGUAGE_BY_EXTENSION, _ext('filename'))}, 'unknown')"


@query(
    "detect_language",
    over("raw_names", f"SELECT file_id, {LANGUAGE} AS language FROM raw_names"),
)
def detect_language(spark, sf_dir):
    names = view(spark, sf_dir, "raw_names")
    return names.select("file_id", text.detect_language(F.col("filename")).alias("language"))


@query("content_hash", over("files", "SELECT file_id, sha256(content) AS content_hash FROM files"))
def content_hash(spark, sf_dir):
    files = view(spark, sf_dir, "files")
    return files.select("file_id", text.content_hash(F.col("content")).alias("content_hash"))


@query("lines_of_code", over("files", f"SELECT file_id, {LOC} AS lines_of_code FROM files"))
def lines_of_code(spark, sf_dir):
    files = view(spark, sf_dir, "files")
    return files.select(
        "file_id", text.lines_of_code(F.col("content")).cast("long").alias("lines_of_code")
    )


@query("token_estimate", over("files", f"SELECT file_id, {tokens('content')} AS tokens FROM files"))
def token_estimate(spark, sf_dir):
    files = view(spark, sf_dir, "files")
    return files.select("file_id", text.token_estimate(F.col("content")).alias("tokens"))


SNIPPET = (
    "array_to_string(list_slice(string_split(content, chr(10)), greatest({0} - 3, 0) + 1, "
    "least(len(string_split(content, chr(10))), {1} + 2)), chr(10))"
)


@query(
    "code_snippet",
    over("files", f"SELECT file_id, line_start, {SNIPPET.format('line_start', 'line_start + 1')} AS code_snippet "
         "FROM (SELECT *, CAST(file_id % 9 AS INT) + 1 AS line_start FROM files)"),
)
def code_snippet(spark, sf_dir):
    files = view(spark, sf_dir, "files").withColumn(
        "line_start", (F.col("file_id") % 9).cast("int") + 1
    )
    return files.select(
        "file_id", "line_start",
        text.code_snippet(
            text.split_lines(F.col("content")), F.col("line_start"), F.col("line_start") + 1
        ).alias("code_snippet"),
    )


BAND = "CASE WHEN {0} >= 80 THEN 'good' WHEN {0} >= 50 THEN 'ok' WHEN {0} IS NOT NULL THEN 'bad' END"


@query(
    "score_band",
    over("scored_files", f"SELECT review_id, file_ord, {BAND.format('health_score')} AS band FROM scored_files"),
)
def score_band(spark, sf_dir):
    files = view(spark, sf_dir, "scored_files")
    return files.select("review_id", "file_ord", text.score_band(F.col("health_score")).alias("band"))


FENCE = f"coalesce({sql_case(fv.FENCE_BY_EXTENSION, _ext('filename'))}, {_ext('filename')})"


@query(
    "fence_language",
    over("raw_names", f"SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'mine' ELSE {FENCE} END AS fence FROM raw_names"),
)
def fence_language(spark, sf_dir):
    names = view(spark, sf_dir, "raw_names")
    chosen = F.when(F.col("file_id") % 3 == 0, "mine")
    return names.select("file_id", text.fence_language(F.col("filename"), chosen).alias("fence"))


@query(
    "line_label",
    over("findings", """SELECT ord, 'Line '||line_start||CASE WHEN line_end <> line_start
         THEN '-'||line_end ELSE '' END AS label FROM findings"""),
)
def line_label(spark, sf_dir):
    findings = view(spark, sf_dir, "findings")
    return findings.select(
        "ord", text.line_label(F.col("line_start"), F.col("line_end")).alias("label")
    )


# Limits small enough for every check to fire on the test data.
_CHECK = {"max_files": 19, "max_file_mb": 0.005, "max_total_mb": 0.05}


@query(
    "validate_files",
    over("raw_names", f"""
      SELECT review_id, CAST(-1 AS BIGINT) AS ord, 0 AS check_ord, 'files' AS field,
             'Too many files. Maximum is 19.' AS message FROM totals WHERE n > 19
      UNION ALL SELECT review_id, 4611686018427387904, 0, 'files',
             'Total upload size exceeds 0.05MB limit.' FROM totals WHERE bytes > 0.05 * 1048576
      UNION ALL SELECT review_id, file_id, 1, filename, 'File exceeds 0.005MB limit.'
             FROM inputs WHERE bytes > 0.005 * 1048576
      UNION ALL SELECT review_id, file_id, 2, filename, 'File extension .'||{_ext('filename')}||' is not allowed.'
             FROM inputs WHERE {_ext('filename')} NOT IN {sql_list(fv.UPLOAD_EXTENSIONS)}""",
         """inputs AS (SELECT CAST(floor(doc_id/20) AS BIGINT) AS review_id, file_id, filename,
            octet_length(encode(text)) AS bytes FROM raw_names JOIN documents ON doc_id = file_id)""",
         "totals AS (SELECT review_id, count(*) AS n, sum(bytes) AS bytes FROM inputs GROUP BY review_id)"),
)
def validate_files(spark, sf_dir):
    names = view(spark, sf_dir, "raw_names")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = names.join(docs, names.file_id == docs.doc_id).select(
        F.floor(docs.doc_id / 20).alias("review_id"),
        names.file_id.alias("file_ord"),
        "filename",
        F.col("text").alias("content"),
    )
    return validation.validate(files, **_CHECK)


@query(
    "text_files_ingest",
    over("files", f"""SELECT 7::BIGINT AS review_id, 'name=' || filename AS folder, {LANGUAGE} AS language, {LOC} AS lines_of_code,
         sha256(content) AS hash FROM files WHERE NOT contains(substr(content, 1, 8192), chr(0))"""),
)
def text_files_ingest(spark, sf_dir):
    """Files are written as text, read with the reader and prepared; the label of a file stands before its name."""
    path = fresh_path(spark, "text")
    written = view(spark, sf_dir, "files").select(F.concat(F.lit("name="), F.col("filename")).alias("name"), "content")
    folders = ingest.write_text_files(written, path)
    read = ingest.written_text_files(ingest.read_text_files(spark, folders, review_id=7))
    named = read.withColumn("filename", F.substring_index("filename", "=", -1))
    return ingest.prepare(named).select(
        "review_id", F.concat(F.lit("name="), F.col("filename")).alias("folder"), "language",
        F.col("lines_of_code").cast("long").alias("lines_of_code"), F.sha2("content", 256).alias("hash"),
    )
