"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm.registry import query, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    """Lower-case host; null or odd addresses share the host ''."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def html_lines(html: Column) -> Column:
    """Tags end lines."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), TAG, "\n")


def _lines(text: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def _mark(line: Column) -> Column:
    """128 bits that stand for a line or a row."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def drop_boilerplate(
    pages: DataFrame, most_share: float = 0.3, least_pages: int = 5
) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, kept_text`` for every row of ``pages``.

    A line is boilerplate on a host if more than ``most_share`` of the host's pages contain it
    and at least ``least_pages`` do; it goes wherever it stands on that host's pages. Lines are
    compared without white space at their ends, and blank lines are left out.

    Only 128-bit marks of lines move: once with their count per host, summed before the
    shuffle, and once per page to meet the few marks that are too frequent. A host or line
    with a third of all pages is a skewed join side facing one row per key. Lines
    themselves move once, to meet what their page loses.

    Needs ``page_id, host, text``; other columns are not read. Null hosts are the host '';
    null or blank texts have no lines and an empty result. Every row counts as a page, so
    repeated rows count as often as they stand there; null ids are allowed. A share that
    equals the limit is not above it. An empty table gives no rows.
    """
    base = pages.select("page_id", F.coalesce("host", F.lit("")).alias("host"), _lines(F.col("text")).alias("_lines"))
    keyed = base.withColumn(
        "_row", F.struct(F.xxhash64("page_id", "host", "_lines").alias("a"), F.xxhash64(F.lit(1), "page_id", "host", "_lines").alias("b"))
    )
    marks = keyed.select(
        "_row", "host", F.explode(F.array_distinct(F.transform("_lines", _mark))).alias("mark")
    )
    totals = base.groupBy("host").agg(F.count(F.lit(1)).alias("_pages"))
    frequent = (
        marks.groupBy("host", "mark")
        .agg(F.count(F.lit(1)).alias("_with"))
        .where(F.col("_with") >= least_pages)
        .join(totals, "host")
        .where(F.col("_with") / F.col("_pages") > most_share)
        .select("host", "mark")
    )
    # A row's list holds marks of its own lines only.
    lost = marks.join(frequent, ["host", "mark"]).groupBy("_row").agg(F.collect_set("mark").alias("_lost"))
    kept = F.filter("_lines", lambda x: ~F.array_contains(F.col("_lost"), _mark(x)))
    return (
        keyed.join(lost, "_row", "left")
        .withColumn("_kept", F.when(F.col("_lost").isNull(), F.col("_lines")).otherwise(kept))
        .select(
            "page_id", "host", F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
            F.array_join("_kept", "\n").alias("kept_text"),
        )
    )


ORACLE = f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
    lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
    list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '{TAG}', chr(10), 'g'), chr(10)),
      lambda x: regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT DISTINCT r, host, unnest(lines) AS line FROM p),
f AS (SELECT l.host, l.line FROM l JOIN t USING (host) GROUP BY l.host, l.line, t.pages
      HAVING count(*) >= 5 AND count(*) / t.pages > 0.3),
b AS (SELECT host, list(line) AS bad FROM f GROUP BY host),
k AS (SELECT p.page_id, p.host, p.lines,
        list_filter(p.lines, lambda x: NOT list_contains(coalesce(b.bad, []), x)) AS kept
      FROM p LEFT JOIN b USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS kept_text
FROM k
"""


@query("op1_line_dedup", ORACLE)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return drop_boilerplate(
        pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text"))
    )
