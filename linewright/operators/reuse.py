"""Reuse of findings by content hash.

The ledger has two tables: heads ``(content_hash, rule_version, seq)`` and findings with the
same three keys. Long rows instead of a list per content keep a content with very many
findings spread out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.operators import scan
from linewright.session import cut_lineage

ENTRY = ["content_hash", "rule_version"]
_FOUND = ["source", "category", "severity", "message", "line_start", "line_end", "rule_id", "ord"]


def rule_version() -> str:
    """Changes whenever a rule does, so that old findings are not taken for current ones."""
    return hashlib.sha256(repr(fv.LINE_RULES).encode()).hexdigest()[:16]


def newest(heads: DataFrame) -> DataFrame:
    """The last written entry per content; an aggregate with a map-side half."""
    return heads.groupBy(*ENTRY).agg(F.max("seq").alias("seq"))


def put(heads: DataFrame, findings: DataFrame, new_heads: DataFrame, new_findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger after a write; of two entries for one content the later one stays."""
    kept = newest(heads.unionByName(new_heads))
    rows = findings.unionByName(new_findings).join(kept, [*ENTRY, "seq"], "left_semi")
    return kept, rows


def known(files: DataFrame, heads: DataFrame, version: str | None = None) -> DataFrame:
    """Files whose content is in the ledger, whatever their name or language."""
    return files.join(_current(heads, version), "content_hash", "left_semi")


def unknown(files: DataFrame, heads: DataFrame, version: str | None = None) -> DataFrame:
    return files.join(_current(heads, version), "content_hash", "left_anti")


def _current(heads: DataFrame, version: str | None) -> DataFrame:
    return heads.where(F.col("rule_version") == (version or rule_version())).select("content_hash").distinct()


def scan_distinct(files: DataFrame) -> DataFrame:
    """Scan each distinct content once and give its findings to every file that has it.

    Which file stands for a content is settled on the narrow columns, so contents that
    are repeated are dropped by the join before they are scanned.
    """
    standing = files.groupBy("content_hash").agg(F.min("file_id").alias("file_id"))
    once = files.join(standing, ["content_hash", "file_id"], "left_semi")
    found = scan.scan(once).join(standing, "file_id").select("content_hash", *_FOUND)
    return files.select("review_id", "file_id", "filename", "content_hash").join(found, "content_hash")


def incremental_scan(files: DataFrame, heads: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of a run: stored ones for known contents, a scan for the others.

    Contents are hashed once, and what is known is settled on the narrow columns. The only
    contents that are asked for again are those of files that have to be scanned. All joins with
    the ledger are by content hash alone, so tables that are laid out by it, as those of
    ``HashLedger``, are read where they lie.
    """
    version = rule_version()
    names = ["review_id", "file_id", "filename"]
    hashed = cut_lineage(files.select(*names, "content_hash"), "hashed")
    current = heads.where(F.col("rule_version") == version).groupBy("content_hash").agg(F.max("seq").alias("_newest"))
    # Both bounds and no equality: a second key would have to be a key of the layout too.
    newest_rows = findings.where(F.col("rule_version") == version).join(current, "content_hash").where(
        (F.col("seq") >= F.col("_newest")) & (F.col("seq") <= F.col("_newest"))
    )
    cached = hashed.join(newest_rows.select("content_hash", *_FOUND), "content_hash")
    missing = cut_lineage(hashed.join(current, "content_hash", "left_anti").select("file_id"), "missing")
    fresh = scan.scan(files.join(missing, "file_id", "left_semi"))
    return cached.select(*names, *_FOUND, F.lit(True).alias("cached")).unionByName(
        fresh.select(*names, *_FOUND, F.lit(False).alias("cached"))
    )


class HashLedger:
    """The ledger as two tables in buckets of the content hash, which runs append to.

    A run's own hashes are dealt out to the buckets; the ledger, which grows with the history, is
    neither shuffled nor sorted anew: its files are sorted by hash within a bucket. Each file has a Bloom filter
    over its hashes, with which ``find`` passes files and row groups that have none of a few contents.
    Entries are never changed; of several for one content the last one counts.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, found: str, buckets: int = 32):
        """``found`` is the DDL of what is stored per finding; ``name`` leads the names of both tables."""
        self.spark, self.buckets = spark, buckets
        keys = "content_hash STRING, rule_version STRING, seq BIGINT"
        self._names = {"heads": f"{name}_heads", "findings": f"{name}_findings"}
        for part, columns in (("heads", keys), ("findings", f"{keys}, {found}")):
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._names[part]} ({columns}) USING parquet "
                "OPTIONS ('parquet.bloom.filter.enabled#content_hash' 'true') "
                f"CLUSTERED BY (content_hash) SORTED BY (content_hash) INTO {buckets} BUCKETS LOCATION '{folder}/{part}'"
            )

    def heads(self) -> DataFrame:
        return self.spark.table(self._names["heads"])

    def findings(self) -> DataFrame:
        return self.spark.table(self._names["findings"])

    def append(self, heads: DataFrame, findings: DataFrame) -> None:
        """What a run found, one file per bucket and table. The findings go first: an entry whose head is
        not there yet is not known."""
        for part, rows in (("findings", findings), ("heads", heads)):
            columns = self.spark.table(self._names[part]).columns
            rows.select(*columns).repartition(self.buckets, "content_hash").write.insertInto(self._names[part])

    def find(self, hashes: list[str], version: str | None = None) -> DataFrame:
        """Newest findings of a few contents."""
        wanted = F.col("content_hash").isin(hashes) & (F.col("rule_version") == (version or rule_version()))
        last = self.heads().where(wanted).groupBy("content_hash").agg(F.max("seq").alias("_newest"))
        return self.findings().where(wanted).join(last, "content_hash").where("seq = _newest").drop("_newest")
