"""Tables that change: rows in buckets by key, replaced bucket by bucket under a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.session import drop_folder

_MANIFEST = "table string, bucket int, version long, commit long"


class KeyedStore:
    """Several tables that share a key, such as a review with its files and findings.

    A change writes new versions of the buckets it touches, for all its tables, and then one manifest
    that names the version of every bucket. Readers only see what the newest manifest names. So a
    change is there as a whole or not at all: what an attempt left behind that never got to its
    manifest is named nowhere, and the next attempt under that number writes over it.

    Buckets come from a hash of the key, so a change costs the buckets of its keys, not the table. One
    writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str], key: str, buckets: int = 16):
        """``tables`` gives each table's schema as DDL; all of them have the column ``key``."""
        self.spark, self.folder, self.tables, self.key, self.buckets = spark, folder.rstrip("/"), tables, key, buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> list[tuple[str, int, int, int]]:
        """All manifests that are kept; each has at most one row per table and bucket."""
        path = f"{self.folder}/manifest"
        self._touch(path)
        return [tuple(r) for r in self.spark.read.schema(_MANIFEST).parquet(path).collect()]

    def _touch(self, path: str) -> None:
        """A first, empty manifest, so that reading never meets a missing folder."""
        if not getattr(self, "_there", False):
            self.spark.createDataFrame([], "table string, bucket int, version long").write.mode("ignore").parquet(f"{path}/commit=-1")
            self._there = True

    def commits(self) -> list[int]:
        """Numbers of the changes whose manifests are kept, in order."""
        return sorted({row[3] for row in self._manifests() if row[3] >= 0})

    def _current(self) -> tuple[int, dict[tuple[str, int], int]]:
        rows = self._manifests()
        newest = max((row[3] for row in rows), default=-1)
        return newest, {(t, b): v for t, b, v, c in rows if c == newest}

    def _rows(self, table: str, versions: dict[tuple[str, int], int], buckets: list[int] | None = None) -> DataFrame:
        schema = self.tables[table]
        wanted = [(v, b) for (t, b), v in versions.items() if t == table and v >= 0 and (buckets is None or b in buckets)]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        # Conditions on folders only: the scan lists them and opens nothing else.
        by_version: dict[int, list[int]] = {}
        for v, b in wanted:
            by_version.setdefault(v, []).append(b)
        named = F.lit(False)
        for v, some in by_version.items():
            named |= (F.col("_version") == v) & F.col("_bucket").isin(some)
        stored = self.spark.read.schema(f"{schema}, _version long, _bucket int").parquet(f"{self.folder}/rows/{table}")
        return stored.where(named).drop("_version", "_bucket")

    def read(self, table: str, key=None) -> DataFrame:
        """The table as of the newest change; rows of one key come from its own bucket."""
        versions = self._current()[1]
        if key is None:
            return self._rows(table, versions)
        wanted = F.lit(key).cast(self.spark.createDataFrame([], self.tables[table]).schema[self.key].dataType)
        bucket = self.spark.range(1).select(self._bucket(wanted)).first()[0]
        return self._rows(table, versions, [bucket]).where(F.col(self.key) == wanted)

    def change(
        self, upserts: dict[str, tuple[DataFrame, list[str]]] | None = None, deletes: DataFrame | None = None, commit: int | None = None
    ) -> int:
        """Put rows in, and take out all rows of some keys, in one step; returns its number.

        ``upserts`` gives, per table, new rows and the columns that name a row: stored rows of that name are
        replaced, others stay. ``deletes`` has the keys whose rows leave every table; they go before the
        new rows come. With ``commit``, a change that is already there is not made again, which makes
        the retry of a stream's batch harmless. A null key is a key like others.
        """
        upserts = upserts or {}
        newest, versions = self._current()
        number = newest + 1 if commit is None else commit
        if commit is not None and commit <= newest:
            return number
        new_versions = dict(versions)
        gone = None
        if deletes is not None:
            gone = deletes.select(F.col(self.key).alias("_gone"))
        for table in self.tables:
            rows, names = upserts.get(table, (None, [self.key]))
            if rows is None and gone is None:
                continue
            touched = self._touched(*[(d, c) for d, c in ((gone, "_gone"), (rows, self.key)) if d is not None])
            stored = self._stored(table, versions, touched)
            if not (touched if rows is not None else stored):
                continue
            kept = self._rows(table, versions, stored)
            if rows is not None:
                rows = rows.select(*kept.columns)
            # Joins are left out where nothing is stored yet: each of them would move the new rows once more.
            if stored and gone is not None:
                kept = kept.join(gone, F.col(self.key).eqNullSafe(F.col("_gone")), "left_anti")
            if stored and rows is not None:
                named = rows.select(*[F.col(n).alias(f"_new_{n}") for n in names])
                same = F.lit(True)
                for n in names:
                    same &= F.col(n).eqNullSafe(F.col(f"_new_{n}"))
                kept = kept.join(named, same, "left_anti").unionByName(rows)
            self._write(table, kept if stored else rows, number)
            new_versions.update({(table, b): number for b in touched})
        self._publish(new_versions, number)
        return number

    def update(self, table: str, changes: DataFrame, names: list[str]) -> int:
        """Set the other columns of ``changes`` in the stored rows that its columns ``names`` name; returns the
        number of the change.

        ``changes`` has one row for a name; names that are not stored are passed over. The buckets of its keys
        meet it in one join.
        """
        newest, versions = self._current()
        number, new_versions = newest + 1, dict(versions)
        stored = self._stored(table, versions, self._touched((changes, self.key)))
        if stored:
            kept = self._rows(table, versions, stored)
            values = [c for c in changes.columns if c not in names]
            new = changes.select(*names, *[F.col(c).cast(kept.schema[c].dataType).alias(f"_new_{c}") for c in values], F.lit(True).alias("_named"))
            columns = [F.when(F.col("_named"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in kept.columns]
            self._write(table, kept.join(new, names, "left").select(*columns), number)
            new_versions.update({(table, b): number for b in stored})
        self._publish(new_versions, number)
        return number

    def _touched(self, *keyed: tuple[DataFrame, str]) -> list[int]:
        """Buckets of the keys. They are all that is collected, and there are as many as the store has."""
        keys = [d.select(self._bucket(F.col(c)).alias("b")) for d, c in keyed]
        return sorted(r["b"] for r in (keys[0] if len(keys) == 1 else keys[0].union(keys[1])).distinct().collect())

    def _stored(self, table: str, versions: dict[tuple[str, int], int], buckets: list[int]) -> list[int]:
        return [b for b in buckets if versions.get((table, b), -1) >= 0]

    def _write(self, table: str, rows: DataFrame, number: int) -> None:
        # AQE packs small buckets together and splits one that a single key has made large.
        bucketed = rows.withColumn("_bucket", self._bucket(F.col(self.key))).hint("rebalance", F.col("_bucket"))
        bucketed.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/rows/{table}/_version={number}")

    def _publish(self, versions: dict[tuple[str, int], int], number: int) -> None:
        rows = [(t, b, v) for (t, b), v in versions.items()] or [("", -1, -1)]
        self.spark.createDataFrame(rows, "table string, bucket int, version long").coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/manifest/commit={number}"
        )

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the newest ``keep`` changes and delete the buckets only older ones name."""
        rows = self._manifests()
        commits = sorted({c for *_, c in rows})
        kept, old = commits[-keep:], commits[:-keep]
        needed = {(t, v, b) for t, b, v, c in rows if c in kept}
        for t, b, v, c in rows:
            if c in old and c >= 0 and v >= 0 and (t, v, b) not in needed:
                needed.add((t, v, b))  # once
                try:
                    drop_folder(f"{self.folder}/rows/{t}/_version={v}/_bucket={b}")
                except FileNotFoundError:
                    pass  # a bucket that lost all its rows has no folder
        for c in old:
            if c >= 0:
                drop_folder(f"{self.folder}/manifest/commit={c}")
