"""Session settings and the folder every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"


def build_session(app: str = "linewright", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call sites per column cost more than planning where rules become many columns.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a session without one gets a local stand-in."""
    configured = spark.conf.get(SHARED_DIR_KEY, None)
    if not configured:
        context_dir = spark.sparkContext.getCheckpointDir()
        if context_dir:
            return context_dir.rsplit("/", 1)[0]
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED_DIR_KEY} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="linewright-")
        atexit.register(shutil.rmtree, configured, True)
        spark.conf.set(SHARED_DIR_KEY, configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write to the shared folder and read back: survives lost executors, computes once,
    and loops go on from a plan that is a plain scan with known size."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_folder(path: str) -> None:
    """Delete a folder that ``fresh_path`` named and that nothing reads any more."""
    file_system, place = fs.FileSystem.from_uri(path)
    file_system.delete_dir(place)


class Steps:
    """Tables in the shared folder that only the ``with`` block needs; they are deleted at its end."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        self._paths[label] = path = fresh_path(self._spark, label)
        df.write.parquet(path)
        return self._spark.read.parquet(path)

    def drop(self, label: str) -> None:
        """Delete a table before the end, once what came from it is written."""
        drop_folder(self._paths.pop(label))

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_) -> None:
        for path in self._paths.values():
            try:
                drop_folder(path)
            except FileNotFoundError:
                pass  # the write failed before it made the folder
