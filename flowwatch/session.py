"""Session helpers: the settings every job of this package relies on."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

# Session settings the operators assume.  UTC because every instant in the data
# model is an epoch instant; AQE so that skewed joins are split at run time and
# broadcasts are only chosen after the real size of a side is known.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "16m",       # a row group of our tables, or less: what a task sorts before a shuffle
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators need to an existing session."""
    for key, value in SESSION_DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, app: str = "flowwatch",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Local/test session.  On a cluster the session comes from the launcher."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    conf.update({
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or 8),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("FLOWWATCH_DRIVER_MEMORY", "16g"),
    })
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and cut-lineage tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master (tests) may leave it unset: on a cluster a
    folder of the driver's machine would not be seen by the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="flowwatch-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc = spark.sparkContext
    if getattr(sc, "_flowwatch_checkpoints", None) != configured:      # each call would make another folder
        sc.setCheckpointDir(configured)
        made = spark._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        made.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(made)
        sc._flowwatch_checkpoints = configured
    return configured


_open_scopes = threading.local()

#: Row groups of written tables are small, so that a task that reads and sorts them holds few rows however large the table is.
ROW_GROUP_BYTES = 32 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Write Parquet; the shuffle files of this write go with its end, for nothing reads the plan behind it again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path, compression="zstd")
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def kept(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """``df`` written once below the shared folder and read back: what several branches of a plan read is computed once,
    a lost executor recomputes from the files, and readers prune columns.  The files go with the enclosing ``scratch`` (with
    ``outlive``, the one around that), or when the driver's JVM ends."""
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark).rstrip('/')}/kept/{name}-{uuid.uuid4().hex}"
    write_once(df.write, spark, at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(path)
    stack = getattr(_open_scopes, "stack", [])
    for scope in stack[-2:-1] if outlive else stack[-1:]:
        scope.append((fs, path))
    out = spark.read.schema(df.schema).parquet(at)
    out._kept_files = (fs, path)
    return out


def is_kept(df: DataFrame | None) -> bool:
    return hasattr(df, "_kept_files")


def release(df: DataFrame | None) -> None:
    """Delete the files of a frame, if it is kept, before its scope ends: nothing that is still to run reads it."""
    if is_kept(df):
        fs, path = df._kept_files
        fs.delete(path, True)


@contextmanager
def scratch():
    """What this thread keeps inside is deleted at the end: for jobs that write their result before it, such as micro-batches
    and searches that keep their result with ``outlive``."""
    if not hasattr(_open_scopes, "stack"):
        _open_scopes.stack = []
    _open_scopes.stack.append([])
    try:
        yield
    finally:
        for fs, path in _open_scopes.stack.pop():
            fs.delete(path, True)
            fs.cancelDeleteOnExit(path)
