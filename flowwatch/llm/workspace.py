"""Tables in the shared folder that cut lineage between the steps of one operator call."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Only a local master may leave it unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """A private folder below the shared one; Hadoop removes it when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return it as a scan; a lost executor costs no recomputation above it."""
        at = f"{self.root}/{name}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they start: its sources go along with the job, once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    made = os.path.join(tempfile.mkdtemp(prefix="llm-code-"), "code.zip")
    with zipfile.ZipFile(made, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(made)
    sc._llm_shipped = True
