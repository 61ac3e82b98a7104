"""Stage derived inputs as Parquet tables in the shared checkpoint folder.

Deriving transaction events from the driver tables is a wide projection (many
name UUIDs); jobs that read it several times (self-joins in the cycle search,
the rule crossing) would otherwise re-derive it per branch.  Writing it once
cuts the lineage -- a lost executor then recomputes from the staged files, not
from the raw tables -- and keeps every query plan small.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from flowwatch.session import checkpoint_dir, write_once

# Staged tables are keyed by the package's own source text, so a changed
# derivation never reuses a stale table.
def _code_digest() -> str:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for d, _, files in sorted(os.walk(root)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(d, f), "rb") as fh:
                    h.update(fh.read())
    return h.hexdigest()[:12]


RECIPE_VERSION = _code_digest()


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _input_mark(spark: SparkSession, source: str, tables: tuple[str, ...]) -> str:
    """Paths, lengths and modification times of the files behind the tables: a rewritten input has another mark."""
    jvm = spark.sparkContext._jvm
    rows = []
    for table in tables:
        p = jvm.org.apache.hadoop.fs.Path(f"{source.rstrip('/')}/{table}.parquet")
        files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            rows.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return "\n".join(sorted(rows))


def staged(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame],
           tables: tuple[str, ...] = ("events",), partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Read the staged table ``name`` derived from ``tables`` of ``source``; build it once per state of the input.

    It is written under a name of its own and renamed when complete, so jobs that build it at the same time do not mix
    their files and a failed build leaves nothing that looks finished.
    """
    key = hashlib.sha1(f"{name}|{_input_mark(spark, source, tables)}|{RECIPE_VERSION}".encode()).hexdigest()[:16]
    folder = f"{checkpoint_dir(spark).rstrip('/')}/staged"
    path = f"{folder}/{name}-{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        jvm = spark.sparkContext._jvm
        own = f"{folder}/.{name}-{key}-{uuid.uuid4().hex[:8]}"
        writer = build().write
        write_once(writer.partitionBy(*partition_by) if partition_by else writer, spark, own)
        here, there = jvm.org.apache.hadoop.fs.Path(own), jvm.org.apache.hadoop.fs.Path(path)
        fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if exists(spark, f"{path}/_SUCCESS") or not fs.rename(here, there):
            fs.delete(here, True)                     # another job finished first
    return spark.read.parquet(path)
