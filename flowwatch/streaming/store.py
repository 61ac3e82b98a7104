"""Tables that micro-batches keep: rows in hash buckets of their key, so that a batch touches only the buckets its keys fall into.

``KeyedTable`` (S6) holds rows that are inserted once.  A bucket is a list of segments: one per batch (``d<batch>``) and, now and
then, a compacted one (``c<batch>``: all rows up to that batch).  A batch reads, per bucket it touches, the last compacted segment
and the few batches after it, however long the history.  Rows carry their ``batch_id``, so a replayed batch compares
itself with earlier batches only, compacted or not, and rewrites exactly its own segments.

``SnapshotTable`` (G8) holds aggregates.  A batch merges its delta into the buckets it touches and writes them as version
``v<batch>``; other buckets keep their last version.  A replayed batch starts from the versions before it.

Segments are directories that appear complete: Spark commits a batch's segments with its job, a compacted one is renamed into
place.  Superseded ones stay for one more compaction (or version), for readers that have listed them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET, SEGMENT, BATCH = "bucket", "segment", "batch_id"
_BUCKET_DIR, _SEGMENT_DIR = re.compile(rf"^{BUCKET}=(\d+)$"), re.compile(rf"^{SEGMENT}=([a-z])(-?\d+)$")


def _name(kind: str, batch_id: int) -> str:
    return f"{kind}{batch_id:012d}"


class _Segments:
    """Directories ``bucket=<b>/segment=<kind><batch>`` below ``path``."""

    def __init__(self, path: str, key_cols: list[str], buckets: int):
        self.path, self.key_cols, self.buckets = path, list(key_cols), buckets
        self.schema: StructType | None = None

    def _fs(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _children(self, spark: SparkSession, at: str) -> list[str]:
        path, fs = self._fs(spark)
        if not fs.exists(path(at)):
            return []
        return [s.getPath().getName() for s in fs.listStatus(path(at)) if s.isDirectory()]

    def segments(self, spark: SparkSession, buckets: set[int] | None = None) -> dict[int, list[tuple[int, str]]]:
        """Per bucket its segments (batch, kind) in order; one listing per bucket."""
        out: dict[int, list[tuple[int, str]]] = {}
        for name in self._children(spark, self.path):
            found = _BUCKET_DIR.match(name)
            if found and (buckets is None or int(found[1]) in buckets):
                inner = (_SEGMENT_DIR.match(n) for n in self._children(spark, f"{self.path}/{name}"))
                out[int(found[1])] = sorted((int(m[2]), m[1]) for m in inner if m)
        return out

    def _at(self, bucket: int, kind: str, batch_id: int) -> str:
        return f"{self.path}/{BUCKET}={bucket}/{SEGMENT}={_name(kind, batch_id)}"

    def _load(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        if not paths:
            if self.schema is None:
                raise FileNotFoundError(f"nothing has been written to {self.path}")
            return spark.createDataFrame([], self.schema)
        found = spark.read.option("basePath", self.path)
        found = (found.schema(self.schema) if self.schema is not None else found).parquet(*paths)
        return found.drop(BUCKET, SEGMENT)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key_cols), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> set[int]:
        """Buckets of the rows: at most ``buckets`` numbers reach the driver."""
        return {r[0] for r in rows.select(self.bucket().alias(BUCKET)).distinct().collect()}

    def _write(self, rows: DataFrame, kind: str, batch_id: int) -> None:
        if self.schema is None:
            self.schema = rows.schema
        (rows.withColumn(BUCKET, self.bucket()).withColumn(SEGMENT, F.lit(_name(kind, batch_id)))
         .repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET, SEGMENT).parquet(self.path))

    def _delete(self, spark: SparkSession, bucket: int, segments: list[tuple[int, str]]) -> None:
        path, fs = self._fs(spark)
        for batch_id, kind in segments:
            fs.delete(path(self._at(bucket, kind, batch_id)), True)


class KeyedTable(_Segments):
    """Insert-if-absent by key over batches."""

    def __init__(self, path: str, key_cols: list[str], buckets: int = 16, compact_after: int = 8):
        super().__init__(path, key_cols, buckets)
        self.compact_after = compact_after

    @staticmethod
    def _current(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
        """The last compacted segment and the batches after it."""
        whole = max((b for b, kind in found if kind == "c"), default=None)
        return [(b, kind) for b, kind in found if (b, kind) == (whole, "c") or kind == "d" and (whole is None or b > whole)]

    def paths(self, spark: SparkSession, buckets: set[int] | None = None) -> list[str]:
        """Segments that a reader of these buckets opens."""
        return [self._at(bucket, kind, b) for bucket, found in sorted(self.segments(spark, buckets).items())
                for b, kind in self._current(found)]

    def read(self, spark: SparkSession) -> DataFrame:
        return self._load(spark, self.paths(spark))

    def earlier(self, rows: DataFrame, batch_id: int, columns: list[str]) -> DataFrame | None:
        """``columns`` of the kept rows of earlier batches that share a key with ``rows``; None where there cannot be one."""
        spark = rows.sparkSession
        paths = self.paths(spark, self._touched(rows))
        if not paths:
            return None
        keys = rows.select(*self.key_cols).distinct()
        return (self._load(spark, paths).where(F.col(BATCH) < batch_id).select(*{*self.key_cols, *columns})
                .join(keys, self.key_cols, "left_semi"))

    def absent(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The rows whose key no earlier batch holds."""
        held = self.earlier(rows, batch_id, [])
        return rows if held is None else rows.join(held.distinct(), self.key_cols, "left_anti")

    def append(self, rows: DataFrame, batch_id: int) -> int:
        """Write a batch's rows, then compact the buckets that have gathered enough earlier batches; returns how many rows the
        batch holds, read from the footers of what it committed."""
        spark = rows.sparkSession
        self._write(rows.withColumn(BATCH, F.lit(batch_id).cast("long")), "d", batch_id)
        own = [self._at(bucket, "d", batch_id) for bucket, found in self.segments(spark).items() if (batch_id, "d") in found]
        written = self._load(spark, own).count() if own else 0
        self.compact(spark, batch_id)
        return written

    def compact(self, spark: SparkSession, batch_id: int) -> None:
        """Merge what lies before ``batch_id``, the only batch that can still be replayed, where it has grown long."""
        due: dict[int, tuple[list[tuple[int, str]], int | None]] = {}
        for bucket, found in self.segments(spark).items():
            now = [(b, kind) for b, kind in self._current(found) if b < batch_id]
            if sum(kind == "d" for _, kind in now) >= self.compact_after:
                due[bucket] = now, max((b for b, kind in found if kind == "c"), default=None)
        if not due:
            return
        own = f"{self.path}/.compact-{uuid.uuid4().hex}"
        paths = [self._at(bucket, kind, b) for bucket, (now, _) in due.items() for b, kind in now]
        (self._load(spark, paths).withColumn(BUCKET, self.bucket()).repartition(BUCKET).sortWithinPartitions(BUCKET, *self.key_cols)
         .write.partitionBy(BUCKET).parquet(own))
        path, fs = self._fs(spark)
        for bucket, (now, before) in due.items():
            fs.rename(path(f"{own}/{BUCKET}={bucket}"), path(self._at(bucket, "c", max(b for b, _ in now))))
            if before is not None:                         # what the last compaction superseded
                old = [(b, kind) for b, kind in self.segments(spark, {bucket})[bucket] if kind == "d" and b <= before or (kind == "c" and b < before)]
                self._delete(spark, bucket, old)
        fs.delete(path(own), True)


class SnapshotTable(_Segments):
    """Merged rows by key, a version per touched bucket and batch."""

    def __init__(self, path: str, key_cols: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = 16):
        super().__init__(path, key_cols, buckets)
        self.merge = merge

    def read(self, spark: SparkSession, before: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """Rows as of the last batch (before a given one); None while there are none."""
        last = {bucket: [b for b, _ in found if before is None or b < before] for bucket, found in self.segments(spark, buckets).items()}
        paths = [self._at(bucket, "v", max(found)) for bucket, found in sorted(last.items()) if found]
        return self._load(spark, paths) if paths else None

    def update(self, delta: DataFrame, batch_id: int) -> None:
        """Merge a batch's delta; a batch that later ones have built upon is not applied again."""
        spark = delta.sparkSession
        known = self.segments(spark)
        if any(found and found[-1][0] > batch_id for found in known.values()):
            return
        touched = self._touched(delta)
        if not touched:
            return
        held = self.read(spark, batch_id, touched)
        self._write(self.merge(delta if held is None else held.unionByName(delta)), "v", batch_id)
        for bucket in touched:
            older = [s for s in known.get(bucket, []) if s[0] < batch_id]
            self._delete(spark, bucket, older[:-1])        # the one before this batch serves its replay
