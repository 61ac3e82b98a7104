"""Stream source and sink with a ``format`` parameter.

``parquet``/``json`` directories are what the tests use; ``kafka`` takes the
usual option map (the connector jar must be on the cluster's class path).
Messages keyed by source account, as the reference's producer does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, fmt: str, schema: StructType | None = None, path: str | None = None,
                options: dict[str, str] | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).options(**(options or {}))
    if schema is not None and fmt != "kafka":
        reader = reader.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path) if path else reader.load()


#: Instants keep their microseconds, in UTC.
_WIRE = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timeZone": "UTC"}


def as_messages(events: DataFrame, key_col: str = "source_account_id") -> DataFrame:
    """Events as ``(key, value)`` JSON messages for a topic sink."""
    return events.select(F.col(key_col).cast("string").alias("key"),
                         F.to_json(F.struct(*events.columns), _WIRE).alias("value"))


def write_stream(df: DataFrame, fmt: str, checkpoint: str, path: str | None = None,
                 options: dict[str, str] | None = None, output_mode: str = "append", trigger: dict | None = None):
    writer = (df.writeStream.format(fmt).outputMode(output_mode)
              .option("checkpointLocation", checkpoint).options(**(options or {})))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start(path) if path else writer.start()
