"""Driver tables and the derivation of transaction events from them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch.functions import name_uuid, shift_micros
from flowwatch.schemas import EVENT_COLUMNS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _v3(prefix: str, col: Column) -> Column:
    return name_uuid(F.concat(F.lit(prefix), col.cast("string")))


def base_transactions(events: DataFrame) -> DataFrame:
    """One transaction event per row of the driver's ``events`` table.

    Accounts pay inside blocks of ten users, so fan-in, fan-out and cycles exist
    at every scale; fixed modulus faults exercise every validation reason.  The
    recipe (moduli, prefixes, lags) is the shared fixture definition that the
    SQL oracle repeats.
    """
    id_ = F.col("event_id")
    u = F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    dest_user = (F.floor(u / 10) * 10 + F.pmod(F.pmod(u, 10) + 1 + F.pmod(k, 9), 10)).cast("long")
    return events.select(
        id_.alias("id"),
        _v3("ev-", id_).alias("event_id"),
        F.when(id_ % 107 == 0, F.lit(None).cast("string")).otherwise(_v3("tx-", id_)).alias("transaction_id"),
        F.when(id_ % 97 == 0, F.lit(2)).otherwise(F.lit(1)).alias("schema_version"),
        F.when(id_ % 83 == 0, F.lit(None).cast("string")).when(id_ % 79 == 0, F.concat(F.lit("corr-"), id_.cast("string")))
         .otherwise(_v3("co-", id_)).alias("correlation_id"),
        _v3("acct-", u).alias("source_account_id"),
        F.when(id_ % 109 == 0, F.lit(None).cast("string"))
         .when(id_ % 89 == 0, _v3("acct-", u))
         .otherwise(_v3("acct-", dest_user)).alias("destination_account_id"),
        F.when(id_ % 103 == 0, F.lit(0).cast("long"))
         .otherwise(F.round(F.col("value") * 100).cast("long")).alias("amount_minor"),
        F.when(id_ % 101 == 0, F.lit("usd"))
         .when(et.isin("purchase", "view", "click"), F.lit("USD"))
         .otherwise(F.lit("EUR")).alias("currency"),
        F.when(et == "error", F.lit(None).cast("string"))
         .when(id_ % 61 == 0, F.concat(F.lit("dev-"), F.repeat(F.lit("x"), F.lit(260))))
         .otherwise(F.concat(F.lit("dev-"), F.floor(u / 10).cast("string"), F.lit("-"),
                             F.pmod(k, 3).cast("string"))).alias("device_id"),
        F.when(F.pmod(k, 10) == 0, F.lit(""))
         .otherwise(F.concat(F.lit("ip-"), F.floor(u / 5).cast("string"))).alias("ip_hash"),
        F.when(id_ % 113 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("ts")).alias("occurred_at"),
        shift_micros(F.col("ts"), (F.pmod(k * 37, 1200) * 1_000_000).cast("long")).alias("ingested_at"),
    )


def transaction_events(events: DataFrame) -> DataFrame:
    """Raw ``transaction_event`` stream: base rows, replays (same event id one
    hour later), conflicts (new event id, same transaction, two hours later), event ids used again for another transaction three
    hours later, and null events."""
    base = base_transactions(events)
    hour = F.lit(3_600_000_000).cast("long")
    replays = base.where(F.col("id") % 50 == 0).withColumn(
        "ingested_at", shift_micros(F.col("ingested_at"), hour))
    conflicts = base.where(F.col("id") % 75 == 0).withColumn(
        "event_id", _v3("ev2-", F.col("id"))).withColumn(
        "ingested_at", shift_micros(F.col("ingested_at"), hour * 2))
    reused = base.where(F.col("id") % 131 == 0).withColumn("transaction_id", _v3("tx3-", F.col("id"))).withColumn(
        "ingested_at", shift_micros(F.col("ingested_at"), hour * 3))
    rows = base.unionByName(replays).unionByName(conflicts).unionByName(reused).select(*EVENT_COLUMNS)
    nothing = base.where(F.col("id") % 127 == 0).select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in EVENT_COLUMNS])
    return rows.withColumn("null_event", F.lit(False)).unionByName(nothing.withColumn("null_event", F.lit(True)))


def load_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transaction events derived from ``events``, staged once per source."""
    from flowwatch.sources.staging import staged

    def build():
        events = read_table(spark, sf_dir, "events").select(
            "event_id", "ts", "user_id", "event_type", "value", "props")
        return transaction_events(events)
    return staged(spark, "transaction_events", sf_dir, build)


def load_base_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per ``events`` row (with its ``id``), staged once."""
    from flowwatch.sources.staging import staged
    return staged(spark, "base_transactions", sf_dir,
                  lambda: base_transactions(read_table(spark, sf_dir, "events")))
