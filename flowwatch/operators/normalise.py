"""Split raw transaction events into validated and invalid ones.

One ``failure_reason`` column decides both outputs, so they partition the
input exactly; no shuffle is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch.functions import currency_ok
from flowwatch.schemas import EVENT_COLUMNS

# Failure texts, in the order the checks are applied.
EVENT_IS_NULL = "Event is null"
MISSING_IDS = "Missing IDs"
MISSING_ACCOUNT_IDS = "Missing account IDs"
SOURCE_EQUALS_DESTINATION = "Source equals destination"
AMOUNT_NOT_POSITIVE = "Amount must be positive"
INVALID_CURRENCY = "Invalid currency format"
UNSUPPORTED_VERSION = "Unsupported schema version"
MISSING_TIMESTAMPS = "Missing timestamps"
SUPPORTED_SCHEMA_VERSION = 1


def failure_reason(null_event: Column | None = None) -> Column:
    """First failing check, or null for a valid event.

    A null amount or schema version is a failure of that check (not an error).
    """
    c = F.col
    chain = F.when(F.lit(False), F.lit(None))
    if null_event is not None:
        chain = F.when(null_event, F.lit(EVENT_IS_NULL))
    return (chain
            .when(c("event_id").isNull() | c("transaction_id").isNull(), F.lit(MISSING_IDS))
            .when(c("source_account_id").isNull() | c("destination_account_id").isNull(),
                  F.lit(MISSING_ACCOUNT_IDS))
            .when(c("source_account_id") == c("destination_account_id"), F.lit(SOURCE_EQUALS_DESTINATION))
            .when(F.coalesce(c("amount_minor") <= 0, F.lit(True)), F.lit(AMOUNT_NOT_POSITIVE))
            .when(~currency_ok(c("currency")), F.lit(INVALID_CURRENCY))
            .when(F.coalesce(c("schema_version") != SUPPORTED_SCHEMA_VERSION, F.lit(True)),
                  F.lit(UNSUPPORTED_VERSION))
            .when(c("occurred_at").isNull() | c("ingested_at").isNull(), F.lit(MISSING_TIMESTAMPS)))


def classify(raw: DataFrame, null_event: str = "null_event") -> DataFrame:
    """Raw events plus ``failure_reason`` (null = valid).

    ``null_event`` names the column that marks null events (messages without an event), as decoding sets it.
    """
    flag = F.col(null_event) if null_event in raw.columns else None
    return raw.withColumn("failure_reason", failure_reason(flag))


def validated(raw: DataFrame) -> DataFrame:
    """Events that pass every check, unchanged."""
    return classify(raw).where(F.col("failure_reason").isNull()).select(*EVENT_COLUMNS)


def invalid(raw: DataFrame, failed_at: Column | None = None) -> DataFrame:
    """``(event struct, failure_reason, failed_at)`` for every other event.

    ``failed_at`` defaults to the event's own arrival time, which keeps reruns
    deterministic; pass a literal for wall-clock stamping.
    """
    stamp = failed_at if failed_at is not None else F.col("ingested_at")
    return (classify(raw).where(F.col("failure_reason").isNotNull())
            .select(F.struct(*EVENT_COLUMNS).alias("event"), "failure_reason",
                    stamp.alias("failed_at")))


def outcome_counts(raw: DataFrame) -> DataFrame:
    """Events per outcome (``failure_reason`` null = valid)."""
    return (classify(raw).groupBy("failure_reason")
            .agg(F.count(F.lit(1)).alias("event_count")))
