"""Table schemas of the data model (snake_case, typed)."""

from pyspark.sql import types as T

TRANSACTION_REQUEST = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("source_account_id", T.StringType()),
    T.StructField("destination_account_id", T.StringType()),
    T.StructField("amount_minor", T.LongType()),
    T.StructField("currency", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("ip_hash", T.StringType()),
    T.StructField("occurred_at", T.TimestampType()),
])

TRANSACTION_EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("correlation_id", T.StringType()),
    T.StructField("source_account_id", T.StringType()),
    T.StructField("destination_account_id", T.StringType()),
    T.StructField("amount_minor", T.LongType()),
    T.StructField("currency", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("ip_hash", T.StringType()),
    T.StructField("occurred_at", T.TimestampType()),
    T.StructField("ingested_at", T.TimestampType()),
])

EVENT_COLUMNS = [f.name for f in TRANSACTION_EVENT.fields]

DEAD_LETTER = T.StructType([
    T.StructField("origin", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
])

CANDIDATE_COLUMNS = [
    "candidate_id", "deduplication_key", "rule_type", "primary_account_id",
    "window_start", "window_end", "distinct_accounts_count", "transaction_count",
    "total_amount_minor", "currency", "involved_accounts", "transaction_ids",
    "generated_at",
]

ALERT_EVENT_COLUMNS = [
    "alert_id", "deduplication_key", "rule_type", "primary_account_id", "status",
    "involved_accounts", "transaction_ids", "generated_at",
]
