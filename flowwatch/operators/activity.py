"""Re-keyed views of validated events.

R5 is the form the rules use: one pass over the events emits one row per
(rule, event) with the rule's key and counterparty, so all four windowed rules
share a single scan and a single shuffle.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.config import DEFAULT_RULES, RuleConfig, RULE_SHAPES
from flowwatch.functions import all_canonical, is_canonical_uuid, not_blank, pack_uuid
from flowwatch.schemas import EVENT_COLUMNS


def by_source(events: DataFrame) -> DataFrame:
    """R1."""
    return events.withColumn("key", F.col("source_account_id"))


def by_destination(events: DataFrame) -> DataFrame:
    """R2."""
    return events.withColumn("key", F.col("destination_account_id"))


def by_device(events: DataFrame) -> DataFrame:
    """Only events whose device id is present and not blank."""
    return events.where(not_blank(F.col("device_id"))).withColumn("key", F.col("device_id"))


def by_ip(events: DataFrame) -> DataFrame:
    """Only events whose ip hash is present and not blank."""
    return events.where(not_blank(F.col("ip_hash"))).withColumn("key", F.col("ip_hash"))


ACTIVITY_PAYLOAD = ["event_id", "transaction_id", "amount_minor", "currency",
                    "occurred_at", "ingested_at"]


#: What the rules read of an event.
RULE_EVENT = [c for c in EVENT_COLUMNS if c in {*ACTIVITY_PAYLOAD, *(name for shape in RULE_SHAPES.values() for name in shape[:2])}]


def activity(events: DataFrame, rules: Iterable[RuleConfig] = DEFAULT_RULES) -> DataFrame:
    """Long form ``(rule_type, key, counterparty, <payload>)``.

    Rows whose key is null, or blank for device/IP rules, are dropped right
    after the ``explode`` (generator and filter stay in whole-stage codegen).
    Of packed events the keys of all rules are bytes if some are.
    """
    rules = tuple(rules)
    types = dict(events.dtypes)
    key_type = "binary" if any(types[RULE_SHAPES[r.rule_type][0]] == "binary" for r in rules) else "string"
    entries = []
    for r in rules:
        key_col, cp_col, text_keyed = RULE_SHAPES[r.rule_type]
        key = F.when(not_blank(F.col(key_col)), F.col(key_col)) if text_keyed else F.col(key_col)
        entries.append(F.struct(F.lit(r.rule_type).alias("rule_type"), key.cast(key_type).alias("key"),
                                F.col(cp_col).alias("counterparty")))
    return (events.select(F.explode(F.array(*entries)).alias("r"), *ACTIVITY_PAYLOAD)
            .select("r.rule_type", "r.key", "r.counterparty", *ACTIVITY_PAYLOAD)
            .where(F.col("key").isNotNull()))


#: Columns of events that hold ids, by kind of id.
EVENT_IDS = {"account": ["source_account_id", "destination_account_id"], "transaction": ["transaction_id"], "event": ["event_id"]}


def packed_events(events: DataFrame) -> tuple[DataFrame, list[str]]:
    """Events with the ids of each kind of which every one is a canonical lower-case UUID as bytes, and these kinds."""
    row = events.agg(*[all_canonical([F.col(c) for c in columns]).alias(kind) for kind, columns in EVENT_IDS.items()]).first()
    uuids = [kind for kind in EVENT_IDS if row[kind] is not False]
    return events.withColumns({c: pack_uuid(F.col(c)) for kind in uuids for c in EVENT_IDS[kind]}), uuids


def graph_updates(events: DataFrame) -> DataFrame:
    """Validated events keyed by source account for the graph projector.

    A correlation id that is not null must be a canonical UUID; other rows are returned by
    :func:`graph_update_failures` for the dead-letter table.
    """
    return (events.where(_correlated())
            .select(F.col("source_account_id").alias("key"), *EVENT_COLUMNS))


def graph_update_failures(events: DataFrame) -> DataFrame:
    return events.where(~_correlated())


def _correlated():
    return F.col("correlation_id").isNull() | is_canonical_uuid(F.col("correlation_id"))
