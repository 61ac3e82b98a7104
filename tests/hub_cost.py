"""Cost of the cycle search on a hub: N payers and N payees of one account, all of one amount within a window.

usage: python tests/hub_cost.py [N ...]      (2 N transactions each, and as many closing ones as N / 100)
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from flowwatch.config import CycleConfig  # noqa: E402
from flowwatch.functions import name_uuid  # noqa: E402
from flowwatch.operators import cycles  # noqa: E402
from flowwatch.schemas import EVENT_COLUMNS  # noqa: E402
from flowwatch.session import build_session  # noqa: E402


def hub_events(spark, n: int):
    """Payer k pays the hub at second k, the hub payee k at second n + k, and every hundredth payee pays its payer back."""
    k = F.col("id")
    account = lambda name, number: name_uuid(F.concat(F.lit(name), number.cast("string")))
    hub = name_uuid(F.lit("hub"))
    at = F.lit(dt.datetime(2026, 1, 1)).cast("timestamp")
    rows = spark.range(n)
    parts = [rows.select(F.lit("in").alias("kind"), k.alias("n"), account("payer", k).alias("s"), hub.alias("d")),
             rows.select(F.lit("out"), k + n, hub, account("payee", k)),
             rows.where(k % 100 == 0).select(F.lit("back"), k + 2 * n, account("payee", k), account("payer", k))]
    every = parts[0].union(parts[1]).union(parts[2])
    when = F.timestamp_add("SECOND", F.col("n"), at)
    event = name_uuid(F.concat("kind", F.col("n").cast("string")))
    columns = {"event_id": event, "transaction_id": event, "schema_version": F.lit(1), "correlation_id": event,
               "source_account_id": F.col("s"), "destination_account_id": F.col("d"), "amount_minor": F.lit(1000).cast("long"),
               "currency": F.lit("USD"), "device_id": F.lit(None).cast("string"), "ip_hash": F.lit(None).cast("string"),
               "occurred_at": when, "ingested_at": when}
    return every.select(*[columns[c].alias(c) for c in EVENT_COLUMNS])


def main(argv):
    spark = build_session("local[8]", shuffle_partitions=16)
    cfg = CycleConfig(4, 30 * 86400, 10)
    cycles.circular_flow(hub_events(spark, 100), cfg).count()             # warm-up
    for n in map(int, argv[1:] or (25000, 50000, 100000)):
        events = hub_events(spark, n).persist()
        events.count()
        t = time.time()
        found = cycles.circular_flow(events, cfg).count()
        print(f"{2 * n + n // 100} events: {found} paths, {time.time() - t:.1f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
