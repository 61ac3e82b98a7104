"""Planted scenario transactions and the alerts they should raise.

One *block* is the reference harness's scenario: 100 noise transfers, 10
fan-outs x 5, 10 fan-ins x 5, 10 shared devices x 3, 10 shared IPs x 3, 5
three-account cycles and 50 far-future rows that advance stream time.  Every
row of the seed table (the driver's ``supplier`` table) becomes one block, so
the scenario grows with the data; all ids are name UUIDs of the block and row
number, so reruns are identical.  Rows are generated with ``explode(sequence)``
per seed row -- no cross join, no driver-side data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch.functions import name_uuid, shift_micros

# Scenario layout (row ranges of one block) and its parameters.
BLOCK_ROWS = 325
NOISE, FAN_OUT_ROWS, FAN_IN_ROWS, SHARED_DEV_ROWS, SHARED_IP_ROWS, CYCLE_ROWS, FUTURE_ROWS = (
    (0, 100), (100, 150), (150, 200), (200, 230), (230, 260), (260, 275), (275, 325))
BASE_TIME = "2026-01-01 00:00:00"
INGEST_LAG_MS = 200
NOISE_AMOUNT, SCENARIO_AMOUNT, FUTURE_AMOUNT = 5000, 1000, 100


def _s(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def scenario_transactions(seeds: DataFrame, seed_col: str = "s_suppkey") -> DataFrame:
    """Raw transaction events of every block (currency USD, version 1)."""
    b = F.col("block").cast("string")
    r = F.col("r")
    rows = seeds.select(F.col(seed_col).alias("block"),
                        F.explode(F.sequence(F.lit(0), F.lit(BLOCK_ROWS - 1))).alias("r"))

    def in_range(rng):
        return (r >= rng[0]) & (r < rng[1])

    kind = (F.when(in_range(NOISE), "NOISE").when(in_range(FAN_OUT_ROWS), "FO")
            .when(in_range(FAN_IN_ROWS), "FI").when(in_range(SHARED_DEV_ROWS), "SD")
            .when(in_range(SHARED_IP_ROWS), "SI").when(in_range(CYCLE_ROWS), "CF").otherwise("FUTURE"))
    offset = (F.when(in_range(NOISE), r - NOISE[0]).when(in_range(FAN_OUT_ROWS), r - FAN_OUT_ROWS[0])
              .when(in_range(FAN_IN_ROWS), r - FAN_IN_ROWS[0]).when(in_range(SHARED_DEV_ROWS), r - SHARED_DEV_ROWS[0])
              .when(in_range(SHARED_IP_ROWS), r - SHARED_IP_ROWS[0]).when(in_range(CYCLE_ROWS), r - CYCLE_ROWS[0])
              .otherwise(r - FUTURE_ROWS[0]))
    per = F.when(F.col("kind").isin("FO", "FI"), 5).when(F.col("kind").isin("SD", "SI", "CF"), 3).otherwise(1)
    df = rows.withColumn("kind", kind).withColumn("_o", offset)
    df = df.withColumn("i", (F.col("_o") / per).cast("int")).withColumn("j", F.pmod(F.col("_o"), per))
    i = F.col("i").cast("string")
    j = F.col("j").cast("string")
    k = F.col("kind")

    def acct(*parts):
        return _s("sc-", b, "-", *parts)

    cyc = ["a", "b", "c"]
    cyc_src = F.when(F.col("j") == 0, acct("cf-a-", i)).when(F.col("j") == 1, acct("cf-b-", i)).otherwise(acct("cf-c-", i))
    cyc_dst = F.when(F.col("j") == 0, acct("cf-b-", i)).when(F.col("j") == 1, acct("cf-c-", i)).otherwise(acct("cf-a-", i))
    src = (F.when(k == "NOISE", acct("noise-src-", i)).when(k == "FO", acct("fo-src-", i))
           .when(k == "FI", acct("fi-src-", i, "-", j)).when(k == "SD", acct("sd-src-", i, "-", j))
           .when(k == "SI", acct("si-src-", i, "-", j)).when(k == "CF", cyc_src)
           .otherwise(acct("future-src-", i)))
    dst = (F.when(k == "NOISE", acct("noise-dst-", i)).when(k == "FO", acct("fo-dst-", i, "-", j))
           .when(k == "FI", acct("fi-dst-", i)).when(k == "SD", acct("sd-dst-", i, "-", j))
           .when(k == "SI", acct("si-dst-", i, "-", j)).when(k == "CF", cyc_dst)
           .otherwise(acct("future-dst-", i)))
    leg = F.element_at(F.array(*[F.lit(x) for x in cyc]), F.col("j") + 1)
    device = (F.when(k == "NOISE", _s("dev_", b, "_", i)).when(k == "FO", _s("dev_fo_", b, "_", i))
              .when(k == "FI", _s("dev_fi_", b, "_", i)).when(k == "SD", _s("SHARED_DEV_", b, "_", i))
              .when(k == "SI", _s("dev_si_", b, "_", i, "_", j)).when(k == "CF", _s("dev_c_", b, "_", i, leg))
              .otherwise(_s("dev_future_", b, "_", i)))
    ip = (F.when(k == "NOISE", _s("ip_", b, "_", i)).when(k == "FO", _s("ip_fo_", b, "_", i))
          .when(k == "FI", _s("ip_fi_", b, "_", i)).when(k == "SD", _s("ip_sd_", b, "_", i, "_", j))
          .when(k == "SI", _s("SHARED_IP_", b, "_", i)).when(k == "CF", _s("ip_c_", b, "_", i, leg))
          .otherwise(_s("ip_future_", b, "_", i)))
    seconds = (F.when(k == "NOISE", F.col("i") * 10)
               .when(k == "FO", 3600 + F.col("i") * 100 + F.col("j"))
               .when(k == "FI", 7200 + F.col("i") * 100 + F.col("j"))
               .when(k == "SD", 10800 + F.col("i") * 100 + F.col("j"))
               .when(k == "SI", 14400 + F.col("i") * 100 + F.col("j"))
               .when(k == "CF", 18000 + F.col("i") * 10000 + F.col("j") * 3600)
               .otherwise(864000 + F.col("i")))
    amount = F.when(k == "NOISE", NOISE_AMOUNT).when(k == "FUTURE", FUTURE_AMOUNT).otherwise(SCENARIO_AMOUNT)
    occurred = shift_micros(F.lit(BASE_TIME).cast("timestamp_ntz"), seconds.cast("long") * 1_000_000)
    rid = _s(b, "-", F.col("r").cast("string"))
    return df.select(
        "block", "kind", "i", "j",
        name_uuid(_s("sc-ev-", rid)).alias("event_id"),
        name_uuid(_s("sc-tx-", rid)).alias("transaction_id"),
        F.lit(1).alias("schema_version"),
        name_uuid(_s("sc-co-", rid)).alias("correlation_id"),
        name_uuid(src).alias("source_account_id"), name_uuid(dst).alias("destination_account_id"),
        F.lit(amount).cast("long").alias("amount_minor"), F.lit("USD").alias("currency"),
        device.alias("device_id"), ip.alias("ip_hash"),
        occurred.alias("occurred_at"),
        shift_micros(occurred, F.lit(INGEST_LAG_MS * 1000).cast("long")).alias("ingested_at"))


def scenario_expected(scenario: DataFrame) -> DataFrame:
    """The alert each scenario should raise, from its triggering row."""
    k = F.col("kind")
    trigger = (((k == "FO") | (k == "FI")) & (F.col("j") == 4)) | \
              (k.isin("SD", "SI", "CF") & (F.col("j") == 2))
    rule = (F.when(k == "FO", "FAN_OUT").when(k == "FI", "FAN_IN").when(k == "SD", "SHARED_DEVICE")
            .when(k == "SI", "SHARED_IP").otherwise("CIRCULAR_FLOW"))
    primary = (F.when(k == "FO", F.col("source_account_id")).when(k == "FI", F.col("destination_account_id"))
               .when(k == "SD", name_uuid(F.col("device_id"))).when(k == "SI", name_uuid(F.col("ip_hash")))
               .otherwise(F.col("source_account_id")))
    return (scenario.where(trigger)
            .select(rule.alias("rule_type"), primary.alias("primary_account_id"),
                    F.concat(k, F.lit("_"), F.col("block").cast("string"), F.lit("_"), F.col("i").cast("string"))
                    .alias("scenario_id"),
                    F.col("occurred_at").alias("trigger_at")))
