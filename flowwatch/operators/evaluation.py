"""Score alerts against the expected ones.

The harness matches each expected alert to the first unmatched actual alert
with the same ``(rule_type, primary_account_id)``; since the key is the only
criterion, that greedy match equals pairing the n-th expected with the n-th
actual of each key: ``row_number`` on both sides, then a full outer join on
key + rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.operators.rules import firing

KEY = ["rule_type", "primary_account_id"]


def expected_alerts(activity: DataFrame, rules) -> DataFrame:
    """Alerts of a run that sees every event in the order in which it occurred.

    The groups are those that fire over whole windows (W6); ``trigger_at`` is when the event occurred
    at which the group reaches its thresholds.  Late rows and arrival order make the real alerts differ.
    """
    by_time = activity.withColumn("ingested_at", F.col("occurred_at"))
    return firing(by_time, rules).select(
        *KEY, F.col("deduplication_key").alias("scenario_id"), F.col("generated_at").alias("trigger_at"))


def match(expected: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per pairing; outcome TP, FN (expected only) or FP (alert only)."""
    e = expected.withColumn("_rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("scenario_id")))
    a = (alerts.select(*KEY, "alert_id", "created_at")
         .withColumn("_rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("created_at", "alert_id"))))
    j = e.join(a, KEY + ["_rank"], "full")
    outcome = (F.when(F.col("scenario_id").isNotNull() & F.col("alert_id").isNotNull(), "TP")
               .when(F.col("scenario_id").isNotNull(), "FN").otherwise("FP"))
    return j.select(*KEY, "scenario_id", "alert_id", "trigger_at", "created_at", outcome.alias("outcome"))


def metrics(matched: DataFrame, scenario: DataFrame) -> DataFrame:
    """Precision, recall, F1, FPR, FNR (0 where undefined).

    Negatives = injected transactions (stream-time advancers excluded) minus
    expected alerts, as the harness approximates it.
    """
    both = (matched.select("outcome", F.lit(None).cast("string").alias("kind"))
            .unionByName(scenario.select(F.lit(None).cast("string").alias("outcome"), "kind")))
    m = both.agg(F.count_if(F.col("outcome") == "TP").alias("tp"),
                 F.count_if(F.col("outcome") == "FP").alias("fp"),
                 F.count_if(F.col("outcome") == "FN").alias("fn"),
                 F.count_if(F.col("kind") != "FUTURE").alias("total_transactions"))
    tp, fp, fn = F.col("tp").cast("double"), F.col("fp").cast("double"), F.col("fn").cast("double")
    precision = F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(tp / (tp + fp))
    recall = F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(tp / (tp + fn))
    negatives = (F.col("total_transactions") - F.col("tp") - F.col("fn")).cast("double")
    return (m.withColumn("precision", precision).withColumn("recall", recall)
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0))
                        .otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
            .withColumn("fpr", F.when(negatives == 0, F.lit(0.0)).otherwise(fp / negatives))
            .withColumn("fnr", F.when(F.col("tp") + F.col("fn") == 0, F.lit(0.0)).otherwise(fn / (tp + fn)))
            .select("tp", "fp", "fn", "total_transactions", "precision", "recall", "f1", "fpr", "fnr"))


def detection_latency(matched: DataFrame) -> DataFrame:
    """E5: mean ms from trigger to alert creation over true positives (integer division)."""
    tp = matched.where(F.col("outcome") == "TP")
    ms = F.timestamp_diff("MILLISECOND", F.col("trigger_at"), F.col("created_at"))
    return tp.agg(F.count(F.lit(1)).alias("true_positives"), F.sum(ms).alias("total_latency_ms")).select(
        "true_positives",
        F.when(F.col("true_positives") == 0, F.lit(0).cast("long"))
        .otherwise(F.expr("total_latency_ms div true_positives"))
        .alias("avg_latency_ms"))


def misses(matched: DataFrame) -> DataFrame:
    """Unmatched expected (FN) and unmatched alerts (FP)."""
    return matched.where(F.col("outcome") != "TP")
