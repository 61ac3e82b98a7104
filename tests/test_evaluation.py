from pyspark.sql import functions as F

from flowwatch.config import DEFAULT_CYCLE, DEFAULT_RULES
from flowwatch.operators import alerts, evaluation, normalise
from flowwatch.plans import jobs
from flowwatch.schemas import EVENT_COLUMNS
from flowwatch.sources import scenario


def test_one_block_scores_as_rebuilt(spark):
    seeds = spark.createDataFrame([(7,)], "s_suppkey long")
    sc = scenario.scenario_transactions(seeds).cache()
    assert sc.count() == 325 and sc.where(F.col("kind") != "FUTURE").count() == 275
    expected = scenario.scenario_expected(sc)
    assert expected.count() == 45
    valid = normalise.validated(sc.select(*EVENT_COLUMNS))
    canon = alerts.canonical(jobs.all_alert_events(valid, DEFAULT_RULES, DEFAULT_CYCLE))
    m = evaluation.match(expected, canon)
    r = evaluation.metrics(m, sc).first()
    assert (r.tp, r.fp, r.fn) == (45, 20, 0)
    assert round(r.precision, 4) == 0.6923 and r.recall == 1.0
    assert round(r.f1, 4) == 0.8182 and round(r.fpr, 4) == 0.0870 and r.fnr == 0.0
    fps = {(x.rule_type) for x in evaluation.misses(m).collect()}
    assert fps == {"SHARED_DEVICE", "SHARED_IP"}          # the fan-in rows share one device and IP
    lat = evaluation.detection_latency(m).first()
    assert lat.avg_latency_ms == scenario.INGEST_LAG_MS
