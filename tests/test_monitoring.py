"""Gauge alert rules on literal metric samples (30 s apart): a run shorter
than the hold time stays pending, a longer one fires."""

from pyspark.sql import functions as F

from riskstream.operators import monitoring as mon
from riskstream.sources import fixtures as fx

from .conftest import SF_ORACLE, SF_SMALL

S = 30_000_000
T0 = 1704067200000000


def test_gauge_rules_hold(spark):
    # breaker open for 3 samples (60 s, fires at the hold of 1 m), then closed,
    # then open for 1 sample only (pending)
    vals = [0, 1, 1, 1, 0, 1, 0]
    rows = [(T0 + i * S, "circuit_breaker_state", "service=model", float(v)) for i, v in enumerate(vals)]
    rows += [(T0 + i * S, "up", "job=inference", 1.0 if i != 3 else 0.0) for i in range(len(vals))]
    samples = spark.createDataFrame(rows, "us long, metric string, labels string, value double")
    scored = fx.scored(spark, SF_SMALL)
    out = mon.evaluate_alert_rules(scored, None, samples)
    cb = {(r["t_us"] - T0) // S: r["state"] for r in out.filter(F.col("rule") == "CircuitBreakerOpen").collect()}
    assert cb == {1: "pending", 2: "pending", 3: "firing", 5: "pending"}
    down = [r["state"] for r in out.filter(F.col("rule") == "ServiceDown").collect()]
    assert down == ["pending"]


def test_windowed_rate_counts(spark):
    ev = spark.createDataFrame([(T0 + 1,), (T0 + 2 * S,), (T0 + 20 * S,)], "us long")
    r = {x["t_us"]: x["increase"] for x in mon.windowed_rate(ev, [], 5 * 60_000_000).collect()}
    # an event at t counts at grid points g with t <= g < t + 5 m
    assert r[T0 + S] == 1 and r[T0 + 2 * S] == 2 and r[T0 + 11 * S] == 1 and (T0 + 12 * S) not in r


def test_gauges_sampled_each_minute_hold(spark):
    """Samples 60 s apart hold over the 30 s grid and end 5 minutes after the last."""
    bad = {"circuit_breaker_state": 1.0, "feature_store_errors_total": 11.0, "kafka_consumer_lag": 10001.0, "up": 0.0}
    rows = [(T0 + 2 * i * S, m, "x=1", v) for m, v in bad.items() for i in range(7)]
    samples = spark.createDataFrame(rows, "us long, metric string, labels string, value double")
    g = sorted((r["t_us"] - T0) // S for r in mon.gauge_series(samples, "up").collect())
    assert g == list(range(12 + 10))
    scored = fx.scored(spark, SF_ORACLE)
    th = mon.AlertThresholds(critical_rate_per_s=0.0, high_value_per_hour=0.0, p95_latency_s=0.0, request_rate_per_s=0.0,
                             prediction_error_rate_per_s=0.0, error_ratio=0.0)
    out = mon.evaluate_alert_rules(scored, fx.requests(spark, SF_ORACLE), samples, th).cache()
    gauges = out.filter(F.col("labels") == "labels=x=1").groupBy("rule").agg(F.max("state").alias("s"), F.min("state").alias("f")).collect()
    assert {r["rule"] for r in gauges} == {"CircuitBreakerOpen", "RedisConnectionIssues", "KafkaConsumerLag", "ServiceDown"}
    assert {r["f"] for r in gauges} == {"firing"}
    assert {r["rule"] for r in out.select("rule").distinct().collect()} == {name for name, *_ in mon.RULES}


def test_edge_rows_and_label_sets(spark):
    """Rows without a time, label or latency, labels that hold separators and
    empty inputs; an hour's window of one alert is one stretch."""
    schema = "us long, amount double, currency string, risk_level string, model_used string, status string, latency_ms double"
    rows = [(T0, 20000.0, "EUR", "CRITICAL", None, "success", None), (None, 20000.0, "EUR", "CRITICAL", "gbt", "error", 900.0),
            (T0 + S, 1.0, None, None, "a,model_used=b", "error", 900.0)]
    scored = spark.createDataFrame(rows, schema)
    th = mon.AlertThresholds(critical_rate_per_s=0.0, high_value_per_hour=0.0, prediction_error_rate_per_s=0.0)
    out = mon.evaluate_alert_rules(scored, th=th).collect()
    by = {}
    for r in out:
        by.setdefault((r["rule"], r["labels"]), []).append(((r["t_us"] - T0) // S, r["value"], r["state"]))
    by = {k: sorted(v) for k, v in by.items()}
    assert by["HighFraudRate", ""] == [(0, 1.0, "pending"), (1, 0.5, "pending")]
    assert [g for g, *_ in by["HighValueFraudDetected", "currency=EUR"]] == list(range(120))
    assert [s for *_, s in by["HighValueFraudDetected", "currency=EUR"]] == ["pending"] * 2 + ["firing"] * 118
    assert [g for g, *_ in by["FraudSpike", ""]] == list(range(10))
    assert [g for g, *_ in by["ModelPredictionFailures", "model_used=a,model_used=b"]] == list(range(1, 11))
    none = spark.createDataFrame([], "us long, metric string, labels string, value double")
    assert mon.evaluate_alert_rules(scored.limit(0), samples=none).count() == 0


def test_rules_read_each_input_once(spark):
    from riskstream.plans.queries import QUERIES
    plan = QUERIES["evaluate_alert_rules"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3 and plan.count("Exchange") <= 4
    rules = QUERIES["evaluate_alert_rules"](spark, SF_ORACLE).select("rule").distinct().collect()
    assert {r["rule"] for r in rules} == {name for name, *_ in mon.RULES}
