"""C10 users, H1-H12: counters, histograms, windowed rates and alert rules.

Inputs are tidy tables: a scored table ``(us, amount, currency,
fraud_probability, risk_level, model_used, status, latency_ms)``, a request
log ``(us, method, path, status_code, duration_s)`` and optional gauge
samples ``(us, metric, labels, value)``.

Time series run on a 30 s evaluation grid: rows are first reduced to
(label set, 30 s bin) counts - a partial aggregate - and the trailing
windows then slide over bins, never over rows. A label set's series is
bounded by the time span / 30 s, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALERT_LEVELS, MODEL_BUCKETS_S, REQUEST_BUCKETS_S, SCORE_BUCKETS_S, STORE_BUCKETS_S
from ..functions import scalar
from ..functions.text import normalize_endpoint
from ..plans.chunked import prefix_aggregate

STEP_US = 30_000_000  # evaluation interval of the rule groups
STALE_US = 300_000_000  # age at which a gauge's last sample no longer counts


def _le_label(b: float) -> str:
    return repr(float(b))


# ---------------------------------------------------------------------------
# H1-H7: counters and histograms
# ---------------------------------------------------------------------------

def score_counters(scored: DataFrame) -> DataFrame:
    """H1: scores by (risk_level, model_used)."""
    return scored.groupBy("risk_level", "model_used").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """H2: cumulative ``le`` buckets (+Inf last), sum and count per label set.

    One aggregate pass with a conditional count per bound (partial
    aggregation, no join); rows are then unpivoted to (labels, le, count).
    """
    v = F.col(value)
    aggs = [F.count_if(v <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)]
    aggs += [F.count(F.lit(1)).alias("_count"), F.sum(v).alias("_sum")]
    g = df.groupBy(*by).agg(*aggs)
    items = [F.struct(F.lit(_le_label(b)).alias("le"), F.lit(i).alias("bucket"),
                      F.col(f"_b{i}").alias("cumulative_count")) for i, b in enumerate(bounds)]
    items.append(F.struct(F.lit("+Inf").alias("le"), F.lit(len(bounds)).alias("bucket"),
                          F.col("_count").alias("cumulative_count")))
    return g.select(*by, F.explode(F.array(*items)).alias("h"), F.col("_count").alias("count"),
                    F.col("_sum").alias("sum")).select(*by, "h.*", "count", "sum")


def latency_histogram(scored: DataFrame, bounds: Sequence[float] = SCORE_BUCKETS_S) -> DataFrame:
    """H2: score latency (seconds) histogram by model."""
    d = scored.withColumn("_lat_s", F.col("latency_ms") / 1000.0)
    return histogram(d, "_lat_s", bounds, ["model_used"])


def amount_totals(scored: DataFrame) -> DataFrame:
    """H3: sum of positive amounts by (currency, risk_level)."""
    return (scored.filter(F.col("amount") > 0).groupBy("currency", "risk_level")
            .agg(F.sum("amount").alias("amount_total")))


def minute_bins(df: DataFrame, width_us: int = 60_000_000) -> Column:
    return ((F.col("us") - F.pmod(F.col("us"), F.lit(width_us))) / F.lit(width_us)).cast("long")


def fraud_rate_running(scored: DataFrame, levels: Sequence[str] = ALERT_LEVELS) -> DataFrame:
    """H4: share of HIGH/CRITICAL scores so far, at the end of each minute.

    Rows reduce to per-minute counts first; the running sums then see one
    row per minute (bounded by the time span).
    """
    m = scored.groupBy(minute_bins(scored).alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk_level").isin(*levels)).alias("k"))
    # running sums over minutes via day chunks: no window sees all minutes
    m = m.withColumn("_t", F.col("minute") * F.lit(60_000_000))
    p = prefix_aggregate(m, [], "_t", [("total_so_far", F.col("n"), "sum"), ("alerts_so_far", F.col("k"), "sum")],
                         include_current=True)
    return p.select("minute", "total_so_far", "alerts_so_far",
                    (F.col("alerts_so_far") / F.col("total_so_far")).alias("fraud_rate"))


def alert_counters(scored: DataFrame, levels: Sequence[str] = ALERT_LEVELS,
                   high_value: float = 10000.0) -> DataFrame:
    """H5: alerts by level, and high-value alerts by currency, as one long
    table (counter, label, n)."""
    a = scored.filter(F.col("risk_level").isin(*levels))
    by_level = a.groupBy(F.col("risk_level").alias("label")).agg(F.count(F.lit(1)).alias("n")) \
                .withColumn("counter", F.lit("fraud_alerts_total"))
    by_cur = a.filter(F.col("amount") > high_value).groupBy(F.col("currency").alias("label")) \
              .agg(F.count(F.lit(1)).alias("n")).withColumn("counter", F.lit("high_value_fraud_total"))
    return by_level.unionByName(by_cur).select("counter", "label", "n")


def request_counters(requests: DataFrame) -> DataFrame:
    """H6: requests by (method, normalised endpoint, status); /metrics skipped."""
    r = requests.filter(F.col("path") != "/metrics").withColumn("endpoint", normalize_endpoint("path"))
    return r.groupBy("method", "endpoint", "status_code").agg(F.count(F.lit(1)).alias("n"))


def request_duration_histogram(requests: DataFrame,
                               bounds: Sequence[float] = REQUEST_BUCKETS_S) -> DataFrame:
    """H6: request duration histogram by (method, endpoint)."""
    r = requests.filter(F.col("path") != "/metrics").withColumn("endpoint", normalize_endpoint("path"))
    return histogram(r, "duration_s", bounds, ["method", "endpoint"])


def outcome_counters(outcomes: DataFrame, latency_for: Sequence[str] = ("model",)) -> DataFrame:
    """H7: count by (name, operation, status); success latency summed for
    the named components only."""
    ok = (F.col("status") == "success") & F.col("name").isin(*latency_for)
    return outcomes.groupBy("name", "operation", "status").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(ok, F.col("latency_s"))).alias("success_latency_s"))


def model_latency_histogram(predictions: DataFrame, bounds: Sequence[float] = MODEL_BUCKETS_S) -> DataFrame:
    """H7: latency (``latency_s``) of the predictions that succeeded, by model."""
    return histogram(predictions.where("status = 'success'"), "latency_s", bounds, ["model_version"])


def store_latency_histogram(operations: DataFrame, bounds: Sequence[float] = STORE_BUCKETS_S) -> DataFrame:
    """H7: latency of all feature-store operations, failed ones included, by operation."""
    return histogram(operations, "latency_s", bounds, ["operation"])


# ---------------------------------------------------------------------------
# Windowed series on the evaluation grid
# ---------------------------------------------------------------------------

def grid_index(us: Column, step_us: int = STEP_US) -> Column:
    """First grid point at or after ``us`` (an event at t counts at grid
    points g with t <= g < t + W)."""
    s = F.lit(step_us)
    x = us + F.lit(step_us - 1)
    return ((x - F.pmod(x, s)) / s).cast("long")


def windowed_sums(events: DataFrame, labels: Sequence[str], values: dict[str, Column],
                  window_us: int, step_us: int = STEP_US) -> DataFrame:
    """H8 core: per label set and grid time ``t``, the sums of ``values``
    over events in ``(t - W, t]``, at every grid time whose window holds at
    least one event (elsewhere every sum is 0).

    Rows reduce to (labels, 30 s bin) sums; each occupied bin is copied to
    the W / 30 s grid points that see it and summed again - two partial
    aggregates, no global ordering and no dense grid.
    Returns (labels..., t_us, value columns).
    """
    labels = list(labels)
    n = window_us // step_us
    b = events.withColumn("_k", grid_index(F.col("us"), step_us))
    binned = b.groupBy(*labels, "_k").agg(*[F.sum(v).alias(k) for k, v in values.items()])
    spread = binned.withColumn("_k", F.explode(F.sequence(F.col("_k"), F.col("_k") + (n - 1))))
    out = spread.groupBy(*labels, "_k").agg(*[F.sum(k).alias(k) for k in values])
    return out.select(*labels, (F.col("_k") * F.lit(step_us)).alias("t_us"), *values.keys())


def windowed_rate(events: DataFrame, labels: Sequence[str], window_us: int = 300_000_000,
                  step_us: int = STEP_US) -> DataFrame:
    """H8: ``increase`` (count in the window) and per-second ``rate``."""
    d = windowed_sums(events, labels, {"increase": F.lit(1).cast("long")}, window_us, step_us)
    return d.withColumn("rate", F.col("increase") / F.lit(window_us / 1e6))


def histogram_quantile_windowed(events: DataFrame, value: str, bounds: Sequence[float], q: float,
                                labels: Sequence[str], window_us: int = 300_000_000,
                                step_us: int = STEP_US) -> DataFrame:
    """H9: quantile of a bucketed histogram over a trailing window.

    The first bucket whose cumulative count reaches q * total is chosen;
    the value is linear inside it, the first bucket starts at 0, and the
    +Inf bucket returns the highest finite bound. Null when empty.
    """
    v = F.col(value)
    vals = {f"_c{i}": F.when(v <= F.lit(float(b)), 1).otherwise(0).cast("long") for i, b in enumerate(bounds)}
    vals["_total"] = F.lit(1).cast("long")
    d = windowed_sums(events, labels, vals, window_us, step_us)
    expr = quantile_of([F.col(f"_c{i}") for i in range(len(bounds))], F.col("_total"), bounds, q)
    return d.select(*labels, "t_us", F.when(F.col("_total") > 0, expr).alias("quantile"))


def quantile_of(counts: Sequence[Column], total: Column, bounds: Sequence[float], q: float) -> Column:
    """The quantile of cumulative bucket counts (H9)."""
    rank = F.lit(q) * total
    expr = None
    prev_b, prev_c = 0.0, F.lit(0).cast("long")
    for c, b in zip(counts, bounds):
        inside = F.lit(prev_b) + (F.lit(float(b)) - F.lit(prev_b)) * \
            F.try_divide((rank - prev_c).cast("double"), (c - prev_c).cast("double"))
        inside = F.coalesce(inside, F.lit(float(b)))
        expr = F.when(c >= rank, inside) if expr is None else expr.when(c >= rank, inside)
        prev_b, prev_c = float(b), c
    return expr.otherwise(F.lit(float(bounds[-1])))


def error_ratio(requests: DataFrame, window_us: int = 300_000_000, step_us: int = STEP_US) -> DataFrame:
    """5xx rate / total rate per normalised endpoint (ratio of sums per
    endpoint, not per full label set)."""
    r = requests.filter(F.col("path") != "/metrics").withColumn("endpoint", normalize_endpoint("path"))
    d = windowed_sums(r, ["endpoint"], {
        "errors": F.when(F.col("status_code").startswith("5"), 1).otherwise(0).cast("long"),
        "total": F.lit(1).cast("long")}, window_us, step_us)
    return d.withColumn("ratio", F.try_divide(F.col("errors").cast("double"), F.col("total")))


def alert_hold(series: DataFrame, labels: Sequence[str], cond: Column, hold_us: int,
               step_us: int = STEP_US) -> DataFrame:
    """Pending -> firing. At each grid time where ``cond`` holds, the
    alert is ``firing`` when it has held at every evaluation for at least
    ``hold_us``, else ``pending``. Rows where it does not hold are dropped;
    a missing grid point counts as not holding (its sums are 0).

    Gaps and islands: among the rows where the condition holds, grid index
    minus row number is constant along a run of consecutive evaluations.
    """
    labels = list(labels)
    d = series.filter(F.coalesce(cond, F.lit(False)))
    k = (F.col("t_us") / F.lit(step_us)).cast("long")
    w = Window.partitionBy(*labels).orderBy("t_us")
    d = d.withColumn("_run", k - F.row_number().over(w))
    d = d.withColumn("active_since_us", F.min("t_us").over(Window.partitionBy(*labels, "_run")))
    return (d.withColumn("state", F.when(F.col("t_us") - F.col("active_since_us") >= F.lit(hold_us), "firing")
                                   .otherwise("pending"))
             .drop("_run"))


# ---------------------------------------------------------------------------
# The twelve alert rules
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class AlertThresholds:
    """Rule thresholds; defaults are the reference's. Parameters so that a
    fixture can cross them."""
    fraud_rate: float = 0.01
    critical_rate_per_s: float = 10.0
    high_value_per_hour: float = 5.0
    p95_latency_s: float = 0.05
    request_rate_per_s: float = 1000.0
    error_ratio: float = 0.01
    prediction_error_rate_per_s: float = 0.1
    fallback_rate_per_s: float = 0.0
    store_errors: float = 10.0
    consumer_lag: float = 10000.0


MIN = 60_000_000

# FIXED VALUES: rule name, severity, category, hold time.
RULES = [
    ("HighFraudRate", "warning", "fraud", 5 * MIN),
    ("FraudSpike", "critical", "fraud", 2 * MIN),
    ("HighValueFraudDetected", "warning", "fraud", 1 * MIN),
    ("LatencySLABreach", "critical", "performance", 5 * MIN),
    ("HighRequestRate", "warning", "performance", 5 * MIN),
    ("ErrorRateSpike", "critical", "errors", 2 * MIN),
    ("CircuitBreakerOpen", "critical", "model", 1 * MIN),
    ("ModelPredictionFailures", "warning", "model", 5 * MIN),
    ("FallbackModeActive", "warning", "model", 5 * MIN),
    ("RedisConnectionIssues", "critical", "infrastructure", 2 * MIN),
    ("KafkaConsumerLag", "warning", "infrastructure", 5 * MIN),
    ("ServiceDown", "critical", "infrastructure", 1 * MIN),
]
RULE_META = {name: (sev, cat, hold) for name, sev, cat, hold in RULES}


def gauge_series(samples: DataFrame, metric: str, step_us: int = STEP_US,
                 stale_us: int = STALE_US) -> DataFrame:
    """Last sample value of a gauge at each grid point (per label set): the
    value of the latest sample that is less than ``stale_us`` old there."""
    s = samples.filter(F.col("metric") == metric)
    s = s.withColumn("_k", grid_index(F.col("us"), step_us))
    w = Window.partitionBy("labels", "_k").orderBy(F.desc("us"))
    last = s.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    after = F.lead("_k").over(Window.partitionBy("labels").orderBy("_k")) - 1
    # us + stale_us - 1 is the last time at which a sample counts; it does count at its own grid point
    old = F.greatest(scalar.idiv(F.col("us") + F.lit(stale_us - 1), step_us), F.col("_k"))
    last = last.withColumn("_to", F.least(after, old))
    return last.select("labels", F.explode(F.sequence("_k", "_to")).alias("_g"), F.col("value").cast("double")) \
        .select("labels", (F.col("_g") * F.lit(step_us)).alias("t_us"), "value")


# FIXED VALUES: gauge metric of each gauge rule.
GAUGES = {"CircuitBreakerOpen": "circuit_breaker_state", "RedisConnectionIssues": "feature_store_errors_total",
          "KafkaConsumerLag": "kafka_consumer_lag", "ServiceDown": "up"}


def _pairs(*names: str) -> Column:
    """A label set as name=value entries (a null value is a null entry)."""
    return F.array(*[F.concat(F.lit(c + "="), F.col(c).cast("string")) for c in names]).cast("array<string>")


def _by_rule(values: dict[str, Column]) -> Column:
    """CASE over the rule's name; null for rules without a value."""
    expr = None
    for name, v in values.items():
        hit = F.col("rule") == name
        expr = F.when(hit, v) if expr is None else expr.when(hit, v)
    return expr


def _rule_bins(rows: DataFrame, parts: Sequence[tuple[str, Column, Column, Column]], latency_s: Column | None,
               step_us: int) -> DataFrame:
    """(rule, l, k) sums of one input in one pass: each row is a member of the
    rules whose condition it meets (rule, condition, label set, numerator)."""
    member = [F.when(cond, F.struct(F.lit(name).alias("rule"), l.alias("l"), n.cast("long").alias("n")))
              for name, cond, l, n in parts]
    lat = (F.lit(None).cast("double") if latency_s is None else latency_s).alias("_lat")
    d = rows.where(F.col("us").isNotNull()).select(
        grid_index(F.col("us"), step_us).alias("k"), lat, F.explode(F.filter(F.array(*member), lambda m: m.isNotNull())).alias("m"))
    bucket = [F.count_if((F.col("m.rule") == "LatencySLABreach") & (F.col("_lat") <= float(b))).alias(f"c{i}")
              for i, b in enumerate(SCORE_BUCKETS_S)]
    return d.groupBy(F.col("m.rule").alias("rule"), F.col("m.l").alias("l"), "k").agg(
        F.sum("m.n").alias("n"), F.count(F.lit(1)).alias("m"), *bucket)


def _gauge_bins(samples: DataFrame, step_us: int, stale_us: int) -> DataFrame:
    """The last sample of each gauge rule's label set and bin, and the last
    grid point at which it counts (its own at least)."""
    rule = F.create_map(*[F.lit(x) for name, metric in GAUGES.items() for x in (metric, name)])[F.col("metric")]
    d = samples.where(F.col("us").isNotNull() & F.col("metric").isin(*GAUGES.values()))
    return d.groupBy(rule.alias("rule"), _pairs("labels").alias("l"), grid_index(F.col("us"), step_us).alias("k")).agg(
        F.max_by(F.col("value").cast("double"), F.struct("us", "value")).alias("v"), F.max("us").alias("_us")).select(
        "rule", "l", "k", "v", F.greatest(scalar.idiv(F.col("_us") + F.lit(stale_us - 1), step_us), F.col("k")).alias("to"))


def evaluate_alert_rules(scored: DataFrame, requests: DataFrame | None = None,
                         samples: DataFrame | None = None,
                         th: AlertThresholds = AlertThresholds(),
                         levels: Sequence[str] = ALERT_LEVELS, step_us: int = STEP_US,
                         stale_us: int = STALE_US) -> DataFrame:
    """Rule, labels, severity, category, t, value, state for every
    evaluation where a rule's condition holds.

    One pass per input: a row joins the partial sums of every rule it belongs
    to, keyed by (rule, label set, 30 s bin). A bin enters its rule's window
    at its own grid point and leaves it one window later, so running totals
    over these change points give a value that holds up to the next one; gauges
    hold their last sample. Conditions and hold times are decided on
    these stretches, which share one shuffle by (rule, label set), and only
    stretches that hold are spread over the grid. Rows and samples without a
    time take no part; of samples of one time the largest value counts.
    """
    five, hour = 5 * MIN, 60 * MIN
    alert, one = F.col("risk_level").isin(*levels), F.lit(1)
    bins = _rule_bins(scored, [
        ("HighFraudRate", F.lit(True), _pairs(), F.coalesce(alert, F.lit(False)).cast("long")),
        ("FraudSpike", F.col("risk_level") == "CRITICAL", _pairs("model_used"), one),
        ("HighValueFraudDetected", alert & (F.col("amount") > 10000.0), _pairs("currency"), one),
        ("LatencySLABreach", F.lit(True), _pairs("model_used"), one),
        ("ModelPredictionFailures", F.col("status") == "error", _pairs("model_used"), one),
        ("FallbackModeActive", F.col("model_used") == "rules_fallback", _pairs(), one),
    ], F.col("latency_ms") / 1000.0, step_us)
    if requests is not None:
        r = requests.where(F.col("path") != "/metrics").withColumn("endpoint", normalize_endpoint("path"))
        bins = bins.unionByName(_rule_bins(r, [
            ("HighRequestRate", F.lit(True), _pairs("method", "endpoint", "status_code"), one),
            ("ErrorRateSpike", F.lit(True), _pairs("endpoint"), F.coalesce(F.col("status_code").startswith("5"), F.lit(False)).cast("long")),
        ], None, step_us))

    # change points: a bin counts from its grid point on and, but for the running share, for one window
    sums = ["n", "m", *[f"c{i}" for i in range(len(SCORE_BUCKETS_S))]]
    window = F.when(F.col("rule") == "HighValueFraudDetected", hour).otherwise(five) / F.lit(step_us)
    leave = F.when(F.col("rule") != "HighFraudRate", F.struct((F.col("k") + window.cast("long")).alias("k"), F.lit(-1).alias("sign")))
    enter = F.struct(F.col("k").alias("k"), F.lit(1).alias("sign"))
    points = bins.select("rule", "l", F.explode(F.filter(F.array(enter, leave), lambda c: c.isNotNull())).alias("c"), *sums).select(
        "rule", "l", F.col("c.k").alias("k"), *[(F.col(c) * F.col("c.sign")).alias(c) for c in sums])
    if samples is not None:
        points = points.unionByName(_gauge_bins(samples, step_us, stale_us), allowMissingColumns=True)
    else:
        points = points.withColumns({"v": F.lit(None).cast("double"), "to": F.lit(None).cast("long")})

    series = Window.partitionBy("rule", "l").orderBy("k")
    so_far = series.rangeBetween(Window.unboundedPreceding, 0)
    d = points.select("rule", "l", "k", "v", "to", *[F.sum(c).over(so_far).alias(c) for c in sums], F.lead("k").over(series).alias("_next"))
    # the last point of a windowed series is where its last bin leaves; the running share ends with its last bin
    last = F.coalesce(F.col("to"), F.when(F.col("rule") == "HighFraudRate", F.col("k")).otherwise(F.col("k") - 1))
    d = d.withColumn("_end", F.when(F.col("_next").isNull(), last).otherwise(F.least(F.col("_next") - 1, F.col("to"))))

    rate, share = F.col("n") / F.lit(five / 1e6), F.try_divide(F.col("n").cast("double"), F.col("m"))
    p95 = quantile_of([F.col(c) for c in sums[2:]], F.col("m"), SCORE_BUCKETS_S, 0.95)
    value = F.when(F.col("m") > 0, _by_rule({
        "HighFraudRate": share, "FraudSpike": rate, "HighValueFraudDetected": F.col("n").cast("double"),
        "LatencySLABreach": p95, "HighRequestRate": rate, "ErrorRateSpike": share,
        "ModelPredictionFailures": rate, "FallbackModeActive": rate}))
    v = F.col("value")
    holds = _by_rule({
        "HighFraudRate": v > th.fraud_rate, "FraudSpike": v > th.critical_rate_per_s,
        "HighValueFraudDetected": v > th.high_value_per_hour, "LatencySLABreach": v > th.p95_latency_s,
        "HighRequestRate": v > th.request_rate_per_s, "ErrorRateSpike": v > th.error_ratio,
        "CircuitBreakerOpen": v == 1, "ModelPredictionFailures": v > th.prediction_error_rate_per_s,
        "FallbackModeActive": v > th.fallback_rate_per_s, "RedisConnectionIssues": v > th.store_errors,
        "KafkaConsumerLag": v > th.consumer_lag, "ServiceDown": v == 0})
    d = d.withColumn("value", F.coalesce("v", value)).where((F.col("k") <= F.col("_end")) & holds)

    # runs of stretches that follow one another without a gap
    starts = F.when(F.coalesce(F.lag("_end").over(series) + 1 != F.col("k"), F.lit(True)), F.col("k"))
    d = d.withColumn("_start", starts).withColumn(
        "_since", F.last("_start", ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.select("rule", "l", "value", "_since", F.explode(F.sequence("k", "_end")).alias("_g"))
    hold = _by_rule({name: F.lit(h) for name, _, _, h in RULES})
    return d.select(
        "rule", F.concat_ws(",", "l").alias("labels"), _by_rule({name: F.lit(x) for name, x, _, _ in RULES}).alias("severity"),
        _by_rule({name: F.lit(x) for name, _, x, _ in RULES}).alias("category"), (F.col("_g") * F.lit(step_us)).alias("t_us"), "value",
        F.when((F.col("_g") - F.col("_since")) * F.lit(step_us) >= hold, "firing").otherwise("pending").alias("state"))
