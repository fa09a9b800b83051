"""

Each entry is ``(spark, sf_dir) -> DataFrame`` over the driver tables (or
data Spark derives from them). Published doubles are rounded to 6 decimals,
arrays are joined to strings, times are epoch microseconds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import scoring
from ..operators.rules import Rule, default_rules
from ..session import scratch_path, written
from ..sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _join(c: str) -> F.Column:
    return F.array_join(F.col(c), ",")


@query("rule_score")
def q_rule_score(spark: SparkSession, sf: str) -> DataFrame:
    s = scoring.rule_score(fx.txn(spark, sf))
    return s.select("transaction_id", "user_id", "us", r6("fraud_probability").alias("fraud_probability"),
                    "risk_level", _join("risk_factors").alias("risk_factors"), "model_used",
                    "model_version")


#: Rules a user adds to the registry's own.
EXTRA_RULES = [Rule("payout_hours", (
    (lambda: (F.col("amount") > 2000) & F.col("hour_of_day").between(0, 5), 1.0, "LARGE_AT_NIGHT"),
    (lambda: F.col("amount") > 2000, 0.5, "LARGE_AMOUNT"))), Rule("first_seen", (
    (lambda: F.coalesce(F.col("user_txn_count_total"), F.lit(0)) == 0, 0.2, "NEW_USER"),))]


@query("rule_score_extended")
def q_rule_score_extended(spark: SparkSession, sf: str) -> DataFrame:
    """The default rules and two appended ones, averaged over seven."""
    s = scoring.rule_score(fx.txn(spark, sf), rules=[*default_rules(), *EXTRA_RULES])
    return s.select("transaction_id", "user_id", "us", r6("fraud_probability").alias("fraud_probability"),
                    "risk_level", _join("risk_factors").alias("risk_factors"))


# ---------------------------------------------------------------------------
# B: validation
# ---------------------------------------------------------------------------
from dataclasses import replace as _replace  # noqa: E402

from pyspark.sql import Window  # noqa: E402

from ..config import DEFAULT, FEATURE_ORDER, TRAIN_NUMERIC_FEATURES, TrainConfig  # noqa: E402
from ..functions import geo, scalar, text  # noqa: E402
from ..operators import evaluation, history, rules as rules_mod, validate  # noqa: E402


def _err_str(c: str = "errors") -> F.Column:
    return F.array_join(F.transform(F.col(c), lambda e: F.concat(e["field"], F.lit(":"), e["type"])), ";")


@query("validate_txn")
def q_validate(spark, sf):
    d = validate.with_errors(fx.txn_raw(spark, sf))
    return d.select("transaction_id", (F.size("errors") == 0).alias("is_valid"),
                    _err_str().alias("errors"))


@query("normalize_txn")
def q_normalize(spark, sf):
    valid, _ = validate.validate_txn(fx.txn_raw(spark, sf))
    n = validate.normalize_txn(valid, now_us=1735689600000000)
    return n.select("transaction_id", "us", "currency", "channel",
                    F.col("location.latitude").alias("latitude"),
                    F.col("location.longitude").alias("longitude"))


@query("validation_summary")
def q_validation_summary(spark, sf):
    _, rej = validate.validate_txn(fx.txn_raw(spark, sf))
    return validate.validation_summary(rej)


@query("batch_outcome")
def q_batch_outcome(spark, sf):
    s = fx.scored(spark, sf).withColumn("batch_id", scalar.idiv("event_id", 100))
    return validate.batch_outcome(s)


# ---------------------------------------------------------------------------
# C: scalar functions over table rows
# ---------------------------------------------------------------------------
LONDON = (51.5074, -0.1278)


def _geo_base(spark, sf):
    t = fx.txn(spark, sf)
    km = geo.haversine_km("latitude", "longitude", F.lit(LONDON[0]), F.lit(LONDON[1]))
    dt = (F.pmod(F.col("us"), F.lit(7200000000)) - F.lit(3600000000)) / 1e6
    return t.select("transaction_id", km.alias("km"), dt.alias("dt"))


@query("haversine_km")
def q_haversine(spark, sf):
    return _geo_base(spark, sf).select("transaction_id", r6("km").alias("km"))


@query("travel_speed_kmh")
def q_speed(spark, sf):
    b = _geo_base(spark, sf)
    return b.select("transaction_id", r6(geo.travel_speed_kmh("km", "dt")).alias("speed_kmh"))


@query("impossible_travel")
def q_impossible(spark, sf):
    b = _geo_base(spark, sf)
    return b.select("transaction_id", geo.impossible_travel("km", "dt").alias("impossible"))


@query("amount_log")
def q_amount_log(spark, sf):
    t = fx.txn(spark, sf)
    return t.select("transaction_id", r6(scalar.amount_log("amount")).alias("amount_log"))


@query("temporal_features")
def q_temporal(spark, sf):
    t = fx.txn(spark, sf)
    tf = scalar.temporal_features("us")
    return t.select("transaction_id", tf["hour_of_day"].alias("hour_of_day"),
                    tf["day_of_week"].alias("day_of_week"), tf["is_weekend"].alias("is_weekend"))


@query("amount_zscore")
def q_zscore(spark, sf):
    t = fx.txn(spark, sf)
    std = (F.pmod(F.col("us"), F.lit(3)) * 100).cast("double")
    return t.select("transaction_id", r6(scalar.amount_zscore("amount", F.lit(500.0), std)).alias("z"))


@query("velocity_score")
def q_velocity_score(spark, sf):
    v = history.velocity_windows(fx.txn(spark, sf, dense=True))
    return v.select("transaction_id",
                    r6(scalar.velocity_score("txn_count_1h", "txn_count_24h")).alias("velocity_score"))


@query("risk_level")
def q_risk_level(spark, sf):
    s = fx.scored(spark, sf)
    return s.select("event_id", scalar.risk_level("fraud_probability").alias("level"))


@query("model_risk_factors")
def q_model_factors(spark, sf):
    f = history.point_in_time_features(fx.txn(spark, sf, dense=True), scores=fx.txn_scores(spark, sf))
    return f.select("transaction_id", F.array_join(text.model_risk_factors(), ",").alias("factors"))


@query("normalize_endpoint")
def q_normalize_endpoint(spark, sf):
    r = fx.requests(spark, sf)
    return r.select("event_id", text.normalize_endpoint("path").alias("endpoint"))


@query("feature_vector")
def q_feature_vector(spark, sf):
    f = history.point_in_time_features(fx.txn(spark, sf))
    v = f.select("transaction_id", scalar.feature_vector().alias("v"))
    e = v.select("transaction_id", F.posexplode("v").alias("pos", "x"))
    return e.select("transaction_id", F.col("pos").cast("int").alias("pos"),
                    r6(F.col("x").cast("double")).alias("x"))


@query("alert_report_row")
def q_alert_report(spark, sf):
    s = scoring.rule_score(fx.txn(spark, sf))
    return s.select("transaction_id", text.short_id("transaction_id").alias("short_id"),
                    text.probability_pct("fraud_probability").alias("probability"),
                    F.array_join(text.factors_display("risk_factors"), ", ").alias("factors"))


# ---------------------------------------------------------------------------
# D: history features
# ---------------------------------------------------------------------------
def _last_out(d):
    return d.select("transaction_id", r6("time_since_last_txn_seconds").alias("time_since_last_txn_seconds"),
                    r6("distance_from_last_txn_km").alias("distance_from_last_txn_km"),
                    r6("travel_speed_kmh").alias("travel_speed_kmh"), "is_impossible_travel")


@query("last_txn_features")
def q_last_txn(spark, sf):
    return _last_out(history.last_txn_features(fx.txn(spark, sf)))


@query("asof_last_txn")
def q_asof(spark, sf):
    req = fx.txn(spark, sf, dense=True)
    hist = fx.txn(spark, sf)
    return _last_out(history.asof_last_txn(req, hist))


def _vel_out(d):
    return d.select("transaction_id", "txn_count_1h", "txn_count_24h", "txn_count_7d",
                    r6("total_amount_24h").alias("total_amount_24h"))


@query("velocity_windows")
def q_velocity(spark, sf):
    return _vel_out(history.velocity_windows(fx.txn(spark, sf, dense=True)))


@query("velocity_windows_ttl")
def q_velocity_ttl(spark, sf):
    return _vel_out(history.velocity_windows_ttl(fx.txn(spark, sf, dense=True)))


@query("user_profile_running")
def q_profile(spark, sf):
    d = history.user_profile_running(fx.txn(spark, sf))
    return d.select("transaction_id", "user_txn_count_total", r6("user_avg_amount").alias("user_avg_amount"),
                    r6("user_std_amount").alias("user_std_amount"), "first_seen_us", "last_seen_us")


@query("user_profile_snapshot")
def q_profile_snapshot(spark, sf):
    d = history.user_profile_snapshot(fx.txn(spark, sf), scores=fx.txn_scores(spark, sf))
    return d.select("user_id", "txn_count_total", r6("avg_amount").alias("avg_amount"),
                    r6("std_amount").alias("std_amount"), "first_seen_us", "last_seen_us", "fraud_count")


@query("rolling_rows_features")
def q_rolling(spark, sf):
    return _vel_out(history.rolling_rows_features(fx.txn(spark, sf)))


@query("user_stats_join")
def q_user_stats(spark, sf):
    d = history.user_stats_join(fx.txn(spark, sf))
    return d.select("transaction_id", r6("user_avg_amount").alias("user_avg_amount"),
                    r6("user_std_amount").alias("user_std_amount"), "user_txn_count",
                    r6("amount_zscore").alias("amount_zscore"))


@query("consecutive_travel")
def q_consecutive(spark, sf):
    d = history.consecutive_travel(fx.txn(spark, sf))
    return d.select("transaction_id", r6("distance_from_last").alias("distance_from_last"),
                    r6("time_since_last_txn").alias("time_since_last_txn"),
                    r6("travel_speed").alias("travel_speed"), "is_impossible_travel")


@query("merchant_risk_join")
def q_merchant_join(spark, sf):
    d = history.merchant_risk_join(fx.txn(spark, sf))
    return d.select("transaction_id", r6("merchant_risk_score").alias("merchant_risk_score"))


@query("merchant_risk_prior")
def q_merchant_prior(spark, sf):
    d = history.merchant_risk_prior(fx.txn(spark, sf))
    return d.select("transaction_id", r6("merchant_risk_score").alias("merchant_risk_score"))


@query("user_fraud_history")
def q_user_fraud(spark, sf):
    d = history.user_fraud_history(fx.txn(spark, sf))
    return d.select("transaction_id", "user_fraud_history")


@query("user_fraud_history_scored")
def q_user_fraud_scored(spark, sf):
    s = fx.scored(spark, sf)
    d = history.user_fraud_history_scored(s, id_col="event_id")
    return d.select("event_id", "user_fraud_history_count")


@query("merchant_txn_count_24h")
def q_merchant_count(spark, sf):
    d = history.merchant_txn_count_24h(fx.txn(spark, sf, dense=True))
    return d.select("transaction_id", "merchant_txn_count_24h")


D10_OUT = ["amount", "amount_log", "amount_zscore", "hour_of_day", "day_of_week", "is_weekend",
           "time_since_last_txn_seconds", "txn_count_1h", "txn_count_24h", "txn_count_7d",
           "total_amount_24h", "distance_from_last_txn_km", "travel_speed_kmh", "is_impossible_travel",
           "user_avg_amount", "user_std_amount", "user_txn_count_total", "user_fraud_history_count",
           "merchant_risk_score", "merchant_txn_count_24h", "velocity_score"]
_DOUBLES = {"amount", "amount_log", "amount_zscore", "time_since_last_txn_seconds", "total_amount_24h",
            "distance_from_last_txn_km", "travel_speed_kmh", "user_avg_amount", "user_std_amount",
            "merchant_risk_score", "velocity_score"}


def _d10_out(d):
    return d.select("transaction_id", *[r6(c).alias(c) if c in _DOUBLES else F.col(c) for c in D10_OUT])


@query("point_in_time_features")
def q_pit(spark, sf):
    t = fx.txn(spark, sf, dense=True)
    return _d10_out(history.point_in_time_features(t, scores=fx.txn_scores(spark, sf)))


D11_OUT = ["amount", "amount_log", "hour_of_day", "day_of_week", "is_weekend", "user_avg_amount",
           "user_std_amount", "user_txn_count", "amount_zscore", "txn_count_1h", "txn_count_24h",
           "txn_count_7d", "total_amount_24h", "velocity_score", "distance_from_last", "time_since_last_txn",
           "travel_speed", "is_impossible_travel", "merchant_risk_score", "user_fraud_history"]
_D11_DOUBLES = {"amount", "amount_log", "user_avg_amount", "user_std_amount", "amount_zscore",
                "total_amount_24h", "velocity_score", "distance_from_last", "time_since_last_txn",
                "travel_speed", "merchant_risk_score"}


@query("training_features")
def q_training_features(spark, sf):
    d = history.training_features(fx.txn(spark, sf))
    return d.select("transaction_id", *[r6(c).alias(c) if c in _D11_DOUBLES else F.col(c) for c in D11_OUT])


# ---------------------------------------------------------------------------
# E: rules and scoring
# ---------------------------------------------------------------------------
def _rule_query(idx: int):
    def q(spark, sf):
        f = scoring.rule_features(fx.txn(spark, sf))
        r = rules_mod.default_rules()[idx]
        return f.select("transaction_id", r.score().alias("score"), r.factor().alias("factor"))
    return q


for _i, _n in enumerate(["rule_amount_velocity", "rule_impossible_travel", "rule_time_pattern",
                         "rule_frequency", "rule_amount_anomaly"]):
    QUERIES[_n] = _rule_query(_i)


def _model_fixture(d):
    """A stand-in model output read from the rows: null (model failed) for
    every third transaction, else a spread of probabilities."""
    k = F.col("transaction_id").substr(5, 100).cast("bigint")
    return d.withColumn("model_probability",
                        F.when(k % 3 == 0, F.lit(None).cast("double"))
                         .otherwise(((k * 37) % 1000).cast("double") / 1000))


def _score_out(s):
    return s.select("transaction_id", r6("fraud_probability").alias("fraud_probability"), "risk_level",
                    _join("risk_factors").alias("risk_factors"), "model_used", "model_version",
                    F.col("features_used").cast("int").alias("features_used"))


@query("hybrid_score")
def q_hybrid(spark, sf):
    f = _model_fixture(history.point_in_time_features(fx.txn(spark, sf, dense=True)))
    return _score_out(scoring.hybrid_score(f))


@query("score_batch")
def q_score_batch(spark, sf):
    return _score_out(scoring.score_batch(fx.txn(spark, sf)))


# ---------------------------------------------------------------------------
# A: sources / lookups
# ---------------------------------------------------------------------------
@query("class_distribution")
def q_class_dist(spark, sf):
    return evaluation.class_distribution(fx.txn(spark, sf)) \
        .select("is_fraud", "n_rows", "total_rows", "positives", r6("fraud_rate").alias("fraud_rate"))


@query("profile_lookup")
def q_profile_lookup(spark, sf):
    from ..operators.lookup import profile_lookup
    req = fx.table(spark, sf, "customer").select(
        F.concat(F.lit("USER_"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("user_id"))
    prof = history.user_profile_snapshot(fx.txn(spark, sf), scores=fx.txn_scores(spark, sf))
    out = profile_lookup(req.distinct(), prof)
    return out.select("user_id", "found", r6("avg_amount").alias("avg_amount"),
                      r6("std_amount").alias("std_amount"), "txn_count_total", "fraud_count")


# ---------------------------------------------------------------------------
# Evaluation over the scored view
# ---------------------------------------------------------------------------
def _eval_in(spark, sf):
    return fx.scored(spark, sf).select("label", F.col("fraud_probability").alias("score"))


@query("confusion_matrix")
def q_confusion(spark, sf):
    return evaluation.confusion_matrix(_eval_in(spark, sf))


@query("classification_report")
def q_report(spark, sf):
    r = evaluation.classification_report(_eval_in(spark, sf))
    return r.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1_score").alias("f1_score"), "support")


@query("roc_curve")
def q_roc(spark, sf):
    c = evaluation.roc_curve(_eval_in(spark, sf))
    return c.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("roc_auc")
def q_roc_auc(spark, sf):
    return evaluation.roc_auc(_eval_in(spark, sf)).select(r6("roc_auc").alias("roc_auc"))


@query("pr_curve")
def q_pr(spark, sf):
    c = evaluation.pr_curve(_eval_in(spark, sf))
    return c.select("threshold", r6("precision").alias("precision"),
                    r6("recall").alias("recall"))


@query("pr_auc")
def q_pr_auc(spark, sf):
    return evaluation.pr_auc(_eval_in(spark, sf)).select(r6("pr_auc").alias("pr_auc"))


# ---------------------------------------------------------------------------
# H: monitoring analytics over the scored view and the request log
# ---------------------------------------------------------------------------
from ..operators import feed, monitoring as mon  # noqa: E402

W5 = 300_000_000


@query("score_counters")
def q_score_counters(spark, sf):
    return mon.score_counters(fx.scored(spark, sf))


@query("latency_histogram")
def q_latency_hist(spark, sf):
    h = mon.latency_histogram(fx.scored(spark, sf))
    return h.select("model_used", "le", "bucket", "cumulative_count", "count", r6("sum").alias("sum"))


@query("amount_totals")
def q_amount_totals(spark, sf):
    a = mon.amount_totals(fx.scored(spark, sf))
    return a.select("currency", "risk_level", r6("amount_total").alias("amount_total"))


@query("fraud_rate_running")
def q_fraud_rate_running(spark, sf):
    d = mon.fraud_rate_running(fx.scored(spark, sf))
    return d.select("minute", "total_so_far", "alerts_so_far", r6("fraud_rate").alias("fraud_rate"))


@query("alert_counters")
def q_alert_counters(spark, sf):
    return mon.alert_counters(fx.scored(spark, sf))


@query("request_counters")
def q_request_counters(spark, sf):
    return mon.request_counters(fx.requests(spark, sf))


@query("request_duration_histogram")
def q_request_hist(spark, sf):
    h = mon.request_duration_histogram(fx.requests(spark, sf))
    return h.select("method", "endpoint", "le", "bucket", "cumulative_count", "count", r6("sum").alias("sum"))


def _outcomes(spark, sf):
    s = fx.scored(spark, sf)
    return s.select(F.when(F.col("model_used") == "gbt", "model").otherwise("rules").alias("name"),
                    F.lit("predict").alias("operation"), "status",
                    (F.col("latency_ms") / 1000.0).alias("latency_s"))


@query("outcome_counters")
def q_outcomes(spark, sf):
    o = mon.outcome_counters(_outcomes(spark, sf))
    return o.select("name", "operation", "status", "n", r6("success_latency_s").alias("success_latency_s"))


_HIST = ["le", "bucket", "cumulative_count", "count"]


@query("model_latency_histogram")
def q_model_latency(spark, sf):
    s = fx.scored(spark, sf).select(F.col("model_used").alias("model_version"), "status", (F.col("latency_ms") / 1000.0).alias("latency_s"))
    return mon.model_latency_histogram(s).select("model_version", *_HIST, r6("sum").alias("sum"))


@query("store_latency_histogram")
def q_store_latency(spark, sf):
    """Each scored event reads the profile, every third one writes it."""
    op = F.when(F.col("event_id") % 3 == 0, "update_profile").otherwise("get_features")
    s = fx.scored(spark, sf).select(op.alias("operation"), "status", (F.col("latency_ms") / 1000.0).alias("latency_s"))
    return mon.store_latency_histogram(s).select("operation", *_HIST, r6("sum").alias("sum"))


@query("windowed_rate")
def q_windowed_rate(spark, sf):
    d = mon.windowed_rate(fx.scored(spark, sf), ["risk_level"], W5)
    return d.select("risk_level", "t_us", "increase", r6("rate").alias("rate"))


@query("histogram_quantile")
def q_hist_quantile(spark, sf):
    s = fx.scored(spark, sf).withColumn("lat_s", F.col("latency_ms") / 1000.0)
    d = mon.histogram_quantile_windowed(s, "lat_s", mon.SCORE_BUCKETS_S, 0.95, ["model_used"], W5)
    return d.select("model_used", "t_us", r6("quantile").alias("quantile"))


@query("error_ratio")
def q_error_ratio(spark, sf):
    d = mon.error_ratio(fx.requests(spark, sf), W5)
    return d.select("endpoint", "t_us", "errors", "total", r6("ratio").alias("ratio"))


@query("alert_hold")
def q_alert_hold(spark, sf):
    d = mon.windowed_rate(fx.scored(spark, sf), ["risk_level"], W5)
    h = mon.alert_hold(d, ["risk_level"], F.col("increase") >= 1, 2 * 60_000_000)
    return h.select("risk_level", "t_us", "increase", "active_since_us", "state")


ALERT_TH = mon.AlertThresholds(critical_rate_per_s=0.003, high_value_per_hour=0.0, request_rate_per_s=0.003,
                               prediction_error_rate_per_s=0.003)


@query("evaluate_alert_rules")
def q_alert_rules(spark, sf):
    d = mon.evaluate_alert_rules(fx.scored(spark, sf), fx.requests(spark, sf), fx.samples(spark, sf), th=ALERT_TH)
    return d.select("rule", "labels", "severity", "category", "t_us", r6("value").alias("value"), "state")


# ---------------------------------------------------------------------------
# I: alert feed
# ---------------------------------------------------------------------------
AS_OF_US = 1706659200000000  # 2024-01-31 00:00:00 UTC, the "now" of the feed


def _alerts(spark, sf):
    return fx.scored(spark, sf).filter(F.col("risk_level").isin("HIGH", "CRITICAL"))


@query("dashboard_stats")
def q_dashboard(spark, sf):
    d = feed.dashboard_stats(fx.scored(spark, sf), AS_OF_US)
    return d.select("total_transactions", "fraud_detected", r6("fraud_rate").alias("fraud_rate"),
                    r6("avg_latency_ms").alias("avg_latency_ms"), "alerts_last_hour",
                    r6("total_amount_blocked").alias("total_amount_blocked"))


@query("alert_history")
def q_alert_history(spark, sf):
    h = feed.alert_history(_alerts(spark, sf), 100)
    return h.select("event_id", "us", "risk_level", "position")


def _subscriptions(spark, sf):
    """Subscribers are customers; a market segment picks the levels watched."""
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    lv = F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), F.array(F.lit("CRITICAL"))) \
          .otherwise(F.array(F.lit("HIGH"), F.lit("CRITICAL")))
    return c.select(F.col("c_custkey").alias("subscriber"), F.explode(lv).alias("level"))


@query("route_alerts")
def q_route(spark, sf):
    r = feed.route_alerts(_alerts(spark, sf), _subscriptions(spark, sf))
    return r.select("event_id", "room", "subscribers")


@query("risk_distribution")
def q_risk_dist(spark, sf):
    return feed.risk_distribution(scoring.rule_score(fx.txn(spark, sf)))


@query("recent_alerts")
def q_recent(spark, sf):
    s = scoring.rule_score(fx.txn(spark, sf, dense=True))
    return feed.recent_alerts(s, ["MEDIUM"], 10)


@query("rate_status")
def q_rate_status(spark, sf):
    s = fx.scored(spark, sf).withColumn("day", scalar.idiv("us", 86_400_000_000))
    r = s.groupBy("day").agg(
        F.try_divide(F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL") & (F.col("label") == 1))
                     .cast("double"), F.count(F.lit(1))).alias("fraud_rate"))
    return feed.rate_status(r).select("day", r6("fraud_rate").alias("fraud_rate"), "status")


# ---------------------------------------------------------------------------
# G: preparation, oversampling, training
# ---------------------------------------------------------------------------
from ..config import TRAIN_CATEGORICAL_FEATURES, TRAIN_NUMERIC_FEATURES  # noqa: E402
from ..operators import boosting, prep, smote as smote_mod, training  # noqa: E402
from .sample_model import SAMPLE_MODEL, STREAM_MODEL  # noqa: E402

BOOST_ROUNDS = 5      # of the registered query; BoostParams has the full setting


def _txn_key():
    return F.col("transaction_id").substr(5, 100).cast("bigint")


@query("select_available_features")
def q_select_features(spark, sf):
    """G1: the declared features present in the table, with their non-null
    counts over the whole table (one aggregate pass, unpivoted)."""
    d = history.training_features(fx.txn(spark, sf).drop("country"))
    num, cat = prep.select_available_features(d)
    items = [(c, "numeric", i) for i, c in enumerate(num)] + [(c, "categorical", i) for i, c in enumerate(cat)]
    agg = d.agg(*[F.count(F.col(c)).alias(f"n{j}") for j, (c, _, _) in enumerate(items)])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(k).alias("kind"), F.lit(i).alias("position"),
                 F.col(f"n{j}").alias("n_non_null")) for j, (c, k, i) in enumerate(items)])).alias("f")) \
        .select("f.*")


@query("impute_median")
def q_impute_median(spark, sf):
    """All training columns, a ninth of whose values (by transaction number
    and column) are taken out and imputed again."""
    d = history.training_features(fx.txn(spark, sf))
    cols = TRAIN_NUMERIC_FEATURES
    gone = written(d.select("transaction_id", *[F.when((_txn_key() + i) % 9 != 0, F.col(c).cast("double")).alias(c)
                                                for i, c in enumerate(cols)]), "impute")
    out = prep.impute_median(gone, prep.fit_medians(gone, cols))
    return out.select("transaction_id", *[r6(c).alias(c) for c in cols])


@query("standard_scale")
def q_standard_scale(spark, sf):
    """All training columns."""
    cols = TRAIN_NUMERIC_FEATURES
    t = written(history.training_features(fx.txn(spark, sf)).select("transaction_id", *cols), "scale")
    s = prep.standard_scale(t, prep.fit_scaler(t, cols))
    return s.select("transaction_id", *[r6(c).alias(c) for c in cols])


@query("one_hot")
def q_one_hot(spark, sf):
    cats = prep.fit_categories(fx.txn(spark, sf), ["currency", "merchant_category", "channel"])
    o = prep.one_hot(fx.txn_raw(spark, sf), cats)
    return o.select("transaction_id", *[F.array_join(F.col(f"{c}_onehot").cast("array<string>"), "").alias(c)
                                        for c in cats])


@query("one_hot_training")
def q_one_hot_training(spark, sf):
    """All categorical training columns of the valid rows, country included."""
    t = fx.txn(spark, sf)
    cats = prep.fit_categories(t, TRAIN_CATEGORICAL_FEATURES)
    return prep.one_hot(t, cats).select("transaction_id", *[
        F.array_join(F.col(f"{c}_onehot").cast("array<string>"), "").alias(c) for c in cats])


@query("category_index")
def q_category_index(spark, sf):
    """The place of each row's user among all users, too many for literals."""
    return prep.category_index(fx.txn(spark, sf), "user_id").select("transaction_id", "user_id_index")


@query("stratified_split")
def q_split(spark, sf):
    d = prep.stratified_split(fx.txn(spark, sf), "is_fraud", _txn_key(), [("test", 0.2), ("validation", 0.1)])
    return d.select("transaction_id", "split")


@query("smote_neighbors")
def q_smote_nn(spark, sf):
    m = fx.txn(spark, sf).filter(F.col("is_fraud") == 1)
    return smote_mod.smote_neighbors(m, ["amount", "latitude", "longitude"], "transaction_id", 5) \
        .select(F.col("id").alias("transaction_id"), "nbr_rank", F.col("nbr_id").alias("neighbor_id"))


@query("smote")
def q_smote(spark, sf):
    t = fx.txn(spark, sf)
    s = smote_mod.smote(t, ["amount", "latitude", "longitude"], "is_fraud", "transaction_id", 5)
    return s.select("transaction_id", "is_fraud", "synthetic", *[r6(c).alias(c) for c in ("amount", "latitude", "longitude")])


@query("class_weight")
def q_class_weight(spark, sf):
    w = prep.class_weight(fx.txn(spark, sf))
    return w.select("negatives", "positives", r6("scale_pos_weight").alias("scale_pos_weight"))


@query("model_score")
def q_model_score(spark, sf):
    """Fit the GBT on the point-in-time features of the training
    part (the same features serving computes), score the test part."""
    d = _training_frame(spark, sf)
    d = written(prep.stratified_split(d, "is_fraud", _txn_key(), [("test", 0.2)]), "split")
    num, cat = prep.select_available_features(d)
    train = d.filter(F.col("split") == "train")
    w = prep.class_weight(train).first()["scale_pos_weight"]
    train = train.withColumn("_w", F.when(F.col("is_fraud") == 1, F.lit(float(w))).otherwise(F.lit(1.0)))
    m = training.train_gbt(train, num, cat, training.GBTParams(), weight_col="_w")
    s = m.predict_proba(d, "model_probability")
    return s.select("transaction_id", r6("model_probability").alias("fraud_probability"),
                    scalar.risk_level("model_probability").alias("risk_level"))


@query("split_gains")
def q_split_gains(spark, sf):
    """Gains of all splits of the first tree's root, on all training
    columns, cut at sixteenths between their extremes."""
    d = history.training_features(fx.txn(spark, sf))
    cols = TRAIN_NUMERIC_FEATURES
    x = d.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    cuts = {c: [x[f"lo_{c}"] + (x[f"hi_{c}"] - x[f"lo_{c}"]) * i / 16 for i in range(1, 16)] if x[f"lo_{c}"] is not None else []
            for c in cols}
    g = boosting.split_gains(d, cols, "is_fraud", cuts)
    return g.select("feature", r6("cut").alias("cut"), r6("gain_missing_left").alias("gain_missing_left"),
                    r6("gain_missing_right").alias("gain_missing_right"))


@query("tree_score")
def q_tree_score(spark, sf):
    """A given model's trees, compiled to SQL text, score every row."""
    d = history.training_features(fx.txn(spark, sf))
    p = F.expr(boosting.Booster(**SAMPLE_MODEL).probability_sql())
    return d.select("transaction_id", r6(p).alias("fraud_probability"), scalar.risk_level(p).alias("risk_level"))


@query("boosted_score")
def q_boosted_score(spark, sf):
    """Second-order trees on all numeric and categorical features,
    validated every round, saved, loaded, and all rows scored."""
    d = written(prep.stratified_split(_training_frame(spark, sf), "is_fraud", _txn_key(), [("test", 0.2), ("validation", 0.1)]), "split")
    num, cat = prep.select_available_features(d)
    m = training.train_boosted(d.where("split = 'train'"), num, cat, boosting.BoostParams(rounds=BOOST_ROUNDS),
                               validation=d.where("split = 'validation'"))
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    m.save(path)
    return training.BoostedModel.load(path).predict_proba(d, "fraud_probability").select(
        "transaction_id", r6("fraud_probability").alias("fraud_probability"), scalar.risk_level("fraud_probability").alias("risk_level"))


def _training_frame(spark, sf):
    """Serving features of all transactions, computed once."""
    return written(history.point_in_time_features(fx.txn(spark, sf)), "train")


@query("train_pipeline")
def q_train_pipeline(spark, sf):
    """Split, oversample, fit, evaluate, save and load; the
    loaded model scores every row as the fitted one does."""
    d = _training_frame(spark, sf)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    m = training.train_pipeline(d, TrainConfig(), path=path)
    again = training.FraudModel.load(path)
    a = m.predict_proba(d, "p").select("transaction_id", "p")
    b = again.predict_proba(d, "q").select(F.col("transaction_id").alias("t"), "q")
    many = F.lit(a.agg(F.countDistinct("p")).first()[0] > 1)
    fair = F.lit(again.metrics == m.metrics and 0.5 < m.metrics["roc_auc"] <= 1.0)
    return a.join(b, F.col("transaction_id") == F.col("t")).select(
        "transaction_id", (F.col("p") == F.col("q")).alias("same_after_reload"),
        F.col("p").between(0, 1).alias("is_probability"), many.alias("varies"), fair.alias("beats_chance"))


@query("tune_grid")
def q_tune_grid(spark, sf):
    """Every grid point's mean AUC over the folds, as bounds."""
    d = _training_frame(spark, sf)
    _, res = training.tune_grid(d, ["amount", "amount_zscore", "velocity_score"], [], {"maxIter": [2], "maxDepth": [2, 3]}, n_folds=2)
    rows = spark.createDataFrame([(p["maxIter"], p["maxDepth"], 0.3 < auc <= 1.0) for p, auc in res],
                                 "max_iter int, max_depth int, in_bounds boolean")
    return rows.withColumn("n_rows", F.lit(d.count()).cast("long"))


# ---------------------------------------------------------------------------
# A1, A3, A4, F: sources, sinks and streaming
# ---------------------------------------------------------------------------
from ..sources import io as rio  # noqa: E402
from ..streaming import batched, models, stream as st  # noqa: E402
from ..streaming.state import Log  # noqa: E402

STREAM_DOUBLES = ["time_since_last_txn_seconds", "distance_from_last_txn_km", "travel_speed_kmh",
                  "total_amount_24h", "user_avg_amount", "user_std_amount"]
STREAM_INTS = ["txn_count_1h", "txn_count_24h", "txn_count_7d", "user_txn_count_total"]


def _replay(spark, sf, name, outputs=None, order=None, **more):
    """Folder of a finished replay of the transactions through the stream."""
    base = scratch_path(spark, f"replay-{name}-{uuid.uuid4().hex}")
    batched.run_replay(spark, fx.txn(spark, sf), base, order, len(order) if order else 2, outputs, **more)
    return base


def _stream_features(spark, sf):
    s = spark.read.parquet(_replay(spark, sf, "f") + "/out")
    return s.select("transaction_id", *[r6(c).alias(c) for c in STREAM_DOUBLES],
                    *[F.col(c).cast("long").alias(c) for c in STREAM_INTS], "is_impossible_travel", "late")


@query("stream_features")
def q_stream_features(spark, sf):
    """replay the transactions through the stream (JSON files,
    availableNow trigger) and read the sink back."""
    return _stream_features(spark, sf)


@query("throughput")
def q_throughput(spark, sf):
    t = st.throughput(fx.txn(spark, sf))
    return t.select("window_start_us", "total", "fraud", r6("rate_per_s").alias("rate_per_s"))


@query("to_keyed_json")
def q_keyed_json(spark, sf):
    k = st.to_keyed_json(fx.txn(spark, sf), "user_id")
    v = F.col("value").cast("string")
    return k.select(F.col("key").cast("string").alias("key"),
                    F.get_json_object(v, "$.transaction_id").alias("transaction_id"),
                    F.get_json_object(v, "$.amount").cast("double").alias("amount"),
                    F.get_json_object(v, "$.us").cast("long").alias("us"),
                    F.get_json_object(v, "$.channel").alias("channel"))


@query("read_transactions")
def q_read_csv(spark, sf):
    """A1: write the labelled transactions as CSV, read them back with the
    declared schema (round trip)."""
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    rio.write_transactions_csv(fx.txn(spark, sf), path)
    d = rio.read_transactions(spark, path)
    return d.select("transaction_id", "user_id", r6("amount").alias("amount"), "channel", "is_fraud",
                    F.unix_micros("timestamp").alias("us"))


@query("stream_features_batched")
def q_stream_features_batched(spark, sf):
    """F1 again under the name it had beside the state-API variant."""
    return _stream_features(spark, sf)


@query("stream_score")
def q_stream_score(spark, sf):
    """rules on the streaming features (replay)."""
    s = spark.read.parquet(_replay(spark, sf, "s", {"score": st.stream_score}) + "/score")
    return s.select("transaction_id", "user_id", "us", r6("fraud_probability").alias("fraud_probability"),
                    "risk_level", _join("risk_factors").alias("risk_factors"), "model_used", "model_version")


@query("stream_alerts")
def q_stream_alerts(spark, sf):
    """alert records keyed by user (rules reach MEDIUM at most, so the
    replay alerts on MEDIUM)."""
    levels = ["MEDIUM", "HIGH", "CRITICAL"]
    s = spark.read.parquet(_replay(spark, sf, "a", {"alerts": lambda f: st.stream_alerts(st.stream_score(f), levels)}) + "/alerts")
    v = F.col("value").cast("string")
    return s.select(F.col("key").cast("string").alias("key"),
                    F.get_json_object(v, "$.transaction_id").alias("transaction_id"),
                    F.round(F.get_json_object(v, "$.fraud_probability").cast("double"), 6).alias("fraud_probability"),
                    F.get_json_object(v, "$.risk_level").alias("risk_level"))


@query("stream_score_counters")
def q_stream_counters(spark, sf):
    """running counters by (hour window, level, model)."""
    base = _replay(spark, sf, "c", {"counts": lambda f: st.stream_score_counters(st.stream_score(f))})
    return st.running_counters(spark.read.parquet(base + "/counts"))


@query("stream_late")
def q_stream_late(spark, sf):
    """replay with the second time range arriving after the third; rows
    older than the watermark (max seen - 1 day) or than their user's last
    processed row go to the late table instead of the state."""
    late = spark.read.parquet(_replay(spark, sf, "l", order=[0, 2, 1, 3]) + "/late")
    return late.select("transaction_id", "user_id", "us", r6("amount").alias("amount"))


@query("stream_features_full")
def q_stream_features_full(spark, sf):
    """all 21 fields of D10 from the stream, the merchants' included, over
    three epochs whose state carries on from one to the next."""
    return _d10_out(spark.read.parquet(_replay(spark, sf, "w", order=[0, 1, 2]) + "/out"))


@query("stream_score_model")
def q_stream_score_model(spark, sf):
    """F2 with a model published while the stream runs: the first range finds
    none and takes the rules with FALLBACK_MODE, the second is scored by it."""
    folder = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    model = training.BoostedModel(boosting.Booster(**STREAM_MODEL), version="sample-v1")

    def publish(k):
        if k == 1:
            models.publish(spark, model, folder, 1)
    base = _replay(spark, sf, "m", scorer=models.folder_scorer(folder), before=publish)
    return _score_out(spark.read.parquet(base + "/score"))


@query("stream_running_counters")
def q_stream_running_counters(spark, sf):
    """the counters of a running stream, added up by levels of epochs."""
    base = _replay(spark, sf, "k", scorer=st.stream_score, logs={"counts": st.score_counter_log()})
    return Log(st.COUNTS, base + "/counts").read(spark)


@query("stream_throughput")
def q_stream_throughput(spark, sf):
    """F5 on a stream: minute windows behind a watermark, upserted by window;
    each of two ranges restarts the query from its checkpoint."""
    base = scratch_path(spark, f"replay-t-{uuid.uuid4().hex}")
    staged = st.replay_ranges(fx.txn(spark, sf), base + "/stage", 2)
    for k in range(2):
        st.wire_records(staged.filter(F.col("_r") == k)).write.mode("append").json(base + "/src")
        st.start_throughput(st.read_txn_stream(spark, "json", base + "/src"), base, trigger={"availableNow": True}).awaitTermination()
    w = Log(st.WINDOWS, base + "/windows").read(spark)
    return w.select("window_start_us", "total", "fraud", r6("rate_per_s").alias("rate_per_s"))


@query("read_txn_stream")
def q_read_txn_stream(spark, sf):
    """A3: transactions as JSON records, read as a stream of two files a
    micro-batch at most, and what arrived."""
    base = scratch_path(spark, f"arrivals-{uuid.uuid4().hex}")
    st.wire_records(fx.txn(spark, sf).repartition(6, "user_id")).write.json(base + "/src")
    s = st.read_txn_stream(spark, "json", base + "/src", {"maxFilesPerTrigger": "2"})
    s.writeStream.format("parquet").option("checkpointLocation", base + "/ck").trigger(availableNow=True) \
     .start(base + "/out").awaitTermination()
    d = spark.read.parquet(base + "/out")
    return d.select("transaction_id", "user_id", "us", r6("amount").alias("amount"), "merchant_id", "is_fraud")
