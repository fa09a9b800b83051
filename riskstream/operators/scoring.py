"""Score transactions (rules, model, hybrid with fallback)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, FEATURE_ORDER, Thresholds
from ..functions.scalar import amount_zscore, hour_of_day, risk_level
from ..functions.text import model_risk_factors
from . import history
from .rules import Rule, apply_rules, default_rules, rule_columns

SCORE_COLUMNS = ["transaction_id", "user_id", "us", "fraud_probability", "risk_level",
                 "risk_factors", "model_version", "model_used", "features_used"]


def rule_features(txn: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The minimal feature row the rules read: last transaction within the
    TTL (D1), running profile of the gap session (D3), hour, z-score."""
    d = history._user_profile_pass(txn, t)
    d = history._finish(d.select("*", *history._last_cols(t)), [])
    return d.select("*", hour_of_day("us").alias("hour_of_day"),
                    amount_zscore("amount", "user_avg_amount", "user_std_amount").alias("amount_zscore"))


def rule_score(txn: DataFrame, t: Thresholds = DEFAULT,
               rules: Sequence[Rule] | None = None) -> DataFrame:
    """E6 (flagship): rule-based score of every transaction, each seeing
    only the user's earlier transactions."""
    return apply_rules(rule_features(txn, t), rules, t).select(*SCORE_COLUMNS)


def hybrid_score(features: DataFrame, model_col: str = "model_probability",
                 model_version: str = "gbt-v1", model_name: str = "gbt",
                 t: Thresholds = DEFAULT, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Model probability when present, else rules + FALLBACK_MODE.

    ``features`` is a D10 frame; ``model_col`` holds the model probability
    (null where the model failed). Missing column = no model at all.
    """
    rules = list(rules) if rules is not None else default_rules(t)
    rc = rule_columns(rules, t)
    if model_col not in features.columns:
        features = features.withColumn(model_col, F.lit(None).cast("double"))
    mp = F.col(model_col)
    ok = mp.isNotNull()
    p = F.when(ok, mp).otherwise(rc["fraud_probability"])
    factors = F.when(ok, model_risk_factors()).otherwise(
        F.concat(rc["risk_factors"], F.array(F.lit("FALLBACK_MODE"))))
    return features.select(
        "*",
        p.alias("fraud_probability"),
        risk_level(p, t).alias("risk_level"),
        factors.alias("risk_factors"),
        F.when(ok, F.lit(model_version)).otherwise(F.lit("rule-based-v1")).alias("model_version"),
        F.when(ok, F.lit(model_name)).otherwise(F.lit("rules_fallback")).alias("model_used"),
        F.when(ok, F.lit(len(FEATURE_ORDER) + 1)).otherwise(F.lit(0)).alias("features_used"),
    )


def score_batch(txn: DataFrame, model=None, t: Thresholds = DEFAULT,
                rules: Sequence[Rule] | None = None) -> DataFrame:
    """Score a whole table; every row sees the user's earlier rows.

    With a fitted model (``training.FraudModel``) its probability is used,
    otherwise every row takes the rules fallback path.
    """
    f = history.point_in_time_features(txn, t)
    if model is not None:
        f = model.predict_proba(f, out_col="model_probability")
        return hybrid_score(f, "model_probability", model_version=model.version, t=t,
                            rules=rules).select(*SCORE_COLUMNS)
    return hybrid_score(f, "model_probability", t=t, rules=rules).select(*SCORE_COLUMNS)
