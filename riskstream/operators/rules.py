"""Transparent rule scoring as Columns.

A rule is an ordered list of branches ``(condition, weight, factor)``; the
first branch that holds gives the rule's weight and factor. Rules are
Column builders, so the whole registry folds into one ``select`` that stays
inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.scalar import risk_level
from ..functions.text import flags_to_array

ColFn = Callable[[], Column]

RULE_MODEL_VERSION = "rule-based-v1"


@dataclass(frozen=True)
class Rule:
    """One entry of the rule registry."""
    name: str
    branches: tuple[tuple[ColFn, float, str], ...]

    def score(self) -> Column:
        out = None
        for cond, w, _ in self.branches:
            c = F.coalesce(cond(), F.lit(False))
            out = F.when(c, F.lit(float(w))) if out is None else out.when(c, F.lit(float(w)))
        return out.otherwise(F.lit(0.0))

    def factor(self) -> Column:
        out = None
        for cond, _, name in self.branches:
            c = F.coalesce(cond(), F.lit(False))
            out = F.when(c, F.lit(name)) if out is None else out.when(c, F.lit(name))
        return out


def default_rules(t: Thresholds = DEFAULT) -> list[Rule]:
    """E1-E5. FIXED VALUES: cut-offs, weights and factor labels.

    The fallback path reads the *profile's* total count as its 24 h count.
    """
    c = F.col
    return [
        Rule("amount_velocity", (
            (lambda: (c("amount") > 1000) & (c("user_txn_count_total") > 10), 0.8, "HIGH_AMOUNT_FREQUENCY"),)),
        Rule("impossible_travel", (
            (lambda: c("is_impossible_travel"), 1.0, "IMPOSSIBLE_TRAVEL"),
            (lambda: c("travel_speed_kmh") > t.suspicious_speed_kmh, 0.7, "SUSPICIOUS_TRAVEL_SPEED"))),
        Rule("time_pattern", (
            (lambda: c("hour_of_day") < 4, 0.3, "LATE_NIGHT_TRANSACTION"),)),
        Rule("frequency", (
            (lambda: c("time_since_last_txn_seconds") < 60, 0.6, "RAPID_SUCCESSION"),
            (lambda: c("time_since_last_txn_seconds") < 300, 0.3, "QUICK_SUCCESSION"))),
        Rule("amount_anomaly", (
            (lambda: F.abs(c("amount_zscore")) > 3, 0.7, "AMOUNT_ANOMALY"),
            (lambda: F.abs(c("amount_zscore")) > 2, 0.4, "MODERATE_AMOUNT_ANOMALY"))),
    ]


def rule_columns(rules: Sequence[Rule], t: Thresholds = DEFAULT) -> dict[str, Column]:
    """Probability (sum in list order / number of rules, capped at 1),
    level and fired factors in list order."""
    total = None
    for r in rules:
        s = r.score()
        total = s if total is None else total + s
    p = F.least(F.lit(1.0), total / F.lit(float(len(rules))))
    factors = F.filter(F.array(*[r.factor() for r in rules]), lambda x: x.isNotNull())
    return {"fraud_probability": p, "risk_level": risk_level(p, t), "risk_factors": factors}


def apply_rules(features: DataFrame, rules: Sequence[Rule] | None = None,
                t: Thresholds = DEFAULT) -> DataFrame:
    """E6 on a feature frame: adds probability, level, factors and labels."""
    rules = list(rules) if rules is not None else default_rules(t)
    cols = rule_columns(rules, t)
    return features.select(
        "*",
        cols["fraud_probability"].alias("fraud_probability"),
        cols["risk_factors"].alias("risk_factors"),
        F.lit(RULE_MODEL_VERSION).alias("model_version"),
        F.lit("rules").alias("model_used"),
        F.lit(0).alias("features_used"),
    ).withColumn("risk_level", risk_level(F.col("fraud_probability"), t))
