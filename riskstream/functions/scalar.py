"""Per-row feature Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DAY_US, DEFAULT, FEATURE_ORDER, HOUR_US, Thresholds


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def amount_log(amount) -> Column:
    return F.log1p(_c(amount))


def idiv(x, n: int) -> Column:
    """Exact floor division of a long by a positive constant."""
    x, k = _c(x), F.lit(int(n))
    return ((x - F.pmod(x, k)) / k).cast("long")


def hour_of_day(us) -> Column:
    """UTC hour from epoch microseconds (arithmetic: no time-zone lookup)."""
    return F.pmod(idiv(us, HOUR_US), F.lit(24)).cast("int")


def day_of_week(us) -> Column:
    """Monday = 0 ... Sunday = 6 (1970-01-01 was a Thursday = 3)."""
    return F.pmod(idiv(us, DAY_US) + 3, F.lit(7)).cast("int")


def is_weekend(us) -> Column:
    return day_of_week(us) >= 5


def temporal_features(us) -> dict[str, Column]:
    return {"hour_of_day": hour_of_day(us), "day_of_week": day_of_week(us),
            "is_weekend": is_weekend(us)}


def amount_zscore(amount, mean, std) -> Column:
    s = _c(std)
    return F.when(s > 0, (_c(amount) - _c(mean)) / s).otherwise(F.lit(0.0))


def velocity_score(c1h, c24h, clip_low: bool = False) -> Column:
    v = (_c(c1h) / 10.0) * 0.3 + (_c(c24h) / 50.0) * 0.7
    v = F.least(F.lit(1.0), v)
    return F.greatest(F.lit(0.0), v) if clip_low else v


def risk_level(p, t: Thresholds = DEFAULT) -> Column:
    p = _c(p)
    return (F.when(p >= t.critical, "CRITICAL").when(p >= t.high, "HIGH")
             .when(p >= t.medium, "MEDIUM").otherwise("LOW"))


def feature_vector(order: list[str] = FEATURE_ORDER) -> Column:
    """Fixed-order float array (booleans as 0/1), the model input."""
    return F.array(*[F.col(n).cast("float") for n in order])


def r6(c) -> Column:
    """Published doubles are rounded to 6 decimals (HALF_UP).

    Rounding first to 10 decimals makes exact ties (e.g. means of cent
    amounts over 32 rows) independent of last-bit differences between
    summation orders, so every engine publishes the same value.
    """
    return F.round(F.round(_c(c), 10), 6)
