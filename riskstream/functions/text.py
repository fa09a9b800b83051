"""Factor lists and report strings, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flags_to_array(pairs: list[tuple[Column, str]]) -> Column:
    """Ordered array of the labels whose condition holds."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]),
                    lambda x: x.isNotNull())


def model_risk_factors(f: dict[str, Column] | None = None) -> Column:
    """Explanation labels of the model path, in the reference's order.

    FIXED VALUES: labels and cut-offs.
    """
    g = (lambda n: F.col(n)) if f is None else (lambda n: f[n])
    return flags_to_array([
        (g("is_impossible_travel"), "IMPOSSIBLE_TRAVEL"),
        (g("amount_zscore") > 3.0, "UNUSUAL_AMOUNT"),
        (g("velocity_score") > 0.7, "HIGH_VELOCITY"),
        (g("txn_count_1h") > 5, "RAPID_TRANSACTIONS"),
        (g("distance_from_last_txn_km") > 500, "DISTANT_TRANSACTION"),
        (g("user_fraud_history_count") > 0, "PRIOR_FRAUD_HISTORY"),
        (g("time_since_last_txn_seconds") < 60, "TOO_QUICK"),
        (g("hour_of_day") < 4, "UNUSUAL_TIME"),
    ])


def normalize_endpoint(path) -> Column:
    """Replace id-like path segments by ``{id}``.

    A segment is id-like when it has 36 characters and a dash, is all
    digits, or is longer than 20 characters.
    """
    segs = F.split(F.regexp_replace(_c(path), r"^/+|/+$", ""), "/")

    def norm(s):
        is_id = (((F.length(s) == 36) & s.contains("-"))
                 | s.rlike(r"^[0-9]+$") | (F.length(s) > 20))
        return F.when(is_id, F.lit("{id}")).otherwise(s)

    return F.concat(F.lit("/"), F.array_join(F.transform(segs, norm), "/"))


def short_id(id_col, n: int = 16) -> Column:
    """First n characters + '...'."""
    return F.concat(F.substring(_c(id_col), 1, n), F.lit("..."))


def probability_pct(p) -> Column:
    """Probability as a percentage with two decimals, e.g. '87.50%'."""
    return F.concat(F.format_number(_c(p) * 100, 2), F.lit("%"))


def factors_display(arr) -> Column:
    """Factor labels with '_' shown as ' '."""
    return F.transform(_c(arr), lambda x: F.regexp_replace(x, "_", " "))
