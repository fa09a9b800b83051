"""Validate, normalise and summarise transactions.

Validation is one projection: each bound becomes ``when(bad, struct(field,
message, type))`` and the row's error list is the non-null ones. Valid and
quarantined rows are two filters of that projection (no second scan when
the caller caches or writes it once).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHANNELS

ERROR_TYPE = "struct<field:string,message:string,type:string>"


def _err(cond: Column, field: str, message: str, typ: str) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)),
                  F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"),
                           F.lit(typ).alias("type")))


def _str_checks(col: str, lo: int | None, hi: int | None, required: bool) -> list[Column]:
    c = F.col(col)
    out = []
    if required:
        out.append(_err(c.isNull(), col, "Field required", "missing"))
    if lo:
        out.append(_err(c.isNotNull() & (F.length(c) < lo), col,
                        f"String should have at least {lo} character{'s' if lo > 1 else ''}",
                        "string_too_short"))
    if hi:
        out.append(_err(c.isNotNull() & (F.length(c) > hi), col,
                        f"String should have at most {hi} characters", "string_too_long"))
    return out


def _num_checks(col: str, lo: float, hi: float, lo_msg: str, hi_msg: str) -> list[Column]:
    c = F.col(col)
    finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return [
        _err(c.isNull(), col, "Field required", "missing"),
        _err(c.isNotNull() & ~finite, col, "Input should be a finite number", "finite_number"),
        _err(c.isNotNull() & finite & (c < lo), col, f"Input should be greater than or equal to {lo_msg}",
             "greater_than_equal"),
        _err(c.isNotNull() & finite & (c > hi), col, f"Input should be less than or equal to {hi_msg}",
             "less_than_equal"),
    ]


def error_array(df: DataFrame) -> Column:
    """Ordered validation errors of a flat transaction row.

    FIXED VALUES: bounds and the validator's message and type labels.
    """
    checks: list[Column] = []
    checks += _str_checks("transaction_id", 1, 64, True)
    checks += _str_checks("user_id", 1, 64, True)
    checks += _num_checks("amount", 0.01, 1_000_000.0, "0.01", "1000000")
    checks += _str_checks("currency", 3, 3, False)
    checks += _str_checks("merchant_id", 1, 64, True)
    checks += _str_checks("merchant_category", 1, 32, True)
    checks += _num_checks("latitude", -90.0, 90.0, "-90", "90")
    checks += _num_checks("longitude", -180.0, 180.0, "-180", "180")
    if "device_id" in df.columns:
        checks += _str_checks("device_id", None, 64, False)
    if "ip_address" in df.columns:
        checks += _str_checks("ip_address", None, 45, False)
    ch = F.col("channel")
    checks.append(_err(ch.isNotNull() & ~ch.isin(CHANNELS), "channel",
                       "String should match pattern '^(" + "|".join(CHANNELS) + ")$'",
                       "string_pattern_mismatch"))
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def with_errors(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", error_array(df))


def validate_txn(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B1: (valid, rejected); rejected rows keep their error list."""
    d = with_errors(df)
    valid = d.filter(F.size("errors") == 0).drop("errors")
    rejected = d.filter(F.size("errors") > 0)
    return valid, rejected


def normalize_txn(df: DataFrame, now_us: Column | int | None = None) -> DataFrame:
    """B2: defaults (currency USD, channel online, time = now) and the
    nested location struct. ``now_us`` is passed in so replays are
    deterministic."""
    now = F.lit(now_us) if isinstance(now_us, int) else (now_us if now_us is not None
                                                          else F.unix_micros(F.current_timestamp()))
    d = df
    if "us" not in d.columns:
        d = d.withColumn("us", F.lit(None).cast("long"))
    return (d.withColumn("currency", F.coalesce(F.col("currency"), F.lit("USD")))
             .withColumn("channel", F.coalesce(F.col("channel"), F.lit("online")))
             .withColumn("us", F.coalesce(F.col("us"), now))
             .withColumn("location", F.struct(F.col("latitude").alias("latitude"),
                                              F.col("longitude").alias("longitude"))))


def validation_summary(rejected: DataFrame) -> DataFrame:
    """Rejected rows per (field, type)."""
    e = rejected.select(F.explode("errors").alias("e"))
    return e.groupBy(F.col("e.field").alias("field"), F.col("e.type").alias("type")) \
            .agg(F.count(F.lit(1)).alias("n_rows"))


def batch_outcome(scored: DataFrame, batch_col: str = "batch_id",
                  status_col: str = "status") -> DataFrame:
    """Per batch, success = every row succeeded, totals and failures."""
    ok = F.col(status_col) == "success"
    return scored.groupBy(batch_col).agg(
        F.bool_and(ok).alias("success"),
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(~ok).alias("failures"))
