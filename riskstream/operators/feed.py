"""C12 users, I1-I6: the alert feed and dashboard figures as queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALERT_LEVELS, HOUR_US, RISK_LEVELS
from ..functions.text import factors_display, probability_pct, short_id


def dashboard_stats(scored: DataFrame, as_of_us: int, levels: Sequence[str] = ALERT_LEVELS) -> DataFrame:
    """One row as of ``as_of_us``: totals, alerts, rate, average latency,
    alerts in the trailing hour (a real decaying count) and amount blocked."""
    d = scored.filter(F.col("us") <= F.lit(as_of_us))
    alert = F.col("risk_level").isin(*levels)
    recent = alert & (F.col("us") > F.lit(as_of_us - HOUR_US))
    return d.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(alert).alias("fraud_detected"),
        F.try_divide(F.count_if(alert).cast("double"), F.count(F.lit(1))).alias("fraud_rate"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.count_if(recent).alias("alerts_last_hour"),
        F.coalesce(F.sum(F.when(alert, F.col("amount"))), F.lit(0.0)).alias("total_amount_blocked"))


def alert_history(alerts: DataFrame, n: int = 100, id_col: str = "event_id") -> DataFrame:
    """The newest ``n`` alerts (top-k: per-partition top-n, then merge),
    with ``position`` 1 = newest."""
    top = alerts.orderBy(F.desc("us"), F.desc(id_col)).limit(n)
    w = Window.orderBy(F.desc("us"), F.desc(id_col))  # over at most n rows
    return top.withColumn("position", F.row_number().over(w))


def route_alerts(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Alerts to the rooms of their level. Subscriptions (subscriber,
    level) reduce to subscriber counts per room first, so the join emits one
    row per alert and room, never one per (alert, subscriber) pair."""
    rooms = subscriptions.groupBy(F.col("level").alias("risk_level")).agg(
        F.countDistinct("subscriber").alias("subscribers"))
    return alerts.join(rooms, "risk_level", "inner").withColumn(
        "room", F.concat(F.lit("alerts:"), F.col("risk_level")))


def write_routed(routed: DataFrame, path: str) -> None:
    """I3 sink: one folder per level."""
    routed.write.mode("overwrite").partitionBy("risk_level").parquet(path)


def risk_distribution(scored: DataFrame) -> DataFrame:
    """I4: count for all four levels, zeros included (4-row literal side)."""
    spark = scored.sparkSession
    lv = spark.createDataFrame([(x,) for x in RISK_LEVELS], "risk_level string")
    c = scored.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(lv).join(c, "risk_level", "left").select(
        "risk_level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def recent_alerts(alerts: DataFrame, levels: Sequence[str] | None = None, n: int = 10,
                  id_col: str = "transaction_id") -> DataFrame:
    """The ``n`` newest alerts after a level filter, as report rows."""
    a = alerts if not levels else alerts.filter(F.col("risk_level").isin(*levels))
    top = a.orderBy(F.desc("us"), F.desc(id_col)).limit(n)
    return top.select(id_col, "us", "risk_level", short_id(id_col).alias("short_id"),
                      probability_pct("fraud_probability").alias("probability"),
                      F.array_join(factors_display("risk_factors"), ", ").alias("factors"))


def rate_status(rates: DataFrame, rate_col: str = "fraud_rate") -> DataFrame:
    """I6: 'Normal' below 0.1 %, else 'Elevated'."""
    return rates.withColumn("status", F.when(F.col(rate_col) < 0.001, "Normal").otherwise("Elevated"))
