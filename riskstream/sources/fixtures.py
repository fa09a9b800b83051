"""Views over the driver tables that give the reference's input shapes.

Each view exists twice: as a Spark DataFrame builder (used by operators and
tests) and as DuckDB SQL (used by the oracle). The derivation rules are
fixed (see FIXTURES.md); they only *derive* attributes, no row is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_utc

# Ten made-up places (index, latitude, longitude, country, merchant category),
# spread over the globe by multiples of steps that share no factor.
CITIES = [(i, (i * 37) % 120 - 60 + i / 8, (i * 101) % 340 - 170 + i / 16, f"country_{i}", f"category_{i}")
          for i in range(10)]
DENSE_ORIGIN_US = 1704067200000000
DENSE_FACTOR = 24


def _lookup(values: list, idx: Column) -> Column:
    """Constant-array lookup: stays in codegen, no join for a 10-row table."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx.cast("int") + 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """``events`` plus ``us`` = epoch microseconds (UTC)."""
    ensure_utc(spark)
    ev = table(spark, sf_dir, "events").withColumn(
        "us", F.unix_micros(F.col("ts").cast("timestamp")))
    if dense:
        us = F.lit(DENSE_ORIGIN_US) + F.expr(
            f"(us - {DENSE_ORIGIN_US}) div {DENSE_FACTOR}")
        ev = ev.withColumn("us", us).withColumn("ts", F.timestamp_micros("us"))
    return ev


def txn(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Canonical flat transactions (view ``txn`` / ``txn_dense``)."""
    e = events(spark, sf_dir, dense)
    eid, uid = F.col("event_id"), F.col("user_id")
    ci = F.when(eid % 11 == 0, (uid + eid) % 10).otherwise(uid % 10)
    mi = eid % 10
    lats = [c[1] for c in CITIES]
    lons = [c[2] for c in CITIES]
    countries = [c[3] for c in CITIES]
    cats = [c[4] for c in CITIES]
    return e.select(
        F.concat(F.lit("TXN_"), F.lpad(eid.cast("string"), 10, "0")).alias("transaction_id"),
        F.concat(F.lit("USER_"), F.lpad(uid.cast("string"), 8, "0")).alias("user_id"),
        F.col("us"),
        F.when(eid % 7 == 0, F.col("value") * 50).otherwise(F.col("value")).alias("amount"),
        F.when(eid % 5 == 2, "EUR").when(eid % 5 == 3, "GBP").when(eid % 5 == 4, "JPY")
         .otherwise("USD").alias("currency"),
        F.concat(F.lit("MERCH_"), F.lpad((eid % 100).cast("string"), 6, "0")).alias("merchant_id"),
        _lookup(cats, mi).alias("merchant_category"),
        _lookup(lats, ci).cast("double").alias("latitude"),
        _lookup(lons, ci).cast("double").alias("longitude"),
        _lookup(countries, ci).alias("country"),
        F.when(eid % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("DEV_"), F.lpad((uid % 100).cast("string"), 4, "0")))
         .alias("device_id"),
        F.when(eid % 4 == 0, "online").when(eid % 4 == 1, "mobile").when(eid % 4 == 2, "offline")
         .otherwise("api").alias("channel"),
        F.when((F.col("event_type") == "error") & (eid % 7 == 0), 1).otherwise(0)
         .cast("int").alias("is_fraud"),
    )


def txn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn`` with nine kinds of damage (2 % of rows each) for validation."""
    t = txn(spark, sf_dir)
    k = F.col("transaction_id").substr(5, 100).cast("bigint") % 50
    t = t.withColumn("_k", k)

    def case(mapping: dict, default: Column) -> Column:
        out = None
        for key, val in mapping.items():
            v = F.lit(val) if not isinstance(val, Column) else val
            out = F.when(F.col("_k") == key, v) if out is None else out.when(F.col("_k") == key, v)
        return out.otherwise(default)

    return t.select(
        "transaction_id", "user_id", "us",
        case({0: -100.0, 1: 2000000.0}, F.col("amount")).alias("amount"),
        case({5: "US", 7: F.lit(None).cast("string")}, F.col("currency")).alias("currency"),
        case({6: ""}, F.col("merchant_id")).alias("merchant_id"),
        "merchant_category",
        case({2: 100.0}, F.col("latitude")).alias("latitude"),
        case({3: 200.0}, F.col("longitude")).alias("longitude"),
        "device_id",
        case({4: "invalid_channel", 8: F.lit(None).cast("string")}, F.col("channel")).alias("channel"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored table independent of the scorer (reaches all four levels)."""
    e = events(spark, sf_dir)
    eid = F.col("event_id")
    p = ((eid * 37) % 1000).cast("double") / 1000
    return e.select(
        "event_id", "user_id", "us",
        F.when(eid % 7 == 0, F.col("value") * 50).otherwise(F.col("value")).alias("amount"),
        F.when(eid % 5 == 2, "EUR").when(eid % 5 == 3, "GBP").when(eid % 5 == 4, "JPY")
         .otherwise("USD").alias("currency"),
        p.alias("fraud_probability"),
        F.when(eid % 6 == 0, "rules_fallback").otherwise("gbt").alias("model_used"),
        F.when(eid % 20 == 0, "error").otherwise("success").alias("status"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("int").alias("label"),
    ).withColumn(
        "risk_level",
        F.when(F.col("fraud_probability") >= 0.85, "CRITICAL")
         .when(F.col("fraud_probability") >= 0.7, "HIGH")
         .when(F.col("fraud_probability") >= 0.5, "MEDIUM").otherwise("LOW"))


def txn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored table's probabilities by transaction id."""
    tid = F.concat(F.lit("TXN_"), F.lpad(F.col("event_id").cast("string"), 10, "0"))
    return scored(spark, sf_dir).select(tid.alias("transaction_id"), "fraud_probability")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log (method, path, status, duration)."""
    e = events(spark, sf_dir)
    eid, uid = F.col("event_id"), F.col("user_id")
    path = (F.when(eid % 6 == 0, "/metrics")
             .when(eid % 6 == 1, "/api/v1/score")
             .when(eid % 6 == 2, "/api/v1/score/batch")
             .when(eid % 6 == 3, F.concat(F.lit("/api/v1/users/"), uid.cast("string"), F.lit("/features")))
             .when(eid % 6 == 4, F.concat(F.lit("/api/v1/users/0a1b2c3d-0000-4000-8000-"),
                                          F.lpad(eid.cast("string"), 12, "0")))
             .otherwise(F.concat(F.lit("/api/v1/users/USER_ACCOUNT_"),
                                 F.lpad(uid.cast("string"), 12, "0"), F.lit("/features"))))
    return e.select(
        "event_id", "us",
        F.when(eid % 3 == 0, "GET").otherwise("POST").alias("method"),
        path.alias("path"),
        F.when(eid % 20 == 0, "500").when(eid % 33 == 0, "422").otherwise("200").alias("status_code"),
        (F.col("value") / 1000).alias("duration_s"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge samples: every event reports four gauges."""
    eid, bad = F.col("event_id"), F.col("event_type") == "error"

    def gauge(metric: str, label: Column, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), label.alias("labels"), value.cast("double").alias("value"))

    def numbered(name: str, n: int) -> Column:
        return F.concat(F.lit(name + "="), (eid % n).cast("string"))

    return events(spark, sf_dir).select("us", F.explode(F.array(
        gauge("circuit_breaker_state", F.lit("service=model"), F.when(bad, 1).otherwise(0)),
        gauge("feature_store_errors_total", numbered("shard", 3), eid % 15),
        gauge("kafka_consumer_lag", numbered("partition", 4), eid * 37 % 1000 * 12),
        gauge("up", numbered("replica", 2), F.when(bad & (eid % 3 == 0), 0).otherwise(1)))).alias("g")).select("us", "g.*")


# ---------------------------------------------------------------------------
# The same views as DuckDB SQL CTEs (for oracle_sql()).
# ---------------------------------------------------------------------------

_CITY_VALUES = ", ".join(
    f"({i}, {lat}, {lon}, '{country}', '{cat}')" for i, lat, lon, country, cat in CITIES)

SQL_EV = "ev AS (SELECT *, epoch_us(ts) AS us FROM events)"
_DENSE_US = f"({DENSE_ORIGIN_US} + (epoch_us(ts) - {DENSE_ORIGIN_US}) // {DENSE_FACTOR})"
SQL_EV_DENSE = (f"ev AS (SELECT * REPLACE (make_timestamp({_DENSE_US}) AS ts), "
                f"{_DENSE_US} AS us FROM events)")

SQL_TXN = f"""city AS (
  SELECT * FROM (VALUES {_CITY_VALUES}) AS t(i, lat, lon, country, category)
), e AS (
  SELECT *, CASE WHEN event_id % 11 = 0 THEN (user_id + event_id) % 10 ELSE user_id % 10 END AS ci FROM ev
), txn AS (
SELECT
  concat('TXN_', lpad(CAST(e.event_id AS varchar), 10, '0')) AS transaction_id,
  concat('USER_', lpad(CAST(e.user_id AS varchar), 8, '0')) AS user_id,
  e.us AS us,
  CASE WHEN e.event_id % 7 = 0 THEN e.value * 50 ELSE e.value END AS amount,
  CASE e.event_id % 5 WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' WHEN 4 THEN 'JPY' ELSE 'USD' END AS currency,
  concat('MERCH_', lpad(CAST(e.event_id % 100 AS varchar), 6, '0')) AS merchant_id,
  m.category AS merchant_category,
  CAST(c.lat AS double) AS latitude, CAST(c.lon AS double) AS longitude, c.country AS country,
  CASE WHEN e.event_id % 13 = 0 THEN NULL ELSE concat('DEV_', lpad(CAST(e.user_id % 100 AS varchar), 4, '0')) END AS device_id,
  CASE e.event_id % 4 WHEN 0 THEN 'online' WHEN 1 THEN 'mobile' WHEN 2 THEN 'offline' ELSE 'api' END AS channel,
  CAST(CASE WHEN e.event_type = 'error' AND e.event_id % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS is_fraud
FROM e JOIN city c ON e.ci = c.i JOIN city m ON e.event_id % 10 = m.i
)"""

SQL_TXN_RAW = """txn_raw AS (
SELECT transaction_id, user_id, us,
  CASE k WHEN 0 THEN -100.0 WHEN 1 THEN 2000000.0 ELSE amount END AS amount,
  CASE k WHEN 5 THEN 'US' WHEN 7 THEN NULL ELSE currency END AS currency,
  CASE k WHEN 6 THEN '' ELSE merchant_id END AS merchant_id, merchant_category,
  CASE k WHEN 2 THEN 100.0 ELSE latitude END AS latitude,
  CASE k WHEN 3 THEN 200.0 ELSE longitude END AS longitude,
  device_id,
  CASE k WHEN 4 THEN 'invalid_channel' WHEN 8 THEN NULL ELSE channel END AS channel
FROM (SELECT *, CAST(substr(transaction_id, 5) AS bigint) % 50 AS k FROM txn) x
)"""

SQL_SCORED = """scored AS (
SELECT *, CASE WHEN fraud_probability >= 0.85 THEN 'CRITICAL' WHEN fraud_probability >= 0.7 THEN 'HIGH'
               WHEN fraud_probability >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM (SELECT event_id, user_id, us,
        CASE WHEN event_id % 7 = 0 THEN value * 50 ELSE value END AS amount,
        CASE event_id % 5 WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' WHEN 4 THEN 'JPY' ELSE 'USD' END AS currency,
        CAST((event_id * 37) % 1000 AS double) / 1000 AS fraud_probability,
        CASE WHEN event_id % 6 = 0 THEN 'rules_fallback' ELSE 'gbt' END AS model_used,
        CASE WHEN event_id % 20 = 0 THEN 'error' ELSE 'success' END AS status,
        value AS latency_ms,
        CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS label
      FROM ev) x
)"""

SQL_REQUESTS = """requests AS (
SELECT event_id, us, CASE WHEN event_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS method,
  CASE event_id % 6 WHEN 0 THEN '/metrics' WHEN 1 THEN '/api/v1/score' WHEN 2 THEN '/api/v1/score/batch'
    WHEN 3 THEN concat('/api/v1/users/', CAST(user_id AS varchar), '/features')
    WHEN 4 THEN concat('/api/v1/users/0a1b2c3d-0000-4000-8000-', lpad(CAST(event_id AS varchar), 12, '0'))
    ELSE concat('/api/v1/users/USER_ACCOUNT_', lpad(CAST(user_id AS varchar), 12, '0'), '/features') END AS path,
  CASE WHEN event_id % 20 = 0 THEN '500' WHEN event_id % 33 = 0 THEN '422' ELSE '200' END AS status_code,
  value / 1000 AS duration_s
FROM ev
)"""

SQL_SAMPLES = """samples AS (
SELECT us, 'circuit_breaker_state' AS metric, 'service=model' AS labels,
  CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS double) AS value FROM ev
UNION ALL SELECT us, 'feature_store_errors_total', concat('shard=', event_id % 3), event_id % 15 FROM ev
UNION ALL SELECT us, 'kafka_consumer_lag', concat('partition=', event_id % 4), event_id * 37 % 1000 * 12 FROM ev
UNION ALL SELECT us, 'up', concat('replica=', event_id % 2),
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 0 ELSE 1 END FROM ev
)"""


def with_views(body: str, *views: str, dense: bool = False) -> str:
    """Prefix a query with the CTEs of the named fixture views."""
    ctes = [SQL_EV_DENSE if dense else SQL_EV]
    need_txn = any(v in ("txn", "txn_raw") for v in views)
    if need_txn:
        ctes.append(SQL_TXN)
    if "txn_raw" in views:
        ctes.append(SQL_TXN_RAW)
    if "scored" in views:
        ctes.append(SQL_SCORED)
    if "requests" in views:
        ctes.append(SQL_REQUESTS)
    if "samples" in views:
        ctes.append(SQL_SAMPLES)
    body = body.strip()
    if body[:4].upper() == "WITH" and body[4:5].isspace():
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
