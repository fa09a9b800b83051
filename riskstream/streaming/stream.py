"""The scoring flow around the stream of ``batched``.

source (Kafka or JSON files) -> parse -> features (F1, ``batched``) -> rules or
model (F2) -> alerts (F3, keyed JSON sink); late rows (F4, ``batched``);
throughput (F5) behind a watermark and running counters (F6) of the scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .state import Log, Table, newest, sums

# Wire schema of a transaction message (JSON value, key = user_id).
TXN_WIRE_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("city", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("is_fraud", T.BooleanType()),
    T.StructField("fraud_type", T.StringType()),
])


# ---------------------------------------------------------------------------
# A3 / A4: keyed JSON in and out
# ---------------------------------------------------------------------------

def parse_txn_json(raw: DataFrame, value_col: str = "value",
                   schema: T.StructType = TXN_WIRE_SCHEMA) -> DataFrame:
    """JSON value -> typed columns, plus ``us`` (epoch micros) and ``ts``."""
    d = raw.select(F.from_json(F.col(value_col).cast("string"), schema).alias("t")).select("t.*")
    ts = F.to_timestamp("timestamp")
    return d.withColumn("ts", ts).withColumn("us", F.unix_micros(ts))


def read_txn_stream(spark: SparkSession, fmt: str = "json", path: str | None = None,
                    options: dict | None = None, schema: T.StructType = TXN_WIRE_SCHEMA) -> DataFrame:
    """A3: a transaction stream. ``fmt="kafka"`` reads ``key/value`` from a
    topic (needs the Kafka connector on the classpath; options such as
    ``kafka.bootstrap.servers``, ``subscribe``, ``startingOffsets=latest``,
    ``maxOffsetsPerTrigger``); ``fmt="json"`` reads the same JSON records
    from files (tests, replays)."""
    opts = dict(options or {})
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**opts).load()
        return parse_txn_json(raw, "value", schema)
    r = spark.readStream.schema(schema).options(**opts).format(fmt)
    d = r.load(path)
    ts = F.to_timestamp("timestamp")
    return d.withColumn("ts", ts).withColumn("us", F.unix_micros(ts))


def to_keyed_json(df: DataFrame, key: str = "user_id", cols: list[str] | None = None) -> DataFrame:
    """A4: (key, value) binary pair, value = JSON of the record."""
    cols = cols or [c for c in df.columns]
    return df.select(F.col(key).cast("string").cast("binary").alias("key"),
                     F.to_json(F.struct(*[F.col(c) for c in cols])).cast("binary").alias("value"))


def write_keyed(df: DataFrame, fmt: str, checkpoint: str, options: dict | None = None,
                path: str | None = None, trigger: dict | None = None):
    """A4 sink: Kafka topic (``options={"topic": ...}``) or files; append
    mode with a checkpoint in the shared folder so a restart resumes."""
    w = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    w = w.options(**(options or {})).format(fmt)
    if trigger:
        w = w.trigger(**trigger)
    return w.start(path) if path else w.start()


# ---------------------------------------------------------------------------
# stateful point-in-time features
# ---------------------------------------------------------------------------

FEATURE_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("us", T.LongType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("late", T.BooleanType()),
    T.StructField("time_since_last_txn_seconds", T.DoubleType()),
    T.StructField("distance_from_last_txn_km", T.DoubleType()),
    T.StructField("travel_speed_kmh", T.DoubleType()),
    T.StructField("is_impossible_travel", T.BooleanType()),
    T.StructField("txn_count_1h", T.LongType()),
    T.StructField("txn_count_24h", T.LongType()),
    T.StructField("txn_count_7d", T.LongType()),
    T.StructField("total_amount_24h", T.DoubleType()),
    T.StructField("user_txn_count_total", T.LongType()),
    T.StructField("user_avg_amount", T.DoubleType()),
    T.StructField("user_std_amount", T.DoubleType()),
])

def stream_score(features: DataFrame) -> DataFrame:
    """rules on the streaming feature rows (stateless Columns). Late rows
    have no features; they are in the late table."""
    from ..functions.scalar import amount_zscore, hour_of_day
    from ..operators.rules import apply_rules
    f = (features.withColumn("hour_of_day", hour_of_day("us"))
                 .withColumn("amount_zscore", amount_zscore("amount", "user_avg_amount", "user_std_amount")))
    return apply_rules(f)


def stream_alerts(scored: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """scores at alert levels -> keyed alert records (key = user)."""
    levels = levels or ["HIGH", "CRITICAL"]
    a = scored.filter(F.col("risk_level").isin(*levels)).select(
        "transaction_id", "user_id", "us", "amount", "fraud_probability", "risk_level", "risk_factors")
    return to_keyed_json(a, "user_id")


def throughput(df: DataFrame, width: str = "1 minute", label: str = "is_fraud") -> DataFrame:
    """total, fraud count and rate per second per tumbling window
    (batch or stream; on a stream add a watermark first)."""
    ts = F.col("ts") if "ts" in df.columns else F.timestamp_micros("us")
    g = df.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(label).cast("int") == 1).alias("fraud"))
    secs = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    return g.select(F.unix_micros(F.col("w.start")).alias("window_start_us"), "total", "fraud",
                    (F.col("total") / secs).alias("rate_per_s"))


WINDOWS = newest("windows", "window_start_us long, total long, fraud long, rate_per_s double",
                 ["window_start_us"], ["total", "fraud", "rate_per_s"])
COUNTS = sums("counts", "window_start_us long, risk_level string, model_used string, n long",
              ["window_start_us", "risk_level", "model_used"], ["n"])


def start_throughput(stream: DataFrame, base: str, width: str = "1 minute", delay: str = "1 day", label: str = "is_fraud",
                     trigger: dict | None = None):
    """F5 on a running stream: windows behind a watermark, kept in Spark's
    state until the watermark passes their end. A micro-batch emits the
    windows it changed (update mode), which replace what ``Log(WINDOWS, base +
    "/windows")`` had of them. Rows behind the watermark count nowhere (the late
    table of F4 has them)."""
    log = Log(WINDOWS, base + "/windows")
    w = (throughput(stream.withWatermark("ts", delay), width, label).writeStream.outputMode("update")
         .foreachBatch(lambda d, e: log.append(d, e)).option("checkpointLocation", base + "/ck"))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def score_counter_log(width: str = "1 hour") -> tuple[Table, Callable[[DataFrame], DataFrame]]:
    """F6 on a running stream, for ``logs`` of ``batched.start_stream_features``:
    an epoch adds its counts, levels of epochs are summed, so reading the
    counters costs no more as epochs go by and a batch run again counts once."""
    return COUNTS, lambda scored: stream_score_counters(scored, width)


def stream_score_counters(scored: DataFrame, width: str = "1 hour") -> DataFrame:
    """counts by (window, risk level, model) of a micro-batch; the running
    counters are the sums over epochs (``running_counters``)."""
    ts = F.col("ts") if "ts" in scored.columns else F.timestamp_micros("us")
    return scored.withColumn("ts", ts).groupBy(
        F.unix_micros(F.window("ts", width)["start"]).alias("window_start_us"), "risk_level", "model_used").agg(
        F.count(F.lit(1)).alias("n"))


def running_counters(counts: DataFrame) -> DataFrame:
    """the counters as of the last written epoch."""
    return counts.groupBy("window_start_us", "risk_level", "model_used").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------------------
# Replays: run a stream over files to completion (tests, registered query)
# ---------------------------------------------------------------------------

def replay_range(us: Column, lo: int, hi: int, n_files: int) -> Column:
    """Index 0..n-1 of equal event-time ranges between ``lo`` and ``hi``."""
    return F.floor((us - F.lit(lo)) * F.lit(n_files) / F.lit(hi - lo + 1)).cast("int")


def replay_ranges(txn: DataFrame, path: str, n_ranges: int = 4) -> DataFrame:
    """The transactions staged in parallel, parted by ``_r``, their range."""
    lo, hi = txn.agg(F.min("us"), F.max("us")).first()
    d = txn.withColumn("_r", replay_range(F.col("us"), lo or 0, hi or 0, n_ranges))
    d.write.mode("overwrite").partitionBy("_r").parquet(path)
    return txn.sparkSession.read.parquet(path)


def wire_records(d: DataFrame) -> DataFrame:
    """Transactions as the records of the wire format."""
    d = d.withColumn("timestamp", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    if "is_fraud" in d.columns:
        d = d.withColumn("is_fraud", F.col("is_fraud") == 1)
    return d.select(*[f.name for f in TXN_WIRE_SCHEMA.fields if f.name in d.columns])
