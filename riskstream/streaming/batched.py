"""The stream as ``foreachBatch`` over the chunked batch plans.

A user with a third of the traffic would put a third of each micro-batch and
a large history list into one state row of the state API. Here state is kept
in *tables* in the shared folder (``state.Table``: a part an epoch, merged by
levels) and every micro-batch runs the same skew-safe plans as D10:

* ``tail``      - the rows let in, by day, as far back as a window reaches;
* ``profile``   - users' profiles after an epoch: session start, count, mean, M2,
  last time, scores at the critical threshold in the session;
* ``merchant``  - (merchant, day) buckets of labelled rows and frauds. Days that
  no row on time can fall into any more are merged into one bucket;
* ``meta/epoch=E`` - the largest time seen and the manifest of the parts.

All 21 fields of D10 come out. A merchant's earlier rows are those of the tail from the
day before the batch's oldest row on time, taken exactly, and the buckets before that
day. The fraud history counts critical scores of earlier epochs, as
those of one micro-batch come out together; without a ``scorer`` it is 0.

An epoch reads only its own users' profiles, its own merchants' buckets and the
days it looks back to, and writes only its own rows. Expired days and merged
parts are removed. Re-running an epoch after a failure reads what the one
before it left and overwrites the same outputs; a missing earlier epoch raises.

Rows without a time, older than the watermark or than their user's last processed
row are late (F4): they go to the late table, so rows in = rows out + late rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DAY_US, DEFAULT, WEEK_US, Thresholds
from ..functions.scalar import amount_log, amount_zscore, temporal_features, velocity_score
from ..operators import history
from ..plans.chunked import KEY, join_windows, prefix_aggregate, prior_moments, window_aggregates
from ..session import delete_path
from .state import FANOUT, PARTS, Log, Part, Table, merge_levels, newest, numbered, remove

COLS = ["user_id", "transaction_id", "us", "amount", "latitude", "longitude", "merchant_id", "is_fraud"]
STATE = ["sess", "n", "mean", "m2", "last_us", "critical"]
META_SCHEMA = f"max_us long, parts {PARTS}, dropped array<string>"
COMPACT = FANOUT


def _day(us: Column) -> Column:
    return F.floor(us / F.lit(DAY_US)).cast("long")


def _tables(max_us: int | None, delay_us: int, t: Thresholds) -> dict[str, Table]:
    """The state tables; what their merges leave out or fold together is out
    of reach of all rows that can still be on time after ``max_us``."""
    on_time = None if max_us is None else max_us - delay_us
    profile = newest("profile", "user_id string, sess long, n long, mean double, m2 double, last_us long, critical long",
                     ["user_id"], STATE)

    def tail(d: DataFrame) -> DataFrame:
        return d if on_time is None else d.where(F.col("day") >= (on_time - WEEK_US) // DAY_US)

    def profiles(d: DataFrame) -> DataFrame:
        d = profile.merge(d)
        return d if on_time is None or t.profile_ttl_us is None else d.where(F.col("last_us") >= on_time - t.profile_ttl_us)

    def buckets(d: DataFrame) -> DataFrame:
        day = F.col("day") if on_time is None else F.greatest("day", F.lit(on_time // DAY_US - 2).cast("long"))
        return d.groupBy("merchant_id", day.alias("day")).agg(F.sum("known").alias("known"), F.sum("fraud").alias("fraud"))

    return {"tail": Table("tail", "user_id string, transaction_id string, us long, amount double, latitude double, "
                          "longitude double, merchant_id string, is_fraud int", tail, by_day=True),
            "profile": Table("profile", profile.schema, profiles),
            "merchant": Table("merchant", "merchant_id string, day long, known long, fraud long", buckets)}


def _merchant_features(d: DataFrame, src: DataFrame, closed: DataFrame) -> DataFrame:
    """D7b and D9 of the rows of ``d``: ``src`` has their merchants' rows from
    some day on, theirs included as ``_new``, ``closed`` the labelled sums before it."""
    w = window_aggregates(src, "merchant_id", "us", {"merchant_txn_count_24h": (DAY_US, 0)}, history._merchant_risk("is_fraud"), F.col("_new"))
    d = join_windows(d, "merchant_id", "us", w)
    c = closed.groupBy(F.col("merchant_id").alias("_cm")).agg(F.sum("known").alias("_ck"), F.sum("fraud").alias("_cf"))
    d = d.join(c, F.col("merchant_id").eqNullSafe(F.col("_cm")), "left")
    d = d.withColumn("_mf", F.col("_mf") + F.coalesce("_cf", F.lit(0))).withColumn("_mc", F.col("_mc") + F.coalesce("_ck", F.lit(0)))
    return history._risk_share(d).drop("_cm", "_ck", "_cf")


def process_batch(new: DataFrame, epoch: int, state: str, out_dir: str, late_dir: str,
                  delay_us: int = DAY_US, t: Thresholds = DEFAULT,
                  outputs: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
                  scorer: Callable[[DataFrame], DataFrame] | None = None, score_dir: str | None = None,
                  logs: dict[str, tuple[Table, Callable[[DataFrame], DataFrame]]] | None = None) -> None:
    """One micro-batch: features of the rows on time, late rows apart, new state.

    ``scorer`` makes scored rows of the features, written to ``score_dir``. From these (without one, from the
    features) come ``outputs`` (folder -> function of the rows) and ``logs``
    (folder -> table and function of the rows whose result is added to it)."""
    spark = new.sparkSession
    max_seen, parts, gone = None, [], []
    if epoch > 0:
        if epoch - 1 not in numbered(spark, f"{state}/meta"):
            raise RuntimeError(f"the state of epoch {epoch - 1} is missing under {state}")
        m = spark.read.schema(META_SCHEMA).parquet(f"{state}/meta/epoch={epoch - 1}").first()
        max_seen, parts, gone = m["max_us"], [Part(*p) for p in m["parts"]], m["dropped"]
    tables = _tables(max_seen, delay_us, t)

    held_rows: list[DataFrame] = []

    def kept(d: DataFrame) -> DataFrame:
        held_rows.append(d.persist())
        return d

    given = {c: F.col(c) if c in new.columns else F.lit(None) for c in COLS}
    given["is_fraud"] = given["is_fraud"].cast("int")
    given["merchant_id"] = given["merchant_id"].cast("string")
    rows = kept(new.select(*[x.alias(c) for c, x in given.items()]))   # each step reads the one before once
    try:
        users = rows.select(F.col("user_id").alias("_u")).distinct()
        own = F.col("user_id").eqNullSafe(F.col("_u"))
        prof = tables["profile"].merge(tables["profile"].read(spark, state, parts).join(users, own, "left_semi"))
        last = prof.select(F.col("user_id").alias("_pu"), F.col("last_us").alias("_last_us"))
        j = rows.join(last, F.col("user_id").eqNullSafe(F.col("_pu")), "left")
        late = F.col("us").isNull() | F.coalesce(F.col("us") < F.col("_last_us"), F.lit(False))
        if max_seen is not None:
            late = late | (F.col("us") < F.lit(max_seen - delay_us))
        j = j.withColumn("_late", late)
        j.filter("_late").select(*COLS).write.mode("overwrite").parquet(f"{late_dir}/epoch={epoch}")
        ontime = j.filter(~F.col("_late")).select(*COLS)

        least = rows.agg(F.min("us")).first()[0]
        if least is not None and max_seen is not None:
            least = max(least, max_seen - delay_us)
        tail = tables["tail"].read(spark, state, parts if least is not None else [])
        before = tail.where(F.col("day") >= (least - WEEK_US) // DAY_US) if least is not None else tail
        before = before.select(*COLS).join(users, own, "left_semi")

        # look-back features (D1, D2) over tail + new rows
        both = kept(before.withColumn("_new", F.lit(False)).unionByName(ontime.withColumn("_new", F.lit(True))))
        d = history._velocity(history._user_pass(both, t).filter("_new"), both, t, F.col("_new"))
        d = kept(d.select("*", *history._last_cols(t)))

        # running profile: sessions and prior moments over the new rows ...
        reset = F.col("_prev_us").isNull()
        d = prefix_aggregate(d, [KEY], "us", [("_s_new", F.when(reset, F.col("us")), "max")],
                             tiebreak=["transaction_id"], include_current=True)
        stored = prof.select(F.col("user_id").alias("_pu"), F.col("sess").alias("_s_old"), F.col("n").alias("_n0"),
                             F.col("mean").alias("_mean0"), F.col("m2").alias("_m20"), F.col("critical").alias("_crit0"))
        d = d.join(stored, F.col("user_id").eqNullSafe(F.col("_pu")), "left")
        d = kept(d.withColumn("_sess", F.coalesce("_s_new", "_s_old")))
        d = prior_moments(d, [KEY, "_sess"], "us", "amount", tiebreak=["transaction_id"], prefix="_pm")
        # ... merged with the stored profile when the stored session continues
        cont = F.col("_s_new").isNull() & F.col("_s_old").isNotNull()
        n0 = F.when(cont, F.col("_n0")).otherwise(F.lit(0)).cast("double")
        n1 = F.col("_pm_n").cast("double")
        n = n0 + n1
        m0 = F.coalesce(F.col("_mean0"), F.lit(0.0))
        m1 = F.coalesce(F.col("_pm_mean"), F.lit(0.0))
        delta = m1 - m0
        mean = F.when(n0 == 0, m1).when(n1 == 0, m0).otherwise(m0 + F.try_divide(delta * n1, n))
        m2 = (F.when(n0 == 0, F.col("_pm_m2")).when(n1 == 0, F.col("_m20"))
               .otherwise(F.col("_m20") + F.col("_pm_m2") + F.try_divide(delta * delta * n0 * n1, n)))
        d = (d.withColumn("user_txn_count_total", n.cast("long"))
              .withColumn("user_avg_amount", F.when(n > 0, mean).otherwise(F.lit(0.0)))
              .withColumn("_m2", F.when(n > 0, m2).otherwise(F.lit(0.0)))
              .withColumn("user_std_amount",
                          F.when(n > 1, F.sqrt(F.try_divide(F.col("_m2"), n))).otherwise(F.lit(0.0))))
        feats = d.select("user_id", "transaction_id", "us", "amount", "latitude", "longitude", "merchant_id", "is_fraud",
                         F.col("_sess").alias("sess"),
                         F.col("_m2").alias("m2"), "time_since_last_txn_seconds", "distance_from_last_txn_km",
                         "travel_speed_kmh", "is_impossible_travel", "txn_count_1h", "txn_count_24h", "txn_count_7d",
                         "total_amount_24h", "user_txn_count_total", "user_avg_amount", "user_std_amount",
                         F.when(cont, F.coalesce("_crit0", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("user_fraud_history_count"),
                         F.lit(False).alias("late"))

        # merchants: the day before the oldest row on time and later exactly, buckets before
        fresh = both.where("_new").select("merchant_id", "us", "is_fraud")
        shops = fresh.select(F.col("merchant_id").alias("_s")).distinct()
        same = F.col("merchant_id").eqNullSafe(F.col("_s"))
        first = 0 if least is None else least // DAY_US - 1
        near = tail.where(F.col("day") >= first).select("merchant_id", "us", "is_fraud").join(shops, same, "left_semi")
        closed = tables["merchant"].read(spark, state, parts).where(F.col("day") < first).join(shops, same, "left_semi")
        feats = _merchant_features(feats, near.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True))), closed)
        tf = temporal_features("us")
        feats = feats.select("*", amount_log("amount").alias("amount_log"),
                             amount_zscore("amount", "user_avg_amount", "user_std_amount").alias("amount_zscore"),
                             *[tf[c].alias(c) for c in ("hour_of_day", "day_of_week", "is_weekend")],
                             velocity_score("txn_count_1h", "txn_count_24h").alias("velocity_score"))
        feats.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
    finally:
        for d in held_rows:
            d.unpersist()

    # everything below reads what was just written (no recompute; lineage cut)
    done = spark.read.parquet(f"{out_dir}/epoch={epoch}")
    if scorer is not None:
        scorer(done).write.mode("overwrite").parquet(f"{score_dir}/epoch={epoch}")
        done = spark.read.parquet(f"{score_dir}/epoch={epoch}")
    for folder, build in (outputs or {}).items():
        build(done).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
    for folder, (table, build) in (logs or {}).items():
        Log(table, folder, COMPACT).append(build(done), epoch)
    batch_max = done.agg(F.max("us")).first()[0]
    new_max = max([v for v in (max_seen, batch_max) if v is not None], default=None)
    tables = _tables(new_max, delay_us, t)
    day = None if batch_max is None else batch_max // DAY_US
    added = [Part("tail", 0, epoch, day), Part("profile", 0, epoch), Part("merchant", 0, epoch)]
    tables["tail"].write(done.select(*COLS, _day(F.col("us")).alias("day")), state, added[0])
    tables["profile"].write(_after(done, t, scorer is not None), state, added[1])
    label = F.col("is_fraud")
    tables["merchant"].write(done.groupBy("merchant_id", _day(F.col("us")).alias("day")).agg(
        F.count(label).alias("known"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("fraud")), state, added[2])
    now = merge_levels(spark, state, [*parts, *added], list(tables.values()), epoch, COMPACT)
    if new_max is not None:
        reach = (new_max - delay_us - WEEK_US) // DAY_US
        now = [p for p in now if p.last_day is None or p.last_day >= reach]
    dropped = [p.path for p in [*parts, *added] if p not in now]
    spark.createDataFrame([(new_max, [astuple(p) for p in now], dropped)], META_SCHEMA).coalesce(1) \
         .write.mode("overwrite").parquet(f"{state}/meta/epoch={epoch}")
    remove(spark, state, [*gone, f"meta/epoch={epoch - 2}"])


def _after(done: DataFrame, t: Thresholds, scored: bool) -> DataFrame:
    """The profiles of an epoch's users after it."""
    hit = history._critical(t) if scored else F.lit(0).cast("long")
    at = F.struct("us", "transaction_id")
    g = done.groupBy("user_id", "sess").agg(
        F.max_by(F.struct("us", "amount", "sess", "user_txn_count_total", "user_avg_amount", "m2", "user_fraud_history_count"), at).alias("r"),
        F.max(at).alias("at"), F.sum(hit).alias("hits"))
    g = g.groupBy("user_id").agg(F.max_by(F.struct("r.*", "hits"), F.col("at")).alias("r"))
    x, k, mu = F.col("r.amount"), F.col("r.user_txn_count_total"), F.col("r.user_avg_amount")
    mean = mu + (x - mu) / (k + 1)
    return g.select("user_id", F.col("r.sess").alias("sess"), (k + 1).alias("n"), mean.alias("mean"),
                    (F.col("r.m2") + (x - mu) * (x - mean)).alias("m2"), F.col("r.us").alias("last_us"),
                    (F.col("r.user_fraud_history_count") + F.col("r.hits")).alias("critical"))


def start_stream_features(stream: DataFrame, base: str, delay_us: int = DAY_US, trigger: dict | None = None,
                          outputs: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
                          scorer: Callable[[DataFrame], DataFrame] | None = None,
                          logs: dict[str, tuple[Table, Callable[[DataFrame], DataFrame]]] | None = None):
    """Start the foreachBatch query; outputs under ``base``/out, ``base``/score
    and ``base``/<name of each output or log>, late rows under ``base``/late, state under
    ``base``/state, checkpoint ``base``/ck."""
    src = stream.select(*COLS)
    named = {f"{base}/{name}": build for name, build in (outputs or {}).items()}
    named_logs = {f"{base}/{name}": x for name, x in (logs or {}).items()}
    w = (src.writeStream.foreachBatch(
            lambda df, e: process_batch(df, e, base + "/state", base + "/out", base + "/late", delay_us, outputs=named,
                                        scorer=scorer, score_dir=base + "/score", logs=named_logs))
         .option("checkpointLocation", base + "/ck"))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def run_replay(spark: SparkSession, txn: DataFrame, base: str, order: list[int] | None = None, n_ranges: int = 2,
               outputs: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
               scorer: Callable[[DataFrame], DataFrame] | None = None,
               logs: dict[str, tuple[Table, Callable[[DataFrame], DataFrame]]] | None = None,
               before: Callable[[int], None] | None = None) -> None:
    """Replay ``txn`` through the stream: its equal ranges of event time, in
    ``order`` (default: time order), are written as JSON files in parallel and
    each processed by a restart of the query from its checkpoint. ``before`` is
    called with each range's number before it arrives."""
    from .stream import read_txn_stream, replay_ranges, wire_records
    staged = replay_ranges(txn, base + "/stage", n_ranges)
    for k in (order or range(n_ranges)):
        if before:
            before(k)
        wire_records(staged.filter(F.col("_r") == k)).write.mode("append").json(base + "/src")
        s = read_txn_stream(spark, "json", base + "/src")
        start_stream_features(s, base, trigger={"availableNow": True}, outputs=outputs, scorer=scorer, logs=logs).awaitTermination()
    delete_path(spark, base + "/stage")


def run_features_replay_batched(spark: SparkSession, txn: DataFrame, base: str,
                                order: list[int] | None = None) -> DataFrame:
    """The feature rows of all epochs of a replay (late rows are under
    ``base``/late)."""
    from .stream import FEATURE_SCHEMA
    run_replay(spark, txn, base, order)
    return spark.read.parquet(base + "/out").select(*[f.name for f in FEATURE_SCHEMA.fields])
