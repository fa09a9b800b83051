"""Point-in-time history features per user and merchant.

Conventions: ``us`` = epoch microseconds; per-user order ``(us,
transaction_id)``; "prior" = strictly earlier ``us`` for RANGE frames and the
preceding row for ROWS frames. All per-key windows run through the skew-safe
plans in ``plans.chunked``: one plan for every key, cut into chunks of event
time. Rows without a key are one key; ids may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY_US, DEFAULT, HOUR_US, WEEK_US, Thresholds
from ..functions.geo import haversine_km, impossible_travel, travel_speed_kmh
from ..functions.scalar import amount_log, amount_zscore, temporal_features, velocity_score
from ..plans import chunked
from ..plans.chunked import (CHUNK, HALO, HOME, KEY, global_lag, join_windows, prefix_aggregate, prior_moments,
                             window_aggregates, with_chunks)

USER, ID, TS = "user_id", "transaction_id", "us"

# Row-chunk size for ROWS frames of the training-style features.
ROW_CHUNK = 100_000


def _keep_home(df: DataFrame) -> DataFrame:
    """Drop halo copies but keep the home chunk as ``_chunk``."""
    return df.filter(~F.col(HALO)).drop(HOME, HALO)


def _user_pass(df: DataFrame, t: Thresholds) -> DataFrame:
    """Previous row of each user within the TTL.

    Adds ``_prev_us/_prev_lat/_prev_lon`` (null when there is none) and keeps
    ``_key`` and ``_chunk`` for the steps that follow on the same partitioning.
    """
    d = with_chunks(df.withColumnRenamed("latitude", "_lat0").withColumnRenamed("longitude", "_lon0"), USER, TS)
    d = global_lag(d, [KEY], TS, ["_lat0", "_lon0"], tiebreak=[ID], prefix="_p_")
    has = F.col("_p_us").isNotNull()
    if t.profile_ttl_us is not None:
        has = has & ((F.col(TS) - F.col("_p_us")) < F.lit(t.profile_ttl_us))
    keep = [F.col(c) for c in d.columns if not c.startswith("_p_") and c not in ("_lat0", "_lon0")]
    return d.select(*keep, F.col("_lat0").alias("latitude"), F.col("_lon0").alias("longitude"),
                    F.when(has, F.col("_p_us")).alias("_prev_us"),
                    F.when(has, F.col("_p__lat0")).alias("_prev_lat"),
                    F.when(has, F.col("_p__lon0")).alias("_prev_lon"))


def _velocity(d: DataFrame, df: DataFrame, t: Thresholds, asks: Column | None = None) -> DataFrame:
    """The trailing 1 h / 24 h / 7 d windows of ``df`` at the rows of ``d``
    (which came through ``_user_pass``), or at those that ``asks`` names."""
    counts = {"txn_count_1h": (HOUR_US, 0), "txn_count_24h": (DAY_US, 0), "txn_count_7d": (WEEK_US, 0)}
    src = df.select(USER, TS, "amount", *([] if asks is None else [asks.alias("_asked")]))
    asked = None if asks is None else F.col("_asked")
    d = join_windows(d, USER, TS, window_aggregates(src, USER, TS, counts, {"total_amount_24h": (F.col("amount"), DAY_US, 0)}, asked))
    if t.history_ttl_us:
        # F5 literal: the history set is trimmed at each record, so "7 d" is
        # the size of the set (t_prev - ttl, t_prev] as it was at t_prev.
        held = window_aggregates(src, USER, TS, {"_set_size": (t.history_ttl_us - 1, 1)})
        d = join_windows(d, USER, "_prev_us", held)
        d = d.withColumn("txn_count_7d", F.coalesce("_set_size", F.lit(0)).cast("long")).drop("_set_size")
    return d


def _last_cols(t: Thresholds) -> list[Column]:
    """D1 columns from ``_prev_*`` (zeros when there is no previous row)."""
    has = F.col("_prev_us").isNotNull()
    dt = F.when(has, (F.col(TS) - F.col("_prev_us")) / 1e6).otherwise(F.lit(0.0))
    dist = F.when(has, haversine_km("_prev_lat", "_prev_lon", "latitude", "longitude")) \
            .otherwise(F.lit(0.0))
    return [dt.alias("time_since_last_txn_seconds"),
            dist.alias("distance_from_last_txn_km"),
            F.when(has, travel_speed_kmh(dist, dt)).otherwise(F.lit(0.0)).alias("travel_speed_kmh"),
            F.when(has, impossible_travel(dist, dt, t.max_speed_kmh)).otherwise(F.lit(False))
             .alias("is_impossible_travel")]


def _user_profile_pass(df: DataFrame, t: Thresholds, critical: Column | None = None) -> DataFrame:
    """D1, D3 and, given ``critical`` (1 where a row counts), D8b in one pass.

    A chunk is no longer than the TTL, so no session starts inside one: a
    chunk's last row, first time, moments and counts are all that later chunks need. One aggregate makes
    them, one table of a row a chunk finds previous rows and sessions and adds up what came before in the
    session, and one join gives that back to the rows, which move once.

    Adds ``_prev_us/_prev_lat/_prev_lon`` (null when there is none within the TTL) and the profile
    before the row; ``user_fraud_history_count`` with ``critical``.
    """
    ttl = t.profile_ttl_us
    if ttl is not None and ttl <= 0:
        raise ValueError("the profile's TTL must be positive")
    chunk_us = chunked.CHUNK_US if ttl is None else min(chunked.CHUNK_US, ttl)
    x, pos = F.col("amount"), F.struct(F.col(TS).alias("us"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    d = with_chunks(df if critical is None else df.withColumn("_crit", critical), USER, TS, chunk_us)
    crit = F.col("_crit") if critical is not None else F.lit(0).cast("long")

    w = Window.partitionBy(KEY, CHUNK).orderBy(TS, ID)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    n_l = F.count(x).over(before)
    rows = d.select("*", F.lag(pos).over(w).alias("_lp"), n_l.alias("_ln"), F.avg(x).over(before).alias("_lmean"),
                    (F.coalesce(F.var_pop(x).over(before), F.lit(0.0)) * n_l).alias("_lm2"),
                    F.coalesce(F.sum(crit).over(before), F.lit(0)).alias("_lc"))

    c = d.groupBy(KEY, CHUNK).agg(
        F.min(TS).alias("_first"), F.max_by(pos, F.struct(TS, ID)).alias("_last"), F.count(x).alias("_tn"), F.avg(x).alias("_tmean"),
        (F.coalesce(F.var_pop(x), F.lit(0.0)) * F.count(x)).alias("_tm2"), F.sum(crit).alias("_tc"))
    wk = Window.partitionBy(KEY).orderBy(CHUNK)
    c = c.withColumn("_cp", F.lag("_last").over(wk))
    reset = F.col("_cp").isNull()
    if ttl is not None:
        reset = reset | (F.col("_first") - F.col("_cp.us") >= F.lit(ttl))
    c = c.withColumn("_reset", reset)
    c = c.withColumn("_sess", F.max(F.when(F.col("_reset"), F.col("_first"))).over(
        wk.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ws = Window.partitionBy(KEY, "_sess").orderBy(CHUNK)
    prev = ws.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_ref", F.first("_tmean", ignorenulls=True).over(
        ws.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    dev = F.col("_tmean") - F.col("_ref")
    c = c.select(F.col(KEY).alias("_jk"), F.col(CHUNK).alias("_jc"), "_sess", "_ref", F.when(~F.col("_reset"), F.col("_cp")).alias("_cp"),
                 F.sum("_tn").over(prev).alias("_on"), F.sum(F.col("_tn") * dev).over(prev).alias("_os"),
                 F.sum(F.col("_tn") * dev * dev).over(prev).alias("_oq"), F.sum("_tm2").over(prev).alias("_om2"),
                 F.sum("_tc").over(prev).alias("_oc"))
    j = rows.join(c, (F.col(KEY) == F.col("_jk")) & (F.col(CHUNK) == F.col("_jc")), "left")

    n, mean, m2 = chunked.merged_moments()
    j = j.withColumn("_p", F.coalesce("_lp", "_cp")).withColumn("_n", n.cast("long")).withColumn("_m2", m2)
    keep = [F.col(name) for name in df.columns]
    std = F.when(F.col("_n") > 1, F.sqrt(F.try_divide(F.greatest(F.lit(0.0), F.col("_m2")), F.col("_n").cast("double")))).otherwise(F.lit(0.0))
    out = [F.col("_p.us").alias("_prev_us"), F.col("_p.lat").alias("_prev_lat"), F.col("_p.lon").alias("_prev_lon"),
           F.col("_n").alias("user_txn_count_total"),
           F.coalesce(F.when(n > 0, mean), F.lit(0.0)).alias("user_avg_amount"), std.alias("user_std_amount"),
           F.when(F.col("_n") > 0, F.col("_sess")).otherwise(F.col(TS)).alias("first_seen_us"),
           F.when(F.col("_n") > 0, F.col("_p.us")).otherwise(F.col(TS)).alias("last_seen_us")]
    if critical is not None:
        out.append((F.col("_lc") + F.coalesce("_oc", F.lit(0))).cast("long").alias("user_fraud_history_count"))
    return j.select(*keep, *out)


def _finish(d: DataFrame, cols: list[str]) -> DataFrame:
    return d.drop(*[c for c in d.columns if c.startswith("_")]).select(*cols) if cols else \
        d.drop(*[c for c in d.columns if c.startswith("_")])


# ---------------------------------------------------------------------------
# Public operators
# ---------------------------------------------------------------------------

def last_txn_features(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Previous transaction of the user within the TTL (as-of)."""
    d = _user_pass(df, t)
    return _finish(d.select("*", *_last_cols(t)), [])


def velocity_windows(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """D2 (and D2b when ``t.history_ttl_us`` is set): prior counts in the
    trailing 1 h / 24 h / 7 d and prior amount in 24 h."""
    return _finish(_velocity(_user_pass(df, t), df, t), [])


def velocity_windows_ttl(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Literal reading where the history set is trimmed to 24 h."""
    from dataclasses import replace
    return velocity_windows(df, replace(t, history_ttl_us=DAY_US))


def user_profile_running(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """D3: count, mean, population std, first/last seen before the row,
    restarting after a gap of at least the profile TTL."""
    return _finish(_user_profile_pass(df, t), [])


def user_profile_snapshot(df: DataFrame, t: Thresholds = DEFAULT,
                          scores: DataFrame | None = None) -> DataFrame:
    """The profile after each user's last transaction (one row per user).

    Aggregates the last session only; ``max_by`` keeps the groupBy
    partial-aggregated, so a hot user never lands whole in one task. With
    ``scores`` (transaction_id, fraud_probability), ``fraud_count`` has the
    session's transactions scored at the critical threshold or above; without
    it none are.
    """
    src = df.select(USER, ID, TS, "amount", "latitude", "longitude")
    if scores is not None:
        src = _with_scores(src, scores)
    else:
        src = src.withColumn("fraud_probability", F.lit(None).cast("double"))
    d = _user_pass(src, t)
    d = prefix_aggregate(d, [KEY], TS, [("_sess", F.when(F.col("_prev_us").isNull(), F.col(TS)), "max")],
                         tiebreak=[ID], include_current=True)
    last_sess = d.groupBy(KEY).agg(F.max("_sess").alias("_last_sess"))
    cur = d.join(last_sess, KEY).filter(F.col("_sess") == F.col("_last_sess"))
    return cur.groupBy(USER).agg(
        F.count(F.lit(1)).alias("txn_count_total"),
        F.avg("amount").alias("avg_amount"),
        F.coalesce(F.stddev_pop("amount"), F.lit(0.0)).alias("std_amount"),
        (F.coalesce(F.var_pop("amount"), F.lit(0.0)) * F.count(F.lit(1))).alias("m2"),
        F.min(TS).alias("first_seen_us"),
        F.max(TS).alias("last_seen_us"),
        F.sum(_critical(t)).alias("fraud_count"))


def _critical(t: Thresholds, p_col: str = "fraud_probability") -> Column:
    return F.when(F.col(p_col) >= t.critical, 1).otherwise(0).cast("long")


def _with_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Left join of the scores; an id scored more than once counts with its
    highest score, so no row is multiplied."""
    s = scores.groupBy(ID).agg(F.max("fraud_probability").alias("fraud_probability"))
    return df.drop("fraud_probability").join(s, ID, "left")


def merchant_txn_count_24h(df: DataFrame, window_us: int = DAY_US) -> DataFrame:
    """Prior transactions of the merchant in the trailing 24 h."""
    w = window_aggregates(df.select("merchant_id", TS), "merchant_id", TS, {"merchant_txn_count_24h": (window_us, 0)})
    return join_windows(df, "merchant_id", TS, w)


def _merchant_risk(label: str) -> dict:
    known = F.when(F.col(label).isNotNull(), 1).otherwise(0)
    return {"_mf": (F.col(label).cast("long"), None, 0), "_mc": (known, None, 0)}


def _risk_share(d: DataFrame) -> DataFrame:
    share = F.when(F.col("_mc") > 0, F.try_divide(F.col("_mf"), F.col("_mc"))).otherwise(F.lit(0.5))
    return d.withColumn("merchant_risk_score", share).drop("_mf", "_mc")


def merchant_risk_prior(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Fraud share of the merchant's strictly earlier rows, 0.5 if none."""
    w = window_aggregates(df.select("merchant_id", TS, label), "merchant_id", TS, {}, _merchant_risk(label))
    return _risk_share(join_windows(df, "merchant_id", TS, w))


def user_fraud_history(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """The user's labelled frauds before this row (cumsum minus own)."""
    d = prefix_aggregate(with_chunks(df, USER, TS), [KEY], TS,
                         [("user_fraud_history", F.col(label).cast("long"), "sum")], tiebreak=[ID], frame="rows")
    return d.drop(KEY, CHUNK)


def user_fraud_history_scored(scored: DataFrame, t: Thresholds = DEFAULT,
                              user: str = USER, id_col: str = ID,
                              p_col: str = "fraud_probability") -> DataFrame:
    """Prior scores >= the critical threshold in the same gap session."""
    d = with_chunks(scored, user, TS)
    keys = [KEY]
    if t.profile_ttl_us is not None:
        d = global_lag(d, [KEY], TS, [], tiebreak=[id_col], prefix="_p_")
        reset = F.col("_p_us").isNull() | ((F.col(TS) - F.col("_p_us")) >= F.lit(t.profile_ttl_us))
        d = prefix_aggregate(d, [KEY], TS, [("_sess", F.when(reset, F.col(TS)), "max")],
                             tiebreak=[id_col], include_current=True)
        keys = [KEY, "_sess"]
    d = prefix_aggregate(d, keys, TS, [("user_fraud_history_count", _critical(t, p_col), "sum")],
                         tiebreak=[id_col], frame="rows")
    return d.drop("_sess", "_p_us", KEY, CHUNK)


def point_in_time_features(df: DataFrame, t: Thresholds = DEFAULT,
                           scores: DataFrame | None = None,
                           label: str | None = "is_fraud") -> DataFrame:
    """The full 21-field feature row, each value as of just before the
    transaction. The user steps but the windows are one pass.

    ``scores`` (transaction_id, fraud_probability) feeds D8b; without it the
    count is 0.
    """
    if scores is not None:
        d = _user_profile_pass(_with_scores(df, scores), t, _critical(t)).drop("fraud_probability")
    else:
        d = _user_profile_pass(df, t).withColumn("user_fraud_history_count", F.lit(0).cast("long"))
    d = d.select("*", *_last_cols(t))
    d = _finish(_velocity(d, df, t), [])
    # both merchant features come from one pass over (merchant, time)
    known = bool(label) and label in df.columns
    src = df.select("merchant_id", TS, *([label] if known else []))
    d = join_windows(d, "merchant_id", TS, window_aggregates(
        src, "merchant_id", TS, {"merchant_txn_count_24h": (DAY_US, 0)}, _merchant_risk(label) if known else {}))
    d = _risk_share(d) if known else d.withColumn("merchant_risk_score", F.lit(0.5))
    tf = temporal_features(TS)
    return d.select("*", amount_log("amount").alias("amount_log"),
                    amount_zscore("amount", "user_avg_amount", "user_std_amount").alias("amount_zscore"),
                    tf["hour_of_day"].alias("hour_of_day"), tf["day_of_week"].alias("day_of_week"),
                    tf["is_weekend"].alias("is_weekend"),
                    velocity_score("txn_count_1h", "txn_count_24h").alias("velocity_score"))


# ---------------------------------------------------------------------------
# Training-style features (D4-D8, D11): row-count windows and whole-table
# statistics, kept as separate named operators.
# ---------------------------------------------------------------------------

def _row_index(df: DataFrame) -> DataFrame:
    """0-based position of the row in its user's (us, id) order."""
    return prefix_aggregate(with_chunks(df, USER, TS), [KEY], TS, [("_idx", F.lit(1).cast("long"), "sum")],
                            tiebreak=[ID], frame="rows").drop(CHUNK)


def rolling_rows_features(df: DataFrame, sum_rows: int = 50) -> DataFrame:
    """Rows in the last 10 / 50 / 100 (incl. self), sum of the last 50
    amounts (incl. self). Counts follow from the row index; the sum uses a
    row-chunk halo so a hot user is split across tasks."""
    d = _row_index(df)
    look = sum_rows - 1
    home = (F.col("_idx") / ROW_CHUNK).cast("long")
    last = ((F.col("_idx") + look) / ROW_CHUNK).cast("long")
    d = (d.withColumn(HOME, home)
          .withColumn(CHUNK, F.explode(F.sequence(home, last)))
          .withColumn(HALO, F.col(CHUNK) != F.col(HOME)))
    w = Window.partitionBy(KEY, CHUNK).orderBy("_idx").rowsBetween(-look, 0)
    d = d.withColumn("total_amount_24h", F.sum("amount").over(w))
    d = _keep_home(d)
    n = F.col("_idx") + 1
    d = (d.withColumn("txn_count_1h", F.least(n, F.lit(10)))
          .withColumn("txn_count_24h", F.least(n, F.lit(50)))
          .withColumn("txn_count_7d", F.least(n, F.lit(100))))
    return _finish(d, [])


def user_stats_join(df: DataFrame) -> DataFrame:
    """Whole-table mean, sample std (null -> 0) and count per user,
    joined back, plus the z-score against them. The per-user aggregate is
    partial-aggregated; AQE splits a skewed join partition."""
    stats = df.groupBy(USER).agg(
        F.avg("amount").alias("user_avg_amount"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("user_std_amount"),
        F.count(F.lit(1)).alias("user_txn_count"))
    d = df.join(stats, USER, "left")
    return d.withColumn("amount_zscore", amount_zscore("amount", "user_avg_amount", "user_std_amount"))


def consecutive_travel(df: DataFrame) -> DataFrame:
    """Distance and time to the previous row (no TTL); training speed
    uses a constant 3600 s step (literal), impossible = speed > 1200."""
    d = global_lag(with_chunks(df, USER, TS), [KEY], TS, ["latitude", "longitude"], tiebreak=[ID], prefix="_p_")
    has = F.col("_p_us").isNotNull()
    dist = F.when(has, haversine_km("_p_latitude", "_p_longitude", "latitude", "longitude")) \
            .otherwise(F.lit(0.0))
    d = (d.withColumn("distance_from_last", dist)
          .withColumn("time_since_last_txn",
                      F.when(has, (F.col(TS) - F.col("_p_us")) / 1e6).otherwise(F.lit(0.0)))
          .withColumn("travel_speed", F.when(has, dist / F.lit(1.0)).otherwise(F.lit(0.0)))
          .withColumn("is_impossible_travel", (F.col("travel_speed") > 1200).cast("int")))
    return _finish(d, [])


def merchant_risk_join(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Whole-table fraud mean per merchant, left-joined; missing -> 0.5."""
    m = df.groupBy("merchant_id").agg(F.avg(F.col(label)).alias("merchant_risk_score"))
    return (df.join(m, "merchant_id", "left")
              .withColumn("merchant_risk_score", F.coalesce("merchant_risk_score", F.lit(0.5))))


def training_features(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """The training-style feature table (C4-C7 + D4-D8)."""
    tf = temporal_features(TS)
    d = (df.withColumn("amount_log", amount_log("amount"))
           .withColumn("hour_of_day", tf["hour_of_day"])
           .withColumn("day_of_week", tf["day_of_week"])
           .withColumn("is_weekend", tf["is_weekend"].cast("int")))
    d = user_stats_join(d)
    d = rolling_rows_features(d)
    d = d.withColumn("velocity_score", velocity_score("txn_count_1h", "txn_count_24h", clip_low=True))
    d = consecutive_travel(d)
    d = merchant_risk_join(d, label)
    d = user_fraud_history(d, label)
    return d


def asof_last_txn(requests: DataFrame, history_df: DataFrame, t: Thresholds = DEFAULT,
                  key: str = USER) -> DataFrame:
    """For each request row, the user's last *history* row strictly
    before it (within the TTL) - an as-of join without an inequality join.

    Both sides are unioned; the match is the largest (time, id) among the
    history rows of strictly earlier time, a running maximum over the chunked
    key. Without a TTL it may lie any time back.
    """
    point = "struct<us:long,id:string,lat:double,lon:double>"
    req = requests.select(key, F.col(ID).alias("_rid"), TS, "latitude", "longitude", F.lit(True).alias("_asks"),
                          F.lit(None).cast(point).alias("_h"))
    hist = history_df.select(key, F.lit(None).cast("string").alias("_rid"), TS, "latitude", "longitude",
                             F.lit(False).alias("_asks"),
                             F.struct(F.col(TS).cast("long").alias("us"), F.col(ID).cast("string").alias("id"),
                                      F.col("latitude").cast("double").alias("lat"),
                                      F.col("longitude").cast("double").alias("lon")).alias("_h"))
    u = prefix_aggregate(with_chunks(req.unionByName(hist), key, TS), [KEY], TS, [("_m", F.col("_h"), "max")], frame="range")
    u = u.filter("_asks")
    has = F.col("_m").isNotNull()
    if t.profile_ttl_us is not None:
        has = has & ((F.col(TS) - F.col("_m.us")) < F.lit(t.profile_ttl_us))
    u = (u.withColumn("_prev_us", F.when(has, F.col("_m.us")))
          .withColumn("_prev_lat", F.when(has, F.col("_m.lat")))
          .withColumn("_prev_lon", F.when(has, F.col("_m.lon"))))
    out = u.select(F.col("_rid").alias(ID), key, TS, "latitude", "longitude", "_prev_us",
                   "_prev_lat", "_prev_lon")
    return _finish(out.select("*", *_last_cols(t)), [])
