"""Properties: order invariance, window monotonicity, chunking = plain
windows on a hot key, stream = batch, SMOTE balance, split exactness."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskstream.config import Thresholds
from riskstream.operators import history, prep, smote
from riskstream.plans import chunked
from riskstream.sources import fixtures as fx

from .conftest import SF_SMALL


def test_shuffle_invariance(spark):
    t = fx.txn(spark, SF_SMALL, dense=True)
    a = history.point_in_time_features(t)
    b = history.point_in_time_features(t.repartition(7, "amount").orderBy(F.rand(3)))
    cols = ["transaction_id", "txn_count_1h", "txn_count_24h", "txn_count_7d", "user_txn_count_total"]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0


def test_window_monotone(spark):
    v = history.velocity_windows(fx.txn(spark, SF_SMALL, dense=True))
    assert v.filter("txn_count_1h > txn_count_24h OR txn_count_24h > txn_count_7d").count() == 0


def test_chunked_equals_plain_on_hot_key(spark):
    # one user holds every row: chunks must reproduce the per-user window
    t = fx.txn(spark, SF_SMALL).withColumn("user_id", F.lit("HOT"))
    p = chunked.prefix_aggregate(t, ["user_id"], "us", [("s", F.col("amount"), "sum")],
                                 tiebreak=["transaction_id"], chunk_us=3600 * 10**6)
    w = Window.partitionBy("user_id").orderBy("us", "transaction_id").rowsBetween(Window.unboundedPreceding, -1)
    q = t.withColumn("s2", F.coalesce(F.sum("amount").over(w), F.lit(0.0)))
    j = p.join(q.select("transaction_id", "s2"), "transaction_id")
    assert j.filter(F.abs(F.col("s") - F.col("s2")) > 1e-6).count() == 0
    m = chunked.prior_moments(t, ["user_id"], "us", "amount", ["transaction_id"], chunk_us=3600 * 10**6)
    q2 = t.withColumn("v", F.var_pop("amount").over(w)).withColumn("c", F.count("amount").over(w))
    j = m.join(q2.select("transaction_id", "v", "c"), "transaction_id")
    bad = j.filter((F.col("p_n") != F.col("c")) |
                   (F.abs(F.col("p_m2") / F.greatest(F.col("p_n"), F.lit(1)) - F.coalesce("v", F.lit(0.0))) > 1e-6))
    assert bad.count() == 0


def test_stratified_split_exact(spark):
    t = fx.txn(spark, SF_SMALL)
    s = prep.stratified_split(t, "is_fraud", F.col("transaction_id").substr(5, 20).cast("long"),
                              [("test", 0.2), ("validation", 0.1)])
    c = {(r["is_fraud"], r["split"]): r["n"] for r in s.groupBy("is_fraud", "split").count()
         .withColumnRenamed("count", "n").collect()}
    for cls in (0, 1):
        n = sum(v for (k, _), v in c.items() if k == cls)
        assert c.get((cls, "test"), 0) == int(n * 0.2 + 0.5)


def test_smote_balance_and_segment(spark):
    t = fx.txn(spark, SF_SMALL)
    feats = ["amount", "latitude", "longitude"]
    s = smote.smote(t, feats, "is_fraud", "transaction_id", 5)
    c = {(r["is_fraud"], r["synthetic"]): r["count"] for r in s.groupBy("is_fraud", "synthetic").count().collect()}
    assert c[(1, False)] + c[(1, True)] == c[(0, False)]
    # every synthetic point lies inside the minority bounding box
    mn = t.filter("is_fraud = 1").agg(*[F.min(f).alias(f) for f in feats]).first()
    mx = t.filter("is_fraud = 1").agg(*[F.max(f).alias(f) for f in feats]).first()
    syn = s.filter("synthetic")
    for f in feats:
        assert syn.filter((F.col(f) < mn[f] - 1e-9) | (F.col(f) > mx[f] + 1e-9)).count() == 0


def _batch_features(t):
    from riskstream.functions.scalar import r6
    b = history.velocity_windows(history.user_profile_running(history.last_txn_features(t)))
    return b.select("transaction_id", *[F.col(c).cast("long") for c in ("txn_count_1h", "txn_count_24h", "txn_count_7d", "user_txn_count_total")],
                    r6("user_std_amount").alias("sd"), r6("total_amount_24h").alias("s"))


def _same_columns(d):
    from riskstream.functions.scalar import r6
    return d.select("transaction_id", *[F.col(c).cast("long") for c in ("txn_count_1h", "txn_count_24h", "txn_count_7d", "user_txn_count_total")],
                    r6("user_std_amount").alias("sd"), r6("total_amount_24h").alias("s"))


def test_stream_equals_batch_across_restarts(spark, monkeypatch):
    """Each range of the replay restarts the query from its checkpoint in the
    shared folder; state is merged into a base on the way."""
    from riskstream.session import list_path, scratch_path
    from riskstream.streaming import batched
    monkeypatch.setattr(batched, "COMPACT", 2)
    t = fx.txn(spark, SF_SMALL)
    base = scratch_path(spark, "test-stream-replay")
    batched.run_replay(spark, t, base)
    got, want = _same_columns(spark.read.parquet(base + "/out")), _batch_features(t)
    assert got.count() == t.count() and got.exceptAll(want).count() == 0
    assert "epoch=1" in list_path(spark, base + "/state/profile-1")
    assert base == scratch_path(spark, "test-stream-replay")


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    from riskstream.streaming import batched
    t = fx.txn(spark, SF_SMALL)
    base = str(tmp_path / "late")
    batched.run_replay(spark, t, base, order=[0, 2, 1, 3], n_ranges=4)
    out, late = spark.read.parquet(base + "/out"), spark.read.parquet(base + "/late")
    assert late.count() > 0 and out.count() + late.count() == t.count()
    assert out.select("transaction_id").intersect(late.select("transaction_id")).count() == 0


def test_state_of_an_epoch_is_bounded_and_must_exist(spark, tmp_path):
    from riskstream.streaming import batched
    base = str(tmp_path / "state")
    t = fx.txn(spark, SF_SMALL).select(*batched.COLS)
    few = t.filter(F.col("user_id") == t.first()["user_id"])
    batched.process_batch(t, 0, base + "/state", base + "/out", base + "/late")
    later = few.withColumn("us", F.lit(t.agg(F.max("us")).first()[0] + 1)).limit(1)
    batched.process_batch(later, 1, base + "/state", base + "/out", base + "/late")
    for table in ("tail", "profile"):
        assert spark.read.parquet(f"{base}/state/{table}/epoch=1").count() == 1
    with pytest.raises(RuntimeError):
        batched.process_batch(later, 7, base + "/state", base + "/out", base + "/late")


def _plain(t, key):
    """Plain per-key windows, the ids' order and null keys as Spark has them."""
    H = 3600 * 10**6

    def rng(lo):
        return Window.partitionBy(key).orderBy("us").rangeBetween(-lo, -1)
    w = Window.partitionBy(key).orderBy("us", "transaction_id", "tag")
    n = F.count(F.lit(1))
    return t.select("tag", n.over(rng(H)).alias("a"), n.over(rng(24 * H)).alias("b"), n.over(rng(168 * H)).alias("c"),
                    F.coalesce(F.sum("amount").over(rng(24 * H)), F.lit(0.0)).alias("s"),
                    F.lag("us").over(w).alias("p"),
                    F.count(F.lit(1)).over(Window.partitionBy("merchant_id").orderBy("us").rangeBetween(-24 * H, -1)).alias("m"),
                    F.sum("is_fraud").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("f"))


def test_keyed_windows_equal_plain_ones(spark):
    """Null users and merchants, repeated ids, a user with a third of all rows."""
    n = F.monotonically_increasing_id()
    t = fx.txn(spark, SF_SMALL, dense=True).coalesce(1)
    t = (t.withColumn("tag", n).withColumn("user_id", F.when(n % 3 == 0, "HOT").when(n % 7 == 0, F.lit(None)).otherwise(F.col("user_id")))
          .withColumn("merchant_id", F.when(n % 3 == 1, F.lit(None)).otherwise(F.col("merchant_id")))
          .withColumn("transaction_id", F.when(n % 11 == 0, "SAME").otherwise(F.col("transaction_id"))))
    t = spark.createDataFrame(t.toPandas(), t.schema).repartition(4).cache()
    d = history.velocity_windows(history.user_fraud_history(history.merchant_txn_count_24h(t)))
    d = d.select("tag", "txn_count_1h", "txn_count_24h", "txn_count_7d", "total_amount_24h", "merchant_txn_count_24h", "user_fraud_history")
    last = history.last_txn_features(t, Thresholds(profile_ttl_us=None)).select("tag", "time_since_last_txn_seconds", "us")
    j = d.join(_plain(t, "user_id"), "tag").join(last, "tag").toPandas()
    assert len(j) == t.count()
    for got, want in (("txn_count_1h", "a"), ("txn_count_24h", "b"), ("txn_count_7d", "c"), ("merchant_txn_count_24h", "m")):
        assert (j[got] == j[want]).all(), got
    assert (j["total_amount_24h"] - j["s"]).abs().max() < 1e-6
    assert (j["user_fraud_history"] - j["f"].fillna(0)).abs().max() == 0
    assert ((j["us"] - j["p"]) / 1e6 - j["time_since_last_txn_seconds"]).abs().max() < 1e-6
    t.unpersist()


def test_asof_match_may_lie_any_time_back(spark):
    cols = "transaction_id string, user_id string, us long, latitude double, longitude double"
    req = spark.createDataFrame([("r1", "u", 40 * 86400 * 10**6, 0.0, 0.0), ("r2", None, 10, 0.0, 0.0)], cols)
    hist = spark.createDataFrame([("h1", "u", 10 * 86400 * 10**6, 1.0, 0.0), ("h2", None, 4, 0.0, 0.0), ("h3", None, 10, 0.0, 0.0)], cols)
    got = {r.transaction_id: r.time_since_last_txn_seconds for r in
           history.asof_last_txn(req, hist, Thresholds(profile_ttl_us=None)).collect()}
    assert got == {"r1": 30 * 86400.0, "r2": 6e-6}


def test_building_a_plan_runs_no_job(spark):
    t = fx.txn(spark, SF_SMALL)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    history.point_in_time_features(t)
    assert len(tracker.getJobIdsForGroup(None)) == before


@pytest.mark.parametrize("ttl", [None, 20 * 60 * 10**6, 24 * 3600 * 10**6])
def test_one_user_pass_equals_a_plain_loop(spark, ttl):
    """Previous row, session, moments and fraud count of the merged pass: users
    with gaps around the TTL and within one chunk, null users and null amounts."""
    import random

    from riskstream.config import DEFAULT
    from dataclasses import replace
    rnd, rows, us = random.Random(3), [], 10**15
    for i in range(400):
        us += rnd.choice([0, 10**6, 19 * 60 * 10**6, 20 * 60 * 10**6, 3600 * 10**6, 30 * 3600 * 10**6])
        rows.append((rnd.choice(["a", "a", "b", None]), f"T{i:04d}", us, rnd.choice([1.0, 7.5, 300.0, None]), float(i % 50), float(i % 70), rnd.choice([0, 1])))
    d = spark.createDataFrame(rows, "user_id string, transaction_id string, us long, amount double, latitude double, longitude double, c long")
    got = {r["transaction_id"]: r for r in history._user_profile_pass(d, replace(DEFAULT, profile_ttl_us=ttl), F.col("c")).collect()}
    state = {}
    for u, i, at, x, lat, lon, c in rows:
        last, sess, xs, hits = state.get(u, (None, None, [], 0))
        if last is None or (ttl is not None and at - last[0] >= ttl):
            last, sess, xs, hits = None, at, [], 0
        r, n = got[i], len(xs)
        assert (r["_prev_us"], r["_prev_lat"], r["_prev_lon"]) == (last or (None, None, None))
        assert r["user_txn_count_total"] == n and r["user_fraud_history_count"] == hits
        mean = sum(xs) / n if n else 0.0
        assert abs(r["user_avg_amount"] - mean) < 1e-9
        sd = (sum((v - mean) ** 2 for v in xs) / n) ** 0.5 if n > 1 else 0.0
        assert abs(r["user_std_amount"] - sd) < 1e-6
        assert r["first_seen_us"] == (sess if n else at)
        state[u] = ((at, lat, lon), sess, xs + ([x] if x is not None else []), hits + c)
