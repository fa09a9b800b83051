"""State of the stream: merchants, models replaced while it runs, levels."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskstream.operators import history, training
from riskstream.operators.boosting import Booster
from riskstream.operators.scoring import hybrid_score
from riskstream.plans.queries import D10_OUT, _d10_out
from riskstream.plans.sample_model import STREAM_MODEL
from riskstream.session import list_path
from riskstream.sources import fixtures as fx
from riskstream.streaming import batched, models, state, stream as st

from .conftest import SF_SMALL


def _feed(t, base, cuts, **more):
    """Epochs of ``t`` cut at times, without files in between."""
    edges = [None, *cuts, None]
    for e, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = t if lo is None else t.where(F.col("us") >= lo)
        part = part if hi is None else part.where(F.col("us") < hi)
        batched.process_batch(part, e, base + "/state", base + "/out", base + "/late", **more)


def _cuts(t, n):
    lo, hi = t.agg(F.min("us"), F.max("us")).first()
    return [lo + (hi - lo) * k // n for k in range(1, n)]


def test_all_fields_equal_the_batch_over_merged_levels(spark, tmp_path, monkeypatch):
    """Five epochs with two parts a level: tail, profiles and merchant buckets
    go through three levels; null merchants, unknown labels and rows of equal time."""
    monkeypatch.setattr(batched, "COMPACT", 2)
    k = F.substring("transaction_id", 5, 20).cast("long")
    t = fx.txn(spark, SF_SMALL).withColumn("merchant_id", F.when(k % 5 > 0, F.concat(F.lit("M"), (k % 3).cast("string")))) \
        .withColumn("is_fraud", F.when(k % 7 > 0, F.col("is_fraud")))
    base = str(tmp_path)
    _feed(t, base, _cuts(t, 5))
    got = _d10_out(spark.read.parquet(base + "/out"))
    want = _d10_out(history.point_in_time_features(t))
    assert got.count() == want.count() == t.count()
    assert got.exceptAll(want).count() == 0
    assert {"merchant-1", "merchant-2", "profile-2"} <= set(list_path(spark, base + "/state"))


def test_merchants_out_of_order_see_earlier_rows_only(spark, tmp_path):
    """Rows of other users that are older but on time: they see the merchant's
    earlier rows alone, those processed before them that are newer do not count."""
    h, day = 3600 * 10**6, 24 * 3600 * 10**6
    rows = [[("a", "1", 10 * day, 1), ("b", "2", 10 * day + 5 * h, 0)],
            [("c", "3", 10 * day + 2 * h, 1), ("d", "4", 9 * day + 6 * h, 0)],
            [("e", "5", 10 * day + 6 * h, 0), ("f", "6", 9 * day + 1, 0)]]
    for e, part in enumerate(rows):
        d = spark.createDataFrame([(u, i, us, 1.0, 0.0, 0.0, "m", y) for u, i, us, y in part],
                                  "user_id string, transaction_id string, us long, amount double, latitude double, "
                                  "longitude double, merchant_id string, is_fraud int")
        batched.process_batch(d, e, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/late")
    got = {r["transaction_id"]: (r["merchant_txn_count_24h"], round(r["merchant_risk_score"], 6))
           for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # row 6 is more than a day older than row 2 and late; row 3 does not see row 2, which is
    # newer; the window of row 5 starts at row 4, which is in it
    assert got == {"1": (0, 0.5), "2": (1, 1.0), "3": (2, 0.5), "4": (0, 0.5), "5": (4, 0.5)}
    assert [r["transaction_id"] for r in spark.read.parquet(f"{tmp_path}/late").collect()] == ["6"]


def test_rows_without_time_are_late_and_an_empty_epoch_passes(spark, tmp_path):
    t = fx.txn(spark, SF_SMALL).limit(20)
    base = str(tmp_path)
    batched.process_batch(t.limit(0), 0, base + "/state", base + "/out", base + "/late")
    batched.process_batch(t.withColumn("us", F.when(F.col("transaction_id") > "TXN_0000000005", F.col("us"))), 1,
                          base + "/state", base + "/out", base + "/late")
    batched.process_batch(t.limit(0), 2, base + "/state", base + "/out", base + "/late")
    out, late = spark.read.parquet(base + "/out"), spark.read.parquet(base + "/late")
    assert out.count() + late.count() == 20 and late.where("us is null").count() == late.count()


def _model(version, shift):
    trees = [type(t)(**{**t.__dict__}) for t in STREAM_MODEL["trees"]]
    trees[0].value = [v + shift for v in trees[0].value]
    return training.BoostedModel(Booster(STREAM_MODEL["columns"], STREAM_MODEL["cuts"], trees), version=version)


def test_model_replaced_between_epochs(spark, tmp_path):
    """No model, then two versions; each epoch equals the batch with the model
    it found, given the critical scores of the epochs before it."""
    t = fx.txn(spark, SF_SMALL)
    folder, base = f"{tmp_path}/models", f"{tmp_path}/run"
    v1, v2 = _model("v1", 0.5), _model("v2", 1.5)
    score, cuts = models.folder_scorer(folder), _cuts(t, 3)
    edges = [0, *cuts, 1 << 60]
    for e in range(3):
        if e:
            models.publish(spark, [v1, v2][e - 1], folder, e)
        batched.process_batch(t.where(F.col("us").between(edges[e], edges[e + 1] - 1)), e, base + "/state", base + "/out",
                              base + "/late", scorer=score, score_dir=base + "/score")
    with pytest.raises(ValueError):
        models.publish(spark, v1, folder, 1)
    got = spark.read.parquet(base + "/score").toPandas().set_index("transaction_id").sort_index()
    b = history.point_in_time_features(t).cache()
    fallback = hybrid_score(b)
    byver = {"rule-based-v1": fallback, "v1": hybrid_score(v1.predict_proba(b), model_version="v1"),
             "v2": hybrid_score(v2.predict_proba(b), model_version="v2")}
    for e, (ver, want) in enumerate(byver.items()):
        w = want.where(F.col("us").between(edges[e], edges[e + 1] - 1)).toPandas().set_index("transaction_id").sort_index()
        g = got[got["model_version"] == ver]
        assert len(g) and list(g.index) == list(w.index)
        assert (g["fraud_probability"] - w["fraud_probability"]).abs().max() < 1e-9
        assert (g["model_used"] == w["model_used"]).all()
    # fraud history by plain Python: critical scores of the user's session in earlier epochs
    got = got.reset_index().sort_values(["user_id", "us", "transaction_id"])
    seen, bad, some = {}, 0, 0
    got["epoch"] = [sum(u >= c for c in cuts) for u in got["us"]]
    for r in got.itertuples():
        last, hits = seen.get(r.user_id, (None, []))
        if last is None or r.us - last >= 24 * 3600 * 10**6:
            hits = []
        want = sum(e < r.epoch for e in hits)
        some += want > 0
        bad += want != r.user_fraud_history_count
        seen[r.user_id] = (r.us, hits + [r.epoch] * (r.fraud_probability >= 0.85))
    assert bad == 0 and (got["fraud_probability"] >= 0.85).any()


def test_log_levels_stay_logarithmic_and_a_repeated_epoch_counts_once(spark, tmp_path):
    table = state.sums("c", "k string, n long", ["k"], ["n"])
    log = state.Log(table, str(tmp_path / "log"), fanout=2)
    for e in range(9):
        d = spark.createDataFrame([("a", e), ("b", 1)], "k string, n long")
        log.append(d, e)
        if e in (3, 4):
            log.append(d, e)      # the epoch runs again
        parts, _ = log._manifest(spark, e)
        assert len(parts) == bin(e + 1).count("1")
    assert {r["k"]: r["n"] for r in log.read(spark).collect()} == {"a": 36, "b": 9}
    kept = [x for f in list_path(spark, log.folder) if f != "meta" for x in list_path(spark, f"{log.folder}/{f}")]
    assert len(kept) <= 6         # parts in force and those the last epoch merged


def test_throughput_on_a_stream_with_restart_and_update(spark, tmp_path):
    """A window that gets rows in two runs is replaced, not added."""
    t = fx.txn(spark, SF_SMALL)
    src = str(tmp_path / "src")
    odd = F.substring("transaction_id", 5, 20).cast("long") % 2
    for k in range(2):
        st.wire_records(t.where(odd == k)).write.mode("append").json(src)
        st.start_throughput(st.read_txn_stream(spark, "json", src), str(tmp_path / "t"), width="1 hour", delay="4000 days",
                            trigger={"availableNow": True}).awaitTermination()
    got = state.Log(st.WINDOWS, str(tmp_path / "t/windows")).read(spark).toPandas().sort_values("window_start_us")
    want = st.throughput(t, "1 hour").toPandas().sort_values("window_start_us")
    cols = ["window_start_us", "total", "fraud"]
    pd.testing.assert_frame_equal(got[cols].reset_index(drop=True), want[cols].reset_index(drop=True), check_dtype=False)


def test_fields_are_those_of_the_batch():
    assert {"merchant_risk_score", "merchant_txn_count_24h", "user_fraud_history_count"} <= set(D10_OUT) and len(D10_OUT) == 21
