"""Frames that several passes read are computed once; what is not asked is not computed."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from riskstream.operators import history, training
from riskstream.plans import queries, select
from riskstream.plans.chunked import window_aggregates
from riskstream.sources import fixtures as fx

from .conftest import SF_SMALL


def _counted(spark, d):
    """d, and how often its rows are computed."""
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x
    return d.withColumn("transaction_id", F.udf(seen, "string")("transaction_id")), made


@pytest.mark.parametrize("name", ["impute_median", "standard_scale"])
def test_training_features_are_computed_once(spark, monkeypatch, name):
    d, made = _counted(spark, history.training_features(fx.txn(spark, SF_SMALL)))
    monkeypatch.setattr(queries.history, "training_features", lambda *_: d)
    rows = queries.QUERIES[name](spark, SF_SMALL).collect()
    assert made.value == len(rows) == fx.txn(spark, SF_SMALL).count()


def test_model_score_computes_its_features_once(spark, monkeypatch):
    d, made = _counted(spark, history.point_in_time_features(fx.txn(spark, SF_SMALL)))
    monkeypatch.setattr(queries.history, "point_in_time_features", lambda *_: d)
    fit = training.train_gbt
    monkeypatch.setattr(queries.training, "train_gbt", lambda t, num, cat, params, **kw: fit(t, num, cat, training.GBTParams(max_iter=1, max_depth=1), **kw))
    rows = queries.QUERIES["model_score"](spark, SF_SMALL).collect()
    assert made.value == len(rows) == fx.txn(spark, SF_SMALL).count()


def test_boosted_score_splits_once(spark, monkeypatch):
    made, split = [], queries.prep.stratified_split

    def counted(*a, **kw):
        d, n = _counted(spark, split(*a, **kw))
        made.append(n)
        return d
    monkeypatch.setattr(queries.prep, "stratified_split", counted)
    monkeypatch.setattr(queries, "BOOST_ROUNDS", 1)
    rows = queries.QUERIES["boosted_score"](spark, SF_SMALL).collect()
    assert made[0].value == len(rows) == fx.txn(spark, SF_SMALL).count()


def test_medians_of_columns_side_by_side(spark):
    nan, inf = float("nan"), math.inf
    rows = [(float(i * i % 37) if i % 5 else None, -1.5 if i % 3 else nan, [inf, -inf, 0.0][i % 3], None) for i in range(401)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    want = [statistics.median(v for v in col if v is not None and v == v) for col in list(zip(*rows))[:3]]
    assert select.exact_medians(d, ["a", "b", "c", "d"]) == {**dict(zip("abc", want)), "d": None}


@pytest.mark.parametrize("hi", [0, 1])
def test_windows_only_where_asked(spark, hi):
    """Null keys and times, repeated times; the row at a time asked for is not in its own window."""
    rows = [(["a", "b", None][i % 3], None if i == 7 else (i // 2) * 1_700_000_000, float(i), i % 4 == 0) for i in range(60)]
    d = spark.createDataFrame(rows, "k string, t long, x double, q boolean")
    spec = ({"n": (7_200_000_000, hi)}, {"s": (F.col("x"), 86_400_000_000, hi)})
    every = {(r["_wk"], r["_wt"]): (r["n"], r["s"]) for r in window_aggregates(d, "k", "t", *spec).collect() if r["_wt"] is not None}
    some = {(r["_wk"], r["_wt"]): (r["n"], r["s"]) for r in window_aggregates(d, "k", "t", *spec, F.col("q")).collect() if r["_wt"] is not None}
    asked = {(k if k is not None else "\0", t) for k, t, _, q in rows if q and t is not None}
    assert set(some) == asked and some == {a: every[a] for a in asked}
    for (k, t), (n, s) in every.items():
        own = [(u, x) for c, u, x, _ in rows if (c if c is not None else "\0") == k and u is not None]
        assert n == sum(t - 7_200_000_000 <= u < t + hi for u, _ in own)
        assert s == sum(x for u, x in own if t - 86_400_000_000 <= u < t + hi)
