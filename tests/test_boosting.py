"""Second-order boosting: gains, trees and scores against plain versions."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskstream.operators import boosting as B, evaluation, training
from riskstream.plans.queries import QUERIES
from riskstream.plans.sample_model import SAMPLE_MODEL


def table(seed, n=600):
    """a, b, c with nulls and NaNs; the label follows a mix of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.uniform(0, 10), rng.choice([0.0, 1.0, 2.0, 3.0]), rng.gauss(0, 1)
        y = int(a > 6 and b >= 1 or c > 1.4) ^ (rng.random() < 0.05)
        rows.append((i, None if rng.random() < 0.1 else a, float("nan") if rng.random() < 0.05 else b, c, y))
    return rows


SCHEMA = "id long, a double, b double, c double, y int"
FULL = B.BoostParams(rounds=3, max_depth=3, subsample=1.0, colsample=1.0, bins=16, min_child_weight=2.0)


def soft(g, l1):
    return math.copysign(max(abs(g) - l1, 0.0), g)


def plain_tree(x, g, h, cuts, p, depth=0):
    """The same greedy tree by loops over rows: (feature, cut, missing left, gain, left, right) or a leaf's (value,)."""
    G, H = sum(g), sum(h)
    leaf = (-p.rate * soft(G, p.l1) / (H + p.l2),)
    if depth == p.max_depth:
        return leaf
    best = None
    for j in range(x.shape[1]):
        n = max(map(len, cuts))
        for left_first in (True, False):
            for k in range(n + 1):
                cut = cuts[j][k] if k < len(cuts[j]) else math.inf
                go = [left_first if math.isnan(v) else v <= cut for v in x[:, j]]
                gl, hl = sum(a for a, t in zip(g, go) if t), sum(a for a, t in zip(h, go) if t)
                if hl < p.min_child_weight or H - hl < p.min_child_weight:
                    continue
                gain = round(soft(gl, p.l1) ** 2 / (hl + p.l2) + soft(G - gl, p.l1) ** 2 / (H - hl + p.l2) - soft(G, p.l1) ** 2 / (H + p.l2), 9)
                rank = (gain, -j, left_first, -k)
                if best is None or rank > best[0]:
                    best = (rank, j, k, left_first, go)
    if best is None or best[0][0] <= B.EPS:
        return leaf
    go = np.array(best[4])
    parts = [plain_tree(x[m], [v for v, t in zip(g, m) if t], [v for v, t in zip(h, m) if t], cuts, p, depth + 1) for m in (go, ~go)]
    if all(len(s) == 1 for s in parts) and best[0][0] < p.gamma:
        return leaf
    return (best[1], best[2], best[3], best[0][0], *parts)


def nested(t, i=0):
    if t.feature[i] < 0:
        return (t.value[i],)
    return (t.feature[i], t.cut[i], t.missing_left[i], t.gain[i], nested(t, 2 * i + 1), nested(t, 2 * i + 2))


def flat(t):
    return [x for part in t for x in (flat(part) if isinstance(part, tuple) else [part])]


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_match_a_plain_version(spark, seed):
    rows = table(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    m = B.fit(df, ["a", "b", "c"], "y", F.col("id"), FULL)
    x = np.array([[math.nan if v is None else v for v in r[1:4]] for r in rows])
    y, margin = np.array([r[4] for r in rows], float), np.zeros(len(rows))
    for t in m.trees:
        prob = 1 / (1 + np.exp(-margin))
        want = plain_tree(x, list(prob - y), list(prob * (1 - prob)), [m.cuts[c] for c in "abc"], FULL)
        assert flat(nested(t)) == pytest.approx(flat(want), abs=1e-9)
        margin += t.margins(m.bins_of(x))
    assert sum(f >= 0 for f in m.trees[0].feature) >= 3


def test_penalties_floor_and_gamma():
    g, h = np.array([-4.0, 3.0, 2.0, 0.5]), np.array([2.0, 2.0, 2.0, 1.0])
    p = B.BoostParams(l1=1.0, l2=2.0, min_child_weight=2.5)
    got = B.gains(g, h, p)
    # after bin 0: missing left gives sums -3.5 / 3 and 5 / 4; missing right leaves the left side too light
    assert got[0, 0] == pytest.approx(2.5 ** 2 / 5 + 4 ** 2 / 6 - 0.5 ** 2 / 9) and got[1, 0] == -np.inf
    assert B.leaf_value(0.5, 3.0, p) == 0.0 and B.leaf_value(-3.0, 3.0, p) == pytest.approx(0.1 * 2 / 5)
    t = B.Tree.empty(2)
    t.feature[0], t.feature[1], t.gain[0], t.gain[1] = 0, 1, 0.05, 0.05
    kept = B.Tree(**{k: list(v) for k, v in vars(t).items()})
    kept.gain[1] = 0.2
    t.prune(0.1)
    kept.prune(0.1)
    assert t.feature[:2] == [-1, -1] and kept.feature[:2] == [0, 1]


def test_scores_agree_and_survive_saving(spark, tmp_path):
    rows = table(3)
    df = spark.createDataFrame(rows, SCHEMA)
    p = B.BoostParams(rounds=13, max_depth=4, bins=24)            # past a checkpoint, with sampling
    m = B.fit(df, ["a", "b", "c"], "y", F.col("id"), p, validation=df)
    again = B.fit(df.repartition(7), ["a", "b", "c"], "y", F.col("id"), p)
    assert [t.feature for t in again.trees] == [t.feature for t in m.trees]
    new = spark.createDataFrame(rows + [(9000, 99.0, -5.0, 50.0, 1), (9001, None, None, None, 0)], SCHEMA).withColumn("model_probability", F.lit("x"))
    got = {r["id"]: r["model_probability"] for r in m.predict(new).collect()}
    text = m.probability_sql()
    compiled = {r["id"]: r["p"] for r in new.select("id", F.expr(text).alias("p")).collect()}
    pdf = new.drop("model_probability").toPandas()
    con = duckdb.connect()
    con.register("pdf", pdf)
    other = dict(con.execute(f"SELECT id, {text} FROM pdf").fetchall())
    assert got.keys() == compiled.keys() == other.keys()
    for i, v in got.items():
        assert compiled[i] == pytest.approx(v, abs=1e-14) and other[i] == pytest.approx(v, abs=1e-14)
    assert len(m.history) == 13 and m.history[-1]["auc"] > m.history[0]["auc"] > 0.5
    scored = m.predict(df, "score").withColumn("label", F.col("y"))
    assert evaluation.roc_auc(scored).first()["roc_auc"] == pytest.approx(m.history[-1]["auc"], abs=1e-9)
    model = training.BoostedModel(m)
    model.save(str(tmp_path / "m"))
    back = training.BoostedModel.load(str(tmp_path / "m"))
    assert back.booster == m
    assert {r["id"]: r["q"] for r in back.predict_proba(new, "q").collect()} == got


def test_sampling_leaves_rows_and_columns_out(spark):
    key = np.arange(200_000)
    kept = B._uniform(key, 7) < 0.8
    assert 0.79 < kept.mean() < 0.81 and (kept != (B._uniform(key, 8) < 0.8)).any()
    df = spark.createDataFrame(table(4), SCHEMA)
    m = B.fit(df, ["a", "b", "c"], "y", F.col("id"), B.BoostParams(rounds=6, max_depth=2, colsample=0.34))
    assert all(len({f for f in t.feature if f >= 0}) <= 1 for t in m.trees)


def test_edges(spark):
    df = spark.createDataFrame(table(5, 200), SCHEMA)
    p = B.BoostParams(rounds=2, max_depth=2)
    empty = B.fit(df.where("false"), ["a", "b"], "y", F.col("id"), p)
    assert empty.trees == [] and empty.predict(df).agg(F.min("model_probability"), F.max("model_probability")).first() == (0.5, 0.5)
    none = df.withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(1.0)).withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y")))
    m = B.fit(none, ["a", "b"], "y", F.lit(None), p)           # nothing to split on, null keys and labels
    assert all(t.feature[0] == -1 for t in m.trees)
    one_class = B.fit(df.withColumn("y", F.lit(1)), ["a"], "y", F.col("id"), p, validation=df.withColumn("y", F.lit(1)))
    assert one_class.history[0]["auc"] is None
    with pytest.raises(ValueError):
        B.fit(df, ["a"], "y", F.col("id"), B.BoostParams(bins=255))


def test_a_given_model_compiles_to_what_it_predicts(spark):
    from riskstream.sources import fixtures as fx
    from riskstream.operators import history
    from .conftest import SF_SMALL
    d = history.training_features(fx.txn(spark, SF_SMALL))
    want = {r["transaction_id"]: r["p"] for r in B.Booster(**SAMPLE_MODEL).predict(d, "p").collect()}
    got = {r["transaction_id"]: r["fraud_probability"] for r in QUERIES["tree_score"](spark, SF_SMALL).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)


def test_staged_grid(spark):
    rows = table(6, 400)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.when(F.col("id") % 3 == 0, "x").otherwise("z"))
    grid = {"maxIter": [2, 4], "maxDepth": [2, 3], "stepSize": [0.1], "subsamplingRate": [0.8]}
    out = training.tune_staged(df, ["a", "b", "c"], ["k"], grid, 2, B.BoostParams(bins=16), "y", "id").collect()
    assert {(r["rounds"], r["depth"]) for r in out} == {(2, 2), (2, 3), (4, 2), (4, 3)} and {r["folds"] for r in out} == {2}
    # A staged score is that of a fit that stops there.
    part = df.where("id % 2 = 0")
    p = B.BoostParams(rounds=4, max_depth=2, bins=16)
    long = training.train_boosted(part, ["a", "b", "c"], ["k"], p, "y", "id")
    short = training.train_boosted(part, ["a", "b", "c"], ["k"], B.BoostParams(rounds=2, max_depth=2, bins=16), "y", "id")
    assert short.booster.trees == long.booster.trees[:2]
    staged = long.booster.staged(long.matrix.apply(part), [2], "id").collect()
    direct = {r["id"]: r["p"] for r in short.predict_proba(part, "p").collect()}
    assert all(1 / (1 + math.exp(-r["score"])) == pytest.approx(direct[r["id"]], abs=1e-12) for r in staged)
