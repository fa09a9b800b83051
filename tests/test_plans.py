"""Physical-plan properties of the registered queries: no cross products,
column pruning at the scan, and the flagship's shuffles stay on the
(user, chunk) partitioning."""

import pytest

from riskstream.plans.queries import QUERIES

from .conftest import SF_SMALL

# queries that run streams or fit models while being built
RUNS_JOBS = {"stream_features", "stream_features_batched", "stream_score", "stream_alerts",
             "stream_score_counters", "stream_features_full", "stream_score_model", "stream_running_counters", "stream_throughput", "model_score", "impute_median", "read_transactions", "train_pipeline", "tune_grid", "smote",
             "smote_neighbors", "stratified_split"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in RUNS_JOBS))
def test_no_cross_products(spark, name):
    p = plan_of(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_prunes_columns(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan_of(QUERIES["rule_score"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = [line for line in p.split("\n") if "FileScan parquet" in line]
    assert scans and all("props" not in s for s in scans)   # unused JSON column never read


def test_flagship_big_side_shuffles_once_per_key(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan_of(QUERIES["rule_score"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    ex = [line.strip() for line in p.split("\n") if "Exchange hashpartitioning" in line]
    # the rows move only on (key, chunk); every other exchange is keyed by
    # the key (+ session) alone and carries per-chunk totals
    big = [e for e in ex if "_chunk" in e and "_key" in e]
    assert big and all("coalesce" not in e for e in ex)


def test_crowded_scores_spread_over_ranges(spark):
    """Scores crowded in [0, 1e-6], with nulls, NaN, infinities and negatives:
    running sums equal a plain sort, and no range holds many of them."""
    import math

    from riskstream.plans.chunked import CHUNK, ordered_prefix, with_ranges
    values = [i * 1e-11 for i in range(20_000)] + [0.5, 0.25, -3.0, math.inf, -math.inf, math.nan, None]
    rows = [(v, i % 7, 1) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "x double, a long, b long").repartition(4)
    per_range = [r["count"] for r in with_ranges(df, "x", ["a"]).groupBy(CHUNK).count().collect()]
    assert max(per_range) <= 30 and len(per_range) > 3000
    for descending in (True, False):
        order = sorted(rows, key=lambda r: (-1, 0) if r[0] is None else (1, 0) if math.isnan(r[0]) else (0, r[0]), reverse=descending)
        want, total = [], 0
        for v, a, _ in order:
            total += a
            want.append((total, a))
        got = ordered_prefix(df, "x", ["a", "b"], descending=descending).collect()
        assert {r["total_a"] for r in got} == {total} and {r["total_b"] for r in got} == {len(rows)}
        assert [(r["cum_a"], r["a"]) for r in sorted(got, key=lambda r: r["cum_b"])] == want
    for few in (df.limit(0), df.where("x is null"), df.where("x = 0.5")):
        assert ordered_prefix(few, "x", ["a", "b"]).count() == few.count()


def test_curves_run_no_job_while_planned(spark):
    from riskstream.operators import evaluation
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None)], "label int, score double")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    evaluation.roc_auc(df)
    evaluation.pr_curve(df)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
