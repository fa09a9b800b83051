"""Every registered query with an oracle equals DuckDB (sf0.001 here; the
driver checks sf0.01). Slow training queries are checked for rows only."""

import pytest

from riskstream.plans.check import compare, duck
from riskstream.plans.oracle import ORACLE
from riskstream.plans.queries import QUERIES

from .conftest import SF_SMALL

SLOW = {"model_score", "stream_features", "stream_features_batched", "stream_score", "stream_alerts", "impute_median", "train_pipeline",
        "tune_grid"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLE and n not in SLOW))
def test_query_matches_oracle(spark, con, name):
    r = compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])
    assert r["match"], r


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and "fraud_probability" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
