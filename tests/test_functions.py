"""Hand fixtures of the reference's own test cases (geography, rules)."""

import pytest
from pyspark.sql import functions as F

from riskstream.functions import geo, scalar, text


def one(spark, cols):
    return spark.range(1).select(*cols).first()


def test_haversine_cases(spark):
    r = one(spark, [geo.haversine_km(F.lit(40.7128), F.lit(-74.0060), F.lit(40.7128), F.lit(-74.0060)).alias("same"),
                    geo.haversine_km(F.lit(40.7128), F.lit(-74.0060), F.lit(51.5074), F.lit(-0.1278)).alias("nyl"),
                    geo.haversine_km(F.lit(40.4168), F.lit(-3.7038), F.lit(-40.4168), F.lit(176.2962)).alias("anti")])
    assert abs(r["same"]) < 0.001
    assert abs(r["nyl"] - 5570) / 5570 < 0.01
    assert r["anti"] > 19000


def test_speed_and_impossible(spark):
    r = one(spark, [geo.travel_speed_kmh(F.lit(500.0), F.lit(3600.0)).alias("s1"),
                    geo.travel_speed_kmh(F.lit(500.0), F.lit(0.0)).alias("s0"),
                    geo.impossible_travel(F.lit(1000.0), F.lit(3600.0)).alias("i1000"),
                    geo.impossible_travel(F.lit(2000.0), F.lit(3600.0)).alias("i2000"),
                    geo.impossible_travel(F.lit(6000.0), F.lit(3600.0)).alias("i6000"),
                    geo.impossible_travel(F.lit(6000.0), F.lit(0.0)).alias("i_zero")])
    assert r["s1"] == pytest.approx(500.0) and r["s0"] == 0.0
    assert (r["i1000"], r["i2000"], r["i6000"], r["i_zero"]) == (False, True, True, False)


def test_temporal_monday_zero(spark):
    # 2024-01-01 was a Monday; 03:00 UTC
    us = 1704078000000000
    r = one(spark, [scalar.hour_of_day(F.lit(us)).alias("h"), scalar.day_of_week(F.lit(us)).alias("d"),
                    scalar.is_weekend(F.lit(us + 5 * 86400000000)).alias("sat")])
    assert (r["h"], r["d"], r["sat"]) == (3, 0, True)


def test_risk_level_and_velocity(spark):
    r = one(spark, [scalar.risk_level(F.lit(0.85)).alias("a"), scalar.risk_level(F.lit(0.7)).alias("b"),
                    scalar.risk_level(F.lit(0.5)).alias("c"), scalar.risk_level(F.lit(0.49)).alias("d"),
                    scalar.velocity_score(F.lit(20), F.lit(100)).alias("v")])
    assert (r["a"], r["b"], r["c"], r["d"], r["v"]) == ("CRITICAL", "HIGH", "MEDIUM", "LOW", 1.0)


def test_normalize_endpoint(spark):
    paths = ["/api/v1/users/12345/features", "/api/v1/users/0a1b2c3d-0000-4000-8000-000000000001",
             "/api/v1/users/USER_ACCOUNT_000000000001/features", "/", "/api/v1/score"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r[0] for r in df.select(text.normalize_endpoint("path")).collect()]
    assert got == ["/api/v1/users/{id}/features", "/api/v1/users/{id}", "/api/v1/users/{id}/features", "/",
                   "/api/v1/score"]


def test_report_row(spark):
    r = one(spark, [text.short_id(F.lit("TXN_0123456789abcdef0000")).alias("s"),
                    text.probability_pct(F.lit(0.875)).alias("p"),
                    F.array_join(text.factors_display(F.array(F.lit("IMPOSSIBLE_TRAVEL"))), ",").alias("f")])
    assert (r["s"], r["p"], r["f"]) == ("TXN_0123456789ab...", "87.50%", "IMPOSSIBLE TRAVEL")
