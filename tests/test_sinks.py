"""Sinks: alerts routed into one folder per level (I3) and the keyed JSON
stream sink with a checkpoint (A4)."""

import os

from pyspark.sql import functions as F

from riskstream.operators import feed
from riskstream.sources import fixtures as fx
from riskstream.streaming import stream as st

from .conftest import SF_SMALL


def test_route_alerts_partitioned_sink(spark, tmp_path):
    alerts = fx.scored(spark, SF_SMALL).filter(F.col("risk_level").isin("HIGH", "CRITICAL"))
    subs = spark.createDataFrame([(1, "HIGH"), (2, "HIGH"), (2, "CRITICAL")], "subscriber int, level string")
    routed = feed.route_alerts(alerts, subs)
    out = str(tmp_path / "routed")
    feed.write_routed(routed, out)
    assert sorted(d for d in os.listdir(out) if d.startswith("risk_level=")) == \
        ["risk_level=CRITICAL", "risk_level=HIGH"]
    back = spark.read.parquet(out)
    assert back.count() == alerts.count()
    assert {(r["risk_level"], r["subscribers"]) for r in back.select("risk_level", "subscribers").distinct().collect()} \
        == {("HIGH", 2), ("CRITICAL", 1)}


def test_keyed_json_stream_sink(spark, tmp_path):
    t = fx.txn(spark, SF_SMALL)
    src = str(tmp_path / "src")
    st.wire_records(t).write.mode("append").json(src)
    s = st.read_txn_stream(spark, "json", src)
    keyed = st.to_keyed_json(s.select("user_id", "transaction_id", "amount"), "user_id")
    q = st.write_keyed(keyed, "parquet", str(tmp_path / "ck"), path=str(tmp_path / "out"),
                       trigger={"availableNow": True})
    q.awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == t.count()
    row = back.select(F.col("key").cast("string").alias("k"),
                      F.get_json_object(F.col("value").cast("string"), "$.user_id").alias("u")).first()
    assert row["k"] == row["u"]
