"""Benchmark the headline queries.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints one JSON line. Each query is executed completely through the
``noop`` sink (no collect), after one warm-up run of the flagship to
exclude JVM start-up from the figures.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["point_in_time_features", "rule_score", "windowed_rate", "roc_curve", "stream_features",
            "score_batch", "evaluate_alert_rules"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from riskstream.plans.queries import QUERIES
    from riskstream.session import get_spark
    spark = get_spark(f"local[{cpus}]", app="riskstream-bench", shuffle_partitions=int(cpus) * 2)
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    QUERIES["rule_score"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "transactions": rows,
                      "flagship_tx_per_sec": round(rows / times["rule_score"], 1) if "rule_score" in times else None}))
    spark.stop()


if __name__ == "__main__":
    main()
