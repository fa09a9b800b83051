"""Stored profile for requested users, defaults when absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_lookup(requests: DataFrame, profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """Left join requests to profiles (one row per user, from D3b).

    Spark/AQE pick broadcast only when the profile side's runtime size is
    under the broadcast threshold; otherwise a sort-merge join on the key.
    Defaults for new users: mean 0, std 0, count 0, fraud count 0.
    """
    p = profiles.withColumn("_found", F.lit(True))
    if "fraud_count" not in p.columns:
        p = p.withColumn("fraud_count", F.lit(0).cast("long"))
    d = requests.join(p, key, "left")
    return d.select(
        key,
        F.coalesce("_found", F.lit(False)).alias("found"),
        F.coalesce("avg_amount", F.lit(0.0)).alias("avg_amount"),
        F.coalesce("std_amount", F.lit(0.0)).alias("std_amount"),
        F.coalesce("txn_count_total", F.lit(0)).cast("long").alias("txn_count_total"),
        F.coalesce("fraud_count", F.lit(0)).cast("long").alias("fraud_count"),
    )
