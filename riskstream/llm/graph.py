"""Connected components by alternating star contraction.

Links only ever move through shuffles keyed by node, each round's links are
written to the shared folder, and the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskstream.llm.common import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the node's smallest one."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the node itself, links to the smallest."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(u, v) links between long node ids -> (node, root): the smallest id
    reachable, for every node with a link to another one. Self links, repeated
    links and either direction are allowed; null ends are no link."""
    scratch = Scratch(spark, "components")
    e = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    e = scratch.write(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        nxt = scratch.write(_small_star(_large_star(e)))
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = nxt
        if tuple(now) == state or now[0] == 0:
            own = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own)
        state = tuple(now)
