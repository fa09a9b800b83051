"""Approximate nearest neighbours by multi-index hashing of binary codes.

Largest inner product is turned into smallest angle: with M the largest norm,
a vector x becomes (x / M, sqrt(1 - |x/M|^2)) and a query q becomes
(q / |q|, 0). Learned rotations (iterative quantisation on a bounded sample,
``ROTATIONS`` of them from different starts) give the signs that make a code.

A code is split into 8-bit substrings, each with an index of its own. For a
Hamming radius r the substrings' radii s(t) are chosen with the sum of
s(t) + 1 equal to r + 1: a code within r then has some substring within s(t),
so probing those balls in every index retrieves all codes within r. Full
distances are verified, and what is left is reranked by the exact inner
product of the original vectors in double precision.

The radius is learned on the sample as the distance that holds ``RECALL`` of
the neighbours that are as near there, in rank over size, as the k nearest
are in the whole table. Queries that find fewer than k rows ask again at twice
the radius, at last at that of all codes: every query gets min(k, candidates)
rows.

Scale: rows are dealt to blocks by a hash, each with its own substring
indexes, and each block meets the query blocks one by one; a task holds one
block of either, and hands on k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskstream.llm.common import Scratch
from riskstream.llm.simhash import grouped

K = 20
ROTATIONS = 4
RECALL = 0.97
SAMPLE = 8_192        # rows that train the rotations and the radius
ROW_BLOCK = 16_384
QUERY_BLOCK = 4_096
_QUERIES = 256        # sampled queries for the radius
_BALL = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)], "u1")


class Codes:
    """Rotated sign codes of augmented vectors."""

    def __init__(self, sample: np.ndarray, top: float, rounds: int = 20):
        self.top = top
        z = self.augment(sample)
        _, _, axes = np.linalg.svd(z, full_matrices=False)
        axes = axes[:64].T
        z = z @ axes
        p = z.shape[1]
        width = -(-p // 8) * 8
        self.maps = []
        for r in range(ROTATIONS):
            turn = np.linalg.qr(np.random.default_rng(r).standard_normal((width, width)))[0][:p]
            for _ in range(rounds if p == width else 0):
                u, _, v = np.linalg.svd(np.where(z @ turn >= 0, 1.0, -1.0).T @ z)
                turn = (u @ v).T
            self.maps.append(axes @ turn)
        self.bits = ROTATIONS * width

    def augment(self, x: np.ndarray) -> np.ndarray:
        x = x / self.top
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]])

    def _signs(self, z: np.ndarray) -> np.ndarray:
        return np.hstack([np.packbits(z @ m >= 0, axis=1) for m in self.maps])

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Substring values (rows x bits / 8) of table rows."""
        return self._signs(self.augment(x))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.maximum(np.abs(q).max(1, keepdims=True), 1e-300)
        q = q / np.sqrt((q * q).sum(1, keepdims=True))
        return self._signs(np.hstack([q, np.zeros((len(q), 1))]))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances (len(a) x len(b)) of codes given as byte substrings."""
    pad = -a.shape[1] % 8
    a, b = (np.ascontiguousarray(np.pad(x, ((0, 0), (0, pad)))).view("u8") for x in (a, b))
    out = np.zeros((len(a), len(b)), "u2")
    for t in range(a.shape[1]):
        out += np.bitwise_count(a[:, t, None] ^ b[None, :, t])
    return out


def learn_radius(codes: Codes, sample: np.ndarray, n: int, k: int) -> int:
    q = sample[:_QUERIES]
    kk = min(max(1, -(-k * len(sample) // max(n, 1))), max(1, len(sample) - 1))
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-score, 1, kind="stable")[:, :kk]
    d = np.take_along_axis(distances(codes.of_queries(q), codes.of_rows(sample)), near, 1)
    return int(np.quantile(d, RECALL, method="higher"))


def substring_radii(radius: int, tables: int) -> list[int]:
    """s(t) >= -1 with the sum of s(t) + 1 equal to radius + 1; -1: not asked."""
    low, more = divmod(radius + 1, tables)
    return [min(8, low - 1 + (t < more)) for t in range(tables)]


class SubstringIndex:
    """For each substring, the rows of each of its 256 values."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for t in range(codes.shape[1]):
            order = np.argsort(codes[:, t], kind="stable")
            self.tables.append((order, np.searchsorted(codes[order, t], np.arange(257))))

    def within(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """Which rows (columns) lie within the radius of the asked codes."""
        seen = np.zeros((len(asked), len(self.codes)), bool)
        for t, s in enumerate(substring_radii(radius, len(self.tables))):
            order, start = self.tables[t]
            for value in np.flatnonzero(np.diff(start)) if s >= 0 else ():
                who = np.flatnonzero(_BALL[asked[:, t], value] <= s)
                if len(who):
                    seen[np.ix_(who, order[start[value]:start[value + 1]])] = True
        return seen & (distances(asked, self.codes) <= radius)


def usable(vectors: DataFrame) -> Column:
    e = F.col("embedding")
    ok = F.forall(e, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    return e.isNotNull() & (F.size(e) > 0) & ok & F.exists(e, lambda x: x != 0)


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found rows of each query row
    but itself, best first, ties to the smaller vec_id (null ids last).

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor those not of the most frequent dimension (ties: the smaller).
    Repeated rows are candidates each on its own; a repeated query id gets the
    rows of each of its vectors. Other columns are not read. An empty table
    gives an empty result."""
    scratch = Scratch(spark, "ann")
    base = (vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable(vectors))
            .withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
            .withColumn("row", F.monotonically_increasing_id()))
    base = scratch.write(base, "rows")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    dims = base.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    size, n = dims[0]
    base = base.where(F.size("embedding") == size)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    top = base.agg(F.max(norm)).first()[0]
    drawn = base.select("embedding").orderBy(F.xxhash64("row")).limit(SAMPLE).collect()
    sample = np.array([r[0] for r in drawn], "f8")
    codes = Codes(sample, top)
    radius = learn_radius(codes, sample, n, k)
    queries = base.where("asks")
    want = min(k, n - 1)
    found = scratch.write(_meet(base, queries, codes, radius, n, k, kind), "found")
    while radius < codes.bits and want > 0:
        got = found.groupBy("row").count()
        short = queries.join(got, "row", "left").where(F.coalesce("count", F.lit(0)) < want).drop("count")
        short = scratch.write(short, "short")
        if short.isEmpty():
            break
        radius = min(2 * radius + 1, codes.bits)
        again = _meet(base, short, codes, radius, n, k, kind)
        found = scratch.write(found.join(short.select("row"), "row", "left_anti").unionByName(again), "found")
    return found.select("query_id", "rank", "vec_id", "score")


def _meet(base: DataFrame, queries: DataFrame, codes: Codes, radius: int, n: int, k: int, kind: str) -> DataFrame:
    rows = max(1, -(-n // ROW_BLOCK))
    asked = max(1, -(-queries.count() // QUERY_BLOCK))
    own = F.xxhash64("row")
    left = base.select("row", "vec_id", "embedding", F.pmod(own, F.lit(rows)).alias("i"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long"))).alias("j"), F.lit(False).alias("q"))
    right = queries.select("row", "vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("i"),
                           F.pmod(own, F.lit(asked)).alias("j"), F.lit(True).alias("q"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, c in grouped(batches, ["i", "j"]):
            t, q = c[~c["q"]], c[c["q"]]
            if not len(t) or not len(q):
                continue
            x = np.array(t["embedding"].tolist(), "f8")
            ids = t["vec_id"].to_numpy("f8", na_value=np.inf) if t["vec_id"].isna().any() else t["vec_id"].to_numpy()
            row = t["row"].to_numpy()
            index = SubstringIndex(codes.of_rows(x))
            for at in range(0, len(q), 512):
                part = q.iloc[at:at + 512]
                y = np.array(part["embedding"].tolist(), "f8")
                near = index.within(codes.of_queries(y), radius)
                whose, which, scores = [], [], []
                for m, own_row in enumerate(part["row"].tolist()):
                    cand = np.flatnonzero(near[m] & (row != own_row))
                    score = x[cand] @ y[m]
                    if len(cand) > k:
                        least = np.partition(score, -k)[-k]
                        cand = cand[score >= least - 1e-9 * (1 + abs(least))]
                    # Summed row by row: equal vectors get equal scores, so that ties go by id.
                    score = (x[cand] * y[m]).sum(1)
                    best = np.lexsort((ids[cand], -score))[:k]
                    whose.append(np.full(len(best), m))
                    which.append(cand[best])
                    scores.append(score[best])
                whose, which = np.concatenate(whose), np.concatenate(which)
                yield pd.DataFrame({"row": part["row"].to_numpy()[whose], "query_id": part["vec_id"].array[whose],
                                    "vec_id": t["vec_id"].array[which], "score": np.concatenate(scores)})

    cells = left.unionByName(right).repartition("i", "j").sortWithinPartitions("i", "j")
    got = cells.select("i", "j", "q", "row", "vec_id", "embedding") \
        .mapInPandas(meet, f"row long, query_id {kind}, vec_id {kind}, score double")
    w = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
