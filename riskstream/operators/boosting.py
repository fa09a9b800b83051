"""Second-order boosted trees, trained by Spark aggregates.

Features are cut into bins once (sketched quantiles) and kept as bytes. Each
level of a tree is one pass: a task sums gradients and hessians by (node,
feature, bin), tasks' sums meet by (node, feature), and each group returns its
best split, so the driver sees nodes x features rows, never data. Missing values
go to the side with the better gain. A split's gain is
``T(GL)^2/(HL+l2) + T(GR)^2/(HR+l2) - T(G)^2/(H+l2)`` with T shrinking sums by the L1 term;
children need ``min_child_weight`` of hessian, and finished trees lose splits
below ``gamma`` from the bottom up. Rows are sampled by a hash of their key, features
by the seed, so that a fit does not depend on how rows are dealt to tasks
(but for the rounding of sums, past which ties go to the first feature and bin).

Margins are written with the bins every ``CHECKPOINT`` rounds: a pass applies
few trees, and lost executors repeat little.

A fitted ``Booster`` scores in three equal ways: ``predict`` (numpy in tasks),
``staged`` (after every round: one fit serves all round counts of a grid) and
``margin_sql``, the trees as nested CASE expressions in text that Spark and
other SQL engines read alike.
"""

from __future__ import annotations

import json
import math
import random
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F, types as T

from ..session import delete_path, scratch_path, ship_package

CHECKPOINT = 10
MISSING = 255
EPS = 1e-6


@dataclass(frozen=True)
class BoostParams:
    """FIXED VALUES: rounds, depth, rate, sampling, penalties and floors."""
    rounds: int = 200
    max_depth: int = 6
    rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    gamma: float = 0.1
    min_child_weight: float = 3.0
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2i+1 and 2i+2; feature -1 is a leaf."""
    feature: list[int]
    cut: list[int]
    missing_left: list[bool]
    value: list[float]
    gain: list[float]

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree([-1] * n, [0] * n, [False] * n, [0.0] * n, [0.0] * n)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.missing_left)
        node, at = np.zeros(len(bins), "i8"), np.arange(len(bins))
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            b = bins[at, np.maximum(f, 0)]
            goes_left = np.where(b == MISSING, left[node], b <= cut[node])
            node = np.where(inner, 2 * node + 2 - goes_left, node)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]

    def prune(self, gamma: float) -> None:
        """Splits into two leaves go where they gain less than ``gamma``."""
        for i in range(len(self.feature) // 2 - 1, -1, -1):
            if self.feature[i] >= 0 and self.feature[2 * i + 1] < 0 and self.feature[2 * i + 2] < 0 and self.gain[i] < gamma:
                self.feature[i] = -1


@dataclass
class Booster:
    """Fitted trees. ``cuts`` of a column ascend; a value of bin b is at most cuts[b]."""
    columns: list[str]
    cuts: dict[str, list[float]]
    trees: list[Tree] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)

    def bins_of(self, values: np.ndarray) -> np.ndarray:
        """Rows x columns of doubles -> bins."""
        out = np.empty(values.shape, "u1")
        for j, c in enumerate(self.columns):
            out[:, j] = np.where(np.isnan(values[:, j]), MISSING, np.searchsorted(self.cuts[c], values[:, j], side="left"))
        return out

    def _values(self, b: pd.DataFrame) -> np.ndarray:
        return np.column_stack([b[f"x{j}"].to_numpy("f8", na_value=np.nan) for j in range(len(self.columns))])

    def _inputs(self) -> list[Column]:
        return [F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(self.columns)]

    def predict(self, df: DataFrame, out: str = "model_probability") -> DataFrame:
        """df and the probability of label 1; null and NaN features are missing."""
        ship_package(df.sparkSession)
        names, m = df.columns, self
        kept = [c for c in names if c != out]
        schema = df.select(*kept).schema.add(out, T.DoubleType())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                bins = m.bins_of(m._values(b))
                margin = _sum([t.margins(bins) for t in m.trees], len(b))
                own = b[kept].copy()
                own[out] = 1.0 / (1.0 + np.exp(-margin))
                yield own
        return df.select(*kept, *self._inputs()).mapInPandas(run, schema)

    def staged(self, df: DataFrame, rounds: Sequence[int] | None = None, *keep: str) -> DataFrame:
        """(keep.., round, score): the margin after each of the given rounds, all by default."""
        ship_package(df.sparkSession)
        m = self
        asked = sorted(set(rounds)) if rounds is not None else list(range(1, len(self.trees) + 1))
        schema = df.select(*keep).schema.add("round", T.IntegerType()).add("score", T.DoubleType())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                bins, margin = m.bins_of(m._values(b)), np.zeros(len(b))
                for r, t in enumerate(m.trees, 1):
                    margin = margin + t.margins(bins)
                    if r in asked:
                        yield b[list(keep)].assign(round=np.int32(r), score=margin)
        return df.select(*keep, *self._inputs()).mapInPandas(run, schema)

    def margin_sql(self, rounds: int | None = None) -> str:
        """The margin as SQL text over columns of the features' names."""
        def node(t: Tree, i: int) -> str:
            if t.feature[i] < 0:
                return _double(t.value[i])
            c = self.columns[t.feature[i]]
            x, cuts = f"CAST({c} AS DOUBLE)", self.cuts[c]
            none = f"({x} IS NULL OR isnan({x}))"
            low = f"{x} <= {_double(cuts[t.cut[i]])}" if t.cut[i] < len(cuts) else f"NOT {none}"
            # NaN is above every number in some engines and equal to none in others
            test = f"{none} OR {low}" if t.missing_left[i] else f"NOT {none} AND {low}"
            return f"CASE WHEN {test} THEN {node(t, 2 * i + 1)} ELSE {node(t, 2 * i + 2)} END"

        def add(parts: list[str]) -> str:
            if len(parts) == 1:
                return parts[0]
            h = len(parts) // 2
            return f"({add(parts[:h])} + {add(parts[h:])})"
        trees = self.trees[:rounds]
        return add([node(t, 0) for t in trees]) if trees else _double(0.0)

    def probability_sql(self, rounds: int | None = None) -> str:
        return f"1 / (1 + exp(-({self.margin_sql(rounds)})))"

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Booster:
        d = json.loads(text)
        return Booster(d["columns"], d["cuts"], [Tree(**t) for t in d["trees"]], d["history"])


def _double(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _sum(parts: list[np.ndarray], n: int) -> np.ndarray:
    """Sums in the order that ``margin_sql`` adds in."""
    if not parts:
        return np.zeros(n)
    if len(parts) == 1:
        return parts[0]
    h = len(parts) // 2
    return _sum(parts[:h], n) + _sum(parts[h:], n)


def fit_cuts(df: DataFrame, columns: Sequence[str], bins: int = BoostParams.bins) -> dict[str, list[float]]:
    """Distinct approximate quantiles of each column, in one aggregate; the
    last cut is the column's maximum. A column without values has none."""
    at = [i / bins for i in range(1, bins)]
    got = df.agg(*[F.percentile_approx(_clean(c), at, 10_000).alias(f"q{j}") for j, c in enumerate(columns)],
                 *[F.max(_clean(c)).alias(f"m{j}") for j, c in enumerate(columns)]).first()
    return {c: sorted({*map(float, got[f"q{j}"] or []), *([float(got[f"m{j}"])] if got[f"m{j}"] is not None else [])})
            for j, c in enumerate(columns)}


def _n_bins(booster: Booster) -> int:
    """Bins of a histogram: up to each cut, and above the last one."""
    return 1 + max([len(c) for c in booster.cuts.values()], default=0)


def _clean(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def gains(g: np.ndarray, h: np.ndarray, p: BoostParams) -> np.ndarray:
    """Gains of splitting after each bin of a histogram whose last entry is
    the missing values: row 0 sends them left, row 1 right; -inf where a child is too light."""
    def score(a, b):
        return np.where(b + p.l2 > 0, np.maximum(np.abs(a) - p.l1, 0.0) ** 2 / np.maximum(b + p.l2, 1e-300), 0.0)
    total_g, total_h = g.sum(), h.sum()
    out = []
    for left in (True, False):
        gl, hl = np.cumsum(g[:-1]) + left * g[-1], np.cumsum(h[:-1]) + left * h[-1]
        gr, hr = total_g - gl, total_h - hl
        own = score(gl, hl) + score(gr, hr) - score(total_g, total_h)
        out.append(np.where((hl >= p.min_child_weight) & (hr >= p.min_child_weight), own, -np.inf))
    return np.array(out)


def leaf_value(g: float, h: float, p: BoostParams) -> float:
    return -p.rate * math.copysign(max(abs(g) - p.l1, 0.0), g) / (h + p.l2) if h + p.l2 > 0 else 0.0


def _uniform(key: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the key to [0, 1)."""
    with np.errstate(over="ignore"):
        x = key.view("u8") + np.uint64(seed % (1 << 63)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype("f8") / float(1 << 53)


def _gradients(b: pd.DataFrame, m: int, trees: list[Tree], p: BoostParams, round_no: int):
    """bins, gradients, hessians of the rows that this round samples."""
    keep = _uniform(b["key"].to_numpy(), p.seed * 100_003 + round_no) < p.subsample if p.subsample < 1 else np.ones(len(b), bool)
    b = b[keep]
    bins = np.frombuffer(b"".join(b["bins"]), "u1").reshape(-1, m)
    margin = b["margin"].to_numpy()
    for t in trees:
        margin = margin + t.margins(bins)
    y, w = b["y"].to_numpy(), b["w"].to_numpy()
    prob = 1.0 / (1.0 + np.exp(-margin))
    return bins, (prob - y) * w, prob * (1 - prob) * w


def _level(binned: DataFrame, m: int, trees: list[Tree], tree: Tree, level: int, features: list[int], n_bins: int,
           p: BoostParams, round_no: int) -> DataFrame:
    """(node, feature, g, h): histograms of the level's nodes, a row for each task."""
    first, width = 2 ** level - 1, 2 ** level

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g_sum, h_sum = np.zeros((width, len(features), n_bins + 1)), np.zeros((width, len(features), n_bins + 1))
        for b in batches:
            bins, g, h = _gradients(b, m, trees, p, round_no)
            node = tree.leaves(bins) - first
            live = node >= 0
            bins, g, h, node = bins[live], g[live], h[live], node[live]
            for k, f in enumerate(features):
                at = node * (n_bins + 1) + np.where(bins[:, f] == MISSING, n_bins, bins[:, f])
                g_sum[:, k] += np.bincount(at, g, width * (n_bins + 1)).reshape(width, -1)
                h_sum[:, k] += np.bincount(at, h, width * (n_bins + 1)).reshape(width, -1)
        filled = np.argwhere(h_sum.any(axis=2))
        yield pd.DataFrame({"node": (filled[:, 0] + first).astype("i4"), "feature": np.array([features[k] for k in filled[:, 1]], "i4"),
                            "g": [g_sum[i, k] for i, k in filled], "h": [h_sum[i, k] for i, k in filled]})
    return binned.mapInPandas(run, "node int, feature int, g array<double>, h array<double>")


def _best_splits(histograms: DataFrame, p: BoostParams) -> list:
    """The best split of each (node, feature)."""
    def best(key, t: pd.DataFrame) -> pd.DataFrame:
        g, h = np.sum(np.stack(t["g"].to_list()), axis=0), np.sum(np.stack(t["h"].to_list()), axis=0)
        gain = np.round(gains(g, h, p), 9)
        side, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
        gl, hl = g[:cut + 1].sum() + (side == 0) * g[-1], h[:cut + 1].sum() + (side == 0) * h[-1]
        return pd.DataFrame({"node": [key[0]], "feature": [key[1]], "gain": [float(gain[side, cut])], "cut": [int(cut)], "missing_left": [bool(side == 0)],
                             "gl": [gl], "hl": [hl], "g": [g.sum()], "h": [h.sum()]})
    return histograms.groupBy("node", "feature").applyInPandas(
        best, "node int, feature int, gain double, cut int, missing_left boolean, gl double, hl double, g double, h double").collect()


def grow(binned: DataFrame, m: int, trees: list[Tree], features: list[int], n_bins: int, p: BoostParams, round_no: int) -> Tree:
    """One tree on the gradients that ``trees`` leave; a pass for each level."""
    tree, open_nodes = Tree.empty(p.max_depth), {0}
    for level in range(p.max_depth):
        best: dict[int, tuple] = {}
        for r in _best_splits(_level(binned, m, trees, tree, level, features, n_bins, p, round_no), p):
            if r["node"] in open_nodes:
                rank = (r["gain"], -r["feature"])
                if r["node"] not in best or rank > best[r["node"]][0]:
                    best[r["node"]] = (rank, r)
        if level == 0 and best:
            tree.value[0] = leaf_value(best[0][1]["g"], best[0][1]["h"], p)
        open_nodes = set()
        for i, (_, r) in best.items():
            if not r["gain"] > EPS or r["gain"] == math.inf:
                continue
            tree.feature[i], tree.cut[i], tree.missing_left[i], tree.gain[i] = r["feature"], r["cut"], r["missing_left"], r["gain"]
            tree.value[2 * i + 1] = leaf_value(r["gl"], r["hl"], p)
            tree.value[2 * i + 2] = leaf_value(r["g"] - r["gl"], r["h"] - r["hl"], p)
            open_nodes |= {2 * i + 1, 2 * i + 2}
        if not open_nodes:
            break
    tree.prune(p.gamma)
    return tree


def bin_rows(df: DataFrame, booster: Booster, label: str, key: Column, weight: Column | None = None) -> DataFrame:
    """(key, y, w, margin, bins) of the rows with a label."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins = booster.bins_of(booster._values(b))
            yield b[["key", "y", "w", "margin"]].assign(bins=[r.tobytes() for r in bins])
    w = F.lit(1.0) if weight is None else weight
    return (df.where(F.col(label).isNotNull())
            .select(F.coalesce(key.cast("long"), F.lit(0)).alias("key"), F.col(label).cast("double").alias("y"), w.cast("double").alias("w"),
                    F.lit(0.0).alias("margin"), *booster._inputs())
            .mapInPandas(run, "key long, y double, w double, margin double, bins binary"))


def fit(df: DataFrame, columns: Sequence[str], label: str, key: Column, p: BoostParams = BoostParams(),
        weight: Column | None = None, validation: DataFrame | None = None) -> Booster:
    """Fits ``p.rounds`` trees on the rows with a label (0 or 1; others are
    left out). ``key`` is a long that names a row, for sampling. With a
    ``validation`` frame ``history`` has its AUC after every round. Without rows or
    columns the model has no trees and scores 0.5."""
    spark = df.sparkSession
    ship_package(spark)
    if not 2 <= p.bins < MISSING:
        raise ValueError("bins must be from 2 to 254")
    booster = Booster(list(columns), fit_cuts(df, columns, p.bins))
    m, n_bins = len(columns), _n_bins(booster)
    base = scratch_path(spark, f"boost-{uuid.uuid4().hex}")
    bin_rows(df, booster, label, key, weight).write.parquet(f"{base}/0")
    binned, done, at = spark.read.parquet(f"{base}/0"), 0, f"{base}/0"
    for r in range(p.rounds if m and n_bins > 1 else 0):
        if len(booster.trees) - done >= CHECKPOINT:
            new = booster.trees[done:]

            def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    bins = np.frombuffer(b"".join(b["bins"]), "u1").reshape(-1, m)
                    yield b.assign(margin=b["margin"] + sum(t.margins(bins) for t in new))
            path = f"{base}/{r}"
            binned.mapInPandas(advance, binned.schema).write.parquet(path)
            delete_path(spark, at)
            binned, done, at = spark.read.parquet(path), len(booster.trees), path
        rng = random.Random(p.seed * 1_000_003 + r)
        features = sorted(rng.sample(range(m), max(1, round(m * p.colsample))))
        booster.trees.append(grow(binned, m, booster.trees[done:], features, n_bins, p, r))
    delete_path(spark, base)
    if validation is not None and booster.trees:
        aucs = staged_auc(booster.staged(validation.where(F.col(label).isNotNull()), None, label), label)
        booster.history = [r.asDict() for r in aucs.orderBy("round").collect()]
    return booster


def staged_auc(scored: DataFrame, label: str, *by: str) -> DataFrame:
    """(by.., round, n, auc) of scores by round: ties count half. Scores are
    counted by distinct value before they are put in order."""
    groups = [*by, "round"]
    one = scored.groupBy(*groups, "score").agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    w = Window.partitionBy(*groups).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = one.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    return below.groupBy(*groups).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def split_gains(df: DataFrame, columns: Sequence[str], label: str, cuts: dict[str, list[float]],
                p: BoostParams = BoostParams()) -> DataFrame:
    """(feature, cut, gain_missing_left, gain_missing_right) of every split of
    all rows in a first tree, null where a child is too light: the table that ``grow`` chooses its root from."""
    booster = Booster(list(columns), {c: sorted(cuts[c]) for c in columns})
    binned = bin_rows(df, booster, label, F.lit(0))
    n_bins = _n_bins(booster)

    def table(key, t: pd.DataFrame) -> pd.DataFrame:
        c = booster.columns[key[1]]
        cut = booster.cuts[c]
        both = gains(np.sum(np.stack(t["g"].to_list()), axis=0), np.sum(np.stack(t["h"].to_list()), axis=0), p)[:, :len(cut)]
        both = np.where(np.isfinite(both), both, np.nan)
        return pd.DataFrame({"feature": c, "cut": cut, "gain_missing_left": both[0], "gain_missing_right": both[1]})
    ship_package(df.sparkSession)
    q = BoostParams(**{**asdict(p), "subsample": 1.0})
    out = _level(binned, len(columns), [], Tree.empty(1), 0, list(range(len(columns))), n_bins, q, 0).groupBy("node", "feature").applyInPandas(
        table, "feature string, cut double, gain_missing_left double, gain_missing_right double")
    return out.select("feature", "cut", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("gain_missing_left", "gain_missing_right")])
