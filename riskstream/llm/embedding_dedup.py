"""Embedding near-dedup over an inverted multi-index.

Unit vectors are split into two halves with a codebook each, trained on a
bounded sample; the product of the codebooks is a grid of cells. A vector is
entered in the cell of its two nearest codewords and asks in the cells nearest
to it, in the order of the multi-sequence traversal (smallest sum of the two
squared distances first). How many cells it visits is calibrated: partners at
exactly the linking cosine are drawn around sampled vectors, and the traversal
is as long as it must be for ``RECALL`` of them to be met from either side;
closer partners are met earlier. Every pair met is verified in double
precision.

Scale: exact copies are reduced to one vector with its count. A cell with many
vectors is dealt to blocks of entries times blocks of askers, so no task holds
a whole hot cell. A block returns link counts for each vector and its links
reduced to a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskstream.llm import graph
from riskstream.llm.common import Scratch, salted_cells
from riskstream.llm.simhash import forest, grouped

MIN_COSINE = 0.95
RECALL = 0.99
CELL = 256            # distinct vectors a cell should have on average
MAX_CODEWORDS = 1024  # of each half
SAMPLE = 20_000       # vectors that train the codebooks and the calibration
BLOCK = 1024          # entries, and askers, of a task's cell
_DRAWS = 2_000


def unit(v) -> np.ndarray | None:
    """The vector over its length; None for a null or zero vector or one with
    null or non-finite components."""
    if v is None or len(v) == 0:
        return None
    x = np.array([np.nan if c is None else c for c in v], "f8") if not isinstance(v, np.ndarray) or v.dtype == object \
        else v.astype("f8")
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def _units(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u = [unit(v) for v in b["embedding"]]
            yield pd.DataFrame({"vec_id": b["vec_id"], "unit": [None if x is None else x.tobytes() for x in u]})
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInPandas(run, f"vec_id {kind}, unit binary")


def _matrix(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), "f8").reshape(len(units), -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centres; a centre that loses all its vectors stays."""
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def traversal(x: np.ndarray, left: np.ndarray, right: np.ndarray, cells: int) -> np.ndarray:
    """The ``cells`` nearest grid cells of each vector, nearest first.

    The cell at places (i, j) of the two sorted sequences has (i+1)(j+1) - 1
    cells that come no later, so only places with (i+1)(j+1) <= cells matter.
    """
    h = x.shape[1] // 2
    dl, dr = _distances(x[:, :h], left), _distances(x[:, h:], right)
    cells = min(cells, len(left) * len(right))
    ol, or_ = np.argsort(dl, 1, kind="stable")[:, :cells], np.argsort(dr, 1, kind="stable")[:, :cells]
    dl, dr = np.take_along_axis(dl, ol, 1), np.take_along_axis(dr, or_, 1)
    i, j = np.array([(a, b) for a in range(dl.shape[1]) for b in range(min(dr.shape[1], cells // (a + 1)))]).T
    order = np.argsort(dl[:, i] + dr[:, j], 1, kind="stable")[:, :cells]
    return ol[np.arange(len(x))[:, None], i[order]] * len(right) + or_[np.arange(len(x))[:, None], j[order]]


def train(sample: np.ndarray, n: int, min_cosine: float, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, int]:
    """(left codebook, right codebook, cells to visit) for n vectors."""
    k = int(min(MAX_CODEWORDS, max(1, round((n / CELL) ** 0.5)), len(sample)))
    h = sample.shape[1] // 2
    left, right = codebook(sample[:, :h], k), codebook(sample[:, h:], k)
    rng = np.random.default_rng(1)
    x = sample[rng.choice(len(sample), min(_DRAWS, len(sample)), replace=False)]
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.maximum(np.sqrt((noise * noise).sum(1))[:, None], 1e-300)
    y = min_cosine * x + (1 - min_cosine ** 2) ** 0.5 * noise
    cells = 4
    while True:
        tx, ty = traversal(x, left, right, cells), traversal(y, left, right, cells)
        met = (tx == ty[:, :1]).any(1) | (ty == tx[:, :1]).any(1)
        if met.mean() >= recall or cells >= len(left) * len(right):
            return left, right, min(cells, len(left) * len(right))
        cells = -(-cells * 3 // 2)


def _of_dimension(spark: SparkSession, scratch: Scratch, own: DataFrame, n: int, min_cosine: float) -> DataFrame:
    """own (node, unit, copies) of one dimension -> (u, v, n): n further links
    of node u; or, with v, a link of the spanning forest."""
    sample = _matrix([r[0] for r in own.select("unit").orderBy(F.xxhash64("unit")).limit(SAMPLE).collect()])
    left, right, cells = train(sample, n, min_cosine)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.iloc[at:at + 2048]
                if len(part):
                    part = part.copy()
                    t = traversal(_matrix(part["unit"].tolist()), left, right, cells)
                    part["visits"] = list(t.astype("i4"))
                    yield part[["node", "unit", "copies", "visits"]]

    seen = own.mapInPandas(visits, "node long, unit binary, copies long, visits array<int>")
    home = F.col("visits")[0]
    asks = seen.select("node", "unit", "copies", home.alias("home"), F.explode("visits").alias("cell"),
                       F.lit(None).cast("array<int>").alias("visits"), F.lit(False).alias("entry"))
    entries = seen.select("node", "unit", "copies", home.alias("home"), home.alias("cell"), "visits", F.lit(True).alias("entry"))
    rows = entries.unionByName(asks)
    sizes = (rows.groupBy("cell").agg(F.sum(F.col("entry").cast("long")).alias("n_entry"),
                                      F.sum((~F.col("entry")).cast("long")).alias("n_ask"))
             .where((F.col("n_entry") > BLOCK) | (F.col("n_ask") > BLOCK)))
    sizes = scratch.write(sizes, "large")
    dealt = salted_cells(rows, ["cell"], F.col("entry"), F.xxhash64("node"), sizes, BLOCK)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, c in grouped(batches, ["cell", "ci", "cj"]):
            e, a = c[c["entry"]], c[~c["entry"]]
            if not len(e) or not len(a):
                continue
            close = _matrix(a["unit"].tolist()) @ _matrix(e["unit"].tolist()).T >= min_cosine
            an, en = a["node"].to_numpy(), e["node"].to_numpy()
            close &= an[:, None] != en[None, :]
            if not close.any():
                continue
            # does the entry ask in the asker's home too? Then that cell counts the entry's side.
            homes, inverse = np.unique(a["home"].to_numpy(), return_inverse=True)
            v = np.array(e["visits"].tolist())
            mutual = np.stack([(v == h).any(1) for h in homes])[inverse]
            asked = close @ e["copies"].to_numpy()
            entered = a["copies"].to_numpy() @ (close & ~mutual)
            counts = pd.DataFrame({"u": np.concatenate([an, en]), "v": None, "n": np.concatenate([asked, entered])})
            yield counts[counts["n"] > 0].astype({"v": "Int64"})
            i, j = np.nonzero(close)
            nodes = np.concatenate([an, en])
            f = list(forest([(i, j + len(an))], len(nodes)))
            yield pd.DataFrame({"u": nodes[[x for x, _ in f]], "v": pd.array(nodes[[y for _, y in f]], "Int64"), "n": 0})

    keyed = dealt.repartition("cell", "ci", "cj").sortWithinPartitions("cell", "ci", "cj")
    return keyed.select("cell", "ci", "cj", "entry", "node", "unit", "copies", "home", "visits") \
        .mapInPandas(meet, "u long, v long, n long")


def near_duplicates(spark: SparkSession, vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Null, zero or non-finite vectors link with nothing, vectors of different
    dimensions never with each other. Repeated rows link as copies do. The
    component is named by its smallest vec_id; where all are null, by null
    (and such rows are kept). An empty table gives an empty result. The other
    columns are not read."""
    scratch = Scratch(spark, "embeddings")
    rows = scratch.write(_units(vectors), "units")
    own = (rows.where("unit is not null").groupBy("unit")
           .agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
           .withColumn("node", F.monotonically_increasing_id()))
    own = scratch.write(own, "distinct")
    found = None
    for size, n in own.groupBy(F.length("unit")).count().orderBy("length(unit)").collect():
        part = _of_dimension(spark, scratch, own.where(F.length("unit") == size), n, min_cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = scratch.write(found, "links")
    comp = graph.components(spark, found.where("v is not null").select("u", "v"))
    n_links = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    rooted = (own.join(comp, "node", "left").join(n_links, "node", "left")
              .select("unit", "low", F.coalesce("root", "node").alias("root"),
                      (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(low, "root").select("unit", "n_links", "component_id", F.lit(True).alias("_linked"))
    out = rows.join(named, "unit", "left")
    comp_id = F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      comp_id.alias("component_id"), F.col("vec_id").eqNullSafe(comp_id).alias("kept"))
