"""SimHash near-dedup by multi-index hashing.

A fingerprint's bit is set if it is set in over half of the XXH64 hashes of
the text's word shingles. Two fingerprints link at ``max_bits`` or fewer
differing bits.

Search: a fingerprint is cut into ``segments`` equal segments, so that linked
ones differ in at most ``max_bits // segments`` bits of some segment. Each
distinct fingerprint is put into a table by each segment's value, and asks
for every value in the Hamming ball of that radius around its own. Of a pair
whose segments differ, the one with the smaller segment value asks, which
halves the ball. All complete distances of what a table returns are verified.

Scale: exact copies are reduced to one row first. A table entry that many
fingerprints share (near copies of one text) is dealt to cells of bounded
size, each a block of entries against a block of askers; a cell returns its
verified links reduced to a spanning forest, never all pairs. Components come
from ``graph.components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskstream.llm import graph
from riskstream.llm.common import Scratch, salted_cells

SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 2
BITS = 64
SEED = 42
BLOCK = 1024        # entries and askers of a cell
_STEP = 1 << 16     # shingles whose bits are counted at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text; 0 if it has no words or is null."""
    words = (text or "").encode().lower().split()     # bytes: ASCII case and ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[:-shingle]).tolist()]
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())], "<u8")
    set_ = np.zeros(BITS, "i8")
    for at in range(0, len(hashes), _STEP):
        part = hashes[at:at + _STEP]
        set_ += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(((2 * set_ > len(hashes)).astype("u8") << np.arange(BITS, dtype="u8")).sum())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's bits as a signed long) of each
    row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], "u8").view("i8")
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "fp": fp})
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
            .mapInPandas(run, f"doc_id {kind}, text_hash long, fp long"))


def _segment(fp: Column, s: int, width: int) -> Column:
    mask = (1 << width) - 1 if width < 64 else -1
    return F.shiftrightunsigned(fp, s * width).bitwiseAND(F.lit(mask).cast("long"))


def _ball(width: int, radius: int) -> list[int]:
    """Masks of 1 to radius bits."""
    out = [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def forest(pairs_of, n: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links that ``pairs_of`` yields as index arrays."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs_of:
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                yield x, y


def cell_links(entry: np.ndarray, asker: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links between entries and askers of one cell, as a spanning forest."""
    values = np.concatenate([entry, asker])
    n = len(entry)

    def pairs():
        for at in range(0, len(asker), 256):
            near = np.bitwise_count((entry[:, None] ^ asker[None, at:at + 256]).view("u8")) <= max_bits
            i, j = np.nonzero(near)
            real = entry[i] != asker[at + j]
            # links of one asker: each to its first partner first
            yield i[real], j[real] + at + n

    return [(int(values[x]), int(values[y])) for x, y in forest(pairs(), len(values))]


def links(spark: SparkSession, fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """fps: distinct ``fp`` -> (u, v) between fingerprints: enough of the pairs
    within max_bits to connect all that such pairs connect."""
    width, radius = BITS // segments, max_bits // segments
    masks = _ball(width, radius)
    fp = F.col("fp")

    def seg(s: int) -> Column:
        return _segment(fp, s, width)

    ask = F.array(*[
        F.struct(F.lit(s).alias("s"), x.alias("k"), F.lit(e).alias("entry"))
        for s in range(segments) for x, e in ((seg(s), True), (seg(s), False))])
    ball = F.array(*[F.lit(m).cast("long") for m in masks]) if masks else F.array().cast("array<bigint>")

    def near(s: int) -> Column:
        asked = F.transform(ball, lambda m: seg(s).bitwiseXOR(m))
        return F.transform(F.filter(asked, lambda k: k > seg(s)),
                           lambda k: F.struct(F.lit(s).alias("s"), k.alias("k"), F.lit(False).alias("entry")))

    rows = (fps.select("fp", F.explode(F.concat(ask, *map(near, range(segments)))).alias("x"))
            .select("fp", "x.s", "x.k", "x.entry"))
    # Keys that may have many rows: those of large table entries and of the ball around them.
    large = (fps.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), seg(s).alias("k")) for s in range(segments)])).alias("x"))
             .groupBy("x.s", "x.k").count().where(F.col("count") > BLOCK // 8))
    around = F.concat(F.array(F.lit(0).cast("long")), ball)
    sizes = (large.select("s", F.explode(F.transform(around, lambda m: F.col("k").bitwiseXOR(m))).alias("k"), "count")
             .groupBy("s", "k").agg(F.sum("count").alias("n_entry"), F.sum("count").alias("n_ask")))
    sizes = Scratch(spark, "simhash").write(sizes, "large")
    cells = salted_cells(rows, ["s", "k"], F.col("entry"), F.xxhash64("fp"), sizes, BLOCK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, cell in grouped(batches, ["s", "k", "ci", "cj"]):
            e = cell["entry"].to_numpy()
            v = cell["fp"].to_numpy()
            # One row of each kind may be of two fingerprints, where a key is dealt to cells.
            if e.any() and not e.all() and (len(v) > 2 or v[0] != v[1]):
                found = cell_links(v[e], v[~e], max_bits)
                if found:
                    yield pd.DataFrame(found, columns=["u", "v"])

    dealt = cells.repartition("s", "k", "ci", "cj").sortWithinPartitions("s", "k", "ci", "cj")
    return dealt.mapInPandas(run, "u long, v long")


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of rows that are sorted by ``keys``, also across batches. Rows
    alone in their group are passed over quickly: a group needs two rows."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        edge = np.concatenate([[0], cut, [len(b)]])
        if held and tuple(held[-1][keys].iloc[-1]) != tuple(k[0]):
            yield tuple(held[-1][keys].iloc[-1]), pd.concat(held) if len(held) > 1 else held[0]
            held = []
        last = len(edge) - 2
        for g in np.flatnonzero(np.diff(edge) > 1).tolist() if last else []:
            if g == last or (g == 0 and held):
                continue
            yield tuple(k[edge[g]]), b.iloc[edge[g]:edge[g + 1]]
        if last and held:
            held.append(b.iloc[:edge[1]])
            yield tuple(k[0]), pd.concat(held)
            held = []
        held.append(b.iloc[edge[last]:])
    if held:
        yield tuple(held[-1][keys].iloc[-1]), pd.concat(held) if len(held) > 1 else held[0]


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, text_hash, fp, component_id: the smallest doc_id reachable over
    links, the row's own included. A row for each input row; null, empty and wordless
    texts have fingerprint 0 and link like any other. A null doc_id forms no
    name: a component of such rows alone has a null component_id. An empty
    table gives an empty result."""
    scratch = Scratch(spark, "simhash")
    fps = scratch.write(fingerprints(docs, shingle), "fp")
    own = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    comp = graph.components(spark, links(spark, own.select("fp"), max_bits))
    rooted = own.join(comp, own["fp"] == comp["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = scratch.write(rooted.join(low, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component: one document
    of each group, all of its columns. Rows equal in doc_id and text count as
    one document; rows without a doc_id stay only where their whole component
    has none."""
    found = near_duplicates(spark, docs, shingle, max_bits)
    drop = (found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("_drop"), F.col("text_hash").alias("_hash")).distinct())
    return docs.join(drop, docs["doc_id"].eqNullSafe(F.col("_drop")) & (F.xxhash64(docs["text"]) == F.col("_hash")), "left_anti")
