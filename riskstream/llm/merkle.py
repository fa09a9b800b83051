"""Merkle manifest of a dataset, with checkpoint and recompute.

A leaf is the digest of a row's columns. The leaves of a source ascend by
doc_id; runs of ``ARITY`` consecutive nodes become the digest of their digests
(hex text) until one is left, the source's subroot. The subroots, ordered by
source, make the upper tree in the same way; its last node is the root.

Only every ``EVERY``-th level of a tree is written (leaves, level 2, level 4,
.. and subroots). A proof is extracted from the top down: the nodes of a
written level are grouped into aligned subtrees of ARITY ** EVERY, each
regenerates the levels in between from its nodes, hands every node the runs on
its path (its own plus those of the subtree's root, from the step above) and
drops what it regenerated. A node's siblings are the others of each run.

All of it is DataFrame expressions; digests are made where the text is read, and
no text is shuffled. Places come from a range sort by (source, doc_id, leaf)
with counts per (partition, source), so that a source that holds any share of
the rows is spread over tasks, as its subtrees are later. A group is one
subtree: at most ARITY ** EVERY digests. The driver sees one number, the
largest source, from which the steps follow: one for each EVERY levels.

Null doc_ids come first in their source and rows equal in (source, doc_id)
ascend by leaf, so repeated rows are leaves of their own. A null source is a
source of its own, before all others. A lone leaf is its source's subroot, a lone
subroot the root; an empty table has no rows and no root. Columns other than
the five are not part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskstream.llm.common import Scratch

ARITY = 16
EVERY = 2
HEX = 64                  # characters of a digest
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_MAX_LEVELS = 15          # 16 ** 15 leaves


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def leaf_of(*columns: Column) -> Column:
    """Digest of the values, each ``-`` if null, else its length in UTF-8
    bytes, a colon and the value (integers in decimal)."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return digest(F.concat(*map(part, columns)))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _levels(n: Column) -> Column:
    """Levels above n nodes until one is left."""
    out = F.lit(0)
    for k in range(_MAX_LEVELS):
        out = F.when(n > F.lit(ARITY ** k), F.lit(k + 1)).otherwise(out)
    return out


def _next_level(nodes: Column) -> Column:
    """Digests of runs of ARITY of an array of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / F.lit(ARITY)).cast("int"))
    return F.transform(runs, lambda r: digest(F.array_join(F.slice(nodes, r * ARITY + 1, F.lit(ARITY)), "")))


def _run_at(nodes: Column, place: Column) -> Column:
    """(run, place in it) of a node of an array of digests; the run is the
    digests of its aligned group, joined."""
    first = place - place % ARITY
    return F.struct(F.array_join(F.slice(nodes, first + 1, F.lit(ARITY)), "").alias("run"),
                    (place % ARITY).cast("int").alias("place"))


def fold(node: Column, path: Column) -> Column:
    """The root that a node and the runs on its path lead to: at each level
    the node takes its place among its siblings."""
    return F.aggregate(path, node, lambda acc, r: digest(F.concat(
        F.substr(r["run"], F.lit(1), r["place"] * HEX), acc, F.substr(r["run"], (r["place"] + 1) * HEX + 1))))


def siblings(path: Column) -> Column:
    """The siblings' digests, level by level, left to right, joined."""
    return F.array_join(F.transform(path, lambda r: F.concat(
        F.substr(r["run"], F.lit(1), r["place"] * HEX), F.substr(r["run"], (r["place"] + 1) * HEX + 1))), "")


class Tree:
    """Trees over the rows of ``leaves`` (tree, levels, place, node, ..): one
    for each value of ``tree``, its leaves numbered from 0 by ``place``, with
    ``levels`` levels above them. ``largest`` is the most leaves that a tree has.
    A tree that ends between two written levels has its last node in the upper one."""

    def __init__(self, scratch: Scratch, leaves: DataFrame, largest: int, every: int = EVERY):
        self.scratch, self.every, self.width = scratch, every, ARITY ** every
        self.stored = [leaves]                                      # every ``every``-th level
        n = largest
        while n > 1:
            self.stored.append(scratch.write(self._above(self.stored[-1], len(self.stored) - 1), "level"))
            n = -(-n // self.width)
        tops = [level.where(self._ends(k)).select("tree", "levels", "node") for k, level in enumerate(self.stored)]
        self.tops = tops[0]                                         # the last node of each tree
        for t in tops[1:]:
            self.tops = self.tops.unionByName(t)

    def _ends(self, k: int) -> Column:
        """Whether a tree ends at written level k: not before, not above."""
        return (F.col("levels") > (k - 1) * self.every) & (F.col("levels") <= k * self.every)

    def _subtrees(self, level: DataFrame, k: int, *more: str) -> DataFrame:
        """The aligned subtrees of written level k, of trees that go on above
        it: (tree, levels, block, height, rows); rows are (at, node, more..) in order."""
        row = F.struct((F.col("place") % self.width).cast("int").alias("at"), "node", *more)
        height = F.least(F.col("levels") - k * self.every, F.lit(self.every)).alias("height")
        return (level.where(F.col("levels") > k * self.every)
                .groupBy("tree", "levels", F.floor(F.col("place") / self.width).alias("block"), height)
                .agg(F.array_sort(F.collect_list(row)).alias("rows")))

    def _interior(self, rows: Column, height: Column) -> list[Column]:
        """The subtree's levels as arrays, its own nodes first; null above its height."""
        out = [F.transform(rows, lambda r: r["node"])]
        for h in range(1, self.every + 1):
            out.append(F.when(height >= h, _next_level(out[-1])))
        return out

    def _above(self, level: DataFrame, k: int) -> DataFrame:
        t = self._subtrees(level.select("tree", "levels", "place", "node"), k)
        levels = self._interior(F.col("rows"), F.col("height"))
        return t.select("tree", "levels", F.col("block").alias("place"), F.coalesce(*[x[0] for x in reversed(levels[1:])]).alias("node"))

    def proofs(self, tops: DataFrame, given: tuple[str, ...], *more: str) -> DataFrame:
        """(tree, place, node, given.., more.., path) of every leaf: path is
        the runs from the leaf up. ``tops`` (tree, path, given..) has what every leaf of a
        tree gets: the path above its last node, on which the leaf's own ends,
        and further columns. ``more`` are columns of the leaves."""
        above = None
        for k in range(len(self.stored) - 1, -1, -1):
            extra = more if k == 0 else ()
            last = (self.stored[k].where(self._ends(k)).join(tops, "tree")
                    .select("tree", "place", "node", *given, *extra, "path"))
            if above is not None:
                t = self._subtrees(self.stored[k], k, *extra).join(
                    above.select("tree", F.col("place").alias("block"), *given, F.col("path").alias("rest")), ["tree", "block"])
                levels = self._interior(F.col("rows"), F.col("height"))[:self.every]

                def found(x: Column) -> Column:
                    """The rows with their paths; x holds the regenerated levels, made once for all rows."""
                    return F.transform("rows", lambda r: F.struct(
                        r["at"].alias("at"), r["node"].alias("node"), *[r[c].alias(c) for c in extra],
                        F.concat(F.array_compact(F.array(*[
                            F.when(F.col("height") > h, _run_at(x[f"level{h}"], F.floor(r["at"] / ARITY ** h).cast("int")))
                            for h in range(self.every)])), F.col("rest")).alias("path")))

                made = F.array(F.struct(*[v.alias(f"level{h}") for h, v in enumerate(levels)]))
                t = t.select("tree", "block", *given, F.explode(F.transform(made, found)[0]).alias("r"))
                last = last.unionByName(t.select(
                    "tree", (F.col("block") * self.width + F.col("r.at")).alias("place"), F.col("r.node").alias("node"),
                    *given, *[F.col(f"r.{c}").alias(c) for c in extra], F.col("r.path").alias("path")))
            above = self.scratch.write(last, "paths") if k else last
        return above


class Order:
    """Rows numbered within groups: a range sort whose partitions are counted.
    ``sizes`` (group.., n); ``places(names)`` the rows with their place."""

    def __init__(self, scratch: Scratch, rows: DataFrame, group: str, order: list[Column], name: str):
        self.group, self.columns = group, rows.columns
        self.rows = scratch.write(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                                  .withColumn("_seq", F.monotonically_increasing_id()), name)
        self.counts = scratch.write(self.rows.groupBy(group, F.shiftright("_seq", 33).alias("_part"))
                                    .agg(F.count("*").alias("_n"), F.min("_seq").alias("_first")), name + "-counts")
        self.sizes = self.counts.groupBy(group).agg(F.sum("_n").alias("n"))

    def places(self, names: DataFrame | None = None) -> DataFrame:
        """The rows and ``place``, from 0 within their group, and the columns
        that ``names`` has for the group. Only (group, partition) counts
        meet the names, so that a large group is no key of a join."""
        w = Window.partitionBy(self.group).orderBy("_part")
        c = self.counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).withColumnRenamed(self.group, "_group")
        more = []
        if names is not None:
            more = [x for x in names.columns if x != self.group]
            c = c.join(names.withColumnRenamed(self.group, "_name"), F.col("_group").eqNullSafe(F.col("_name")))
        c = c.select("_group", F.col("_part").alias("_at"), "_first", "_before", *more)
        on = (F.shiftright("_seq", 33) == F.col("_at")) & F.col(self.group).eqNullSafe(F.col("_group"))
        return self.rows.join(c, on).select(*self.columns, *more, (F.col("_seq") - F.col("_first") + F.col("_before")).alias("place"))


def manifest(spark: SparkSession, docs: DataFrame, every: int = EVERY) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, leaf, subroot, root and
    path, the (run, place) pairs from leaf to root that ``siblings`` and ``fold`` read."""
    return _extract(spark, docs.select("doc_id", "source", leaf_of(*map(F.col, COLUMNS)).alias("node")), every)


def verify(spark: SparkSession, docs: DataFrame, text: Column, every: int = EVERY) -> DataFrame:
    """``manifest`` and, for each row, ``claimed``: the leaf that the row has
    if its text is replaced by ``text``, a column over the five; null where
    that is the leaf itself."""
    own = leaf_of(*map(F.col, COLUMNS))
    other = F.when(~text.eqNullSafe(F.col("text")), leaf_of(*[F.col(c) for c in COLUMNS[:-1]], text))
    return _extract(spark, docs.select("doc_id", "source", own.alias("node"), other.alias("claimed")), every, "claimed")


def _extract(spark: SparkSession, leaves: DataFrame, every: int, *more: str) -> DataFrame:
    scratch = Scratch(spark, "merkle")
    # rows equal in source, doc_id and leaf are told apart by where they were read
    leaves = leaves.withColumn("_row", F.monotonically_increasing_id())
    rows = Order(scratch, leaves, "source", [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(),
                                             F.col("node"), F.col("_row")], "leaves")
    # a source's number is its place in the upper tree
    sources = Order(scratch, rows.sizes.withColumn("one", F.lit(0)), "one", [F.col("source").asc_nulls_first()], "sources")
    sources = scratch.write(sources.places().select("source", "n", F.col("place").alias("tree")), "numbers")
    largest, many = sources.agg(F.max("n"), F.count("*")).first()
    placed = rows.places(sources.select("source", "tree", _levels(F.col("n")).alias("levels")))
    placed = scratch.write(placed.select("tree", "levels", "place", "node", "doc_id", "source", *more), "placed")
    scratch.drop(rows.rows)
    lower = Tree(scratch, placed, largest or 0, every)
    subroots = scratch.write(lower.tops.select(
        F.lit(0).cast("long").alias("tree"), _levels(F.lit(many)).alias("levels"), F.col("tree").alias("place"), "node"), "subroots")
    upper = Tree(scratch, subroots, many, every)
    nothing = F.array().cast("array<struct<run:string,place:int>>").alias("path")
    paths = upper.proofs(upper.tops.select("tree", F.col("node").alias("root"), nothing), ("root",))
    paths = scratch.write(paths.select(F.col("place").alias("tree"), F.col("node").alias("subroot"), "root", "path"), "upper")
    found = lower.proofs(paths, ("subroot", "root"), "doc_id", "source", *more)
    return found.select("doc_id", "source", F.col("node").alias("leaf"), "subroot", "root", *more, "path")
