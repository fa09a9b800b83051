import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from riskstream.llm import merkle as M
from riskstream.llm.common import read_table
from riskstream.llm.queries import op12_merkle_manifest
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    parts = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """Levels from the given nodes to the last one."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(levels, i):
    """(siblings left, right) of node i at each level."""
    out = []
    for level in levels[:-1]:
        first = i - i % 16
        out.append(("".join(level[first:i]), "".join(level[i + 1:first + 16])))
        i //= 16
    return out


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            way = path(trees[s], i) + path(top, k)
            acc = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                acc = leaf(r, lower(r["text"]))
            for a, b in way:
                acc = h(a + acc + b)
            out.append((r["doc_id"], own, trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in way)), acc, acc == top[-1][0]))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[4]))


def query(spark, docs, every):
    t = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, M.ascii_lower(F.col("text"))).otherwise(F.col("text"))
    f = M.verify(spark, docs, t, every).withColumn("folded", M.fold(F.coalesce("claimed", "leaf"), F.col("path")))
    got = f.select("doc_id", "leaf", "subroot", "root", M.digest(M.siblings(F.col("path"))), "folded",
                   F.col("folded") == F.col("root")).collect()
    return sorted(map(tuple, got), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[4]))


def test_query_matches_brute_force(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    got = sorted(map(tuple, op12_merkle_manifest(spark, SF_SMALL).collect()), key=lambda x: (x[0], x[1], x[4]))
    assert got == brute([r.asDict() for r in docs.collect()])
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("every", [1, 2, 3])
def test_hot_source_many_sources_and_all_depths(spark, every):
    rows = [(i, f"Text {i} É", "en", "hot", i) for i in range(4700)]
    rows += [(i, "A", None, f"s{i}", 1) for i in range(300)]               # 300 sources of one leaf
    rows += [(i, "B", "x", f"n{n}", None) for n in (15, 16, 17, 255, 256, 257) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "X", None, None, None), (5, "", "", "", 0)]
    rows += [(7, "Same", "en", "same", 4)] * 40 + [(7, "Other", "en", "same", 5)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = brute([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows])
    assert query(spark, docs, every) == want


def test_few_rows_and_extra_columns(spark):
    one = spark.createDataFrame([(5, "T", "en", None, 1)], SCHEMA).withColumn("tree", F.lit("x")).withColumn("place", F.lit(1)) \
        .withColumn("_seq", F.lit(1))
    want = brute([{"doc_id": 5, "text": "T", "lang": "en", "source": None, "n_chars": 1}])
    assert query(spark, one, 2) == want
    assert want[0][1] == want[0][2] == want[0][3] and want[0][4] == h("")
    assert query(spark, one.where("false"), 2) == []
    assert M.manifest(spark, one).select("leaf", F.size("path")).first()[1] == 0


def test_long_text(spark):
    rows = [(1, "Ab é" * 500_000, "en", "s", 1), (2, "x", "en", "s", 1)]
    assert query(spark, spark.createDataFrame(rows, SCHEMA), 2) == brute(
        [dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows])


def test_only_every_second_level_is_written(spark):
    from riskstream.llm.common import Scratch
    leaves = spark.range(5000).select(F.lit(0).cast("long").alias("tree"), M._levels(F.lit(5000)).alias("levels"),
                                      F.col("id").alias("place"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    t = M.Tree(Scratch(spark, "merkle-test"), leaves, 5000)
    assert [level.count() for level in t.stored] == [5000, 20, 1]
