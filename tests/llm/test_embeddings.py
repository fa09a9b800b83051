import numpy as np
import pytest
from pyspark.sql import functions as F

from riskstream.llm import ann, embedding_dedup as E


def table(spark, rows, extra=False):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows],
                               "vec_id long, embedding array<double>")
    return df.withColumn("node", F.lit("x")).withColumn("rank", F.lit(7)) if extra else df


def clustered(n, dim, rng, noise):
    centres = rng.standard_normal((max(2, n // 12), dim))
    v = centres[rng.integers(0, len(centres), n)] + noise * rng.standard_normal((n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def links(rows, least=E.MIN_COSINE):
    u = [E.unit(v) for _, v in rows]
    return [(i, j) for i in range(len(u)) for j in range(i + 1, len(u))
            if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= least]


def check_dedup(spark, rows, recall=1.0):
    got = E.near_duplicates(spark, table(spark, rows, extra=True)).collect()
    want = links(rows)
    assert len(got) == len(rows)
    n = np.zeros(len(rows), int)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in want:
        n[i] += 1
        n[j] += 1
        root[find(i)] = find(j)
    if recall == 1.0:
        low = {}
        for i, (k, _) in enumerate(rows):
            low[find(i)] = min((x for x in (low.get(find(i)), k) if x is not None), default=None)
        exp = sorted(((k, int(n[i]), low[find(i)], k == low[find(i)]) for i, (k, _) in enumerate(rows)), key=str)
        assert sorted((tuple(r) for r in got), key=str) == exp
    else:
        assert recall * n.sum() <= sum(r.n_links for r in got) <= n.sum()


def test_dedup_edge_cases(spark):
    rows = [(1, [1, 0, 0, 0]), (2, [2, 0, 0, 0]), (3, [0, 0, 0, 0]), (4, None), (5, [1, None, 0, 0]), (6, [float("nan"), 1, 0, 0]),
            (7, [1, 0]), (8, [1, 0.01, 0, 0]), (8, [1, 0.01, 0, 0]), (None, [1, 0, 0, 0]), (9, []), (10, [float("inf"), 0, 0, 0]),
            (11, [1e200, 1e198, 0, 0]), (None, [0, 0, 1, 0])]
    check_dedup(spark, rows)
    assert E.near_duplicates(spark, table(spark, [])).count() == 0
    assert [tuple(r) for r in E.near_duplicates(spark, table(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]


def test_dedup_blocks_and_grid(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    monkeypatch.setattr(E, "CELL", 16)
    rng = np.random.default_rng(5)
    v = clustered(400, 16, rng, 0.06)
    check_dedup(spark, list(enumerate(np.vstack([v, v[:20]]).tolist())), recall=0.97)


def test_dedup_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {r.vec_id: r.n_links for r in E.near_duplicates(spark, df).collect()}
    x = np.array([v for _, v in rows], "f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= E.MIN_COSINE).sum(1) - 1
    have = np.array([got[i] for i, _ in rows])
    assert (have <= want).all() and have.sum() >= 0.99 * want.sum()


def test_multi_sequence_order():
    rng = np.random.default_rng(0)
    x, left, right = rng.standard_normal((50, 8)), rng.standard_normal((7, 4)), rng.standard_normal((5, 4))
    sums = ((x[:, None, :4] - left) ** 2).sum(2)[:, :, None] + ((x[:, None, 4:] - right) ** 2).sum(2)[:, None, :]
    want = np.argsort(sums.reshape(50, -1), 1)
    for t in (1, 4, 9, 35):
        assert (E.traversal(x, left, right, t) == want[:, :t]).all()


def test_mih_returns_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    rows, asked = rng.integers(0, 256, (300, 6), "u1"), rng.integers(0, 256, (20, 6), "u1")
    rows[:40] = asked[rng.integers(0, 20, 40)] ^ (1 << rng.integers(0, 8, (40, 6))).astype("u1") * (rng.random((40, 6)) < .4)
    index, d = ann.SubstringIndex(rows), ann.distances(asked, rows)
    assert (d == np.array([[bin(int.from_bytes(a.tobytes(), "big") ^ int.from_bytes(b.tobytes(), "big")).count("1")
                            for b in rows] for a in asked])).all()
    for r in (0, 1, 3, 5, 6, 11, 20, 48):
        assert (index.within(asked, r) == (d <= r)).all()
        assert r == 48 or sum(s + 1 for s in ann.substring_radii(r, 6)) == r + 1


def brute_search(rows, asks, k):
    x = {i: np.array(v, "f8") for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    return {q: sorted(((-float(x[q] @ x[i]), i) for i in x if i != q))[:k] for q in x if asks(q)}


def test_search_edge_cases(spark):
    rows = [(i, v) for i, v in enumerate([[1, 0, 0], [0.5, 0, 0], [0, 2, 0], None, [0, 0, 0], [None, 1, 0], [float("nan"), 0, 1],
                                          [3, 0, 0], [0.5, 0, 0], [1, 1]])]
    got = ann.search(spark, table(spark, rows, extra=True), F.col("vec_id") % 2 == 0, k=20).collect()
    want = brute_search([r for r in rows if r[0] != 9], lambda q: q % 2 == 0, 20)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(
        (q, n + 1, i, pytest.approx(-s)) for q, best in want.items() for n, (s, i) in enumerate(best))
    assert ann.search(spark, table(spark, []), F.col("vec_id") % 2 == 0).count() == 0
    twice = ann.search(spark, table(spark, [(0, [1, 0]), (0, [1, 0]), (None, [1, 1])]), F.col("vec_id") % 2 == 0, k=5)
    assert twice.count() == 4


def test_search_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in ann.search(spark, df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    want = brute_search(rows, lambda q: q % 20 == 0, ann.K)
    assert got.keys() == want.keys() and all(len(v) == ann.K for v in got.values())
    hit = sum(i in got[q] for q, best in want.items() for _, i in best) / (ann.K * len(want))
    assert hit >= 0.9
    assert all(abs(got[q][i] + s) < 1e-12 for q, best in want.items() for s, i in best if i in got[q])


def test_equal_vectors_are_ordered_by_id(spark):
    rng = np.random.default_rng(8)
    distinct = rng.normal(size=(40, 64))
    rows = [(i, distinct[i % 40].tolist()) for i in range(480)]
    by_query = {}
    for r in ann.search(spark, table(spark, rows), F.col("vec_id") % 20 == 0).collect():
        by_query.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert len(by_query) == 24
    for found in by_query.values():
        found.sort()
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)
        for (_, s, v), (_, t, w) in zip(found, found[1:]):
            assert s != t if v % 40 != w % 40 else s == t
