import random

from riskstream.llm import graph


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(420)]
    links += [(1000 + i, 1001 + i) for i in range(64)] + [(7, 7), (5000, 5000), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        if u is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = graph.components(spark, spark.createDataFrame(links, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert graph.components(spark, spark.createDataFrame([], "u long, v long")).count() == 0
