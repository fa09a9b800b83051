import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from riskstream.llm import chat as C

LEGAL_NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def brute_cost(roles):
    """Cheapest repair by trying all role sequences."""
    best = C.INF
    for new in itertools.product(("system", "user", "assistant"), repeat=len(roles)):
        cost, state = 0.0, ""
        for old, r in zip(roles, new):
            known = (old or "").strip().lower() if isinstance(old, str) else ""
            cost += 0 if r == known else C.RELABEL if known in ("system", "user", "assistant") else C.RELABEL_UNKNOWN
            if r in LEGAL_NEXT[state]:
                pass
            elif r == state:
                cost += C.MERGE
            elif any(r in LEGAL_NEXT[q] for q in LEGAL_NEXT[state]):
                cost += C.INSERT
            else:
                cost = C.INF
            state = r
        cost += C.INSERT * {"": 2, "system": 2, "user": 1, "assistant": 0}[state]
        best = min(best, cost)
    return best


def legal(text):
    heads = [x.split("|>")[0] for x in text.split("<|") if not x.startswith("end") and x]
    if heads[:1] == ["system"]:
        heads = heads[1:]
    return len(heads) % 2 == 0 and heads == ["user", "assistant"] * (len(heads) // 2) and heads


def test_repair_is_cheapest_and_legal():
    rng = random.Random(0)
    for _ in range(300):
        roles = [rng.choice(["system", "user", "assistant", " User", None, "tool"]) for _ in range(rng.randint(1, 5))]
        out = C.repair(roles, [f"t{i}" for i in range(len(roles))])
        assert abs(sum(r[3] for r in out) - brute_cost(roles)) < 1e-9
        text = "".join(r[4] for r in out)
        assert legal(text), (roles, text)
        assert [f"t{i}" in text for i in range(len(roles))] == [True] * len(roles)


def test_split_conversations_are_repaired_as_a_whole(spark):
    rng = random.Random(1)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", None, "system"]), f"text {i}") for i in range(3000)]
    rows += [(c, i, rng.choice(["user", "assistant"]), "x") for c in range(100, 140) for i in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = C.format_chats(spark, df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert out.rdd.getNumPartitions() > 1
    got = out.collect()
    hot = sorted((r for r in got if r.conv_id == 7), key=lambda r: r.turn)
    want = C.repair([r[2] for r in rows[:3000]], [r[3] for r in rows[:3000]])
    assert abs(sum(r.cost for r in hot) - sum(w[3] for w in want)) < 1e-6
    assert legal("".join(r.rendered for r in hot))
    for c in range(100, 140):
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: r.turn)
        if own:
            assert [(r.new_role, r.rendered) for r in own] == [
                (w[0], w[4]) for w in C.repair([r.role for r in own], ["x"] * len(own))]


def test_edge_cases(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (1, None, "user", None), (1, None, "user", None), (2, 1, "", ""),
            (3, 1, "system", "s" * 300_000), (3, 1, "system", "s" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x")).withColumn("_row", F.lit(1))
    out = C.format_chats(spark, df).collect()
    assert len(out) == len(rows)
    assert sorted(r.action for r in out if r.conv_id == 1) == ["keep", "merge"]
    none = [r for r in out if r.conv_id is None]
    assert "".join(r.rendered for r in sorted(none, key=lambda r: r.turn)) == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n"
    assert C.format_chats(spark, df.limit(0)).count() == 0


def test_min_plus_matrix_is_associative():
    rng = random.Random(2)
    roles = [rng.randrange(4) for _ in range(30)]
    assert np.allclose(C.times(C.matrix(roles[:11]), C.matrix(roles[11:])), C.matrix(roles))
