import hashlib
import random
import zlib
from functools import lru_cache
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskstream.llm import structure as S
from riskstream.llm.common import read_table
from riskstream.llm.oracle import ORACLE
from riskstream.llm.queries import op13_structure_repair
from riskstream.plans.check import compare, duck
from tests.conftest import SF_ORACLE, SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(symbols):
    """Least (cost, edits) over all edit sequences, insertions included, by the rows that are left."""
    symbols = tuple(symbols)

    @lru_cache(None)
    def rest(i, state, inserted):
        options = [(0, "")] if i == len(symbols) and state in ("", "A") else []

        def go(cost, edit, i, state, inserted):
            c, e = rest(i, state, inserted)
            options.append((cost + c, edit + e))
        after = {"": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}[state]
        if inserted < 2:
            for role in after:
                if role != "s":
                    go(5, "I", i, after[role], inserted + 1)
        if i < len(symbols):
            role, fault = "suax"[symbols[i] >> 2], symbols[i] & 3
            go(2, "D", i + 1, state, 0)
            if fault not in (S.BLANK, S.DUPLICATE):
                stay = 5 * (fault == S.TRUNCATED)
                if role in after:
                    go(stay, "K", i + 1, after[role], 0)
                for to in "ua":
                    if to in after:
                        go(stay + 1, "R", i + 1, after[to], 0)
        return min(options, default=(10 ** 9, ""))
    return rest(0, "", 0)


def repaired(rows, audit):
    out, at = [], 0
    for e in audit:
        role, text = rows[at] if e != "I" else (None, "")
        at += e != "I"
        if e == "D":
            continue
        out.append((role if e == "K" else "assistant" if out and out[-1][0][0] == "u" else "user", text))
    return out


def brute(rows, names):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    found = {}
    for conv in names:
        own = sorted(convs.get(conv, []))
        seen, symbols, counts = set(), [], [0, 0, 0, 0]
        for _, _, role, text in own:
            full = text.rstrip(WHITE)
            fault = (S.BLANK if not text.strip(WHITE) else S.DUPLICATE if (role, text) in seen
                     else S.NONE if full[-1] in ".!?" else S.TRUNCATED)
            seen.add((role, text))
            counts[fault] += 1
            symbols.append("sua".find(role[:1]) * 4 + fault if role[:1] in ("s", "u", "a") else 12 + fault)
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[1] for r in own if r[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = cheapest(symbols)
        text = "\n".join(f"{a}:{b}" for a, b in repaired([(r[2], r[3]) for r in own], audit))
        found[conv] = (gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def run(spark, df, names=None):
    got = S.repair(spark, df, df if names is None else names)
    return {r[0]: tuple(r[1:]) for r in got.collect()}


def test_matrices_match_enumeration():
    sequences = [list(p) for n in (1, 2, 3) for p in product(range(16), repeat=n)]
    rng = random.Random(3)
    sequences += [[rng.randrange(16) for _ in range(rng.randint(4, 14))] for _ in range(600)]
    e = S.Evaluated([np.array(s) for s in sequences])
    assert e.rules
    for i, s in enumerate(sequences):
        total, states, tail = S.chain([(e.costs[i].tolist(), e.ranks[i].tolist())])
        (p, q), = states
        assert (total, e.audit(i, p, q) + tail) == cheapest(s)


def test_blocks_chain_to_the_same_edits():
    rng = random.Random(4)
    for _ in range(150):
        s = [rng.choice([4, 8, 8, 4, 0, 5, 7, 11, 12, 15, 9]) for _ in range(rng.randint(2, 24))]
        cut = sorted(rng.sample(range(1, len(s)), min(len(s) - 1, 3)))
        parts = [s[a:b] for a, b in zip([0, *cut], [*cut, len(s)])]
        e = S.Evaluated([np.array(p) for p in parts])
        total, states, tail = S.chain([(c.tolist(), r.tolist()) for c, r in zip(e.costs, e.ranks)])
        audit = "".join(e.audit(i, p, q) for i, (p, q) in enumerate(states)) + tail
        assert (total, audit) == cheapest(s)


def test_grammar_expands_to_the_sequences():
    rng = random.Random(5)
    sequences = [np.array([rng.choice([4, 8, 4, 4, 0]) for _ in range(rng.randint(1, 40))]) for _ in range(200)]
    sequences.append(np.array([4] * 101))
    rules, top = S.re_pair(sequences)

    def expand(x):
        return [x] if x < 16 else expand(rules[x - 16][0]) + expand(rules[x - 16][1])
    assert [[y for x in t for y in expand(int(x))] for t in top] == [s.tolist() for s in sequences]
    assert len(rules) > 20 and sum(map(len, top)) < sum(map(len, sequences)) / 3
    # With and without rules the same matrices.
    a, b = S.Evaluated(sequences), S.Evaluated(sequences, rules=0)
    assert (a.costs == b.costs).all()
    assert [a.audit(i, 0, 3) for i in range(50)] == [b.audit(i, 0, 3) for i in range(50)]


def random_rows(rng, convs):
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, 9)):
            out.append((c if c else None, t if rng.random() < 0.9 else None,
                        rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]),
                        rng.choice(["Hi.", "Yes!", "Why?  ", "cut off", "", " \t", None, "Ends ", "Hi.\n"])))
    return out


@pytest.mark.parametrize("bits", [1, 12])
def test_tables_match_brute_force(spark, monkeypatch, bits):
    """Nulls in every column, ties, repeated rows; also with blocks of two rows."""
    monkeypatch.setattr(S, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    rows = random_rows(rng, 40)
    rows += rows[:30]
    # order of ties: by role, then a hash of the text; here the texts of a tie are equal
    kept = {}
    for r in rows:
        kept.setdefault((r[0], r[1], " " if r[2] is None else r[2]), r)
    rows = [kept[r[0], r[1], " " if r[2] is None else r[2]] for r in rows]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("seq", F.lit("x")).withColumn("blk", F.lit(1)).repartition(5)
    assert run(spark, df) == brute(rows, {r[0] for r in rows})


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"t{t}.", "same!", ""])) for t in range(9000)]
    rows += [(8, 1, "user", "a.")]
    got = run(spark, spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got[8] == brute(rows[-1:], {8})[8]
    assert got[7][:5] == (0, sum(r[3] == "" for r in rows), got[7][2], 0, got[7][4])
    symbols, seen = [], set()
    for r in rows[:-1]:
        fault = S.BLANK if r[3] == "" else S.DUPLICATE if r[2:] in seen else S.NONE
        seen.add(r[2:])
        symbols.append(("sua".find(r[2][0])) * 4 + fault)
    e = S.Evaluated([np.array(symbols)], rules=0)
    total, ((p, q),), _ = S.chain([(e.costs[0].tolist(), e.ranks[0].tolist())])
    assert got[7][5:7] == (total, e.audit(0, p, q))
    assert got[7][7] == hashlib.sha256("\n".join(
        f"{a}:{b}" for a, b in repaired([r[2:] for r in rows[:-1]], got[7][6])).encode()).hexdigest()


def test_empty_table_and_names_without_rows(spark):
    names = spark.createDataFrame([(1,), (None,), (1,)], "conv_id long")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = spark.createDataFrame([], SCHEMA)
    assert run(spark, empty, names) == {1: nothing, None: nothing}
    assert run(spark, empty) == {}


def test_long_text(spark):
    rows = [(1, 0, "user", "x " * 1_000_000 + "." + " \n" * 1_000_000), (1, 1, "assistant", "y" * 2_000_000)]
    assert run(spark, spark.createDataFrame(rows, SCHEMA)) == brute(rows, {1})


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        if k:
            text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def test_damage(spark):
    rows = [(c if c else None, t if t else None, None if t == 3 else "assistant", None if t == 2 else "A.b!") for c in range(30) for t in range(8)]
    got = S.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(damaged(rows), key=key)


def test_query_matches_brute_force_and_sql(spark):
    rows = [tuple(r) for r in read_table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[1:]) for r in op13_structure_repair(spark, SF_SMALL).collect()}
    assert got == brute(damaged(rows), {r[0] for r in rows})
    assert compare(op13_structure_repair(spark, SF_ORACLE), duck(SF_ORACLE), ORACLE["op13_structure_repair"])["match"]
