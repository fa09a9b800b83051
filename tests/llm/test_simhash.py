import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from riskstream.llm import simhash as S


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, bits=3):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min((x for x in (low.get(find(i)), d) if x is not None), default=None)
    return [low[find(i)] for i in range(len(rows))]


TEXTS = ["", None, "one", "One two", "ONE TWO three", "É Ä Ünicode words here", "a b c d", "a\x0bb\x0cc\x1cd e", " \t\n ",
         "same words same words same words", "x " * 40_000, "tail of words   here", "a b c d", "A B C D"]


def test_fingerprints_match_the_definition():
    for t in TEXTS:
        assert S.fingerprint(t) == brute_fingerprint(t), t


def near(rng, n, family):
    base = rng.integers(0, 1 << 63, n, dtype="u8")
    out = [int(b) for b in base]
    for b in base[:family]:
        for _ in range(40):
            v = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                v ^= 1 << int(bit)
            out.append(v)
    return sorted(set(out))


def check_links(spark, fps):
    signed = [int(np.array(v, "u8").view("i8")) for v in fps]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = [(r.u, r.v) for r in S.links(spark, df).collect()]
    want = brute_components(list(enumerate(fps)))
    at = {v: i for i, v in enumerate(signed)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in got:
        assert bin((u ^ v) & (1 << 64) - 1).count("1") <= 3
        a, b = find(at[u]), find(at[v])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == want


def test_links_connect_what_brute_force_connects(spark):
    check_links(spark, near(np.random.default_rng(0), 200, 12))


def test_large_table_entries_are_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(1)
    fps = {(77 << 32) | int(x) for x in rng.integers(0, 1 << 10, 150)} | {int(x) << 32 | 5 for x in rng.integers(0, 1 << 9, 60)}
    check_links(spark, sorted(fps))


def test_near_duplicates(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "One two"), (None, "one"), (None, "nobody's own words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = S.near_duplicates(spark, df).collect()
    fps = [brute_fingerprint(t) for _, t in docs]
    want = brute_components([(d, f) for (d, _), f in zip(docs, fps)])
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == sorted(
        ((d, f, c) for (d, _), f, c in zip(docs, fps, want)), key=str)
    kept = S.keep_one(spark, df)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(
        (d for (d, _), c in zip(docs, want) if d == c), key=str)


def test_empty_table_and_hex(spark):
    assert S.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(0,), (-1,), (255,)], "fp long")
    assert [r[0] for r in df.select(S.hex_digits(F.col("fp"))).collect()] == ["0" * 16, "f" * 16, "0" * 14 + "ff"]


def test_sparse_keys_beside_a_hot_value(spark, monkeypatch):
    """Pairs alone under a segment value one bit below a hot one, 2 or 3 bits
    apart in the other segment: that key is dealt like the hot one, so that
    the two meet in a cell with no third row. And pairs that differ in both
    segments, one end under the hot value."""
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(5)
    low = [int(x) for x in rng.choice(1 << 32, 300, replace=False)]
    hot = 0xFFFFFFFF
    fps = {hot << 32 | x for x in low[:200]}
    for n, x in enumerate(low[200:232]):
        beside = (hot ^ 1 << n) << 32
        fps |= {beside | x, beside | x ^ (0b11 if n % 2 else 0b111)}
    for n, x in enumerate(low[:32]):
        fps.add((hot ^ 1 << n) << 32 | x ^ 0b101)
    check_links(spark, sorted(fps))
