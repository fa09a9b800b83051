import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskstream.llm import byte_bpe as B, packing as P
from riskstream.llm.queries import vocabulary

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = ["", None, "plain words, and more words", "a" * 20_000, "ab" * 9_000 + "é" * 500, "<|endoftext|> x", "\x00\x1c　 hi  ",
         "a\n\n b  c\n \nb ", "a ", "a\n b\n", " x", "a\n ", "a \x1c b\x1cc", "it's IT'S ''s 12a3", "日本語 текст 🙂🙂", "!!!???   \t\t.",
         "plain words, and more words"]


@pytest.fixture(scope="module")
def bpe():
    return B.ByteBPE.load(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def random_text(rng):
    return "".join(rng.choice(["a", "b", "th", "er", " ", " ", "\n", "  ", "é", "1", "!", "'s", "\t", "\u3000", "Z"]) for _ in range(rng.randint(0, 60)))


def test_encoding_matches_the_library(bpe, reference):
    rng = random.Random(0)
    for t in [t or "" for t in TEXTS] + [random_text(rng) for _ in range(3000)]:
        ids = bpe.encode(t).tolist()
        assert ids == reference.encode_ordinary(t), t
        assert bpe.decode(ids) == t.encode()


def test_rank_queue_takes_the_smallest_rank():
    rng, q, held = random.Random(1), B.RankQueue(), []
    for _ in range(4000):
        if held and rng.random() < 0.4:
            rank, positions = q.take()
            want = min(r for r, _ in held)
            assert rank == want and sorted(positions) == sorted(p for r, p in held if r == want)
            held = [x for x in held if x[0] != want]
        else:
            item = (rng.choice([rng.randrange(64 ** 3), rng.randrange(50)]), rng.randrange(100))
            q.push(*item)
            held.append(item)
        assert bool(q.top) == bool(held)


def test_overlapping_pairs_and_stale_entries():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"aba": 258, b"abab": 259, b"aa": 260, b"abc": 255 + 6}
    enc = tiktoken.Encoding("tiny", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})
    own, rng = B.ByteBPE(ranks, r"[^\n]+|\n"), random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("abc\n") for _ in range(rng.randint(0, 14)))
        assert own.encode(t).tolist() == enc.encode_ordinary(t), t


def test_frames(spark, bpe, reference):
    path, pat = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "x"), (3, "y")], "doc_id long, text string").withColumn("ids", F.lit(1))
    enc = B.encode(df, path, pat)
    back = {(r.doc_id, bytes(r.bytes)) for r in B.decode(enc, path, pat).collect()}
    assert back == {(i, (t or "").encode()) for i, t in enumerate(TEXTS)} | {(None, b"x"), (3, b"y")}
    dig = B.digest(df, path, pat)
    assert dig.count() == len(TEXTS) + 2
    assert {r.doc_id: r.n_tokens for r in dig.where("doc_id <> 3").collect()} == {
        i: len(reference.encode_ordinary(t or "")) for i, t in enumerate(TEXTS) if i != 3}
    assert B.digest(df.limit(0), path, pat).count() == 0


def test_memo_generations():
    calls = []
    m = P.Memo(lambda k: calls.append(k) or k * 2, entries=3)
    for k in "abcabcdabcefgabc":
        assert m[k] == k * 2
        assert len(m) <= 3 and len(m.old) <= 3
    assert m["x" * 100] == "x" * 200 and "x" * 100 not in m


def test_word_ids_match_the_library():
    w, rng = P.WordIds(vocabulary("word_bpe_49k.json")), random.Random(3)
    more = ["İstanbul ΣΑΣ", "a\u0301 \u0301b", "x\x1cy \x85 z　q\u200bq", "\x1c!\x1f!", "a\tb\x0bc\x0cd!\r!", "ÀÉß ªº²½ µ"]
    for t in [t or "" for t in TEXTS] + more + [random_text(rng) for _ in range(1500)]:
        want = w.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(w.encode(t), "<u4").tolist() == want, t


def brute_pack(lengths, capacity):
    bins = []          # [gap, id]
    out = []
    for s in lengths:
        def total(gaps):
            return sum(gaps.count(g) ** 2 for g in set(gaps) if 0 < g)
        gaps = [b[0] for b in bins]
        best = min([(total([*gaps[:i], g - s, *gaps[i + 1:]]), 0, g) for i, g in enumerate(gaps) if g >= s]
                   + [(total([*gaps, capacity - s]), 1, capacity)])
        if best[1]:
            bins.append([capacity, len(bins)])
            k = len(bins) - 1
        else:
            k = max(i for i, g in enumerate(gaps) if g == best[2])
        bins[k][0] -= s
        out.append(best[0])
    return out, len(bins)


def test_each_placement_has_the_smallest_sum_of_squares():
    rng = random.Random(4)
    for _ in range(60):
        cap = rng.choice([5, 9, 20])
        lengths = [rng.randint(1, cap) for _ in range(25)]
        seq, off = P.sum_of_squares(np.array(lengths), cap)
        want, made = brute_pack(lengths, cap)
        fill, got = {}, []
        for s, b, o in zip(lengths, seq.tolist(), off.tolist()):
            assert fill.get(b, 0) == o and o + s <= cap
            fill[b] = o + s
            gaps = [cap - f for f in fill.values() if f < cap]
            got.append(sum(gaps.count(g) ** 2 for g in set(gaps)))
        assert got == want and len(fill) == made


def check_packed(rows, docs, ids_of, cap):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, t in docs:
        ids = ids_of(t or "") + [P.END_ID]
        got = sorted(by_doc[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [
            (k, a, len(ids[a:a + cap]), zlib.crc32(np.array(ids[a:a + cap], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), cap))]
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap
    return len(by_seq)


def test_packed_documents(spark):
    path = vocabulary("word_bpe_49k.json")
    tok = P.WordIds(path).tokenizer
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["word", "Thing,", "é", "x1"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, "long " * 900), (153, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("offset", F.lit("x")).withColumn("row_key", F.lit(0))
    for groups in (10_000, 40):
        rows = P.pack_documents(spark, df, path, capacity=64, group_pieces=groups).collect()
        n = check_packed(rows, docs, lambda t: tok.encode(t, add_special_tokens=False).ids, 64)
        assert n <= 1.03 * -(-sum(r.length for r in rows) // 64) + 3
    assert P.pack_documents(spark, df.limit(0), path).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert P.pack_documents(spark, twice, path).count() == 3
