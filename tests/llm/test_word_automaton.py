import hashlib
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskstream.llm import word_automaton as W
from riskstream.llm.common import read_table
from riskstream.llm.queries import op11_word_automaton, vocabulary
from tests.conftest import SF_SMALL

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

PATH = "word_bpe_49k.json"
BITS = ["a", "b", "th", "er", "in", "g", " ", "\n", "é", "ß", "1", "!", "'s", "\t", "　", "Z", "İ", "Σ", "日本", "🙂", "́",
        "<|endoftext|>", "<|startoftext|>", "<|", "...", "ing", "\x00", "\x1c", "\x85", "ŉ", "ǆ", "ﬁ", "IT'S"]


@pytest.fixture(scope="module")
def own():
    return W.WordAutomaton(vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary(PATH))


def same(own, library, text):
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == want, text
    assert own.decode(ids) == library.decode(want, skip_special_tokens=False), text


def test_texts_match_the_library(own, library):
    rng = random.Random(1)
    for text in ["", " ", "\n", "<|endoftext|>", "a" * 30_001, "ab" * 9_000 + "é" * 501, "No <|EndOfText|>"]:
        same(own, library, text)
    for _ in range(4000):
        same(own, library, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))))
    for _ in range(4000):
        same(own, library, "".join(rng.choice("abehitnrsogl") for _ in range(rng.randint(1, 30))))


def greedy(letters, merges):
    """Merges one pair at a time: the smallest rank, the leftmost of it."""
    rank = {(a, b): (k, m) for k, (a, b, m) in enumerate(merges)}
    out = list(letters)
    while True:
        best = min(((rank[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in rank), default=None)
        if best is None:
            return out
        i = best[1]
        out[i:i + 2] = [rank[out[i], out[i + 1]][1]]


@pytest.mark.parametrize("seed", range(12))
def test_gadgets_of_random_merges(seed):
    """All words of small random vocabularies; repeated letters and merges
    that an earlier one makes unreachable included."""
    rng = random.Random(seed)
    tokens, merges = [(0,), (1,), (2,)], []
    while len(merges) < 14:
        a, b = rng.randrange(len(tokens)), rng.randrange(len(tokens))
        if tokens[a] + tokens[b] not in tokens and len(tokens[a] + tokens[b]) <= 6:
            merges.append((a, b, len(tokens)))
            tokens.append(tokens[a] + tokens[b])
    auto = W.Automaton([0, 1, 2], merges)
    t = W.Transducer(auto, dict(enumerate(tokens)), table_arcs=5)
    accepted = 0
    for n in range(1, 8):
        for word in product(range(3), repeat=n):
            want = greedy(word, merges)
            assert t.tokens(list(word)) == want
            state = W.START
            for x in want:
                state = auto.step(state, x)
                assert state >= 0
            accepted += 1
    assert accepted == sum(3 ** n for n in range(1, 8))
    for a, b in product(range(len(tokens)), repeat=2):
        if auto.live[a] and auto.live[b]:
            assert auto.has_arc(a, b) == (auto.step(auto.target[a], b) >= 0) == (greedy(tokens[a] + tokens[b], merges) == [a, b])


def test_a_letter_outside_the_vocabulary_raises():
    t = W.Transducer(W.Automaton([0], []), {0: (0,)})
    with pytest.raises(ValueError):
        t.tokens([0, 1])


def test_query_matches_the_library(spark, library):
    got = {r["doc_id"]: r for r in op11_word_automaton(spark, SF_SMALL).collect()}
    docs = read_table(spark, SF_SMALL, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"], add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_rows_and_round_trip(spark, own):
    rows = [(1, "plain words"), (None, "null id"), (2, None), (3, ""), (1, "plain words"), (4, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(-1))
    out = W.digest(docs, vocabulary(PATH)).collect()
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in out) == sorted(
        (i is None, i or 0, len(own.encode(t or "")) // 4) for i, t in rows)
    enc = W.encode(docs, vocabulary(PATH))
    assert enc.columns == ["doc_id", "ids"]
    texts = sorted(r["text"] for r in W.decode(enc, vocabulary(PATH)).collect())
    assert texts == sorted(own.decode(np.frombuffer(own.encode(t or ""), "<u4").tolist()) for _, t in rows)
    empty = docs.where("false")
    assert W.digest(empty, vocabulary(PATH)).count() == W.encode(empty, vocabulary(PATH)).count() == 0
