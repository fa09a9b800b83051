import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from riskstream.llm import quality as Q, toxicity as T
from riskstream.llm.common import read_table
from riskstream.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def area(label, score):
    """Share of (1, 0) pairs in the right order."""
    a, b = score[label == 1], score[label == 0]
    return ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())


def held_out(spark, query, column):
    got = QUERIES[query](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    return np.array([r[column] for r in got]), np.array([r.score for r in got]), np.array([r.predicted for r in got])


def test_quality_on_held_out_documents(spark):
    y, s, p = held_out(spark, "op1_quality_crf", "quality")
    assert area(y, s) > 0.97 and (p == y).mean() > 0.95


def test_toxicity_on_held_out_documents(spark):
    y, s, p = held_out(spark, "op8_toxicity", "toxic")
    assert area(y, s) > 0.9 and (p == y).mean() > 0.95


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    crf = Q.Crf(rng.standard_normal(4), rng.standard_normal((2, 2)), np.array([1.0, 0.0]))
    per = np.array([3, 1, 5, 2])
    x = rng.standard_normal((per.sum(), 4))
    p, pairs = crf.marginals(x, per, pairs=True)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in per:
        u = x[at:at + n] @ crf.w
        total, good = 0.0, np.zeros(n)
        counts = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(u[t] for t in range(n) if y[t]) + sum(crf.trans[y[t - 1], y[t]] for t in range(1, n)))
            total += w
            good += w * np.array(y)
            for t in range(1, n):
                counts[y[t - 1], y[t]] += w
        assert np.allclose(p[at:at + n], good / total)
        want_pairs += counts / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_line_features_use_neighbours_only_inside_a_text():
    a, b = "Good words here.\nBAD!! BAD!! BAD!!\nend", "Other text."
    xa, wa, pa = Q.line_features([a])
    xab, wab, pab = Q.line_features([b, a, "", a])
    assert pab.tolist() == [1, 3, 1, 3] and (xab[1:4] == xa).all() and (xab[5:8] == xa).all()
    assert wab[4] == 1 and xa.shape[1] == Q.FEATURES
    assert (xa[0, Q.OWN:2 * Q.OWN] == 0).all() and (xa[0, 2 * Q.OWN:3 * Q.OWN] == xa[1, :Q.OWN]).all()


def edge_table(spark):
    rows = [(1, "Fine words are here.\nMore of them."), (2, None), (3, ""), (4, "\n\n\n"), (5, "x" * 300_000), (6, "a\n" * 20_000), (None, "é"), (1, "Fine words are here.\nMore of them.")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("lang", F.lit(None).cast("string"))


def test_scores_of_edge_cases(spark):
    df = edge_table(spark)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 0, 0), (None, 1, 1), (2, None, None), (3, 7, 7), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for mod in (Q, T):
        out = mod.score(df, mod.fit(df, labels))
        rows = out.collect()
        assert out.columns == ["doc_id", "text", "lang", "score", "predicted"] and len(rows) == 8
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        by = {}
        for r in rows:
            assert by.setdefault(r.text or "", r.score) == r.score
        assert mod.score(df.limit(0), mod.fit(df.limit(0), labels.limit(0))).count() == 0


def paths(transducer, word):
    """All accepted (weight, output) of a transducer, by enumeration."""
    live = [(0, 0.0, ())]
    for a in word:
        live = [(s2, w + v, out + (b,)) for s, w, out in live for s2, b, v in transducer.table[s][a]]
    return [(w, out) for s, w, out in live if s in transducer.accepts]


def test_composition_equals_the_cascade():
    rng = random.Random(0)
    report = T.Transducer.of(2, {(0, T.REPORT): [(1, T.OTHER)], (1, T.INSULT): [(1, T.QUOTED_INSULT, 0.5)]})
    aim = T.Transducer.of(3, {(0, T.TARGET): [(1, T.OTHER)], (0, T.INSULT): [(0, T.INSULT, 1.0), (2, T.AIMED_INSULT, 2.0)],
                              (1, T.INSULT): [(1, T.AIMED_INSULT, 2.0)], (2, T.TARGET): [(1, T.OTHER)],
                              (1, T.QUOTED_INSULT): [(0, T.DENIED, 0.25)]}, {0, 1})
    both = report.then(aim)
    for _ in range(200):
        word = [rng.randrange(6) for _ in range(rng.randint(0, 7))]
        cascade = [(w + v, out) for w, mid in paths(report, word) for v, out in paths(aim, mid)]
        assert sorted(paths(both, word)) == sorted(cascade)
        assert both.best(word)[0] == max((w for w, _ in cascade), default=0.0)


def test_best_path_equals_enumeration():
    rng = random.Random(1)
    g = T.grammar()
    for _ in range(300):
        word = [rng.randrange(6) for _ in range(rng.randint(1, 7))]
        every = paths(g, word)
        weight, counts = g.best(word)
        assert every and abs(weight - max(w for w, _ in every)) < 1e-9
        assert abs(T.unpack(counts) @ np.array([T.PRIOR[k] for k in T.KINDS]) - weight) < 1e-9


def test_clause_grammar():
    model = T.Model(words=frozenset({"moron"}), stems=("idio",))
    s = T.Scorer(model)

    def kinds(text):
        found, _ = s.clauses(text)
        return {T.KINDS[i] for _, counts in found for i in np.flatnonzero(T.unpack(counts))}

    assert kinds("What a moron.") == {T.INSULT}
    assert kinds("You are an idiot!") == {T.AIMED_INSULT}
    assert kinds("an idiot like you") == {T.AIMED_INSULT}
    assert kinds("the moron on the hill saw you") == {T.INSULT}
    assert kinds("He is not a moron") == {T.DENIED}
    assert kinds("She said moron") == {T.QUOTED_INSULT}
    assert kinds("She said so. moron") == {T.INSULT}
    assert kinds("You came\nmoron") == {T.INSULT}
    assert kinds("I will kill you") == {T.AIMED_THREAT}
    assert kinds("I will kill time") == {T.THREAT}
    assert kinds("kill you idiot") == {T.AIMED_THREAT, T.AIMED_INSULT}
    assert kinds("he wrote kill") == {T.QUOTED_THREAT}
    assert kinds("nothing here") == set()
    assert [w for w, _ in s.clauses("You idiot. What a moron! No moron.")[0]] == [T.PRIOR[k] for k in (T.AIMED_INSULT, T.INSULT, T.DENIED)]


AIMED = ["you are an idiot", "they are idiots", "your a moron", "i will kill you", "stupid of you"]
REPORTED = ["she said idiot", "he is not an idiot", "it was never stupid", "the paper quoted moron", "the report said kill"]
PLAIN = ["the market opens at nine", "rain fell over the hills", "a train left the old station", "we planted beans in rows"]


def mixed(n, seed):
    """Toxic documents aim as many insults as clean ones report or deny."""
    rng = random.Random(seed)
    labels = [i % 2 for i in range(n)]
    texts = []
    for y in labels:
        c = [rng.choice(PLAIN) for _ in range(6)] + [rng.choice(AIMED if y else REPORTED) for _ in range(rng.randint(1, 3))]
        rng.shuffle(c)
        texts.append(". ".join(c) + ".")
    return texts, np.array(labels)


def test_grammar_decides_and_the_identity_does_not(monkeypatch):
    texts, labels = mixed(400, 1)
    fresh, truth = mixed(200, 2)

    def wrong():
        scorer = T.Scorer(T.train(texts, labels))
        return sum(int(scorer.score(t) >= 0.5) != y for t, y in zip(fresh, truth))

    monkeypatch.setattr(T, "learn_vocabulary", lambda toxic, other: (frozenset(), ()))   # closed word list alone
    with_grammar = wrong()
    monkeypatch.setattr(T, "grammar", lambda weights=T.PRIOR: T.weigh({k: weights[k] for k in (T.INSULT, T.THREAT)}))
    assert with_grammar <= 4 and wrong() >= 40


def test_order_of_clauses_on_the_table(spark):
    model = T.fit(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))
    k, s = model.kinds, T.Scorer(model)
    assert k[T.AIMED_INSULT] >= k[T.INSULT] >= k[T.QUOTED_INSULT] >= k[T.DENIED] >= 0
    assert k[T.AIMED_THREAT] >= k[T.THREAT] >= k[T.QUOTED_THREAT] >= k[T.DENIED]
    assert (model.weights[:T.CLAUSE_FEATURES] >= 0).all()
    aimed, quoted, denied, clean = map(s.score, ["You are an idiot.", "He called me an idiot.", "She is no idiot at all.", "A fine day it was."])
    assert aimed > 0.3 and aimed > quoted > denied >= clean and clean < 0.3
    assert s.score("I will kill you.") > 0.3 > s.score("I will kill some time.")


def test_vocabulary_finds_planted_words_and_stems():
    rng = random.Random(1)
    syll = ["ta", "ro", "mi", "ne", "lu", "ka"]

    def words(n):
        return ["".join(rng.choice(syll) for _ in range(rng.randint(1, 4))) for _ in range(n)]

    texts, labels = [], []
    for i in range(400):
        w = words(80)
        if i % 4 == 0:
            w[::20] = ["scum", "vilestem" + rng.choice(syll) + rng.choice(syll), "scum", "vilestem" + rng.choice(syll)]
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    m = T.train(texts, np.array(labels))
    assert "scum" in m.words and any("vilestem".startswith(x) or x.startswith("vile") for x in m.stems)
    s = T.Scorer(m)
    assert [int(s.score(t) >= T.CUT) for t in texts] == labels
