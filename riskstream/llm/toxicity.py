"""Toxicity scores from a weighted finite-state grammar of clauses.

Words become symbols: insult, threat, target (a person spoken of or to),
negation, reported speech, other. Five small transducers read a clause's
symbols from left to right, each rewriting what the one before it wrote:

    report:   insults and threats after a verb of saying become quoted ones,
              up to the end of the clause;
    negate:   insults and threats within three words of a negation become
              denied ones;
    threaten: a threat may be guessed to be aimed; the clause must then name
              a target after it;
    aim:      an insult after a target is aimed; one before a target may be
              guessed to be, and the target must follow within three words;
    weigh:    every match pays its kind's weight, all else is deleted.

The middle two have several arcs for a symbol and reject paths whose guess does
not come true. The composition is built once, state by state, and is what
runs: a clause's score is the weight of its best accepted path, so a word
counts by what stands around it. A document's score is a logistic model over
its clauses (sum, density and largest of their scores).

An isolated insult weighs 1. The other weights are fitted, between bounds that
keep aimed >= isolated >= quoted >= denied >= 0 for insults and threats alike,
and drawn to ``PRIOR``, which stands where the sample has no such match. The
bounds also make the best path the same for all weights. The document model
never falls with a clause's score.

The insult vocabulary is a short list of common ones and what is learned from
labelled documents: words, and stems at the front of words, whose rate in
toxic documents exceeds that in others beyond chance. Training reads at most
``TRAIN_DOCS`` labelled documents; scoring is a map over the rows. A text is
read line by line, holding the symbols of one clause's states at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskstream.llm.common import crc_mod
from riskstream.llm.packing import Memo
from riskstream.llm.quality import logistic

TRAIN_DOCS = 4_000
TRAIN_CHARS = 16_000_000   # of the sample; documents beyond it are left out of the sample
HOLD_OUT = (4, 2)          # crc32 of the id's text mod 4 = 2 is held out
CUT = 0.3
STEMS = 64                 # most entries of the learned vocabulary
MIN_GAIN = 25.0            # log-likelihood ratio an entry must reach
MIN_RATIO = 4.0            # times the rate in other documents

# Closed-class words of the grammar.
TARGETS = frozenset("you your yours yourself u ur he him his she her they them their these those "
                    "du dich dir dein ihr euch tu te toi ton vous votre tus ustedes usted vosotros".split())
NEGATIONS = frozenset("not no never neither nor without isn't aren't wasn't don't doesn't didn't "
                      "nicht kein keine nie pas jamais ni nunca jamás sin".split())
REPORTS = frozenset("said says say called calls quoted quotes reported reports wrote writes claimed alleged "
                    "sagte sagt nannte schrieb dit disait appelé dijo dice llamó escribió".split())
INSULTS = frozenset("idiot idiots idiotic moron morons moronic stupid dumb fool fools imbecile loser losers scum trash "
                    "worthless pathetic disgusting clown clowns jerk bastard dumbass scumbag "
                    "idiota idioten dummkopf abschaum connard imbécile estúpido imbécil basura".split())
THREATS = frozenset("kill killing murder hurt destroy stab shoot strangle hang beat burn "
                    "töten umbringen tuer frapper matar golpear".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# Written by the transducers besides the input symbols.
QUOTED_INSULT, QUOTED_THREAT, DENIED, AIMED_THREAT, AIMED_INSULT = range(6, 11)
SYMBOLS = 11
KINDS = (INSULT, THREAT, QUOTED_INSULT, QUOTED_THREAT, DENIED, AIMED_THREAT, AIMED_INSULT)
#: Weights by kind where nothing is learned; an isolated insult is the unit.
PRIOR = {INSULT: 1.0, THREAT: 0.2, QUOTED_INSULT: 0.3, QUOTED_THREAT: 0.05, DENIED: 0.05,
         AIMED_THREAT: 1.5, AIMED_INSULT: 1.5}
PRIOR_PULL = 4.0           # log-likelihood that a weight one unit from its prior costs
REACH = 3                  # words between an insult and the target after it; also what a negation reaches
_BITS = 32                 # of a kind's number of matches in a path's packed counts

_CORE = re.compile(r"^[\W_]+|[\W_]+$")
_CLAUSE_END = re.compile(r"[.!?;:]+[\"')\]]*$")


class Transducer:
    """Weighted, several arcs allowed: ``table[state][symbol]`` is a list of
    (next state, written symbol, weight); ``accepts`` are the states a path
    may end in."""

    def __init__(self, table: list[list[list[tuple[int, int, float]]]], accepts: set[int]):
        self.table, self.accepts = table, accepts

    @classmethod
    def of(cls, states: int, rules: dict[tuple[int, int], list], accepts: set[int] | None = None) -> Transducer:
        """Where no rule holds, the symbol is copied and the state kept, at weight 0."""
        return cls([[[(*arc, 0.0)[:3] for arc in rules.get((s, a), [(s, a)])] for a in range(SYMBOLS)]
                    for s in range(states)], set(range(states)) if accepts is None else accepts)

    def then(self, other: Transducer) -> Transducer:
        """The composition, over the state pairs that can be reached."""
        number, todo, table, accepts = {(0, 0): 0}, [(0, 0)], [], set()
        for s, t in todo:                # grows while it is read
            if s in self.accepts and t in other.accepts:
                accepts.add(number[s, t])
            row = []
            for a in range(SYMBOLS):
                arcs = []
                for s2, b, w in self.table[s][a]:
                    for t2, c, v in other.table[t][b]:
                        if (s2, t2) not in number:
                            number[s2, t2] = len(number)
                            todo.append((s2, t2))
                        arcs.append((number[s2, t2], c, w + v))
                row.append(arcs)
            table.append(row)
        return Transducer(table, accepts)

    def best(self, symbols) -> tuple[float, int]:
        """(weight, packed counts of the written kinds) of the best accepted
        path; equal weights are decided by the counts."""
        live = {0: (0.0, 0)}
        for a in symbols:
            after: dict[int, tuple[float, int]] = {}
            for state, (weight, counts) in live.items():
                for s2, b, w in self.table[state][a]:
                    path = (weight + w, counts + _UNIT[b])
                    if s2 not in after or after[s2] < path:
                        after[s2] = path
            live = after
        return max((path for state, path in live.items() if state in self.accepts), default=(0.0, 0))


_UNIT = [1 << (_BITS * KINDS.index(b)) if b in KINDS else 0 for b in range(SYMBOLS)]


def unpack(counts: int) -> np.ndarray:
    """Matches by kind of a path's packed counts."""
    return np.array([counts >> (_BITS * k) & ((1 << _BITS) - 1) for k in range(len(KINDS))], "f8")


def weigh(weights: dict[int, float]) -> Transducer:
    """Matches pay their kind's weight, everything else is deleted."""
    return Transducer.of(1, {(0, a): [(0, a, weights[a])] if a in weights else [(0, OTHER)] for a in range(SYMBOLS)})


def grammar(weights: dict[int, float] = PRIOR) -> Transducer:
    report = Transducer.of(2, {(0, REPORT): [(1, OTHER)], (1, REPORT): [(1, OTHER)],
                               (1, INSULT): [(1, QUOTED_INSULT)], (1, THREAT): [(1, QUOTED_THREAT)]})
    rules = {}
    for s in range(REACH + 1):           # words the negation still reaches
        for a in range(SYMBOLS):
            rules[s, a] = [(max(0, s - 1), DENIED if s and a in (INSULT, THREAT) else a)]
        rules[s, NEGATION] = [(REACH, OTHER)]
    negate = Transducer.of(REACH + 1, rules)
    # state 1: a threat was guessed to be aimed and its target is to come
    threaten = Transducer.of(2, {(0, THREAT): [(0, THREAT), (1, AIMED_THREAT)], (1, THREAT): [(1, AIMED_THREAT)],
                                 (1, TARGET): [(0, TARGET)]}, {0})
    # state 1: a target was named; 2 ...: an insult waits for its target, for so many words more
    rules = {(0, TARGET): [(1, OTHER)], (1, TARGET): [(1, OTHER)], (1, INSULT): [(1, AIMED_INSULT)],
             (0, INSULT): [(0, INSULT), (1 + REACH, AIMED_INSULT)]}
    for s in range(2, 2 + REACH):
        for a in range(SYMBOLS):
            rules[s, a] = [(s - 1, a)] if s > 2 else []
        rules[s, INSULT] = [(s - 1, AIMED_INSULT)] if s > 2 else []
        rules[s, TARGET] = [(1, OTHER)]
    aim = Transducer.of(2 + REACH, rules, {0, 1})
    return report.then(negate).then(threaten).then(aim).then(weigh(weights))


@dataclass
class Model:
    """Learned vocabulary (whole words, and stems of at least four letters
    that begin words), the weights of the grammar's kinds and the document
    model over ``document_features``."""
    words: frozenset = frozenset()
    stems: tuple = ()
    kinds: dict = field(default_factory=lambda: dict(PRIOR))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(CLAUSE_FEATURES + 2))

    def symbol(self, chunk: str) -> int:
        word = _CORE.sub("", chunk)
        if word in self.words or word in INSULTS or any(word.startswith(s) for s in self.stems):
            return INSULT
        return (THREAT if word in THREATS else TARGET if word in TARGETS else NEGATION if word in NEGATIONS
                else REPORT if word in REPORTS else OTHER)


CLAUSE_FEATURES = 5        # features that grow with clause scores; then the length and the constant


def document_features(total: np.ndarray, largest: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One row per document from the sum and the largest of its clauses' scores."""
    return np.stack([np.log1p(total), total * 50 / (words + 20), np.minimum(total, 1),
                     np.log((total + 0.05) / (words + 20)), np.minimum(largest, 3),
                     np.log1p(words), np.ones(len(total))], axis=1)


class Scorer:
    """A worker's matcher: composed grammar and a bounded memo of words."""

    def __init__(self, model: Model, compiled: Transducer | None = None):
        self.model = model
        self.grammar = compiled or grammar(model.kinds)
        self.memo = Memo(model.symbol)

    def clauses(self, text: str) -> tuple[list[tuple[float, int]], int]:
        """((score, packed counts) of every clause with an insult or threat,
        words) of a whole text."""
        memo, found, words = self.memo, [], 0
        for line in text.lower().split("\n"):
            chunks = line.split()
            words += len(chunks)
            symbols = [memo[c] for c in chunks]
            if INSULT in symbols or THREAT in symbols:
                first = 0
                for i, c in enumerate(chunks, 1):
                    if i == len(chunks) or _CLAUSE_END.search(c):
                        clause = symbols[first:i]
                        if INSULT in clause or THREAT in clause:
                            found.append(self.grammar.best(clause))
                        first = i
        return found, words

    def score(self, text: str) -> float:
        found, words = self.clauses(text)
        weights = [w for w, _ in found]
        x = document_features(np.array([sum(weights)]), np.array([max(weights, default=0.0)]), np.array([float(words)]))
        return float(1 / (1 + np.exp(-np.clip(x[0] @ self.model.weights, -30, 30))))


def _gain(a: np.ndarray, b: np.ndarray, na: float, nb: float) -> np.ndarray:
    """Log-likelihood ratio of counts a, b in na, nb words; 0 if a's rate is
    not ``MIN_RATIO`` times b's."""
    e = (a + b) / (na + nb)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (a * np.log(np.maximum(a, 1e-9) / (na * e)) + b * np.log(np.maximum(b, 1e-9) / (nb * e)))
    return np.where(a / na >= MIN_RATIO * b / nb, g, 0)


def learn_vocabulary(toxic: Counter, other: Counter) -> tuple[frozenset, tuple]:
    """Words and stems by greedy log-likelihood ratio. Counts are documents
    times at most three occurrences, so that no single text decides."""
    na, nb = sum(toxic.values()) or 1, sum(other.values()) or 1
    words, stems = [], []
    whole = {w: (n, other.get(w, 0)) for w, n in toxic.items()}
    front: dict[str, list[int]] = {}
    for counts, side in ((toxic, 0), (other, 1)):
        for w, n in counts.items():
            for k in range(4, min(len(w) - 1, 9) + 1):
                if side == 0:
                    front.setdefault(w[:k], [0, 0])[0] += n
                elif w[:k] in front:
                    front[w[:k]][1] += n
    for _ in range(STEMS):
        best = (MIN_GAIN, "", False)
        for table, is_stem in ((whole, False), (front, True)):
            if table:
                keys = list(table)
                c = np.array([table[k] for k in keys], "f8")
                g = _gain(c[:, 0], c[:, 1], na, nb)
                i = int(g.argmax())
                if g[i] > best[0]:
                    best = (float(g[i]), keys[i], is_stem)
        _, entry, is_stem = best
        if not entry:
            break
        (stems if is_stem else words).append(entry)
        covered = [w for w in whole if w == entry or is_stem and w.startswith(entry)]
        covered_other = [w for w in other if w not in whole and is_stem and w.startswith(entry)] if is_stem else []
        for w in covered + covered_other:
            a, b = whole.pop(w, (0, other.get(w, 0)))
            for k in range(4, min(len(w) - 1, 9) + 1):
                if w[:k] in front:
                    front[w[:k]][0] -= a
                    front[w[:k]][1] -= b
        whole = {w: v for w, v in whole.items() if v[0] > 0}
        front = {w: v for w, v in front.items() if v[0] > 1}
    return frozenset(words), tuple(stems)


def train(texts: list[str], labels: np.ndarray) -> Model:
    """label 1: toxic. Without a class the vocabulary is empty and the score
    follows the labels' share."""
    counts = {0: Counter(), 1: Counter()}
    for text, y in zip(texts, labels):
        own = Counter(_CORE.sub("", c) for c in text.lower().split())
        own.pop("", None)
        counts[int(y)].update({w: min(n, 3) for w, n in own.items()})
    # what occurs once among toxic texts can reach no entry of its own, but counts for its stems
    model = Model(*learn_vocabulary(counts[1], counts[0])) if counts[0] and counts[1] else Model()
    if len(labels):
        s = Scorer(model)
        read = [s.clauses(t) for t in texts]
        model.kinds, model.weights = fit_weights(read, np.asarray(labels, "f8"))
    return model


def _monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, log-likelihood) of a logistic model whose weights of clause
    features are not negative: a feature that would fall is left out."""
    used = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        w[used] = logistic(x[:, used], y, ridge=3e-4)
        falls = used & (w < 0) & (np.arange(len(w)) < CLAUSE_FEATURES)
        if not falls.any():
            z = np.clip(x @ w, -30, 30)
            return w, float((y * z - np.logaddexp(0, z)).sum())
        used[np.where(falls, w, 0).argmin()] = False


def fit_weights(read: list[tuple[list[tuple[float, int]], int]], y: np.ndarray) -> tuple[dict, np.ndarray]:
    """Kinds' weights and document model of the read clauses: one weight at a
    time over a grid within its bounds, by the likelihood of the document
    model refitted for it less the pull of the prior."""
    doc = np.repeat(np.arange(len(read)), [len(c) for c, _ in read])
    counts = np.array([unpack(k) for c, _ in read for _, k in c]).reshape(-1, len(KINDS))
    words = np.array([float(n) for _, n in read])

    def judged(kinds: dict) -> tuple[float, np.ndarray]:
        clause = counts @ np.array([kinds[k] for k in KINDS])
        largest = np.zeros(len(read))
        np.maximum.at(largest, doc, clause)
        w, fit = _monotone(document_features(np.bincount(doc, clause, len(read)), largest, words), y)
        return fit - PRIOR_PULL * sum((kinds[k] - PRIOR[k]) ** 2 for k in KINDS), w

    kinds = dict(PRIOR)
    best, w = judged(kinds)
    seen = {k for k, n in zip(KINDS, counts.sum(0)) if n}
    for _ in range(2):
        for k in KINDS:
            if k == INSULT or k not in seen:
                continue
            low, high = _bounds(kinds, k)
            for v in np.linspace(low, high, 6):
                trial = {**kinds, k: float(v)}
                value, w2 = judged(trial)
                if value > best:
                    best, w, kinds = value, w2, trial
    return kinds, w


def _bounds(kinds: dict, k: int) -> tuple[float, float]:
    """Between the weights of the next weaker and the next stronger kind."""
    chains = ((DENIED, QUOTED_INSULT, INSULT, AIMED_INSULT), (DENIED, QUOTED_THREAT, THREAT, AIMED_THREAT))
    low, high = 0.0, 3.0
    for chain in chains:
        if k in chain:
            i = chain.index(k)
            low = max([low] + [kinds[j] for j in chain[:i]])
            high = min([high] + [kinds[j] for j in chain[i + 1:]])
    return low, high


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Trains on labelled documents that are not held out, at most
    ``train_docs`` of them. A doc_id with several labels or rows counts once,
    by its largest label and text; null ids and other labels take no part."""
    n, held = HOLD_OUT
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", n) != held))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))
    sample = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")   # at most train_docs rows
              .groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id"))
    texts, ys, budget = [], [], TRAIN_CHARS
    for r in sample.toLocalIterator():
        if len(r["text"]) <= budget:
            budget -= len(r["text"])
            texts.append(r["text"])
            ys.append(r["toxic"])
    return train(texts, np.array(ys))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` and ``predicted``
    (replacing columns of those names). Null text counts as empty, whose score
    is that of a text without a match; repeated rows score alike; an empty
    table gives an empty table; a text of any length is read whole, a line's
    words at a time."""
    keep = [f for f in docs.schema.fields if f.name.lower() not in ("score", "predicted")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            s = np.array([scorer.score(t or "") for t in b["text"]], "f8")
            yield b.assign(score=s, predicted=(s >= CUT).astype("i4"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", score double, predicted int"
    return docs.select(*[F.col(f"`{f.name}`") for f in keep]).mapInPandas(run, schema)
