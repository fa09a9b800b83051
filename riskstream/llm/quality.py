"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad. A line's features are its
own (length, shares of character classes, repetition) and those of the lines
before and after it; the chain's transition weights tie neighbouring labels
together. Forward-backward gives each line's marginal probability; their mean,
weighted by line length, is the document's share of good text, which a
logistic calibration turns into the score.

Training: at most ``TRAIN_DOCS`` labelled documents (the smallest hashes of
the id; the bound is the only sampling). Lines start with their document's
label; after a first fit, lines of low-quality documents that the model finds
clearly good change sides, and it is fitted once more. The driver holds the
sample's features only, never its texts. Scoring is a map over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskstream.llm.common import crc_mod

TRAIN_DOCS = 4_000
TRAIN_LINES = 200       # mean lines a training document may have; the sample shrinks beyond
HOLD_OUT = (5, 0)       # crc32 of the id's text mod 5 = 0 is held out
CUT = 0.3
ROUNDS = 120
_SURE = 0.8             # marginal from which a line of a bad document counts as good
_CHARS = 2_000_000      # characters whose features are made at a time

# Classes of a UTF-8 byte.
_LOWER, _UPPER, _DIGIT, _SPACE, _HIGH, _STOP, _COMMA, _BANG, _PIPE, _MARK, _QUOTE, _OTHER = range(12)
_CLASS = np.full(256, _OTHER, "u1")
for _c, _chars in ((_LOWER, "abcdefghijklmnopqrstuvwxyz"), (_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_DIGIT, "0123456789"),
                   (_SPACE, " \t\r\x0b\x0c"), (_STOP, "."), (_COMMA, ",;:"), (_BANG, "!?"), (_PIPE, "|"),
                   (_MARK, "*#$%&@^~+=<>\\/_"), (_QUOTE, "'\"()[]{}-")):
    _CLASS[[ord(x) for x in _chars]] = _c
_CLASS[128:] = _HIGH
OWN = 22                # features of a line alone
FEATURES = 3 * OWN + 3  # with its neighbours', and first, last, constant


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, weight of each line, lines of each text). A
    text without characters has one empty line."""
    joined = "\n".join(texts)
    lines = joined.split("\n")
    raw = np.frombuffer(joined.encode() + b"\n", "u1")
    ends = np.flatnonzero(raw == 10)
    size = np.diff(ends, prepend=-1) - 1
    counts = np.zeros((len(lines), 12))
    classes = _CLASS[raw]
    owner = np.repeat(np.arange(len(lines)), size + 1)
    body = np.ones(len(raw), bool)
    body[ends] = False
    counts = np.bincount(owner[body] * 12 + classes[body], minlength=12 * len(lines)).reshape(-1, 12).astype("f4")
    n = np.maximum(size, 1).astype("f4")
    words, distinct, same, starts, stops = (np.zeros(len(lines), "f4") for _ in range(5))
    for i, line in enumerate(lines):
        w = line.split()
        words[i] = len(w)
        distinct[i] = len(set(w))
        if w:
            starts[i] = line[0].isupper()
            stops[i] = w[-1][-1] in ".!?"
    per_text = np.array([t.count("\n") + 1 for t in texts])
    seen: set[str] = set()
    at = 0
    for k in per_text.tolist():
        if k > 1:
            seen.clear()
            for i in range(at, at + k):
                same[i] = lines[i] in seen
                seen.add(lines[i])
        at += k
    share = counts / n[:, None]
    w = np.maximum(words, 1)
    own = np.column_stack([
        share[:, [_LOWER, _UPPER, _DIGIT, _HIGH, _SPACE, _OTHER]] * 3,
        np.minimum(counts[:, [_STOP, _COMMA, _BANG, _PIPE, _MARK, _QUOTE]] / w[:, None], 2) * 2,
        np.log1p(size) / 5, np.log1p(words) / 3, np.minimum(n / w, 20) / 5,
        1 - distinct / w, (words > 8) * (1 - distinct / w) * 2, same,
        starts, stops, size == 0, words == 1]).astype("f4")
    first, last = np.zeros(len(lines), "f4"), np.zeros(len(lines), "f4")
    begin = np.cumsum(per_text) - per_text
    first[begin], last[begin + per_text - 1] = 1, 1
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first == 1], after[last == 1] = 0, 0
    x = np.column_stack([own, before, after, first, last, np.ones(len(lines), "f4")])
    return x, np.maximum(size, 1).astype("f8"), per_text


@dataclass
class Crf:
    """Weights of the label good for each feature, label transitions, and the
    calibration of the document score. Label 1: good."""
    w: np.ndarray
    trans: np.ndarray      # 2 x 2, from x to
    calibration: np.ndarray

    def marginals(self, x: np.ndarray, per_text: np.ndarray, pairs: bool = False):
        """P(good) of each line; with ``pairs`` also the expected transition
        counts and the log normaliser's sum."""
        u = np.clip(x @ self.w, -30, 30)
        order = np.argsort(-per_text, kind="stable")
        length = per_text[order]
        begin = (np.cumsum(per_text) - per_text)[order]
        e = np.exp(self.trans - self.trans.max())
        emit = np.stack([1 / (1 + np.exp(u)), 1 / (1 + np.exp(-u))], 1)
        alpha, beta = np.empty_like(emit), np.ones_like(emit)
        live = np.searchsorted(-length, -np.arange(1, length.max(initial=0) + 1), side="right")
        a = np.empty((0, 2))
        for t, m in enumerate(live.tolist()):      # the texts that have a line t
            at = begin[:m] + t
            a = emit[at] if t == 0 else (a[:m] @ e) * emit[at]
            a = a / a.sum(1, keepdims=True)
            alpha[at] = a
        expected = np.zeros((2, 2))
        for t in range(len(live) - 1, 0, -1):
            at = begin[:live[t]] + t
            right = emit[at] * beta[at]
            b = right @ e.T
            beta[at - 1] = b / b.sum(1, keepdims=True)
            if pairs:
                joint = alpha[at - 1][:, :, None] * e * right[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        p = alpha * beta
        p = p[:, 1] / p.sum(1)
        return (p, expected) if pairs else p

    def document_share(self, x: np.ndarray, weight: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals of each text."""
        p = self.marginals(x, per_text)
        begin = np.cumsum(per_text) - per_text
        return np.add.reduceat(p * weight, begin) / np.add.reduceat(weight, begin)

    def score(self, share: np.ndarray) -> np.ndarray:
        q = np.clip(share, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.calibration[0] * np.log(q / (1 - q)) + self.calibration[1])))


def fit_chain(x: np.ndarray, y: np.ndarray, per_text: np.ndarray, rounds: int = ROUNDS) -> Crf:
    """Maximum likelihood with a small ridge, by Adam on the full gradient."""
    crf = Crf(np.zeros(x.shape[1]), np.zeros((2, 2)), np.array([1.0, 0.0]))
    inner = np.ones(len(y), bool)
    inner[np.cumsum(per_text) - per_text] = False
    to = np.flatnonzero(inner)
    observed = np.bincount(2 * y[to - 1].astype(int) + y[to].astype(int), minlength=4).reshape(2, 2)
    theta, m, v = np.zeros(x.shape[1] + 4), 0, 0
    for r in range(1, rounds + 1):
        p, expected = crf.marginals(x, per_text, pairs=True)
        g = np.concatenate([x.T @ (y - p), (observed - expected).ravel()]) / len(y) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-8)
        crf.w, crf.trans = theta[:-4], theta[-4:].reshape(2, 2)
    return crf


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Newton's method; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * w)
    return w


def train(x: np.ndarray, weight: np.ndarray, per_text: np.ndarray, label: np.ndarray) -> Crf:
    """label: 1 good or 0 of each text. Without labels every score is 0.5;
    with one class alone the calibration follows it."""
    if not len(label):
        return Crf(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2))
    y = np.repeat(label, per_text).astype("f8")
    crf = fit_chain(x, y, per_text)
    if 0 < label.mean() < 1:
        own = np.repeat(label, per_text)
        y = np.where((own == 0) & (crf.marginals(x, per_text) > _SURE), 1.0, y)
        crf = fit_chain(x, y, per_text)
    q = np.clip(crf.document_share(x, weight, per_text), 1e-6, 1 - 1e-6)
    crf.calibration = logistic(np.column_stack([np.log(q / (1 - q)), np.ones(len(q))]), label.astype("f8"), ridge=1e-4)
    return crf


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of about ``_CHARS`` characters."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > _CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Crf:
    """Trains on labelled documents that are not held out. A doc_id with
    several labels or rows counts once, by its largest label and text; null
    ids, labels and labels other than 0 and 1 take no part."""
    n, held = HOLD_OUT
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", n) != held))
             .groupBy("doc_id").agg(F.max("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))
    sample = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")   # at most train_docs rows
              .groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("quality").alias("quality")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, text, label in zip(b["doc_id"], b["text"], b["quality"]):
                x, weight, per_text = line_features([text])
                yield pd.DataFrame({"doc_id": [doc], "label": [label], "x": [x.astype("f2").tobytes()],
                                    "weight": [weight.astype("f4").tobytes()]})

    made = sample.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, x binary, weight binary")
    budget, xs, ws, per, ys = train_docs * TRAIN_LINES, [], [], [], []
    rows = made.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator()
    for r in rows:
        weight = np.frombuffer(r["weight"], "f4")
        if budget < len(weight):
            continue
        budget -= len(weight)
        xs.append(np.frombuffer(r["x"], "f2").reshape(len(weight), FEATURES))
        ws.append(weight)
        per.append(len(weight))
        ys.append(r["label"])
    if not xs:
        return train(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, int), np.zeros(0, int))
    return train(np.concatenate(xs).astype("f4"), np.concatenate(ws).astype("f8"), np.array(per), np.array(ys))


def score(docs: DataFrame, crf: Crf) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` and ``predicted``
    (replacing columns of those names). Null and empty texts are one empty
    line; repeated rows score alike."""
    keep = [f for f in docs.schema.fields if f.name.lower() not in ("score", "predicted")]
    model = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [model.value.score(model.value.document_share(*line_features(part)))
                 for part in _chunks([t or "" for t in b["text"]])]
            s = np.concatenate(s) if s else np.zeros(0)
            yield b.assign(score=s, predicted=(s >= CUT).astype("i4"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", score double, predicted int"
    return docs.select(*[F.col(f"`{f.name}`") for f in keep]).mapInPandas(run, schema)


def line_labels(text: str, crf: Crf) -> list[tuple[str, float]]:
    """(line, probability that it is good) of one text."""
    x, _, per_text = line_features([text or ""])
    return list(zip((text or "").split("\n"), crf.marginals(x, per_text).tolist()))
