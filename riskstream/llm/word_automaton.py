"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts as one state on which every single
letter loops, and each merge (a, b) applies one gadget: the state that a leads
to is split, so that after a no arc b is left, and every state with an arc a
into a state with an arc b gets an arc ab to where that b led. What it then
accepts are the correct tokenizations and nothing else, one for each word.

All arcs of a label lead to one state, so a gadget adds a single state: the
copy of another one but for one arc less. A state is stored as that
difference (what it copies, the arc that it lacks, when it was made), and
whether it has an arc x is read off the gadgets: arc x is missing if one of the
state's gadgets barred x, or barred the left part that x was made from before x
was made.

Encoding composes the automaton with the spelling of its tokens (their letters
in a trie whose nodes know the longest shorter end that begins a token, and all
tokens that end there) and moves along the words that the file's pre-tokenizer
splits: after each letter, exactly one token that ends there has an arc from
the state before it, as each beginning of a word is tokenized in one way; it is
written down, and a word's tokens are read back from its end. Arcs asked for
once are kept in a table of bounded size. Time is linear in a word's length.

Decoding emits the label of each arc.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from riskstream.llm.packing import _PARTS, Memo, byte_letters

TABLE_ARCS = 500_000       # that a worker keeps, at least
PART_ENTRIES = 300_000     # of a generation of the memo of pre-tokens
START = 0


class Automaton:
    """``singles`` are the one-letter tokens' ids; ``merges`` are (left, right,
    merged) ids in order of rank, each of tokens made before it."""

    def __init__(self, singles: list[int], merges: list[tuple[int, int, int]]):
        n = 1 + max([*singles, *[m for _, _, m in merges]], default=-1)
        self.left, self.right = [-1] * n, [-1] * n
        self.born = [0] * n                       # the merge that made a token, from 1; 0: single
        self.target = [START] * n                 # where the arcs of a label lead
        self.live = [False] * n                   # whether any arc has the label
        self.copy_of, self.barred, self.made = [-1], [-1], [0]
        self.bar_time: dict[int, int] = {}        # a * n + b -> the gadget that bars b after a
        self.n = n
        for x in singles:
            self.live[x] = True
        for time, (a, b, merged) in enumerate(merges, 1):
            self.gadget(a, b, merged, time)

    def gadget(self, a: int, b: int, merged: int, time: int) -> None:
        self.left[merged], self.right[merged], self.born[merged] = a, b, time
        if not (self.live[a] and self.live[b] and self.has_arc(a, b)):
            return
        after_b = self.target[b]
        self.copy_of.append(self.target[a])
        self.barred.append(b)
        self.made.append(time)
        self.target[a] = len(self.made) - 1
        self.target[merged] = after_b
        self.live[merged] = True
        self.bar_time[a * self.n + b] = time

    def has_arc(self, last: int, x: int) -> bool:
        """Whether the state after ``last`` has an arc ``x``. The gadgets of
        that state are those of ``last``, those that its right part had when
        ``last`` was made, and so on down the right parts."""
        bars, n, born = self.bar_time, self.n, self.born
        r, before = last, 1 << 60
        while r >= 0:
            y, until = x, 1 << 60
            while y >= 0:
                t = bars.get(r * n + y)
                if t is not None and t < before and t <= until:
                    return False
                until = born[y]
                y = self.left[y]
            before = born[r]
            r = self.right[r]
        return True

    def step(self, state: int, x: int) -> int:
        """The state that arc ``x`` of a state leads to, or -1; by the chain of
        copies (``has_arc`` answers the same by labels)."""
        token = x
        if not self.live[x]:
            return -1
        while state != START:
            if x == self.barred[state]:
                return -1
            if self.born[x] < self.made[state]:
                state = self.copy_of[state]
            else:
                x = self.left[x]
        return self.target[token]


class Transducer:
    """Letters in, tokens out: the automaton composed with the spelling of its tokens."""

    def __init__(self, automaton: Automaton, spelling: dict[int, tuple[int, ...]], table_arcs: int = TABLE_ARCS):
        self.automaton, self.table_arcs = automaton, table_arcs
        self.length = {t: len(s) for t, s in spelling.items()}
        self.children: list[dict[int, int]] = [{}]
        token = [-1]
        for t, letters in spelling.items():
            if not automaton.live[t]:
                continue
            node = 0
            for c in letters:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    token.append(-1)
                node = nxt
            token[node] = t
        self.shorter = [0] * len(self.children)                     # longest proper end that begins a token
        self.ends: list[tuple] = [()] * len(self.children)          # (token, length) that end here, longest first
        order = list(self.children[0].values())
        for node in order:
            t = token[node]
            self.ends[node] = (((t, self.length[t]),) if t >= 0 else ()) + self.ends[self.shorter[node]]
            for c, child in self.children[node].items():
                s = self.shorter[node]
                while s and c not in self.children[s]:
                    s = self.shorter[s]
                self.shorter[child] = self.children[s].get(c, 0)
                order.append(child)
        self.arcs: dict[int, bool] = {}

    def tokens(self, letters: list[int]) -> list[int]:
        """Tokens of a word."""
        children, shorter, ends, arcs, n = self.children, self.shorter, self.ends, self.arcs, self.automaton.n
        if len(arcs) > self.table_arcs:
            arcs.clear()
        v, last = 0, [n]                     # last token of each beginning; n: none
        for i, c in enumerate(letters, 1):
            nxt = children[v].get(c)
            while nxt is None and v:
                v = shorter[v]
                nxt = children[v].get(c)
            if nxt is None:
                raise ValueError("a letter outside the vocabulary")
            v = nxt
            for x, size in ends[v]:
                before = last[i - size]
                arc = arcs.get(before * n + x)
                if arc is None:
                    arc = arcs[before * n + x] = before == n or self.automaton.has_arc(before, x)
                if arc:
                    last.append(x)
                    break
        out, i, length = [], len(letters), self.length
        while i:
            t = last[i]
            out.append(t)
            i -= length[t]
        out.reverse()
        return out


class WordAutomaton:
    """Whole texts by a ``tokenizers`` file of kind BPE with word ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, self.suffix = data["model"]["vocab"], data["model"]["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.labels = {i: t for t, i in (vocab | special).items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        made = {vocab[a + b] for a, b in pairs}
        singles = [i for t, i in vocab.items() if i not in made and t not in special]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.automaton = Automaton(singles, merges)
        spelling: dict[int, tuple[int, ...]] = {i: (i,) for i in singles}
        for a, b, m in merges:
            spelling[m] = spelling[a] + spelling[b]
        self.transducer = Transducer(self.automaton, spelling)
        self.inner = {t: i for t, i in vocab.items() if len(t) == 1}
        self.final = {t[0]: i for t, i in vocab.items() if len(t) == 1 + len(self.suffix) and t.endswith(self.suffix)}
        self.special = special
        self.special_cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.letters = byte_letters()
        self.words = Memo(lambda w: np.array(self.word(w), "<u4").tobytes())
        self.parts = Memo(lambda p: np.array(self.word(p if p.isalpha() and p.isascii() else "".join(
            [self.letters[b] for b in p.encode()])), "<u4").tobytes(), PART_ENTRIES)

    def word(self, w: str) -> list[int]:
        """Ids of one pre-split word in byte letters."""
        inner = self.inner
        return self.transducer.tokens([inner[c] for c in w[:-1]] + [self.final[w[-1]]])

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. The file's normaliser changes
        a Latin-1 text in case and white space only, so it is split by a
        pattern of the same borders; other texts are split chunk by chunk
        between spaces, where no word goes across, by the file's own rules."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            chunks = text.replace("\n", " ").split(" ")
            if len(chunks) > 1:
                return b"".join([self.plain(c) for c in chunks if c])
            words = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
            return b"".join([self.words[w] for w, _ in words])
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids of a whole text; special tokens, which the
        library looks for first, are cut out before anything else."""
        if self.special_cut and "<" in text:
            return b"".join([np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.plain(p)
                             for p in self.special_cut.split(text)])
        return self.plain(text)

    def decode(self, ids) -> str:
        """The arcs' labels, as the library joins them for a file without a
        decoder; ids without a label are passed over, as there."""
        return " ".join([t for t in map(self.labels.get, ids) if t is not None])


_LOADED: dict[str, WordAutomaton] = {}


def automaton(path: str) -> WordAutomaton:
    """The worker's automaton, compiled once from the file."""
    if path not in _LOADED:
        _LOADED[path] = WordAutomaton(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) of each row. Null text counts as empty and has
    no ids; null or repeated doc_ids stay, a row for each row; other columns are not
    returned; an empty table gives an empty result. A text's ids are held
    whole in its task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [np.frombuffer(a.encode(t or ""), "<i4") for t in b["text"]]})
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text (string) of each row of ids; null ids are an empty text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [a.decode([] if i is None else i.tolist()) for i in b["ids"]]})
    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {_type(encoded)}, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian uint32 ids),
    decoded_sha256 (of the decoded text in UTF-8): each text encoded, its ids
    decoded again, both reduced to digests where they were made. Null text
    counts as empty; null or repeated doc_ids stay, a row for each row; clashing
    further columns are not read; an empty table gives an empty result."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton(path)
        for b in batches:
            rows = []
            for text in b["text"]:
                ids = a.encode(text or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                             hashlib.sha256(a.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].values)
            yield out
    return docs.select("doc_id", "text").mapInPandas(
        run, f"doc_id {_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()
