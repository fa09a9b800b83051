"""Byte-level BPE encoding and decoding over a hierarchical-bitmap rank queue.

A pre-token's bytes form a doubly linked list. Every adjacent pair that has a
merge rank is put, by its left position, in the bucket of that rank. Which
buckets hold something is kept in a three-level bitmap of 64-way words: the
next rank is found by a find-first-set on each level, so the queue needs no
comparison and no sorting, and a merge costs the same however long the
pre-token is. Entries that a later merge made untrue stay in their buckets and
are skipped when they are popped.

A bucket is worked off from left to right, as byte-pair merging of the leftmost
smallest rank demands; if a merge makes a pair that comes first, the rest of
the bucket goes back. Spark deals the rows; a task keeps a
bounded memo of pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from riskstream.llm.packing import Memo

# A space before white space of any kind, or at the end.
_SPACE_RUN = re.compile(r" (\s|$)").search
_BIT = [1 << i for i in range(64)]
MEMO_ENTRIES = 600_000    # of pre-tokens, and chunks, of a memo's generation


class RankQueue:
    """Buckets 0 .. 64**3 - 1 of list positions, with a bitmap hierarchy over
    the filled ones. Emptied by taking, so one queue serves all pre-tokens."""

    __slots__ = ("top", "mid", "low", "buckets")

    def __init__(self):
        self.top = 0                              # one bit for each word of mid
        self.mid = [0] * 64                       # one bit for each word of low
        self.low = [0] * 4096                     # one bit for each bucket
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            w = rank >> 6
            if not self.low[w]:
                m = w >> 6
                self.mid[m] |= _BIT[w & 63]
                self.top |= _BIT[m]
            self.low[w] |= _BIT[rank & 63]
        else:
            bucket.append(position)

    def take(self) -> tuple[int, list[int]]:
        """The smallest filled bucket's rank and positions; it is empty then."""
        m = (self.top & -self.top).bit_length() - 1
        word = self.mid[m]
        w = (m << 6) + (word & -word).bit_length() - 1
        word = self.low[w]
        bit = word & -word
        rank = (w << 6) + bit.bit_length() - 1
        word = self.low[w] = word ^ bit
        if not word:
            word = self.mid[m] = self.mid[m] ^ _BIT[w & 63]
            if not word:
                self.top ^= _BIT[m]
        return rank, self.buckets.pop(rank)


class ByteBPE:
    """Encoder and decoder for a file of ``base64(token) rank`` lines.

    Pre-tokens are the pattern's matches. Where every space is followed by
    something other than white space, no match crosses the front of a space
    (the pattern takes at most one space, and only at a match's start), so a
    text is cut there and each chunk's matches are found, and remembered,
    once. Other texts go through the pattern whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        if max(ranks.values(), default=0) >= 64 ** 3:
            raise ValueError("ranks must be below 262144")
        self.pattern = regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.queue = RankQueue()
        self.words = Memo(lambda w: np.array(self.merge(w.encode()), "<u4").tobytes(), MEMO_ENTRIES)
        self.chunks = Memo(lambda c: b"".join([self.words[w] for w in self.pattern.findall(" " + c)]), MEMO_ENTRIES)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. A whole token stands for itself."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        rank_of, queue = ranks.get, self.queue
        push, take = queue.push, queue.take
        n = len(piece)
        part = [piece[i:i + 1] for i in range(n)]     # text of the node at i, None once absorbed
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [rank_of(piece[i:i + 2], -1) for i in range(n)]   # rank of the pair that starts at i
        live[-1] = -1
        for i, r in enumerate(live):
            if r >= 0:
                push(r, i)
        while queue.top:
            rank, bucket = take()
            if len(bucket) > 1:
                bucket.sort(reverse=True)
            while bucket:
                i = bucket.pop()
                if live[i] != rank:
                    continue   # stale
                j = after[i]
                merged = part[i] = part[i] + part[j]
                part[j] = None
                live[j] = -1
                lowest = rank
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = live[i] = rank_of(merged + part[k], -1)
                    if r >= 0:
                        push(r, i)
                        if r <= lowest:
                            lowest = r - 1
                else:
                    live[i] = -1
                h = before[i]
                if h >= 0:
                    r = rank_of(part[h] + merged, -1)
                    if r != live[h]:
                        live[h] = r
                        if r >= 0:
                            push(r, h)
                            if r <= lowest:
                                lowest = r - 1
                if lowest < rank and bucket:   # a pair that comes before the rest of this bucket
                    for i in bucket:
                        push(rank, i)
                    break
        return [ranks[p] for p in part if p is not None]

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids of a whole text, special tokens as ordinary text."""
        words = self.words
        if _SPACE_RUN(text):
            ids = [words[w] for w in self.pattern.findall(text)]
        else:
            first, *rest = text.split(" ")
            chunks = self.chunks
            ids = [words[w] for w in self.pattern.findall(first)]
            ids += [chunks[c] for c in rest]
        return np.frombuffer(b"".join(ids), "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """The worker's tokenizer, read once."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE.load(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) of each row. Null text counts as empty and has
    no ids; null or repeated doc_ids stay; other columns are not returned."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [bpe.encode(t or "").astype("i4") for t in b["text"]]})
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary) of each row of ids; null ids are no bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"],
                                "bytes": [bpe.decode([] if i is None else i.tolist()) for i in b["ids"]]})
    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {_type(encoded)}, bytes binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids
    decoded again, both reduced to digests where they were made."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path, pattern)
        for b in batches:
            rows = []
            for text in b["text"]:
                ids = bpe.encode(text or "").tolist()
                rows.append((len(ids),
                             hashlib.sha256(" ".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest(),
                             hashlib.sha256(bpe.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].values)
            yield out
    return docs.select("doc_id", "text").mapInPandas(
        run, f"doc_id {_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()
