"""Best-fit packing of documents into training sequences by sums of squares.

With N(g) the number of open sequences that have g tokens left, each piece
goes where the sum of N(g)**2 becomes smallest: into an open sequence of gap
g >= size, which then has gap g - size, or into a new one. Full sequences no
longer count. Ties go to the smallest remaining gap, a new sequence last.

Pieces are packed largest first: equal sizes then follow one another, and
small pieces fill what large ones left. Only (piece, length) is shuffled, not
text or ids. Groups of about ``group_pieces`` pieces, dealt by a hash, are
packed each by one task, so that no task grows with the corpus; a group has
one shared tail of open sequences, some hundredths of a percent of its tokens.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 65_536
MEMO_ENTRIES = 150_000    # of a generation: a worker's memo holds up to twice as many
PART_ENTRIES = 300_000    # of the memo of pre-tokens
MEMO_CHARS = 64           # longer ones are not remembered

# Pre-tokens of lower-cased Latin-1 text, as the file's pattern cuts them.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable
    Latin-1 stands for itself, the others for the letters from U+0100 on."""
    own = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else "" for b in range(256)]
    rest = iter(range(256, 512))
    return [c or chr(next(rest)) for c in own]


class Memo(dict):
    """Bounded memo of two generations: a full one becomes the old one, and
    what is asked for again moves back. ``learn(key)`` makes a value."""

    def __init__(self, learn, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.learn, self.entries, self.old = learn, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.learn(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordIds:
    """Ids of whole texts from a ``tokenizers`` file that drops white space.

    A Latin-1 text (which the file's normaliser changes in case and white space
    only) is cut at the file's own pre-token borders, and each distinct part
    goes to the library's model once. In other texts no token spans a space or
    line end: their chunks in between go the same way, those beyond Latin-1
    through the library's whole chain.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = byte_letters()
        model = self.tokenizer.model.tokenize

        def part_ids(part: str) -> bytes:
            word = part if part.isalpha() and part.isascii() else "".join([self.letters[b] for b in part.encode()])
            return np.array([t.id for t in model(word)], "<u4").tobytes()

        self.parts = Memo(part_ids, PART_ENTRIES)
        self.chunks = Memo(lambda c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes())

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids of a whole text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            chunks = text.replace("\n", " ").split(" ")
            if len(chunks) == 1:
                return self.chunks[text]
            return b"".join([self.encode(c) for c in chunks if c])
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, row_key (the document's place in the
    table, which keeps repeated or null doc_ids apart), piece, start, length,
    ids_crc32. Null text is empty: its piece is the end id alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, end = word_ids(path), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, key, text in zip(b["doc_id"], b["row_key"], b["text"]):
                ids = tok.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "row_key", "piece", "start", "length", "ids_crc32"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", "text").withColumn("row_key", F.monotonically_increasing_id())
            .mapInPandas(run, f"doc_id {kind}, row_key long, piece int, start long, length long, ids_crc32 long"))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Packs pieces in the given order -> (sequence number, offset) of each."""
    count = np.zeros(capacity + 1, "i8")            # N(g); gap 0 is closed
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    seq, off = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    made = 0
    for i, s in enumerate(lengths.tolist()):
        # change of the sum: 2 * (N(g - s) - N(g)) + 2, without the square of gap 0
        fits = count[s:]
        gaps = np.flatnonzero(fits)
        best = gap = None
        if len(gaps):
            cost = 2 * (count[gaps] - fits[gaps]) + 2
            if gaps[0] == 0:
                cost[0] = 1 - 2 * fits[0]
            k = int(np.argmin(cost))
            best, gap = int(cost[k]), int(gaps[k]) + s
        new = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if best is None or new < best:
            b, gap = made, capacity
            made += 1
        else:
            b = open_[gap].pop()
            count[gap] -= 1
        seq[i], off[i] = b, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_[gap - s].append(b)
    return seq, off


def pack(items: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """items (with row_key, piece, length) and the columns sequence_id, offset.

    The group count is the table's rows over ``group_pieces``. A length null,
    below 1 or above the capacity raises."""
    n = items.count()
    groups = max(1, -(-n // group_pieces))
    fields = [f for f in items.schema.fields if f.name not in ("sequence_id", "offset")]

    def run(key, t: pd.DataFrame) -> pd.DataFrame:
        size = t["length"].to_numpy()
        if len(size) and not (size.min() >= 1 and size.max() <= capacity):
            raise ValueError("a piece's length must be from 1 to the capacity")
        t = t.sort_values(["length", "row_key", "piece"], ascending=[False, True, True], kind="stable")
        seq, t["offset"] = sum_of_squares(t["length"].to_numpy(), capacity)
        t["sequence_id"] = seq * groups + int(key[0])
        return t[[f.name for f in fields] + ["sequence_id", "offset"]]

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    g = F.pmod(F.xxhash64("row_key", "piece"), F.lit(groups)).alias("_g")
    return items.select(*[f.name for f in fields]).groupBy(g).applyInPandas(run, out)


def pack_documents(spark, docs: DataFrame, path: str, capacity: int = CAPACITY,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Packs whole documents: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. The pieces are written once to the shared folder, as
    both the count and the packing read them."""
    from riskstream.llm.common import Scratch
    items = Scratch(spark, "packing").write(pieces(docs, path, capacity), "pieces")
    return pack(items, capacity, group_pieces).drop("row_key")
