"""Conversation structure repair by grammar-compressed dynamic programming.

A conversation is legal if its role initials read ``(s?(ua)+)?``: a system
turn or none, then user and assistant in turn. Each row has a fault or none:
blank, duplicate (role and text seen earlier), truncated (no ``.``, ``!`` or
``?`` at the end). The cheapest edits that make it legal are: keep a row (0), give
it the role user or assistant (1), delete it (2; blank and duplicate rows must
be), insert an empty row (5); a truncated row that stays costs 5 more. The audit is
the edits' initials in order, the ASCII-least of the cheapest.

A row is a symbol of its role and fault, and a symbol a min-plus matrix: from
each state of the automaton before it to each state after it, the least cost and
the rope of edits that costs it. Runs of conversations are compressed
together: Re-Pair replaces the most frequent pair of neighbours by a new
symbol, again and again, and each rule's matrix is made once, from those of its
two parts, for all conversations in which it occurs. Ropes are not spelled out for
that: edits of equal cost have equal length (insertion never pays: to delete
its partner is cheaper), so a rule needs only the order of its 16 ropes, which
follows from the orders of its parts. Only the rope that a conversation takes is
spelled, from strings that are shared in the same way.

Scale: rows are put in order by a range sort and numbered; blocks of ``BLOCK``
rows within a conversation become one matrix each, however long the conversation, and
a task chains the matrices of a conversation (a row for 4096) to the states at the
blocks' borders; the blocks then spell their edits. A conversation's digest alone
is read row after row in one task, as SHA-256 asks; its rows pass through, sorted,
and are not held.

Cases: rows are ordered by turn, nulls first, ties by role and a hash of the text.
A null role or text counts as one space, so that such a text is blank. A null
conv_id is a conversation of its own. A role counts by its initial; one other than
s, u or a can't be kept. Repeated rows are duplicates. Texts of any length are whole.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskstream.llm.common import Scratch

BLOCK_BITS = 12                      # 4096 rows
RULES = 240                          # of a grammar; what is left is chained symbol by symbol
RUN_SYMBOLS = 1_000_000              # compressed together
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
START, LED, ASKED, DONE = range(4)   # nothing yet; after system, user, assistant
FINAL = (START, DONE)
STEP = {(START, SYSTEM): LED, (START, USER): ASKED, (LED, USER): ASKED, (DONE, USER): ASKED, (ASKED, ASSISTANT): DONE}
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
NEVER = 1 << 40
KEPT, GONE = "=", "-"                # marks; u, a: rerole, U, A: insert


def _inserts() -> list[list[tuple[int, str]]]:
    """Cheapest insertions from state to state."""
    best = [[(0, "") if p == q else (NEVER, "") for q in range(4)] for p in range(4)]
    for _ in range(4):
        for p in range(4):
            for (r, role), q in STEP.items():
                if role in (USER, ASSISTANT) and best[p][r][0] < NEVER:
                    best[p][q] = min(best[p][q], (best[p][r][0] + INSERT, best[p][r][1] + "I"))
    return best


def _symbol(role: int, fault: int) -> list[list[tuple[int, str]]]:
    """A row's cheapest edits from state to state, insertions before it included."""
    own = [[(NEVER, "") for _ in range(4)] for _ in range(4)]
    for p in range(4):
        options = [(p, DELETE, "D")]
        if fault not in (BLANK, DUPLICATE):
            more = CUT_OFF if fault == TRUNCATED else 0
            options += [(STEP[p, role], more, "K")] if (p, role) in STEP else []
            options += [(STEP[p, x], REROLE + more, "R") for x in (USER, ASSISTANT) if (p, x) in STEP]
        for q, cost, edit in options:
            own[p][q] = min(own[p][q], (cost, edit))
    lead = _inserts()
    return [[min((lead[p][r][0] + own[r][q][0], lead[p][r][1] + own[r][q][1]) for r in range(4)) for q in range(4)] for p in range(4)]


_SYMBOLS = [_symbol(s >> 2, s & 3) for s in range(16)]
_TAIL = _inserts()


def combine(ca, ra, cb, rb):
    """Min-plus products of matrices (m, 4, 4) with the order of their ropes:
    costs, orders, and the states in between."""
    key = (np.minimum(ca[:, :, :, None] + cb[:, None, :, :], NEVER) << 10) | (ra[:, :, :, None] << 5) | rb[:, None, :, :]
    via = key.argmin(axis=2)
    best = np.take_along_axis(key, via[:, :, None, :], axis=2)[:, :, 0, :]
    code = (best & 1023).reshape(-1, 16)
    rank = (code[:, None, :] < code[:, :, None]).sum(2).reshape(-1, 4, 4)
    return best >> 10, rank, via


def re_pair(sequences: list[np.ndarray], rules: int = RULES) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Rules, numbered from 16, and the compressed sequences."""
    size = 16 + rules
    joined = np.concatenate([np.concatenate([s.astype("i8"), [-1]]) for s in sequences]) if sequences else np.zeros(0, "i8")
    made: list[tuple[int, int]] = []
    while len(made) < rules and len(joined) > 1:
        x, y = joined[:-1], joined[1:]
        pairs = np.where((x >= 0) & (y >= 0), x * size + y, size * size)
        counts = np.bincount(pairs, minlength=size * size + 1)[:-1]
        pair = int(counts.argmax())
        if counts[pair] < 2:
            break
        a, b = divmod(pair, size)
        at = np.flatnonzero(pairs == pair)
        if a == b:                                # of a run of one symbol every second place
            new = np.concatenate([[True], np.diff(at) > 1])
            start = at[new][np.cumsum(new) - 1]
            at = at[(at - start) % 2 == 0]
        joined[at] = 16 + len(made)
        joined = np.delete(joined, at + 1)
        made.append((a, b))
    ends = np.flatnonzero(joined < 0)
    return made, [joined[i:j] for i, j in zip(np.concatenate([[0], ends[:-1] + 1]).tolist(), ends.tolist())]


class Evaluated:
    """The matrices of a run of symbol sequences (none empty), which share a grammar."""

    def __init__(self, sequences: list[np.ndarray], rules: int = RULES):
        self.rules, self.top = re_pair(sequences, rules)
        n = 16 + len(self.rules)
        self.cost, self.rank = np.zeros((n, 4, 4), "i8"), np.zeros((n, 4, 4), "i8")
        self.via = np.zeros((n, 4, 4), "i8")
        for s, matrix in enumerate(_SYMBOLS):
            order = sorted({e for row in matrix for _, e in row})
            for p in range(4):
                for q in range(4):
                    self.cost[s, p, q], self.rank[s, p, q] = matrix[p][q][0], order.index(matrix[p][q][1])
        for k, (a, b) in enumerate(self.rules, 16):
            self.cost[k:k + 1], self.rank[k:k + 1], self.via[k:k + 1] = combine(
                self.cost[a:a + 1], self.rank[a:a + 1], self.cost[b:b + 1], self.rank[b:b + 1])
        self.spelled: dict[tuple[int, int, int], str] = {}
        length = np.array([len(t) for t in self.top], "i8")
        first = np.array([t[0] for t in self.top], "i8")
        self.costs, self.ranks = self.cost[first], self.rank[first]     # of each sequence
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []            # (sequence -> row, states in between)
        for t in range(1, int(length.max()) if len(length) else 0):
            active = np.flatnonzero(length > t)
            s = np.array([self.top[i][t] for i in active.tolist()], "i8")
            self.costs[active], self.ranks[active], via = combine(self.costs[active], self.ranks[active], self.cost[s], self.rank[s])
            self.steps.append((active, via))

    def spell(self, symbol: int, p: int, q: int) -> str:
        """The rope of a symbol's entry; a part's string is made once."""
        todo = [(symbol, p, q)]
        while todo:
            at = todo[-1]
            s, i, j = at
            if at not in self.spelled:
                if s < 16:
                    self.spelled[at] = _SYMBOLS[s][i][j][1]
                else:
                    (a, b), r = self.rules[s - 16], int(self.via[s, i, j])
                    parts = [(a, i, r), (b, r, j)]
                    missing = [x for x in parts if x not in self.spelled]
                    if missing:
                        todo += missing
                        continue
                    self.spelled[at] = self.spelled[parts[0]] + self.spelled[parts[1]]
            todo.pop()
        return self.spelled[symbol, p, q]

    def audit(self, i: int, p: int, q: int) -> str:
        """The cheapest edits of sequence i from state p to state q."""
        out, top = [], self.top[i]
        for t in range(len(top) - 1, 0, -1):
            active, via = self.steps[t - 1]
            r = int(via[np.searchsorted(active, i), p, q])
            out.append(self.spell(int(top[t]), r, q))
            q = r
        out.append(self.spell(int(top[0]), p, q))
        return "".join(reversed(out))


def marks(audit: str, symbols, state: int) -> str:
    """What each edit makes of its row: kept, gone, or the role that it gets."""
    out, at = [], 0
    for e in audit:
        role = symbols[at] >> 2 if e != "I" else None
        if e == "D":
            out.append(GONE)
        elif e == "K":
            state = STEP[state, role]
            out.append(KEPT)
        else:
            to = ASSISTANT if state == ASKED else USER
            state = STEP[state, to]
            out.append(("ua" if e == "R" else "UA")[to == ASSISTANT])
        at += e != "I"
    return "".join(out)


def chain(blocks) -> tuple[int, list[tuple[int, int]], str]:
    """The cheapest way through a conversation's blocks of (cost, rank): its
    cost, the states before and after each block, and insertions at the end."""
    cost, rank = [0 if p == START else NEVER for p in range(4)], [0] * 4
    back = []
    for c, r in blocks:
        best = [min((cost[p] + c[p][q], rank[p], r[p][q], p) for p in range(4)) for q in range(4)]
        cost = [min(b[0], NEVER) for b in best]
        order = sorted({b[1:3] for b in best})
        rank = [order.index(b[1:3]) for b in best]
        back.append([b[3] for b in best])
    total, _, tail, q = min((cost[q] + _TAIL[q][f][0], rank[q], _TAIL[q][f][1], q) for q in range(4) for f in FINAL)
    states = []
    for b in reversed(back):
        states.append((b[q], q))
        q = b[q]
    return total, states[::-1], tail


def _whole(batches: Iterator[pd.DataFrame], column: str, limit: int) -> Iterator[pd.DataFrame]:
    """Runs of rows whose arrays hold about ``limit`` symbols."""
    for b in batches:
        size = np.cumsum([len(x) for x in b[column]])
        cut = np.flatnonzero(np.diff(size // limit, prepend=-1)).tolist() + [len(b)]
        for x, y in zip(cut[:-1], cut[1:]):
            yield b.iloc[x:y]


def damage(rows: DataFrame) -> DataFrame:
    """Planted faults, by the row's conv_id and turn: a row in 20 each is
    dropped, emptied, loses its ``.!?``, is repeated, becomes the user's."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = F.crc32(name) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (rows.select("conv_id", "turn", d.alias("d"), role.alias("role"), text.alias("text")).where("d <> 0")
            .select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


class Repair:
    """The repair of a table (conv_id, turn, role, text).

    ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost
    and audit of each conversation with rows; ``rows()``: the repaired rows;
    ``digests()``: SHA-256 of each conversation's repaired rows."""

    def __init__(self, spark: SparkSession, table: DataFrame):
        self.scratch = Scratch(spark, "structure")
        self.kind = table.schema["conv_id"].dataType.simpleString()
        text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
        order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash"), F.col("_row")]
        self.sorted = self.scratch.write(
            table.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
            .withColumn("hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
            .repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("seq", F.monotonically_increasing_id()).drop("_row", "hash"), "sorted")
        self.blocks = self.scratch.write(self._blocks(), "blocks")
        chained = self.scratch.write(self._chained(), "chained")
        self.marked = self.scratch.write(self._marked(chained), "marked")
        pieces = F.array_sort(F.collect_list(F.struct("blk", "audit")))
        audits = self.marked.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"))
        stats = chained.where("cost is not null").drop("blk", "p", "q", "tail")
        self.conversations = (stats.alias("s").join(audits.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")))
                              .drop("_c"))

    def _blocks(self) -> DataFrame:
        """(conv_id, blk, seq, symbol, turn): arrays of up to 4096 rows in order."""
        last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
        initial = F.substring("role", 1, 1)
        role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
        rows = self.sorted.select("conv_id", "turn", "seq", role.alias("r"), last.alias("last"),
                                  F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"))
        # The first row of each role and text, counted before it is shuffled; the others are repeats.
        first = rows.groupBy("conv_id", "same").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
        fault = (F.when(F.col("last") == "", BLANK).when(F.col("first").isNull(), DUPLICATE)
                 .when(F.col("last").isin(".", "!", "?"), NONE).otherwise(TRUNCATED))
        met = rows.drop("same").join(first, "seq", "left").select(
            "conv_id", "seq", "turn", (F.col("r") * 4 + fault).alias("symbol"))
        row = F.array_sort(F.collect_list(F.struct("seq", "symbol", "turn")))
        return (met.groupBy("conv_id", F.shiftright("seq", BLOCK_BITS).alias("blk")).agg(row.alias("x"))
                .select("conv_id", "blk", F.col("x.seq").alias("seq"), F.col("x.symbol").alias("symbol"), F.col("x.turn").alias("turn")))

    def _chained(self) -> DataFrame:
        """A row for each block: the states before (p) and after it (q); with
        its conversation's last one, the conversation's figures."""
        def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _whole(batches, "symbol", RUN_SYMBOLS):
                symbols = [np.asarray(x, "i8") for x in b["symbol"]]
                e = Evaluated(symbols)
                rows = []
                for i, (s, turn) in enumerate(zip(symbols, b["turn"])):
                    role, fault = s >> 2, s & 3
                    legal = np.array([[(x, y) in LEGAL for y in range(4)] for x in range(4)])
                    known = [int(x) for x in turn if x is not None and x == x]
                    rows.append((e.costs[i].ravel().tolist(), e.ranks[i].ravel().tolist(), int(role[0]), int(role[-1]),
                                 int((~legal[role[:-1], role[1:]]).sum()), int((fault == BLANK).sum()), int((fault == DUPLICATE).sum()),
                                 int((fault == TRUNCATED).sum()), known[0] if known else None, known[-1] if known else None, len(set(known))))
                out = pd.DataFrame(rows, columns=["costs", "ranks", "first", "last", "illegal", "blank", "duplicate", "truncated",
                                                  "low", "high", "turns"])
                out["low"], out["high"] = out["low"].astype("Int64"), out["high"].astype("Int64")
                out.insert(0, "blk", b["blk"].to_numpy())
                out.insert(0, "conv_id", b["conv_id"].array)
                yield out

        summaries = self.blocks.mapInPandas(matrices, f"conv_id {self.kind}, blk long, costs array<long>, ranks array<long>, "
                                            "first int, last int, illegal long, blank long, duplicate long, truncated long, "
                                            "low long, high long, turns long")

        def walk(rows: list) -> list[tuple]:
            total, states, tail = chain([(np.reshape(r.costs, (4, 4)).tolist(), np.reshape(r.ranks, (4, 4)).tolist()) for r in rows])
            illegal, turns, low, high, before = 0, 0, None, None, None
            for r in rows:
                illegal += r.illegal + (before is not None and (before, r.first) not in LEGAL)
                before = r.last
                if pd.notna(r.low):
                    turns += r.turns - (high is not None and high == r.low)
                    low, high = r.low if low is None else low, r.high
            own = (0 if low is None else int(high) - int(low) + 1 - turns, sum(r.blank for r in rows), sum(r.duplicate for r in rows),
                   sum(r.truncated for r in rows), illegal, total)
            end = len(rows) - 1
            return [(r.conv_id, r.blk, p, q, tail if k == end else "", *(own if k == end else [None] * 6))
                    for k, (r, (p, q)) in enumerate(zip(rows, states))]

        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

        def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, out = [], []

            def frame() -> pd.DataFrame:
                f = pd.DataFrame(out, columns=["conv_id", "blk", "p", "q", "tail", *names])
                for c in names:
                    f[c] = f[c].astype("Int64")
                if self_kind_is_long:
                    f["conv_id"] = f["conv_id"].astype("Int64")
                return f
            for b in batches:
                for r in b.itertuples(index=False):
                    if held and not _equal(held[-1].conv_id, r.conv_id):
                        out += walk(held)
                        held = []
                    held.append(r)
                if out:
                    yield frame()
                    out = []
            if held:
                out += walk(held)
                yield frame()

        self_kind_is_long = self.kind in ("bigint", "int", "smallint", "tinyint")
        return (summaries.repartition("conv_id").sortWithinPartitions("conv_id", "blk")
                .mapInPandas(chains, f"conv_id {self.kind}, blk long, p int, q int, tail string, " + ", ".join(f"{c} long" for c in names)))

    def _marked(self, chained: DataFrame) -> DataFrame:
        """(conv_id, blk, seq, audit, marks) of each block."""
        c = chained.select(F.col("conv_id").alias("_c"), F.col("blk").alias("_b"), "p", "q", "tail")
        met = self.blocks.join(c, (F.col("blk") == F.col("_b")) & F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c", "_b", "turn")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _whole(batches, "symbol", RUN_SYMBOLS):
                symbols = [np.asarray(x, "i8") for x in b["symbol"]]
                e = Evaluated(symbols)
                audits = [e.audit(i, p, q) + tail for i, (p, q, tail) in enumerate(zip(b["p"], b["q"], b["tail"]))]
                yield pd.DataFrame({"conv_id": b["conv_id"].array, "blk": b["blk"].to_numpy(), "seq": b["seq"].to_numpy(), "audit": audits,
                                    "marks": [marks(a, s.tolist(), p) for a, s, p in zip(audits, symbols, b["p"])]})
        return met.mapInPandas(run, f"conv_id {self.kind}, blk long, seq array<long>, audit string, marks string")

    def rows(self) -> DataFrame:
        """(conv_id, seq, place, role, text) of the repaired conversations, to
        be read in the order of seq and place. An inserted row has the seq of the row
        that it stands before or, at a block's end, after."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                seqs, places, out = [], [], []
                for seq, m in zip(b["seq"], b["marks"]):
                    at = place = 0
                    for x in m:
                        if x != GONE:
                            seqs.append(seq[min(at, len(seq) - 1)])
                            places.append(place)
                            out.append(x)
                        place += 1
                        at += x not in "UA"
                if out:
                    yield pd.DataFrame({"seq": np.array(seqs, "i8"), "place": np.array(places, "i4"), "mark": out})
        edits = self.marked.select("seq", "marks").mapInPandas(run, "seq long, place int, mark string")
        inserted = F.col("mark").isin("U", "A")
        role = (F.when(F.lower("mark") == "u", "user").when(F.lower("mark") == "a", "assistant").otherwise(F.col("role")))
        return self.sorted.join(edits, "seq").select(
            "conv_id", "seq", "place", role.alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"))

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256): of the rows ``role:text``, joined by line ends."""
        kind = self.kind

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, digest = None, None
            for b in batches:
                done = []
                for conv, role, text in zip(b["conv_id"], b["role"], b["text"]):
                    if digest is not None and _equal(held, conv):
                        digest.update(b"\n")
                    else:
                        if digest is not None:
                            done.append((held, digest.hexdigest()))
                        held, digest = conv, hashlib.sha256()
                    digest.update(f"{role}:{text}".encode())
                if done:
                    yield _frame(done, kind)
            if digest is not None:
                yield _frame([(held, digest.hexdigest())], kind)
        return (self.rows().repartition("conv_id").sortWithinPartitions("conv_id", "seq", "place")
                .mapInPandas(run, f"conv_id {kind}, repaired_sha256 string"))


def _equal(a, b) -> bool:
    return (pd.isna(a) and pd.isna(b)) or a == b


def _frame(rows: list, kind: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "repaired_sha256"])
    if kind in ("bigint", "int", "smallint", "tinyint"):
        out["conv_id"] = out["conv_id"].astype("Int64")
    return out


def repair(spark: SparkSession, table: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each conv_id of ``names``: what ``Repair`` finds in ``table``;
    zeros, no edits and the digest of nothing where it has no rows there."""
    r = Repair(spark, table)
    def own(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnRenamed("conv_id", name)
    everyone = names.select("conv_id").distinct()
    met = (everyone.join(own(r.conversations, "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
           .join(own(r.digests(), "_d"), F.col("conv_id").eqNullSafe(F.col("_d")), "left"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return met.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
