"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn followed by pairs of a user
and an assistant turn. Turns that break this are merged into the one before
(same role), relabelled, or given an empty turn in front; an open end is
closed with empty turns. Dynamic programming over the automaton of legal turns
finds the repair of the smallest total cost; the repaired sequence is rendered
turn by turn, so that the renderings of a conversation's rows, in order, join
to its text.

Scale: rows are sorted by conversation and turn over all tasks by ranges, so a
conversation of any length is spread over as many tasks as it needs. A task
sums up what it holds of a conversation that crosses its borders as a min-plus
matrix (cheapest cost from each state to each state); the driver multiplies
these, two for each task at most, and tells each task in which states its
pieces begin and end. The tasks then trace their own pieces back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskstream.llm.common import shared_dir

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
LEGAL = frozenset({(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)})
RELABEL = 2.0
RELABEL_UNKNOWN = 0.25    # a null role or one that is none of the three
MERGE = 0.4
INSERT = 0.75
INF = float("inf")


def _entry(state: int, role: int) -> tuple[float, tuple[int, ...], bool]:
    """(cost, inserted roles, merged) of a turn with this role after a state."""
    if (state, role) in LEGAL:
        return 0.0, (), False
    if state == role:
        return MERGE, (), True
    for q in (SYSTEM, USER, ASSISTANT):
        if (state, q) in LEGAL and (q, role) in LEGAL:
            return INSERT, (q,), False
    return INF, (), False


def _closing(state: int) -> tuple[int, ...]:
    """Empty turns that end a conversation legally."""
    return {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]


END = np.array([INSERT * len(_closing(s)) for s in range(4)])
_ENTRIES = [[_entry(s, r) for r in range(4)] for s in range(4)]


def _known(role) -> int:
    role = role.strip().lower() if isinstance(role, str) else ""
    return ROLES.index(role) if role in ROLES[1:] else START


def _step(own: int) -> np.ndarray:
    """Cost of a turn with role ``own`` from each state to each state."""
    m = np.full((4, 4), INF)
    for s in range(4):
        for r in (SYSTEM, USER, ASSISTANT):
            m[s, r] = _ENTRIES[s][r][0] + (0 if r == own else RELABEL if own else RELABEL_UNKNOWN)
    return m


STEPS = [_step(own) for own in range(4)]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return (a[:, :, None] + b[None, :, :]).min(1)


def matrix(roles: list[int]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0.0, INF)
    for own in roles:
        out = times(out, STEPS[own])
    return out


def trace(roles: list[int], begin: int = START, end: int | None = None) -> list[int]:
    """States after each turn on the cheapest path from ``begin`` to ``end``,
    or to the cheapest legal end. Ties go to the smaller state."""
    cost = np.full(4, INF)
    cost[begin] = 0
    back = np.empty((len(roles), 4), "i1")
    for t, own in enumerate(roles):
        way = cost[:, None] + STEPS[own]
        back[t] = way.argmin(0)
        cost = way.min(0)
    state = int((cost + END).argmin()) if end is None else end
    path = []
    for t in range(len(roles) - 1, -1, -1):
        path.append(state)
        state = int(back[t, state])
    return path[::-1]


def _open(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


_CLOSE = "<|end|>\n"


def repair(roles: list, texts: list, begin: int = START, end: int | None = None, last: bool = True) -> list[tuple]:
    """(new role, action, inserted before, cost, rendered) of each turn."""
    own = [_known(r) for r in roles]
    states, out, before = trace(own, begin, end), [], begin
    for i, (role, state) in enumerate(zip(own, states)):
        cost, inserted, merged = _ENTRIES[before][state]
        cost += STEPS[role][before, state] - cost
        text = texts[i] or ""
        if merged:
            shown = "\n" + text
        else:
            shown = (_CLOSE if before != START else "") + "".join(_open(q) + _CLOSE for q in inserted) + _open(state) + text
        action = ("merge" if merged else "keep") if role == state else ("merge+relabel" if merged else "relabel")
        if last and i == len(own) - 1:
            shown += _CLOSE + "".join(_open(q) + _CLOSE for q in _closing(state))
            cost += END[state]
        out.append((ROLES[state], action, ",".join(ROLES[q] for q in inserted), float(cost), shown))
        before = state
    return out


_ROWS = 4_096      # that are repaired before they are handed on


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, object, list[tuple]]]:
    """(number, conv_id, rows) of each conversation in a sorted partition;
    null ids are one conversation."""
    held, number, own = [], 0, None
    for b in batches:
        ids = b["conv_id"].astype(object).where(b["conv_id"].notna(), None)
        for conv, *row in zip(ids, *[b[c] for c in b.columns if c != "conv_id"]):
            if held and conv != own:
                yield number, own, held
                held, number = [], number + 1
            own = conv
            held.append(row)
    if held:
        yield number, own, held


def _borders(ordered: DataFrame) -> list:
    """The first and last conversation of each partition: (pid, number, id,
    matrix)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, out, last = TaskContext.get().partitionId(), [], None
        for number, conv, rows in _pieces(batches):
            last = (pid, number, conv, rows)
            if number == 0:
                out.append(last)
        if last is not None and last[1] > 0:
            out.append(last)
        if out:
            yield pd.DataFrame([(p, n, None if c is None else str(c), matrix([_known(r) for r, in rows]).ravel().tolist())
                                for p, n, c, rows in out], columns=["pid", "number", "conv", "costs"])
    got = ordered.select("conv_id", "role").mapInPandas(run, "pid int, number int, conv string, costs array<double>")
    return sorted(got.collect(), key=lambda r: (r["pid"], r["number"]))


def _ends(borders: list) -> dict[tuple[int, int], tuple[int, int | None, bool]]:
    """(pid, number) -> (begin, end, is the conversation's last piece) of
    pieces whose conversation crosses partitions."""
    out, at = {}, 0
    while at < len(borders):
        to = at + 1
        while to < len(borders) and borders[to]["conv"] == borders[at]["conv"]:
            to += 1
        if to - at > 1:
            run = borders[at:to]
            ahead = [np.array([0, INF, INF, INF])]
            for r in run:
                ahead.append((ahead[-1][:, None] + np.array(r["costs"]).reshape(4, 4)).min(0))
            state = int((ahead[-1] + END).argmin())
            for k in range(len(run) - 1, -1, -1):
                begin = int((ahead[k] + np.array(run[k]["costs"]).reshape(4, 4)[:, state]).argmin())
                out[run[k]["pid"], run[k]["number"]] = (begin, state, k == len(run) - 1)
                state = begin
        at = to
    return out


def format_chats(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, new_role, action, inserted, cost, rendered: a row
    for each row. Order within a conversation: turn (null first), role, text
    hash. Null or unknown roles are relabelled cheaply, null texts are empty,
    rows without a conv_id are one conversation, repeated rows are turns of
    their own. Other columns are not read. An empty table gives an empty
    result."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    order = ["conv_id", "turn", "role", "_hash", "_row"]
    # The row number only splits runs of equal rows between tasks.
    base = (turns.select("conv_id", "turn", "role", "text").withColumn("_hash", F.xxhash64("text"))
            .withColumn("_row", F.monotonically_increasing_id()))
    ordered = base.repartitionByRange(*order).sortWithinPartitions(*order) \
        .select("conv_id", "turn", "role", "text").checkpoint()
    ends = _ends(_borders(ordered))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, out = TaskContext.get().partitionId(), []
        for number, conv, rows in _pieces(batches):
            begin, end, last = ends.get((pid, number), (START, None, True))
            found = repair([r for _, r, _ in rows], [x for *_, x in rows], begin, end, last)
            out += [(conv, turn, role, *new) for (turn, role, _), new in zip(rows, found)]
            if len(out) >= _ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    names = ["conv_id", "turn", "role", "new_role", "action", "inserted", "cost", "rendered"]
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema.fields}
    return ordered.mapInPandas(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, new_role string, "
                                    "action string, inserted string, cost double, rendered string")
