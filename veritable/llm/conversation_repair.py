"""Repair of conversation structure by a Viterbi search that emits edits as soon as they are settled.

The roles of a repaired conversation read `(system)? (user assistant)+`, or there are none. Each
turn is kept, given the other role, or deleted, and empty turns may be inserted anywhere; the
edits with the least total cost are found, of equal cost those whose initials come first in ASCII.

The search has four states: nothing yet, after the system turn, after a user, after an assistant.
For each state one survivor, the cheapest way to it, is a leaf of a tree of edits that point
back to the edit before. Nodes count what refers to them and are freed when nothing does. Once
all survivors share their first open edit, it is settled, emitted, and becomes the root, so
what is held is only the part on which survivors still differ. Equal costs are decided by comparing
the whole open parts. A survivor so dear that another state, brought over by insertions or a
deletion, beats it whatever follows, is dropped; else the way that deletes everything would keep
all edits open.

Turns are dealt by conversation and sorted in each partition, and one conversation after the other
streams through a task; a long one is never collected. It stays in one task, since each edit
depends on all before it and so does the digest of the repaired text; duplicates are marked
before, in the sort, not by remembering turns.

Faults of a turn, of which the first counts: blank (nothing but white space), duplicate (role and
text of an earlier turn of the conversation), truncated (its last character that is no white space does
not end a sentence). Defined cases: null roles and texts count as one space, so such a
role is none of the three and such a text is blank. Null turns come first; equal turns are ordered by
role and text. Null conversation ids are one conversation. Gaps beyond a long are null. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.llm.quality_rules import SPACE_CHARS

# Costs of edits, of leaving a truncated turn, and characters that end a sentence.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ENDINGS = ".!?"
ROLES = {"s": "system", "u": "user", "a": "assistant"}

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Where a role leads, the role that may be given or inserted, and pairs of roles in order.
_NEXT = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
_GIVEN = ("u", "u", "a", "u")
_PAIRS = {"su", "ua", "au"}
#: [s][t]: how much dearer the rest can be from s than from t, whatever follows.
_BEHIND = (
    (0, 0, INSERT, 0),
    (2 * INSERT, 0, INSERT, 2 * INSERT),
    (INSERT + DELETE, INSERT, 0, INSERT),
    (DELETE, 0, INSERT, 0),
)
_FAULTS = ("blank", "duplicate", "truncated")
_FLUSH_ROWS, _FLUSH_CHARS = 4096, 1 << 22


class _Edit:
    """A node of the tree: an edit, the one before it, those after it, and survivors that end in it."""

    __slots__ = ("before", "after", "held", "depth", "initial", "role", "text")

    def __init__(self, before: _Edit | None, initial: str, role: str, text: str) -> None:
        self.before, self.initial, self.role, self.text = before, initial, role, text
        self.after: list[_Edit] = []
        self.held = 0
        self.depth = before.depth + 1 if before else 0
        if before:
            before.after.append(self)


def _comes_first(a: list[str], x: _Edit, b: list[str], y: _Edit) -> bool:
    """Whether the open edits up to x and then a come before those up to y and then b."""
    left, right = a[::-1], b[::-1]
    while x is not y:
        if x.depth >= y.depth:
            left.append(x.initial)
            x = x.before
        else:
            right.append(y.initial)
            y = y.before
    return left[::-1] < right[::-1]


class Repair:
    """One conversation: `turn` for each of its turns, then `end`; edits go to `emit` in order."""

    def __init__(self, emit: Callable[[str, str, str], None]) -> None:
        self.emit = emit
        self.root = _Edit(None, "", "", "")
        self.root.held = 1
        self.survivors: dict[int, tuple[int, _Edit]] = {_START: (0, self.root)}

    @property
    def open_edits(self) -> int:
        return max(node.depth for _, node in self.survivors.values()) - self.root.depth

    def _with_insertions(self) -> dict[int, tuple[int, _Edit, list[tuple[str, str, str]]]]:
        """The cheapest way to each state when turns may be inserted: cost, survivor, and inserted edits."""
        ways = {state: (cost, node, []) for state, (cost, node) in self.survivors.items()}
        for to, sources in ((_USER, (_START, _SYSTEM, _ASSISTANT)), (_ASSISTANT, (_USER,))):
            made = [ways[s] for s in sources if s in ways]
            for cost, node, edits in made:
                role = ROLES["u" if to == _USER else "a"]
                self._offer(ways, to, cost + INSERT, node, [*edits, ("I", role, "")])
        return ways

    @staticmethod
    def _offer(ways: dict, state: int, cost: int, node: _Edit, edits: list[tuple[str, str, str]]) -> None:
        known = ways.get(state)
        if known is None or cost < known[0] or (
            cost == known[0] and _comes_first([e[0] for e in edits], node, [e[0] for e in known[2]], known[1])
        ):
            ways[state] = (cost, node, edits)

    def turn(self, role: str, text: str, fault: str | None) -> None:
        ways: dict[int, tuple[int, _Edit, list]] = {}
        rest = TRUNCATED if fault == "truncated" else 0
        for state, (cost, node, edits) in self._with_insertions().items():
            self._offer(ways, state, cost + DELETE, node, [*edits, ("D", role, text)])
            if fault in ("blank", "duplicate"):
                continue
            kept = _NEXT[state].get(role[:1])
            if kept is not None:
                self._offer(ways, kept, cost + rest, node, [*edits, ("K", role, text)])
            given = _GIVEN[state]
            self._offer(ways, _NEXT[state][given], cost + rest + REROLE, node, [*edits, ("R", ROLES[given], text)])
        beaten = {t for t in ways for s in ways if ways[t][0] > ways[s][0] + _BEHIND[s][t]}
        self._become({state: way for state, way in ways.items() if state not in beaten})

    def _become(self, ways: dict[int, tuple[int, _Edit, list]]) -> None:
        """Survivors make way for new ones; what nothing refers to any more is freed, what all share is emitted."""
        old = self.survivors
        self.survivors = {}
        for state, (cost, node, edits) in ways.items():
            for edit in edits:
                node = _Edit(node, *edit)
            node.held += 1
            self.survivors[state] = (cost, node)
        for _, node in old.values():
            node.held -= 1
            while not node.held and not node.after and node is not self.root:
                node.before.after.remove(node)
                node = node.before
        while not self.root.held and len(self.root.after) == 1:
            self.root = self.root.after[0]
            self.root.before = None
            self.emit(self.root.initial, self.root.role, self.root.text)

    def end(self) -> int:
        """Settle and emit what is open; the cost."""
        ways = {s: w for s, w in self._with_insertions().items() if s in (_START, _ASSISTANT)}
        last: dict[int, tuple[int, _Edit, list]] = {}
        for cost, node, edits in ways.values():
            self._offer(last, _START, cost, node, edits)
        self._become(last)
        return last[_START][0]


class _Summary:
    """The figures of one conversation, and its repaired text's digest, from turns in order."""

    def __init__(self, key: Any) -> None:
        self.key, self.audit, self.digest = key, [], hashlib.sha256()
        self.faults = dict.fromkeys(_FAULTS, 0)
        self.illegal = self.turns = self.chars = 0
        self.least = self.most = self.last = None
        self.initial: str | None = None
        self.any = False
        self.repair = Repair(self._emit)

    def _emit(self, initial: str, role: str, text: str) -> None:
        self.audit.append(initial)
        if initial != "D":
            self.digest.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode())
            self.any = True

    def turn(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = self.last = turn
        if self.initial is not None and self.initial + role[:1] not in _PAIRS:
            self.illegal += 1
        self.initial = role[:1]
        self.repair.turn(role, text, fault)

    def row(self) -> tuple:
        cost = self.repair.end()
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (
            self.key, gaps if gaps < 1 << 63 else None, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.digest.hexdigest(),
        )


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(whether a conversation begins, its row) of sorted rows."""
    last: Any = _turns
    for batch in batches:
        for row in zip(*[batch.column(batch.schema.names.index(n)).to_pylist() for n in ("key", "turn", "role", "text", "fault")]):
            yield last is _turns or row[0] != last, row
            last = row[0]


def faulty(turns: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, turn, role, text and fault of each turn, conversations whole in a partition and in order."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    rows = turns.select(F.col(f"`{id_column}`").alias("key"), F.col(f"`{turn}`").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    earlier = F.row_number().over(Window.partitionBy("key", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    shown = F.rtrim("text", F.lit(SPACE_CHARS))
    fault = F.when(shown == "", "blank").when(earlier, "duplicate").when(~F.substring(shown, -1, 1).isin(*ENDINGS), "truncated")
    return rows.repartition("key").withColumn("fault", fault).sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")


def edits(turns: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per edit: conversation, number from 1, initial (K, R, D or I), and the role and text it leaves or deletes."""
    rows = faulty(turns, id_column, turn, role, text)
    names = [id_column, "number", "edit", "new_role", "new_text"]
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        key_type = None
        current: Repair | None = None
        key: Any = None
        number = 0

        def emit(initial: str, new_role: str, new_text: str) -> None:
            nonlocal number
            number += 1
            made.append((key, number, initial, new_role, new_text))

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*made), (key_type, pa.int64(), pa.string(), pa.string(), pa.string()))]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal key_type
            for one in batches:
                key_type = one.schema.field("key").type
                yield one

        for begins, (k, _, r, t, fault) in _turns(typed()):
            if begins:
                if current:
                    current.end()
                key, number, current = k, 0, Repair(emit)
            current.turn(r, t, fault)
            if len(made) >= _FLUSH_ROWS or sum(len(m[4]) for m in made[-64:]) > _FLUSH_CHARS:
                yield batch()
        if current:
            current.end()
        if made:
            yield batch()

    return rows.mapInArrow(run, f"`{id_column}` {kind}, number long, edit string, new_role string, new_text string")


def repair(turns: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: gaps, faults, illegal pairs of roles, cost, audit, and the repaired text's SHA-256."""
    rows = faulty(turns, id_column, turn, role, text)
    names = [id_column, "gaps", *_FAULTS, "illegal", "cost", "audit", "repaired_sha256"]
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        chars = 0
        key_type = None
        current: _Summary | None = None

        def close() -> None:
            nonlocal chars
            made.append(current.row())
            chars += len(made[-1][7])

        def batch() -> pa.RecordBatch:
            nonlocal chars
            types = (key_type, *[pa.int64()] * 6, pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*made), types)]
            made.clear()
            chars = 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal key_type
            for one in batches:
                key_type = one.schema.field("key").type
                yield one

        for begins, (key, *values) in _turns(typed()):
            if begins:
                if current:
                    close()
                current = _Summary(key)
            current.turn(*values)
            if len(made) >= _FLUSH_ROWS or chars > _FLUSH_CHARS:
                yield batch()
        if current:
            close()
            yield batch()

    longs = ", ".join(f"{n} long" for n in names[1:7])
    return rows.mapInArrow(run, f"`{id_column}` {kind}, {longs}, audit string, repaired_sha256 string")
