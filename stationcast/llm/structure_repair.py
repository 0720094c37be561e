"""Repair of conversation structure by the cheapest edits, found in one ordered pass.

Rows are dealt by conversation and sorted by turn (secondary sort), so one task sees a
conversation as a stream. ``mapInPandas`` carries the state of a dynamic program from row to
row and from Arrow batch to Arrow batch: for each state of the grammar ``(s?(ua)+)?`` over
the initials of the roles, the least cost of the rows so far and the order of the states'
edit strings. Costs relative to the least one take few values, so each row is one lookup in
a table of transitions that fills as they are met. A row leaves two things behind: the number
of its transition (the backpointers of all states in four bytes) and, where it can survive,
its role and text. Both go to spooled files of the task, which stay in memory for usual
conversations and spill for giant ones; they have no name, so nothing outlives the task and
a lost executor only means that the task runs again.

Edits are named by their initials: Keep, Rerole, Delete, Insert. Among the cheapest edit
sequences the one whose initials are least in ASCII order is taken. The comparison can be
made row by row: two strings that both end with the edit of the same row are never a proper
prefix of one another.

A conversation is one ordered stream by nature, so it stays in one task, in bounded memory.

Defined results: null roles and texts count as one space; a null conversation id is a
conversation of its own; null turns come first; rows of equal turns are ordered by role and
text; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import pickle
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationcast.llm import text as tx

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Bytes of backpointers or rows of one conversation that stay in memory.
SPILL_BYTES = 8 << 20
#: Rows and characters of one batch of output.
_OUT_ROWS, _OUT_CHARS = 4096, 4 << 20

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_WANTED = "uuau"
_NAMES = {"u": "user", "a": "assistant"}
#: Inserts that end a text in an accepting state.
_ENDING = (0, 2, 1, 0)
#: A state that costs more than this above the cheapest is dropped. What a state can do, another
#: can do for at most 7 more: an assistant inserted first where it must answer (3), and then either
#: a user inserted (3), a system row deleted (4), or, after s alone, both inserted at the end (6).
_BEHIND = 7

Vector = tuple[tuple[int, int] | None, ...]
#: Of each state: the state before, inserts before the row's edit, the edit.
Back = tuple[tuple[int, int, str] | None, ...]

OUT = (
    "conv_id bigint, place bigint, edit string, role string, text string, gaps bigint, blank bigint, duplicate bigint,"
    " truncated bigint, illegal bigint, cost bigint, audit string"
)
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def inserted(state: int) -> Iterator[tuple[int, int]]:
    """States after no, one and two inserts; more would only go round."""
    for n in range(3):
        yield n, state
        state = _NEXT[state, _WANTED[state]]


def advance(vector: Vector, initial: str, forced: bool, cut: bool) -> tuple[Vector, int, Back]:
    """One row: the states' relative costs and orders after it, the cost added to all, and where each came from."""
    best: list[tuple | None] = [None] * 4
    extra = TRUNCATED if cut else 0
    for state, known in enumerate(vector):
        if known is None:
            continue
        cost, order = known
        for n, at in inserted(state):
            edits = [("D", at, DELETE)]
            if not forced:
                edits.append(("R", _NEXT[at, _WANTED[at]], REROLE + extra))
                if (at, initial) in _NEXT:
                    edits.append(("K", _NEXT[at, initial], extra))
            for letter, to, price in edits:
                found = (cost + INSERT * n + price, order, "I" * n + letter, state)
                if best[to] is None or found < best[to]:
                    best[to] = found
    low = min(b[0] for b in best if b)
    best = [b if b and b[0] - low <= _BEHIND else None for b in best]
    ranked = sorted((b[1], b[2], to) for to, b in enumerate(best) if b)
    order = {to: k for k, (_, _, to) in enumerate(ranked)}
    after = tuple((b[0] - low, order[to]) if b else None for to, b in enumerate(best))
    return after, low, tuple((b[3], len(b[2]) - 1, b[2][-1]) if b else None for b in best)


class Transitions:
    """All transitions met so far in this worker, numbered."""

    def __init__(self) -> None:
        self.vectors: dict[Vector, int] = {}
        self.numbers: dict[tuple[int, str, bool, bool], tuple[int, int, int]] = {}
        self.by_vector: list[Vector] = []
        self.back: list[Back] = []
        self.forced: list[bool] = []
        self.start = self._number(((0, 0), None, None, None))

    def _number(self, vector: Vector) -> int:
        if vector not in self.vectors:
            self.vectors[vector] = len(self.by_vector)
            self.by_vector.append(vector)
        return self.vectors[vector]

    def step(self, at: int, initial: str, forced: bool, cut: bool) -> tuple[int, int, int]:
        """Number of the vector after the row, cost added, number of the transition."""
        key = (at, initial if initial in ("s", "u", "a") else "", forced, cut)
        found = self.numbers.get(key)
        if found is None:
            after, low, back = advance(self.by_vector[at], *key[1:])
            found = self.numbers[key] = (self._number(after), low, len(self.back))
            self.back.append(back)
            self.forced.append(forced)
        return found


class Conversation:
    """Running state of one conversation."""

    def __init__(self, key, table: Transitions) -> None:
        self.key, self.table = key, table
        self.at, self.cost, self.rows = table.start, 0, 0
        self.links = tempfile.SpooledTemporaryFile(SPILL_BYTES)
        self.said = tempfile.SpooledTemporaryFile(SPILL_BYTES)
        self.least = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def add(self, turn, role: str, text: str, blank: bool, repeat: bool, cut: bool) -> None:
        if turn is not None:
            if self.least is None:
                self.least = turn
            self.turns += turn != self.last
            self.last = turn
        fault = "blank" if blank else "duplicate" if repeat else "truncated" if cut else None
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        forced = blank or repeat
        self.at, added, number = self.table.step(self.at, initial, forced, fault == "truncated")
        self.cost += added
        self.rows += 1
        self.links.write(struct.pack("<I", number))
        if not forced:  # others are deleted for certain
            pickle.dump((role, text), self.said, protocol=5)

    def edits(self) -> tuple[int, bytearray, int]:
        """Total cost, one byte a row (inserts before it times three, plus its edit), inserts at the end."""
        vector = self.table.by_vector[self.at]
        _, _, state = min((v[0] + INSERT * _ENDING[s], v[1], s) for s, v in enumerate(vector) if v)
        total, ending = self.cost + vector[state][0] + INSERT * _ENDING[state], _ENDING[state]
        codes, end = bytearray(self.rows), self.rows
        while end:
            first = max(0, end - (SPILL_BYTES >> 4))
            self.links.seek(4 * first)
            block = struct.unpack(f"<{end - first}I", self.links.read(4 * (end - first)))
            for i in range(end - 1, first - 1, -1):
                state, n, letter = self.table.back[block[i - first]][state]
                codes[i] = 3 * n + "DKR".index(letter)
            end = first
        return total, codes, ending

    def finish(self) -> Iterator[tuple]:
        """Rows of the repaired conversation in order, then its report."""
        total, codes, ending = self.edits()
        self.said.seek(0)
        state = place = 0
        pieces = ["I" * (c // 3) + "DKR"[c % 3] for c in range(9)]
        audit = "".join([pieces[c] for c in codes]) + "I" * ending
        forced = self.forced_rows()
        for code in codes:
            for _ in range(code // 3):
                role = _NAMES[_WANTED[state]]
                state = _NEXT[state, _WANTED[state]]
                yield (self.key, place, "I", role, "", *[None] * 7)
                place += 1
            if next(forced):
                continue
            role, text = pickle.load(self.said)
            letter = "DKR"[code % 3]
            if letter == "D":
                continue
            if letter == "R":
                role = _NAMES[_WANTED[state]]
            state = _NEXT[state, role[:1]]
            yield (self.key, place, letter, role, text, *[None] * 7)
            place += 1
        for _ in range(ending):
            role = _NAMES[_WANTED[state]]
            state = _NEXT[state, _WANTED[state]]
            yield (self.key, place, "I", role, "", *[None] * 7)
            place += 1
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        yield (
            self.key, None, None, None, None, gaps, self.blank, self.duplicate, self.truncated, self.illegal, total, audit,
        )
        self.links.close()
        self.said.close()

    def forced_rows(self) -> Iterator[bool]:
        """Whether each row had to go, and so left no text."""
        self.links.seek(0)
        while block := self.links.read(4096):
            for (number,) in struct.iter_unpack("<I", block):
                yield self.table.forced[number]


def faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last character other than white space ends no sentence."""
    blank = ~text.rlike(tx.WORD)
    return blank, ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def ordered_rows(
    rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None
) -> DataFrame:
    """Rows dealt by conversation, their faults marked, in order within each partition.

    One shuffle serves both orders: the repeats of a conversation's rows are numbered in the
    partitions that hold whole conversations. ``present`` is false for rows that only name
    their conversation.
    """
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    named = rows.select(
        F.col(f"`{conv}`").cast("bigint").alias("conv_id"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.when(here, F.coalesce(F.col(f"`{role}`"), F.lit(" "))).alias("role"),
        F.when(here, F.coalesce(F.col(f"`{text}`"), F.lit(" "))).alias("text"),
    )
    blank, cut = faults(F.col("text"))
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    return (
        named.repartition("conv_id")
        .withColumn("repeat", F.row_number().over(same) > 1)
        .withColumn("blank", blank)
        .withColumn("cut", cut)
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    )


def repair(rows: DataFrame, **columns) -> DataFrame:
    """The repaired turns in order (``conv_id, place, edit, role, text``), and after those of each
    conversation one row without ``place`` that reports on it (``gaps, blank, duplicate, truncated,
    illegal, cost, audit``).

    All rows of a conversation come from one partition, in this order. ``columns`` are those of
    ``ordered_rows``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_batches(stream(batches))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        table = Transitions()
        now: Conversation | None = None
        for batch in batches:
            keys, turns = (batch[c].astype(object).where(batch[c].notna(), None) for c in ("conv_id", "turn"))
            for key, turn, role, text, blank, repeat, cut in zip(
                keys, turns, batch["role"], batch["text"], batch["blank"], batch["repeat"], batch["cut"]
            ):
                key = None if key is None else int(key)
                if now is None or now.key != key:
                    if now is not None:
                        yield from now.finish()
                    now = Conversation(key, table)
                if role is not None:
                    now.add(None if turn is None else int(turn), role, text, bool(blank), bool(repeat), bool(cut))
        if now is not None:
            yield from now.finish()

    # text: pandas would turn a long with nulls into floats
    ordered = ordered_rows(rows, **columns)
    wide = ordered.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "blank", "repeat", "cut")
    return wide.mapInPandas(run, OUT)


def in_batches(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Frames of bounded rows and characters."""
    held: list[tuple] = []
    chars = 0

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(held, columns=_COLUMNS, dtype=object)
        for name, kind in (x.split() for x in OUT.split(", ")):
            if kind == "bigint":
                out[name] = out[name].astype("Int64")
        return out

    for row in rows:
        held.append(row)
        chars += len(row[4] or "") + len(row[-1] or "")
        if len(held) >= _OUT_ROWS or chars >= _OUT_CHARS:
            yield frame()
            held, chars = [], 0
    if held:
        yield frame()


def repaired_turns(rows: DataFrame, **columns) -> DataFrame:
    """``conv_id, place, edit, role, text`` of the repaired conversations; emptied ones have no row."""
    return repair(rows, **columns).filter("place is not null").select("conv_id", "place", "edit", "role", "text")


def reports(rows: DataFrame, **columns) -> DataFrame:
    """One row per conversation: faults, ``cost`` and ``audit``."""
    return repair(rows, **columns).filter("place is null").drop("place", "edit", "role", "text")
