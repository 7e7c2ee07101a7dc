"""Recovery of books after losses, message by message: which snapshot groups install, which deltas apply, wait, repeat or tear a gap.

Messages of a book, in order: delta (seq, mktdata_seq), begin (snapshot_id, anchor_seq, total, last_seq), part (snapshot_id, side, price or
order_id: one level or order of the group), end (snapshot_id, anchor_seq), reset (anchor_seq) and session_end. The state machine sees numbers
only; what applied is folded by the operators of books.py, so no task holds a book. A session's end leaves nothing behind: recovered()
cuts each book's stream there, and each session is a key of its own.

Level books (L2) judge a snapshot by the last delta it holds, order books (L3) by its anchor on the channel: that is how their feeds promise
it. Both wait for as many parts as the begin promised; L2 counts distinct prices, L3 messages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tickloom.operators.books import epochs
from tickloom.streaming.stateful import Kept, in_order

#: Deltas that wait for a snapshot, and parts that a group may promise; beyond, the feed is malformed.
WAITING, PARTS = 65_536, 1 << 20


class Recovery:
    """Where a book stands: status, the last delta applied and its place on the channel, the group being assembled, and deltas that wait.

    status: awaiting (a snapshot), building, ready or gap; order books know only recovering and synced.
    """

    IDLE, READY, TORN = "awaiting", "ready", "gap"

    def __init__(self):
        self.status, self.applied, self.place, self.needed = self.IDLE, 0, 0, None
        self.group: tuple[int, int, int, int] | None = None
        self.parts: set[str] = set()
        self.received = 0
        self.waiting: list[tuple[int, int]] = []

    def _wait(self, seq: int, place: int) -> None:
        if len(self.waiting) < WAITING:
            self.waiting.append((place, seq))

    def delta(self, seq: int, place: int) -> str:
        if self.status != self.READY:
            self._wait(seq, place)
            return "buffered"
        if seq <= self.applied:
            return "duplicate"
        if seq != self.applied + 1:
            self.status, self.waiting = self.TORN, [(place, seq)]
            return "gap"
        self.applied, self.place = seq, place
        return "applied"

    def stale(self, anchor: int, last: int) -> bool:
        """A ready book has seen what this snapshot holds."""
        return self.status == self.READY and last <= self.applied

    def begin(self, group: tuple[int, int, int, int]) -> str:
        _, anchor, total, last = group
        if (self.needed is not None and anchor < self.needed) or self.stale(anchor, last) or total > PARTS:
            return "declined"
        if self.group == group:
            return "repeated"
        self.group, self.parts, self.received, self.status = group, set(), 0, "building"
        return "opened"

    def part(self, snapshot: int, what: str) -> str:
        if self.group is None:
            return "declined"
        if self.group[0] != snapshot:
            return "orphan"
        if what in self.parts:
            return "repeated"
        self.parts.add(what)
        self.received += 1
        return "taken"

    def end(self, snapshot: int, anchor: int) -> str:
        group, self.group = self.group, None
        received, self.received, self.parts = self.received, 0, set()
        if group is None:
            return "declined"
        if group[:2] != (snapshot, anchor) or received != group[2]:
            self.status = self.IDLE
            return "incomplete"
        self.status, self.applied, self.place, self.needed = self.READY, group[3], anchor, None
        self._replay(anchor)
        return "installed"

    def _replay(self, anchor: int) -> None:
        """What waited and lies past the snapshot applies, up to the first gap; the rest waits on."""
        rest = sorted(w for w in self.waiting if w[0] > anchor)
        self.waiting = []
        for i, (place, seq) in enumerate(rest):
            if seq > self.applied + 1:
                self.status, self.waiting = self.TORN, rest[i:]
                return
            if seq == self.applied + 1:
                self.applied, self.place = seq, place

    def reset(self, anchor: int) -> str:
        self.group, self.parts, self.received = None, set(), 0
        self.waiting = [w for w in self.waiting if w[0] > anchor]
        self.status, self.applied, self.needed = self.IDLE, 0, anchor
        return "reset"

    def take(self, row: Row) -> str:
        kind = row["kind"]
        if kind == "delta":
            return self.delta(row["seq"], row["mktdata_seq"])
        if kind == "begin":
            return self.begin((row["snapshot_id"], row["anchor_seq"], row["total"], row["last_seq"]))
        if kind == "part":
            return self.part(row["snapshot_id"], row["part"])
        if kind == "end":
            return self.end(row["snapshot_id"], row["anchor_seq"])
        if kind == "reset":
            return self.reset(row["anchor_seq"])
        self.__init__()
        return "ended"

    def pack(self) -> tuple:
        return self.status, self.applied, self.place, self.needed, self.group, sorted(self.parts), self.received, self.waiting

    @classmethod
    def unpack(cls, r: Row) -> Recovery:
        one = cls()
        one.status, one.applied, one.place, one.needed, one.received = r["status"], r["applied"], r["place"], r["needed"], r["received"]
        one.group, one.parts, one.waiting = r["group"] and tuple(r["group"]), set(r["parts"]), [tuple(w) for w in r["waiting"]]
        return one


class OrderRecovery(Recovery):
    """A book of orders: snapshots are judged by their anchor, a group counts messages, and nothing but being synced is told apart."""

    IDLE, READY, TORN = "recovering", "synced", "recovering"

    def stale(self, anchor: int, last: int) -> bool:
        return self.status == self.READY and anchor <= self.place

    def begin(self, group: tuple[int, int, int, int]) -> str:
        if self.stale(group[1], group[3]) or group[2] > PARTS:
            self.group = None
            return "declined"
        self.group, self.received = group, 0
        return "opened"

    def part(self, snapshot: int, what: str) -> str:
        if self.group is None:
            return "declined"
        if self.group[0] != snapshot:
            return "orphan"
        self.received += 1
        return "taken"

    def _replay(self, anchor: int) -> None:
        """As above, but what comes behind a gap is given up, as the feed's rule is to wait for another snapshot; the torn delta waits."""
        super()._replay(anchor)
        self.waiting = self.waiting[:1]

    def reset(self, anchor: int) -> str:
        super().reset(anchor)
        self.needed = None
        return "reset"


_STATE = "status string, applied long, place long, needed long, group struct<id:long,anchor:long,total:long,last:long>, parts array<string>, received long, waiting array<struct<place:long,seq:long>>"


def recovery(messages: DataFrame, key: Sequence[str], order: Sequence[str], machine: type[Recovery] = Recovery, idle_ms: int | None = None) -> DataFrame:
    """messages with outcome, the status before (`was`) and after each, and applied: the book's last delta then.

    Outcomes: applied, buffered, duplicate, gap; opened, declined, repeated; taken, orphan; installed, incomplete; reset, ended. What waited
    and applied with an install is what lies between the group's last_seq and the install's `applied`.
    """

    def step(state: Recovery | None, row: Row) -> tuple[Recovery, tuple]:
        state = state or machine()
        was = state.status
        outcome = state.take(row)
        return state, (outcome, was, state.status, state.applied)

    return in_order(messages, key, order, step, Kept(_STATE, machine.pack, machine.unpack), "outcome string, was string, status string, applied long", idle_ms)


def recovered_sessions(messages: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column, machine: type[Recovery] = Recovery) -> DataFrame:
    """As recovery() for a whole table: every session of a book is judged by itself, as its end leaves nothing behind.

    A row of session_end belongs to the session that it ends. Sessions are numbered by a running sum, in two levels.
    """
    ended = F.col("kind") == "session_end"
    cut = epochs(messages, key, order, bucket, ended).withColumn("session", F.col("epoch") - ended.cast("long")).drop("epoch")
    return recovery(cut, [*key, "session"], order, machine)
