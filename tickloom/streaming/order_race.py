"""The order-level race between mirrored publishers, and the venue's clock that bounds what it has to remember.

Two stateful operators in a row, each by its own key: venue_clock() keeps one clock a channel from the stamps of its batches; order_race()
keeps, for each market, the events delivered lately and what rests of each order, and judges every change by the clock's stamp and
frontier that its batch got. Both state machines live here as plain classes, so tests drive them without Spark as well.

A batch: one datagram's changes of one market. A removal has size 0. Times are nanoseconds; mono_ns is a clock that never falls.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tickloom.streaming.stateful import Kept, in_order, values_of

#: A stamp so far ahead of the host's clock is no evidence.
FUTURE_SKEW_NS = 5_000_000_000


@dataclass(frozen=True)
class Guard:
    """Bounds of the clock and the race; the clock's three must not contradict each other."""

    retention_ns: int = 30_000_000_000
    max_jump_ns: int = 5_000_000_000
    reseat_after_ns: int = 10_000_000_000
    dedup_ns: int = 1_000_000_000
    seen_events: int = 1024
    live_orders: int = 512
    forgotten_a_batch: int = 4096

    def __post_init__(self):
        if self.max_jump_ns >= self.retention_ns:
            raise ValueError("one accepted jump would put the whole channel outside of the retention")
        if self.retention_ns <= FUTURE_SKEW_NS:
            raise ValueError("the retention has to exceed the skew of the host's clock")


class Clock:
    """Newest venue stamp of a channel: moves on with its batches by bounded jumps, and is seated anew where it got stuck.

    ahead: since when stamps were refused without a break. sample: the highest stamp since the last one that was made newest. All are null at first.
    """

    def __init__(self, newest: int | None = None, moved: int = 0, ahead: int | None = None, sample: int | None = None):
        self.newest, self.moved, self.ahead, self.sample = newest, moved, ahead, sample

    def seat(self, stamp: int | None, now: int) -> None:
        caught_up = stamp is None or self.sample is None or stamp >= self.sample
        if caught_up:
            self.sample = self.ahead = None
        self.newest, self.moved = stamp, now

    def observe(self, stamp: int, now: int, wall: int, guard: Guard) -> str | None:
        """Takes a batch's stamp; anchor or jump where it must not become the newest."""
        bound = "anchor" if stamp > wall + FUTURE_SKEW_NS else None
        stamp = min(stamp, wall + FUTURE_SKEW_NS)
        self.sample = stamp if self.sample is None else max(self.sample, stamp)
        if bound is None and self.newest is not None and stamp - self.newest > guard.max_jump_ns:
            bound = "jump"
        if bound:
            self.ahead = now if self.ahead is None else self.ahead
        elif self.newest is None or stamp > self.newest:
            self.seat(stamp, now)
        return bound

    def reseat(self, now: int, guard: Guard) -> bool:
        """Once nothing moved, or stamps were refused, for long enough, the highest stamp seen since counts, whichever way it lies."""
        since = [self.moved] if self.ahead is None else [self.moved, self.ahead]
        if self.sample is None or all(now - t < guard.reseat_after_ns for t in since):
            return False
        stamp, self.sample = self.sample, None
        self.seat(stamp, now)
        return True

    def held_down(self, stamp: int, wall: int) -> int:
        """The stamp that a batch is judged by: never beyond the newest one accepted."""
        return min(stamp, wall + FUTURE_SKEW_NS if self.newest is None else self.newest)


def _clock_step(guard: Guard):
    def step(clock: Clock | None, row: Row) -> tuple[Clock, tuple]:
        clock = clock or Clock()
        if row["kind"] == "session_end":
            clock.seat(None, row["mono_ns"])
            return clock, (None, None, None, None, False, False)
        if row["kind"] == "rebaseline":  # stamped with a book's age: no evidence, and never refused
            return clock, (clock.newest or 0, None, clock.newest, None, False, False)
        bound = clock.observe(row["source_ts_ns"], row["mono_ns"], row["wall_ns"], guard)
        reseated = clock.reseat(row["mono_ns"], guard)
        frontier = None if clock.newest is None else max(0, clock.newest - guard.retention_ns)
        stamp = clock.held_down(row["source_ts_ns"], row["wall_ns"])
        return clock, (stamp, frontier, clock.newest, bound, reseated, frontier is not None and stamp < frontier)

    return step


def venue_clock(batches: DataFrame, order: Sequence[str], key: Sequence[str] = ("venue", "category", "channel"), guard: Guard | None = None, idle_ms: int | None = None) -> DataFrame:
    """batches (kind, source_ts_ns, mono_ns, wall_ns) with stamp, frontier, newest, bound (anchor, jump or null), reseated and refused.

    kind: batch, rebaseline (the market's state anew: seen by no clock) or session_end (the clock is unset). A batch that a bound kept
    from moving the clock is still served, by the stamp held down. refused: the stamp lies before the frontier.
    """
    kept = Kept("newest long, moved long, ahead long, sample long", lambda c: (c.newest, c.moved, c.ahead, c.sample), lambda r: Clock(*r))
    made = "stamp long, frontier long, newest long, bound string, reseated boolean, refused boolean"
    return in_order(batches, key, order, _clock_step(guard or Guard()), kept, made, idle_ms, reads=["kind", "source_ts_ns", "mono_ns", "wall_ns"])


class Race:
    """What one market remembers: events by arrival, and of each order the size that rests (0: removed), since which stamp, claimed by whom.

    came queues the events: the front of a dict that loses its front is slow to find. live and gone queue the orders in the order in which they came, or were removed. Live ones beyond a number are let go silently; removed
    ones only when the channel's frontier has passed them, from the front of the queue.
    """

    def __init__(self):
        self.seen: dict[tuple, int] = {}
        self.came: deque[tuple] = deque()
        self.rests: dict[int, tuple[int, float, int | None]] = {}
        self.live: deque[int] = deque()
        self.gone: deque[int] = deque()
        self.n_live = 0

    def forget(self, frontier: int | None, guard: Guard) -> None:
        for _ in range(guard.forgotten_a_batch if frontier is not None else 0):
            if not self.gone:
                return
            slot = self.rests.get(self.gone[0])
            if slot is not None and slot[1] == 0:
                if slot[0] >= frontier:
                    return
                del self.rests[self.gone[0]]
            self.gone.popleft()

    def _rest(self, order: int, size: float, stamp: int, owner: int | None, guard: Guard) -> None:
        slot = self.rests.get(order)
        self.rests[order] = (stamp, size, owner)
        if slot is None or slot[1] == 0:
            self.n_live += 1
            self.live.append(order)
        self._let_go(guard)

    def _let_go(self, guard: Guard) -> None:
        while self.n_live > guard.live_orders and self.live:
            first = self.live.popleft()
            if self.rests.get(first, (0, 0, None))[1] != 0:
                del self.rests[first]
                self.n_live -= 1

    def _remove(self, order: int, stamp: int) -> None:
        slot = self.rests.get(order)
        if slot is not None and slot[1] == 0:
            return
        self.n_live -= slot is not None
        self.rests[order] = (stamp, 0.0, None)
        self.gone.append(order)

    def judge(self, order: int, action: str, price: float, size: float, publisher: int, arrival: int, stamp: int, guard: Guard) -> str:
        """deliver, duplicate, resurrection, stale, or disagreement: the market has to be re-baselined."""
        return self.judged([(order, action, price, size)], publisher, arrival, stamp, guard)[0]

    def judged(self, events: Sequence[tuple], publisher: int, arrival: int, stamp: int, guard: Guard) -> list[str]:
        """judge() of a batch's events (order, action, price, size), one after the other; what has no order is delivered."""
        seen, came, rests, out = self.seen, self.came, self.rests, []
        while came and arrival - seen[came[0]] > guard.dedup_ns:
            del seen[came.popleft()]
        for event in events:
            order, _, _, size = event
            if not order:
                out.append("deliver")
                continue
            if event in seen:
                out.append("duplicate")
                continue
            slot = rests.get(order)
            if slot is None and size != 0:
                rests[order] = (stamp, size, publisher)
                self.n_live += 1
                self.live.append(order)
                self._let_go(guard)
            elif slot is None:
                self._remove(order, stamp)
            elif slot[1] == 0:
                if size != 0:
                    out.append("resurrection")
                    continue
            elif size == 0:
                self._remove(order, stamp)
            elif stamp < slot[0]:
                out.append("stale")
                continue
            elif size > slot[1] and slot[2] != publisher:
                out.append("disagreement")
                continue
            else:
                rests[order] = (stamp, size, publisher) if size < slot[1] else (stamp, slot[1], slot[2])
            seen[event] = arrival
            came.append(event)
            if len(came) > guard.seen_events:
                del seen[came.popleft()]
            out.append("deliver")
        return out

    def rebaselined(self, orders: list[tuple[int, float]], stamp: int, guard: Guard) -> None:
        """The market's state anew: events are forgotten, removed orders aren't; its orders rest by nobody's claim."""
        self.seen.clear()
        self.came.clear()
        for order, size in orders:
            if order and size:
                self._rest(order, size, stamp, None, guard)

    def pack(self) -> tuple:
        return [(*e, at) for e, at in self.seen.items()], [(o, *s) for o, s in self.rests.items()], list(self.live), list(self.gone), self.n_live

    @classmethod
    def unpack(cls, r: Row) -> Race:
        race = cls()
        race.seen = {tuple(x[:4]): x[4] for x in r["seen"]}
        race.came = deque(race.seen)
        race.rests = {x[0]: tuple(x[1:]) for x in r["rests"]}
        race.live, race.gone, race.n_live = deque(r["live"]), deque(r["gone"]), r["n_live"]
        return race


def _events(changes: Sequence[Row]) -> list[tuple]:
    return [(c["order_id"], c["action"], c["price"], c["size"]) for c in changes]


def _listed(changes: pa.Array) -> list[list[tuple] | None]:
    """_events() of a whole column."""
    flat = changes.flatten()
    fields = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
    events = list(zip(*(values_of(fields[f]) for f in ("order_id", "action", "price", "size")), strict=True))
    out, at = [], 0
    for n in pc.list_value_length(changes).to_pylist():
        out.append(None if n is None else events[at : at + n])
        at += n or 0
    return out


def _race_step(guard: Guard, events_of: Callable[[Sequence], Sequence[tuple]] = _events):
    def step(race: Race | None, row: Row) -> tuple[Race, tuple]:
        if row["kind"] == "session_end":  # ids start anew
            return Race(), ([], False)
        race, events = race or Race(), events_of(row["changes"])
        if row["refused"]:
            race.forget(row["frontier"], guard)
            return race, (["past_frontier"] * len(events), False)
        if row["kind"] == "rebaseline":
            race.rebaselined([(e[0], e[3]) for e in events], row["stamp"], guard)
            return race, (["rebaseline"] * len(events), False)
        race.forget(row["frontier"], guard)
        verdicts = race.judged(events, row["publisher"], row["recv_ts_ns"], row["stamp"], guard)
        if "disagreement" not in verdicts:
            return race, (verdicts, False)
        # what two paths disagree about is a torn event: it only goes out if it removes an order, which nothing else would
        if not any(v == "deliver" and e[0] and e[3] == 0 for v, e in zip(verdicts, events, strict=True)):
            verdicts = ["withheld" if v == "deliver" else v for v in verdicts]
        return race, (verdicts, True)

    return step


def order_race(batches: DataFrame, order: Sequence[str], key: Sequence[str] = ("venue", "category", "channel", "instrument_id"), guard: Guard | None = None, idle_ms: int | None = None, first: DataFrame | None = None) -> DataFrame:
    """Batches of venue_clock() with verdicts, one for each of `changes` (order_id, action, price, size), and forced: re-baseline the market.

    Verdicts: deliver (the first copy of an event), duplicate, resurrection (of an order removed before), stale (older than
    the order's last change), disagreement (another path claims that more rests), withheld (torn by a disagreement), past_frontier, rebaseline. Changes
    without an order are delivered with their batch. A refused batch makes no state; a session_end (one a market) ends it. first: races to begin with, see race_states().
    """
    schema = "seen array<struct<order_id:long,action:string,price:double,size:double,at_ns:long>>, rests array<struct<order_id:long,stamp:long,size:double,owner:long>>, live array<long>, gone array<long>, n_live long"
    kept = Kept(schema, Race.pack, Race.unpack)
    step = _race_step(guard or Guard()) if batches.isStreaming else _race_step(guard or Guard(), lambda events: events)
    reads = ["kind", "refused", "frontier", "stamp", "publisher", "recv_ts_ns", "changes"]
    return in_order(batches, key, order, step, kept, "verdicts array<string>, forced boolean", idle_ms, first, reads, {"changes": _listed})


def race_states(orders: DataFrame, key: Sequence[str] = ("venue", "category", "channel", "instrument_id")) -> DataFrame:
    """States for order_race(first=...): a book made elsewhere (order_id, size, stamp, and size 0 for orders known as removed), one row a market.

    The stream then goes on from that book: what it removed stays removed, and nobody claims what rests in it. A market's states are one
    row, so the book handed over has to be one that a market's state may hold (Guard.live_orders and what the retention keeps removed).
    """
    slot = F.struct("order_id", F.col("stamp").cast("long").alias("stamp"), F.col("size").cast("double").alias("size"), F.lit(None).cast("long").alias("owner"))
    place = F.struct("stamp", "order_id")
    ids = lambda held: F.transform(F.array_sort(F.filter(F.collect_list(F.struct(place.alias("p"), held.alias("h"))), lambda x: x["h"])), lambda x: x["p"]["order_id"])
    seen = F.array().cast("array<struct<order_id:long,action:string,price:double,size:double,at_ns:long>>")
    return orders.groupBy(*key).agg(seen.alias("seen"), F.collect_list(slot).alias("rests"), ids(F.col("size") > 0).alias("live"), ids(F.col("size") == 0).alias("gone"), F.count_if(F.col("size") > 0).alias("n_live"))
