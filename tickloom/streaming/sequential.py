"""Sequential rules of single streams: re-announced definitions, trade windows, tapes, and authority over a scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row

from tickloom.streaming.stateful import Kept, Step, in_order

REANNOUNCE_NS, HANDOVER_NS, SILENCE_NS = 15_000_000_000, 5_000_000_000, 2_000_000_000
TRADE_IDS, PATHS = 8192, 8


def sequential(rows: DataFrame, key: Sequence[str], order: Sequence[str], rule: tuple[Step, Kept], idle_ms: int | None = None) -> DataFrame:
    """rows with a column verdict, by one of the rules below over the rows of a key in order."""
    step, kept = rule
    return in_order(rows, key, order, lambda state, row: _one(step(state, row)), kept, "verdict string", idle_ms)


def _one(found: tuple[object, str]) -> tuple[object, tuple[str]]:
    return found[0], (found[1],)


def _reannounce(state: tuple | None, row: Row) -> tuple[tuple, str]:
    content = (row["price_exponent"], row["qty_exponent"])
    if state and tuple(state[:2]) == content and max(0, row["at_ns"] - state[2]) < REANNOUNCE_NS:
        return state, "drop"
    return (*content, row["at_ns"]), "emit"


#: Definitions of an instrument (price_exponent, qty_exponent, at_ns): new content goes out at once, the same again only after 15 s.
reannounce = (_reannounce, Kept("price_exponent long, qty_exponent long, sent long"))


def trade_ids(capacity: int = TRADE_IDS) -> tuple[Step, Kept]:
    """Trades by id (publisher, trade_id): emit, contest or drop, remembering the last `capacity` emitted ids of a key exactly; id 0 bypasses."""

    def step(winners: dict | None, row: Row) -> tuple[dict, str]:
        winners = {} if winners is None else winners
        trade, publisher = row["trade_id"], row["publisher"]
        if not trade:
            return winners, "bypass"
        if trade in winners:
            return winners, "drop" if winners[trade] == publisher else "contest"
        winners[trade] = publisher
        if len(winners) > capacity:
            del winners[next(iter(winners))]  # the id emitted first
        return winners, "emit"

    return step, Kept("ids array<long>, winners array<long>", lambda w: (list(w), list(w.values())), lambda r: dict(zip(r["ids"], r["winners"], strict=True)))


def _unnumbered_tape(state: tuple | None, row: Row) -> tuple[tuple, str]:
    if state and state[0] != row["publisher"] and row["at_ns"] - state[1] <= HANDOVER_NS:
        return state, "conflict"
    return (row["publisher"], row["at_ns"]), "emit"


#: Trades without ids (publisher, at_ns): all go out; `conflict` marks those of a second publisher while the tape's owner isn't silent for 5 s.
unnumbered_tape = (_unnumbered_tape, Kept("owner long, last long"))


class _Scope:
    """Leader of a scope, when each path was heard last in the order in which they came, and the paths that are ill for a market."""

    def __init__(self, leader: int, heard: dict[int, int], ill: dict[str, set[int]]):
        self.leader, self.heard, self.ill = leader, heard, ill


def _sticky_authority(s: _Scope | None, row: Row) -> tuple[_Scope, str]:
    path, now = row["publisher"], row["at_ns"]
    s = s or _Scope(path, {}, {})
    if path not in s.heard and len(s.heard) >= PATHS:
        return s, "drop"
    s.heard[path] = now
    if s.leader != path and now - s.heard.get(s.leader, 0) > SILENCE_NS:
        s.leader = path
    ill = s.ill.setdefault(row["market"], set())
    (ill.discard if row["healthy"] else ill.add)(path)
    if not ill:
        del s.ill[row["market"]]
    serves = s.leader
    if serves in ill:
        places = list(s.heard)
        serves = max((p for p in places if p not in ill), key=lambda p: (s.heard[p], places.index(p)), default=serves)
    return s, "emit" if serves == path else "drop"


#: Batches of a scope's markets (market, publisher, at_ns, and healthy: of this path for this market): emit or drop.
#: The first path leads. Another takes over once the leader was silent in the whole scope for 2 s. Where the leader is unhealthy for a
#: market, the healthy path heard of last serves it (of two, the one that came later to the scope). Paths beyond the eighth never do.
sticky_authority = (
    _sticky_authority,
    Kept(
        "leader long, heard array<struct<path:long,at_ns:long>>, ill array<struct<market:string,paths:array<long>>>",
        lambda s: (s.leader, list(s.heard.items()), [(m, sorted(p)) for m, p in s.ill.items()]),
        lambda r: _Scope(r["leader"], {path: at for path, at in r["heard"]}, {market: set(paths) for market, paths in r["ill"]}),
    ),
)


def _tape_gate(state: tuple | None, row: Row) -> tuple[tuple, str]:
    path = row["publisher"]
    if state is None:
        return (path, row["at_ns"], None), "emit"
    mine, last, honoured = state
    if path != mine:
        tracked = list(row["tracked"] or [])
        better = path in tracked and mine not in tracked
        elected = row["elected"] == path and honoured != path
        if not (better or elected or row["at_ns"] - last > HANDOVER_NS):
            return state, "drop"
        honoured = row["elected"]
    return (path, row["at_ns"], honoured), "emit"


#: Prints of a universe (publisher, at_ns, elected: the path elected now or None, tracked: the paths that deliver books): emit or drop.
#: One path prints. Another takes over if it is tracked and the present one isn't, if it is elected and that election wasn't honoured yet, or
#: after 5 s of silence.
tape_gate = (_tape_gate, Kept("path long, last long, honoured long"))
