"""The venue's clock and the order-level race: scenarios, and the operators against one pass of plain Python, whatever the cuts into batches."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.plans import raced
from tickloom.streaming.order_race import FUTURE_SKEW_NS, Clock, Guard, Race, _listed, order_race, race_states, venue_clock

S = 1_000_000_000
KEY = ["venue", "category", "channel", "instrument_id"]
BATCHES = "venue string, category string, channel int, instrument_id long, seq long, publisher long, kind string, source_ts_ns long, mono_ns long, wall_ns long, recv_ts_ns long, changes array<struct<order_id:long,action:string,price:double,size:double>>"


def test_guard_refuses_bounds_that_contradict():
    for bounds in ({"max_jump_ns": 30 * S}, {"retention_ns": FUTURE_SKEW_NS}):
        with pytest.raises(ValueError):
            Guard(**bounds)


def test_clock_seats_on_the_host_clock_where_that_is_behind():
    guard, clock, wall = Guard(reseat_after_ns=20_000_000), Clock(), 10**15
    for i in range(40):
        assert clock.observe(wall + 3600 * S + i * S, i * 1_000_000, wall, guard) == "anchor"
        if clock.reseat((i + 1) * 1_000_000, guard):
            assert clock.newest == wall + FUTURE_SKEW_NS and i == 19
            return
    pytest.fail("never seated")


def test_clock_gets_past_a_crawling_path():
    guard, clock, wall = Guard(reseat_after_ns=20_000_000), Clock(), 10**15
    clock.observe(1000, 0, wall, guard)
    for i in range(1, 41):
        now = i * 1_000_000
        assert clock.observe(1000 + i, now, wall, guard) is None and clock.moved == now  # never still
        assert clock.observe(60 * S + i, now, wall, guard) == "jump"
        if clock.reseat(now, guard):
            assert clock.newest == 60 * S + i and i == 21 and clock.ahead is None
            return
    pytest.fail("never seated")


def test_clock_of_a_session_that_restarts_lower():
    guard, clock, wall = Guard(), Clock(), 10**15
    clock.observe(100 * S, 0, wall, guard)
    assert clock.observe(1 * S, 1, wall, guard) is None and clock.newest == 100 * S
    assert clock.reseat(10 * S, guard) and clock.newest == 1 * S
    assert not clock.reseat(30 * S, guard)  # without a sample nothing is seated
    clock.seat(None, 31 * S)
    assert clock.observe(7, 31 * S, wall, guard) is None and clock.newest == 7 and clock.held_down(9, wall) == 7
    assert Clock().held_down(wall + 99 * S, wall) == wall + FUTURE_SKEW_NS


def race(*events, guard=None):
    one = Race()
    return one, [one.judge(o, a, 100.0, float(size), publisher, at, stamp, guard or Guard(dedup_ns=1000)) for o, a, size, publisher, at, stamp in events]


def test_race_verdicts():
    up, gone = "update", "delete"
    assert race((7, up, 6, 1, 1000, 1), (7, gone, 0, 1, 1100, 2), (7, up, 6, 2, 9_000_000, 3))[1] == ["deliver", "deliver", "resurrection"]
    assert race((7, up, 6, 1, 1000, 1), (7, gone, 0, 1, 1100, 2), (7, gone, 0, 2, 9_000_000, 3))[1] == ["deliver"] * 3
    assert race((7, up, 6, 1, 1000, 1), (7, up, 6, 2, 1500, 1), (7, up, 6, 2, 9000, 1))[1] == ["deliver", "duplicate", "deliver"]
    assert race((7, up, 6, 1, 0, 1), (7, up, 8, 2, 1, 1), (7, up, 8, 1, 2, 1))[1] == ["deliver", "disagreement", "deliver"]
    assert race((7, up, 6, 1, 0, 5), (7, up, 8, 2, 1, 4), (7, gone, 0, 2, 2, 3))[1] == ["deliver", "stale", "deliver"]  # a removal is never stale


def test_removed_orders_are_forgotten_by_the_frontier_from_the_front():
    one, _ = race((7, "delete", 0, 1, 0, 1000), (8, "delete", 0, 1, 0, 500), (7, "delete", 0, 2, 9000, 9_000_000))
    one.forget(1000, Guard())
    assert set(one.rests) == {7, 8} and one.rests[7][0] == 1000  # a repeat doesn't make it younger; 8 waits behind it
    one.forget(1001, Guard())
    assert not one.rests and not one.gone
    one.rebaselined([(0, 0.0), (9, 5.0)], 44, Guard())
    assert one.rests == {9: (44, 5.0, None)} and one.judge(9, "update", 1.0, 6.0, 1, 0, 50, Guard()) == "disagreement"


def test_live_orders_are_bounded_and_let_go_silently():
    guard = Guard(live_orders=3)
    one, verdicts = race(*[(i, "update", 6, 1, i, i) for i in range(1, 6)], (1, "update", 9, 2, 9000, 9), guard=guard)
    assert verdicts[-1] == "deliver" and one.n_live == 3 and set(one.rests) == {4, 5, 1}


def batches(n, seed):
    some, out = random.Random(seed), []
    for i in range(n):
        kind = some.choices(["batch", "rebaseline", "session_end"], [60, 2, 1])[0]
        late = some.choice([0, 0, 0, 1, 40, -8]) * S
        changes = [(some.choice([0, *range(1, 30)]), some.choice(["update", "delete"]), 100.0, float(some.choice([0, 0, 3, 5, 8]))) for _ in range(some.randint(0, 5))]
        out.append(("V", "perp", some.randint(0, 1), some.randint(0, 2), i, some.randint(0, 2), kind, None if kind == "session_end" else i * S // 4 + 10**18 - late, i * S // 4, i * S // 4 + 10**18, i * 50_000_000, None if kind == "session_end" else changes))
    return out


def model(rows, guard):
    """One pass in order over all rows."""
    clocks, races, out = {}, {}, []
    for r in rows:
        channel, market, (seq, publisher, kind, ts, mono, wall, recv, changes) = r[:3], r[:4], r[4:]
        clock = clocks.setdefault(channel, Clock())
        if kind == "session_end":
            clock.seat(None, mono)
            races.pop(market, None)
            out.append((seq, None, None, [], False))
            continue
        one = races.setdefault(market, Race())
        if kind == "rebaseline":
            one.rebaselined([(c[0], c[3]) for c in changes], clock.newest or 0, guard)
            out.append((seq, None, clock.newest or 0, ["rebaseline"] * len(changes), False))
            continue
        clock.observe(ts, mono, wall, guard)
        clock.reseat(mono, guard)
        stamp, frontier = clock.held_down(ts, wall), max(0, clock.newest - guard.retention_ns) if clock.newest is not None else None
        one.forget(frontier, guard)
        if frontier is not None and stamp < frontier:
            out.append((seq, frontier, stamp, ["past_frontier"] * len(changes), False))
            continue
        verdicts = [one.judge(*c, publisher, recv, stamp, guard) if c[0] else "deliver" for c in changes]
        forced = "disagreement" in verdicts
        if forced and not any(v == "deliver" and c[0] and c[3] == 0 for v, c in zip(verdicts, changes)):
            verdicts = ["withheld" if v == "deliver" else v for v in verdicts]
        out.append((seq, frontier, stamp, verdicts, forced))
    return sorted(out, key=lambda r: r[0])


GUARD = Guard(dedup_ns=S, seen_events=20, live_orders=8)


@pytest.mark.parametrize(("seed", "cuts"), [(1, [1, 150, 400]), (2, [200, 201, 400])])
def test_operators_equal_one_pass_over_any_cuts(spark, tmp_path, seed, cuts):
    rows = batches(400, seed)
    source, at = str(tmp_path / "in"), 0
    for end in cuts:
        spark.createDataFrame(rows[at:end], BATCHES).coalesce(1).write.mode("append").parquet(source)
        at = end
    stream = spark.readStream.schema(BATCHES).option("maxFilesPerTrigger", 1).parquet(source)
    raced = order_race(venue_clock(stream, ["seq"], guard=GUARD), ["seq"], guard=GUARD)
    for turn in range(2 if seed == 1 else 1):  # the second start has nothing left to do: the checkpoint holds all
        q = raced.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(600)
    got = [(r.seq, r.frontier, r.stamp, r.verdicts, r.forced) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert got == model(rows, GUARD)


def test_a_table_is_raced_like_a_stream(spark):
    rows = batches(300, 5)
    table = spark.createDataFrame(rows, BATCHES).repartition(3)
    got = [(r.seq, r.frontier, r.stamp, r.verdicts, r.forced) for r in order_race(venue_clock(table, ["seq"], guard=GUARD), ["seq"], guard=GUARD).orderBy("seq").collect()]
    assert got == model(rows, GUARD)
    assert order_race(venue_clock(table.limit(0), ["seq"]), ["seq"]).collect() == []


def test_a_stream_goes_on_from_a_book(spark, tmp_path):
    """Any cut of a stream into a book and the rest gives the verdicts of the rest."""
    rows = [("V", "perp", 0, i % 2, i, 1, "batch", 10**18 + i, i, 10**18 + i, i, [(i % 7, "update" if i % 3 else "delete", 1.0, float(20 - i) if i % 3 else 0.0)]) for i in range(1, 20)]
    whole = {r[0]: r[3] for r in model(rows, Guard(dedup_ns=0))}
    for cut in (5, 11):
        races = {}
        for r in rows[:cut]:
            one = races.setdefault(r[:4], Race())
            for c in r[11]:
                one.judge(*c, r[5], r[10], r[7], Guard(dedup_ns=0)) if c[0] else None
        orders = [(*k, o, float(size), stamp) for k, one in races.items() for o, (stamp, size, _) in one.rests.items()]
        first = race_states(spark.createDataFrame(orders, "venue string, category string, channel int, instrument_id long, order_id long, size double, stamp long"))
        source = str(tmp_path / f"in{cut}")
        spark.createDataFrame(rows[cut:], BATCHES).coalesce(1).write.parquet(source)
        stream = spark.readStream.schema(BATCHES).parquet(source).withColumns({"refused": F.lit(False), "frontier": F.lit(None).cast("long"), "stamp": F.col("source_ts_ns")})
        q = order_race(stream, ["seq"], guard=Guard(dedup_ns=0), first=first).writeStream.format("parquet").option("path", str(tmp_path / f"out{cut}")).option("checkpointLocation", str(tmp_path / f"c{cut}")).trigger(availableNow=True).start()
        q.awaitTermination(600)
        got = {r.seq: r.verdicts for r in spark.read.parquet(str(tmp_path / f"out{cut}")).collect()}
        assert got == {seq: v for seq, v in whole.items() if seq > cut}


def test_the_query_equals_one_pass_and_its_clock_sees_no_changes(spark):
    sf = "/root/testdata/sf0.001"
    datagrams = raced._datagrams(spark, sf)
    changes = {(r.instrument_id, r.datagram): r.changes for r in datagrams.collect()}
    rows = sorted(raced._batches(datagrams).collect(), key=lambda r: (r.recv_ts_ns, r.publisher, r.datagram))
    given = [(r.venue, r.category, r.channel, r.instrument_id, (r.instrument_id, r.publisher, r.datagram), r.publisher, r.kind, r.source_ts_ns, r.mono_ns, r.wall_ns, r.recv_ts_ns, [(c.order_id, c.action, c.price, c["size"]) for c in changes[r.instrument_id, r.datagram]]) for r in rows]
    want = sorted((*seq, c.order_id, c.seq_no, v, forced) for seq, _, _, verdicts, forced in model(given, Guard()) for c, v in zip(changes[seq[0], seq[2]], verdicts, strict=True))
    query = raced.order_race_verdicts(spark, sf)
    got = sorted(tuple(r) for r in query.collect())
    assert got == want and len({r[5] for r in got}) > 1
    steps = [line for line in query._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line]
    assert len(steps) == 2 and sum("changes#" in line for line in steps) == 1, steps


def test_changes_of_a_column():
    """Cut columns, lists that are null or empty, null values."""
    kind = pa.list_(pa.struct([("seq_no", pa.int64()), ("order_id", pa.int64()), ("action", pa.string()), ("price", pa.float64()), ("size", pa.float64())]))
    rows = [[(0, 1, "new", 1.0, 2.0)], None, [], [(1, None, None, None, 0.0), (2, 3, "update", 5.0, None)], [(3, 4, "new", 1.0, 1.0)]]
    column = pa.array([None if r is None else [dict(zip(("seq_no", "order_id", "action", "price", "size"), c, strict=True)) for c in r] for r in rows], kind)
    for lo, hi in ((0, 5), (1, 4), (3, 5), (1, 3), (2, 2)):
        assert _listed(column.slice(lo, hi - lo)) == [None if r is None else [c[1:] for c in r] for r in rows[lo:hi]]
