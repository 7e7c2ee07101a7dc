"""Operators against sequential models, and on nulls, ties and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import arbitration as a
from tickloom.operators import books as b
from tickloom.operators import candles as c
from tickloom.operators import dimensions as d
from tickloom.operators import serving as s
from tickloom.operators.ordered import running

COPY = "symbol string, publisher long, event_id long, recv_us long, tick long, price double"


def stream(seed, n=300):
    r = random.Random(seed)
    return [(r.choice("ab"), r.randrange(3), i, r.randrange(50) * 1_000_000_000, r.randrange(12), float(r.randrange(3))) for i in range(n)]


def floor_model(rows):
    """The verdicts that one sequential pass in order gives."""
    state, out = {}, {}
    for symbol, publisher, event, recv, tick, price in sorted(rows, key=lambda x: (x[3], x[1], x[2])):
        floor = state.get(symbol)
        if floor and tick < floor["tick"]:
            verdict = "stale"
        elif not floor or tick > floor["tick"]:
            state[symbol] = {"tick": tick, "leader": publisher, "seen": {price}, "contested": False, "at": recv}
            verdict = "open"
        elif publisher != floor["leader"]:
            verdict = "drop" if floor["contested"] else "contest"
            floor["contested"] = True
        else:
            verdict = "drop" if price in floor["seen"] else "emit"
            floor["seen"].add(price)
        out[event] = verdict
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_floor_verdicts(spark, seed):
    rows = stream(seed)
    got = {r.event_id: r.verdict for r in a.floor_verdicts(spark.createDataFrame(rows, COPY)).collect()}
    assert got == floor_model(rows)


def test_floor_verdicts_on_odd_rows(spark):
    df = spark.createDataFrame([("a", 0, 1, 5, None, 1.0), (None, 0, 2, 5, 1, None), (None, 1, 3, 6, 1, None)], COPY)
    assert {r.event_id: r.verdict for r in a.floor_verdicts(df).collect()} == {1: "stale", 2: "open", 3: "contest"}
    assert a.floor_verdicts(df.limit(0)).collect() == [] and a.win_share(a.floor_verdicts(df.limit(0))).collect() == []


def test_trade_verdicts(spark):
    rows = [("a", 0, 7, 1, 0, 1.0), ("a", 1, 7, 2, 0, 1.0), ("a", 0, 7, 3, 0, 1.0), ("b", 1, 7, 3, 0, 1.0), ("a", 1, 0, 1, 0, 1.0), ("a", 1, 0, 1, 0, 1.0)]
    got = sorted((r.symbol, r.recv_us, r.event_id, r.verdict) for r in a.trade_verdicts(spark.createDataFrame(rows, COPY), ["recv_us"]).collect())
    assert got == [("a", 1, 0, "bypass"), ("a", 1, 0, "bypass"), ("a", 1, 7, "emit"), ("a", 2, 7, "contest"), ("a", 3, 7, "drop"), ("b", 3, 7, "emit")]


def sequence_model(rows):
    last, out = {}, {}
    for i, channel, reset, seq in rows:
        if channel not in last:
            out[i], last[channel] = "first", (reset, seq)
        elif last[channel][0] != reset:
            out[i], last[channel] = "reset", (reset, seq)
        elif seq < last[channel][1]:
            out[i] = "stale"
        else:
            out[i], last[channel] = "ok", (reset, seq)
    return out


def test_sequence_check(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(2), i // 60 % 3 if r.random() < 0.97 else 9, r.randrange(40)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, channel long, reset_count long, sequence long")
    got = {x.i: x.check for x in a.sequence_check(df, ["i"], ["channel"], F.floor(F.col("i") / 17)).collect()}
    assert got == sequence_model(rows)
    assert a.sequence_check(df.limit(0), ["i"], ["channel"], F.floor(F.col("i") / 17)).collect() == []


def test_election_needs_samples_rate_and_median(spark):
    leads = [(1, -500)] * 32 + [(2, -900)] * 31 + [(3, -500)] * 16 + [(3, 500)] * 16
    got = {r.challenger: (r.samples, r.wins, r.median_us, r.won) for r in a.elect(spark.createDataFrame([(ch, lead, 5) for ch, lead in leads], "challenger long, lead_us long, first_us long"), 100, 100).collect()}
    assert got == {1: (32, 32, -500, True), 2: (31, 31, -900, False), 3: (32, 16, 500, False)}


def test_running_equals_one_window(spark):
    r = random.Random(5)
    rows = [(r.choice(["x", None]), i, r.choice([None, r.randrange(9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {x.i: (x.n, x.m, x.mb, x.last_, x.lb) for x in running(df, ["k"], ["i"], F.floor(F.col("i") / 13), n=("count", None), m=("max", F.col("v")), mb=("max_before", F.col("v")), last_=("last", F.col("v")), lb=("last_before", F.col("v"))).collect()}
    seen = {}
    for k, i, v in rows:
        before = list(seen.get(k, []))
        seen.setdefault(k, []).append(v)
        known, earlier = [x for x in seen[k] if x is not None], [x for x in before if x is not None]
        assert got[i] == (len(seen[k]), max(known, default=None), max(earlier, default=None), known[-1] if known else None, earlier[-1] if earlier else None)


def test_late_trades_and_retention(spark):
    rows = [(1, 0, 0, 5000_000_000, 1, 10.0, 1, 0), (1, 0, 0, 1400_000_000, 2, 9.0, 1, 1), (1, 0, 0, 1399_000_000, 3, 8.0, 1, 2), (1, 0, 0, 5000_000_000, 4, 11.0, 2, 3)]
    df = spark.createDataFrame(rows, "source_id long, channel long, instrument_id long, source_us long, arrival_seq long, price double, size long, arrival_us long")
    v = c.late_verdicts(df)
    assert {r.arrival_seq: r.accepted for r in v.collect()} == {1: True, 2: True, 3: False, 4: True}
    bars = c.retained_bars(v)
    assert sorted((r.sec, r.open, r.close, r.volume) for r in bars.collect()) == [(1400, 9.0, 9.0, 1), (5000, 10.0, 11.0, 3)]
    served = c.served_candles(bars, 5001, 3600, 1).where("granularity = 'ONE_DAY'").collect()
    assert [(r.start, r.nth, r.open, r.close) for r in served] == [(0, 1, 10.0, 11.0)]
    kept = c.retention(bars, 60, 5, 99_999).first()
    assert (kept.oldest, kept.newest, kept.truncated, kept.held) == (99_999, 99_999, False, True)
    assert [r.arrival_seq for r in c.recent_trades(v, 2).orderBy("nth").collect()] == [4, 2]
    assert c.occupancy(bars.limit(0)).first()["products"] == 0 and c.rollup(bars, 0).count() == 2


def test_books_on_odd_rows(spark):
    flow = "instrument_id long, order_id long, side string, price long, seq_kind int, seq_no long, qty long"
    rows = [(1, 1, "bid", 10, 0, 0, 5), (1, 1, "bid", 10, 1, 1, 5), (1, 2, "bid", 11, 0, 0, 5), (1, 3, "ask", 11, 0, 0, 4), (1, 4, "ask", 12, 0, 0, 4), (1, 4, "ask", 12, 2, 0, 0), (2, 5, "bid", 9, 0, 0, 1)]
    df = spark.createDataFrame(rows, flow)
    book = b.order_book(df)
    assert sorted((r.order_id, r["size"]) for r in book.collect()) == [(2, 5), (3, 4), (5, 1)]
    assert {r.instrument_id: (r.bid, r.ask) for r in b.best(b.price_fold(book)).collect()} == {1: (11, 11), 2: (9, None)}
    assert {r.instrument_id: r.crossed for r in b.crossed(b.price_fold(book)).collect()} == {1: False, 2: False}
    assert sorted((r.order_id, r.seq_kind, r.diff) for r in b.order_diffs(df).collect()) == [(1, 0, "new"), (1, 1, "remove"), (2, 0, "new"), (3, 0, "new"), (4, 0, "new"), (4, 2, "remove"), (5, 0, "new")]
    levels = spark.createDataFrame([(1, "bid", 12345, 1, 1), (1, "bid", 12399, 2, 1), (1, "ask", 12401, 3, 1), (1, "ask", 99999, 1, 1)], "instrument_id long, side string, price long, size long, n long")
    assert sorted((r.side, r.price, r["size"], r.nth) for r in b.bucketed_levels(levels, 3).collect()) == [("ask", 12500, 3, 1), ("ask", 100000, 1, 2), ("bid", 12300, 3, 1)]
    for empty in (b.order_book(df.limit(0)), b.rebaseline(levels.limit(0)), b.top_levels(levels.limit(0)), b.order_diffs(df.limit(0))):
        assert empty.collect() == []


def test_ids_are_parsed_from_the_right(spark):
    ids = ["abc:BTC", "abc:BTC#2.7", "abc:A#B#2.7", "abc:BTC#2", ":BTC", "abc:", "BTC", "abc:#1.2", "abc:B#300.1", None]
    got = {r.id: (r.source, r.symbol, r.channel, r.instrument_id) for r in d.parse_ids(spark.createDataFrame([(x,) for x in ids], "id string")).where("valid").collect()}
    assert got == {"abc:BTC": ("ABC", "BTC", None, None), "abc:BTC#2.7": ("ABC", "BTC", 2, 7), "abc:A#B#2.7": ("ABC", "A#B", 2, 7)}


def test_pages(spark):
    products = spark.createDataFrame([("v", "c", i, i) for i in range(5)], "venue string, category string, channel long, instrument_id long")
    page = lambda *x: [(r.nth, r.next_cursor) for r in d.page(products, *x).orderBy("channel").collect()]
    assert page(2, 0) == [(0, 2), (1, 2)] and page(2, 4) == [(4, None)] and page(5, 0)[0] == (0, None) and page(3, 9) == [] and len(page(None, 3)) == 2
    with pytest.raises(ValueError):
        d.page(products, 0)


def test_unregistered_sources_are_capped(spark):
    rows = spark.createDataFrame([(i, i) for i in range(3, 80)] + [(1, 100), (None, 101)], "source_id long, seen long")
    got = {r.source_id: r.label for r in d.source_labels(rows, spark.createDataFrame([(1, "ALPHA")], "source_id long, name string"), ["seen"]).collect()}
    assert got[1] == "ALPHA" and got[3] == "SOURCE_3" and got[66] == "SOURCE_66" and got[67] == "UNREGISTERED" and got[None] == "UNREGISTERED"


def test_health_and_guards(spark):
    r = spark.createDataFrame([("a", "top_of_book", 2), ("a", "market_by_order", 0), ("b", "market_by_order", 0)], "venue string, kind string, liveness int")
    assert {x.venue: x.up for x in s.venue_health(r).collect()} == {"a": False, "b": True}
    values = spark.createDataFrame([(x,) for x in ("1.5", "-1", "NaN", "Infinity", "x", None, "0")], "t string").select(d.guarded(F.col("t")).alias("v"))
    assert [x.v for x in values.collect()] == [1.5, None, None, None, None, None, 0.0]


def test_feeds_are_selected(spark):
    feeds = spark.createDataFrame([("Va", 1), ("Va", 2), ("Vb", 1)], "venue string, port int")
    assert s.select_feeds(feeds, ["va"], [1]).collect() == [("Va", 1)] and s.select_feeds(feeds).count() == 3
    with pytest.raises(ValueError, match="VC"):
        s.select_feeds(feeds, ["va", "vc"])
    health = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 1, False)], "venue string, at int, up boolean")
    assert sorted((r.venue, r.at) for r in s.health_edges(health, "at").collect()) == [("a", 1), ("a", 3), ("b", 1)]


def test_books_go_on_from_the_last_complete_snapshot(spark):
    begins = spark.createDataFrame([(1, 7, 1, 10), (2, 7, 2, 20), (3, 8, 1, 5)], "snapshot_id long, instrument_id long, total long, last_seq long")
    levels = spark.createDataFrame([(1, "bid", 100, 4), (2, "bid", 101, 9), (3, "ask", 5, 5), (3, "ask", 6, 5)], "snapshot_id long, side string, price long, size long")
    deltas = spark.createDataFrame([(7, 10, "bid", 100, 1, 0), (7, 11, "bid", 99, 3, 0), (7, 12, "bid", 100, 0, 0), (7, 12, "bid", 100, 8, 1), (7, 14, "ask", 1, 1, 0), (8, 6, "ask", 5, 1, 0)], "instrument_id long, seq long, side string, price long, qty long, seq_place long")
    got = [(r.instrument_id, r.side, r.price, r["size"], r.applied) for r in b.recovered(begins, levels, deltas).collect()]
    assert got == [(7, "bid", 99, 3, 2)]
    assert b.recovered(begins.limit(0), levels, deltas).collect() == []
