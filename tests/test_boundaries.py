"""The book at every boundary against a book that is replayed."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import boundaries as b
from tickloom.operators import books
from tickloom.plans import boundary

SCHEMA = "instrument_id long, side string, price long, qty long, t long, d long, k long"


def replay(rows, n):
    """market, moment -> the n best of each side after it."""
    books, out = {}, {}
    for m, side, price, qty, t, d, _ in sorted(rows, key=lambda r: (r[4], r[5], r[6])):
        book = books.setdefault(m, {"bid": {}, "ask": {}})
        book[side][price] = qty
        out[m, t, d] = tuple(sorted(((p, q) for p, q in book[s].items() if q), reverse=s == "bid")[:n] for s in ("bid", "ask"))
    return out


@pytest.mark.parametrize(("seed", "count", "block"), [(0, 300, 3), (1, 300, 10), (2, 1, 10), (3, 65, 0), (4, 200, 1)])
def test_book_at_every_boundary(spark, monkeypatch, seed, count, block):
    monkeypatch.setattr(b, "BLOCK", block)
    some = random.Random(seed)
    rows = [(some.randint(0, 1), some.choice(["bid", "ask"]), some.randint(1, 40), some.choice([0, 0, 1, 5]), i // 7, i // 2, i) for i in range(count)]
    updates = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bounds = b.boundaries(updates, ["t", "d"], F.floor(F.col("t") / 5))
    lives = b.lives(updates, bounds, ["t", "d"], ["k"])
    want = replay(rows, 3)
    depth = b.depth_at(bounds, lives, 3).collect()
    assert {(r.instrument_id, r.t, r.d): (tuple(map(tuple, r.bids)), tuple(map(tuple, r.asks))) for r in depth} == {k: (tuple(x), tuple(y)) for k, (x, y) in want.items()}
    before = {}
    for r in sorted(depth, key=lambda r: r.ord):
        assert r.published == (before.get(r.instrument_id) != (r.bids, r.asks))
        before[r.instrument_id] = (r.bids, r.asks)
    for r in b.best_at(bounds, lives).collect():
        bids, asks = want[r.instrument_id, r.t, r.d]
        assert (r.bid, r.bid_size) == (bids[0] if bids else (None, None)) and (r.ask, r.ask_size) == (asks[0] if asks else (None, None))
        assert r.crossed == bool(bids and asks and bids[0][0] > asks[0][0])


def test_as_of(spark):
    updates = spark.createDataFrame([(1, "bid", 5, 1, 10, d, d) for d in (1, 2)] + [(1, "bid", 6, 1, 20, 1, 3)], SCHEMA)
    bounds = b.boundaries(updates, ["t", "d"], F.col("t"))
    asked = spark.createDataFrame([(1, 9, "a"), (1, 10, "b"), (1, 19, "c"), (1, 19, "c"), (1, 20, "d"), (2, 20, "e"), (1, None, "f")], "instrument_id long, at long, what string")
    got = sorted((r.what, r.ord) for r in b.as_of(asked, bounds, ["t", "d"], "at", lambda t: F.floor(t / 10)).collect())
    assert got == [("a", None), ("b", 1), ("c", 1), ("c", 1), ("d", 2), ("e", None), ("f", None)]


def test_without_updates(spark):
    none = spark.createDataFrame([], SCHEMA)
    bounds = b.boundaries(none, ["t", "d"], F.col("t"))
    assert b.depth_at(bounds, b.lives(none, bounds, ["t", "d"], ["k"])).collect() == []


@pytest.mark.parametrize("seed", [0, 1])
def test_clears_from_a_price_outward(spark, seed):
    some = random.Random(seed)
    rows = [(1, some.choice(["bid", "ask"]), some.choice([None, *range(1, 40)]) if i % 9 == 8 else some.randint(1, 40), some.choice([0, 1, 5]), i, some.choice(["clear", "clear_from", "clear_from"]) if i % 9 == 8 else "set") for i in range(150)]
    book = {"bid": {}, "ask": {}}
    for _, side, price, qty, _, action in rows:
        if action == "set":
            book[side][price] = qty
        elif action == "clear" or price is not None:
            book[side] = {p: q for p, q in book[side].items() if action != "clear" and (p > price if side == "bid" else p < price)}
    updates = spark.createDataFrame(rows, "instrument_id long, side string, price long, qty long, t long, action string").repartition(3)
    got = books.fold_with_outward_clears(updates, ["t"], F.floor(F.col("t") / 20))
    assert sorted((r.side, r.price, r["size"]) for r in got.collect()) == sorted((s, p, q) for s in book for p, q in book[s].items() if q)


@pytest.mark.parametrize(("seed", "long"), [(0, 1 << 16), (1, 130), (2, 0)])
def test_books_of_short_and_long_markets(spark, monkeypatch, seed, long):
    """Short markets are read whole, long ones by blocks: the same rows, whichever a market is."""
    monkeypatch.setattr(b, "LONG", long)
    monkeypatch.setattr(b, "BLOCK", 3)
    monkeypatch.setattr(b, "BATCH", 7)
    some = random.Random(seed)
    rows = [(some.choice([0, 0, 1]), some.choice(["bid", "ask"]), some.randint(1, 40), some.choice([0, 0, 1, 5]), i // 7, i // 2, i) for i in range(400)]
    odd = [(0, None, 3, 9, 60, 0, 900), (0, "bid", None, 9, 60, 1, 901), (3, "bid", 5, None, 1, 1, 902), (3, "mid", 5, 1, 2, 1, 903)]
    updates = spark.createDataFrame([*rows, *odd], SCHEMA).repartition(3)
    want = replay(rows, 3)
    for m, t, d in ((0, 60, 0), (0, 60, 1)):
        want[m, t, d] = want[max(k for k in want if k[0] == m and k < (m, t, d))]
    want |= {(3, 1, 1): ((), ()), (3, 2, 1): ((), ())}
    got = b.book_of(updates, ["t", "d"], ["k"], F.floor(F.col("t") / 5), 3).collect()
    assert {(r.instrument_id, r.t, r.d): (tuple(map(tuple, r.bids)), tuple(map(tuple, r.asks))) for r in got} == {k: (tuple(x), tuple(y)) for k, (x, y) in want.items()}
    assert len(got) == len(want)
    nth, before = {}, {}
    for r in sorted(got, key=lambda r: (r.instrument_id, r.t, r.d)):
        m = r.instrument_id
        assert r.ord == nth.setdefault(m, 0) and r.published == (before.get(m) != (r.bids, r.asks))
        nth[m], before[m] = nth[m] + 1, (r.bids, r.asks)
    asked = spark.createDataFrame([(m, at, f"{m}.{at}") for m in (0, 1, 2, 3, None) for at in (None, -1, *range(0, 64, 3))] + [(0, 9, "0.9")], "instrument_id long, at long, what string")
    found = b.best_as_of(asked, updates, ["t", "d"], ["k"], "at", lambda at: F.floor(at / 5))
    assert found.columns == [*asked.columns, "bid", "bid_size", "ask", "ask_size", "crossed"]
    rows = found.collect()
    assert sorted(r.what for r in rows) == sorted(r.what for r in asked.collect())
    for r in rows:
        until = [k for k in want if r.at is not None and k[0] == r.instrument_id and k[1] <= r.at]
        bids, asks = want[max(until)] if until else ((), ())
        bid, ask = bids[0] if bids else (None, None), asks[0] if asks else (None, None)
        assert (r.bid, r.bid_size, r.ask, r.ask_size, r.crossed) == (*bid, *ask, bool(bids and asks and bid[0] > ask[0]) if until else None)


def test_books_without_updates(spark):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, 2)], "instrument_id long, at long")
    assert b.book_of(none, ["t", "d"], ["k"], F.col("t")).collect() == [] and b.best_of(none, ["t", "d"], ["k"], F.col("t")).collect() == []
    assert [tuple(r) for r in b.best_as_of(asked, none, ["t", "d"], ["k"], "at", lambda at: at).collect()] == [(1, 2, *(None,) * 5)]


@pytest.mark.parametrize("query", [boundary.best_at_boundaries, boundary.depth_changes, boundary.book_as_of])
def test_short_markets_are_dealt_once(spark, query):
    """Updates and what is asked go over the network once, without a join."""
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
