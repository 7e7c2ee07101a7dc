"""Streams give what the batch operators give on the same rows, and sequential steps what a loop gives."""

import json
import time

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import candles, wire
from tickloom.sources import public, tables
from tickloom.streaming import sequential as q
from tickloom.streaming import windows

SF = "/root/testdata/sf0.001"


def run(spark, tmp_path, df, make, files=3, order="arrival_seq", stops_by_itself=True):
    """The rows that a stream over df, in `files` files in order, has given at its end."""
    source, n = str(tmp_path / "in"), df.count()
    ranked = df.orderBy(order).collect()
    for i in range(files):
        part = ranked[i * n // files : (i + 1) * n // files]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    name = "s" + str(abs(hash(str(tmp_path))))
    out = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    until = time.time() + 300
    # with timers on the cluster's clock a query goes on looking for what is due
    while not out.awaitTermination(1) and (stops_by_itself or spark.table(name).count() < n) and time.time() < until:
        pass
    out.stop()
    return spark.table(name)


def test_bars_of_a_stream(spark, tmp_path):
    trades = tables.trades(spark, SF)
    got = {tuple(r) for r in run(spark, tmp_path, trades, lambda s: windows.bars(s, "1 hour", "1 second")).collect()}
    want = {tuple(r) for r in candles.one_second_bars(trades).select("source_id", "channel", "instrument_id", "sec", "open", "high", "low", "close", "volume").collect()}
    # what lies within the delay of the end is still open
    newest = max(r[3] for r in want)
    assert got <= want and {r for r in want if r[3] < newest - 3600} <= got


def loop(rows, rule):
    """The verdicts of one pass, with the state put away and taken back after every row."""
    step, kept = rule
    state, out = None, []
    for r in rows:
        state, verdict = step(state, r)
        fields = [f.name for f in T.StructType.fromDDL(kept.schema).fields]
        state = kept.unpack(as_row(dict(zip(fields, kept.pack(state), strict=True)), T.StructType.fromDDL(kept.schema)))
        out.append(verdict)
    return out


def as_row(value, kind):
    if isinstance(kind, T.StructType) and value is not None:
        values = value.values() if isinstance(value, dict) else value
        return Row(*kind.names)(*[as_row(v, f.dataType) for v, f in zip(values, kind.fields, strict=True)])
    return [as_row(v, kind.elementType) for v in value] if isinstance(kind, T.ArrayType) else value


def test_steps_keep_state_between_batches(spark, tmp_path):
    at = lambda i: None if i % 4 == 3 else 1_780_609_924_758_000_123 + i  # noqa: E731  nulls beside longs that no double holds
    rows = [{"k": "a", "arrival_seq": i, "publisher": i % 3, "trade_id": i * 7 % 5, "at_ns": i * 1_000_000_000, "price_exponent": i // 6, "qty_exponent": 0, "other": at(i)} for i in range(30)]
    df = spark.createDataFrame(rows, "k string, arrival_seq long, publisher long, trade_id long, at_ns long, price_exponent int, qty_exponent int, other long")
    for i, rule in enumerate((q.reannounce, q.trade_ids(3), q.unnumbered_tape)):
        got = run(spark, tmp_path / str(i), df, lambda s, rule=rule: q.sequential(s, ["k"], ["arrival_seq"], rule)).orderBy("arrival_seq").collect()
        assert [r.verdict for r in got] == loop(rows, rule) and [r.other for r in got] == [at(i) for i in range(30)]
    assert [r.verdict for r in q.sequential(df.repartition(3), ["k"], ["arrival_seq"], q.reannounce).orderBy("arrival_seq").collect()] == loop(rows, q.reannounce)
    assert q.sequential(df.limit(0), ["k"], ["arrival_seq"], q.reannounce).collect() == []


def test_state_of_idle_keys_is_forgotten(spark, tmp_path):
    df = spark.createDataFrame([("a", i, 1, i) for i in range(3)], "k string, arrival_seq long, publisher long, trade_id long")
    late = lambda s: q.sequential(s, ["k"], ["arrival_seq"], q.trade_ids(), idle_ms=1)
    assert {r.verdict for r in run(spark, tmp_path, df.withColumn("trade_id", F.lit(7).cast("long")), late, files=3, stops_by_itself=False).collect()} == {"emit"}


def test_steps():
    d = lambda at, x=1: {"price_exponent": x, "qty_exponent": 0, "at_ns": at * 1_000_000_000}
    assert loop([d(0), d(14), d(15), d(16, 2), d(17), d(33), d(33)], q.reannounce) == ["emit", "drop", "emit", "emit", "emit", "emit", "drop"]
    t = lambda trade, publisher: {"trade_id": trade, "publisher": publisher}
    assert loop([t(1, 0), t(1, 1), t(1, 0), t(2, 0), t(3, 0), t(1, 1), t(0, 0), t(0, 0)], q.trade_ids(2)) == ["emit", "contest", "drop", "emit", "emit", "emit", "bypass", "bypass"]
    p = lambda at, publisher: {"at_ns": at * 1_000_000_000, "publisher": publisher}
    assert loop([p(0, 0), p(1, 1), p(5, 1), p(6, 1), p(7, 0)], q.unnumbered_tape) == ["emit", "conflict", "conflict", "emit", "conflict"]


def test_steps_of_paths():
    S = 1_000_000_000
    b = lambda at, publisher, market="m", healthy=True: {"at_ns": at * S, "publisher": publisher, "market": market, "healthy": healthy}
    assert loop([b(0, 0), b(1, 1), b(1, 0, "n"), b(3, 1), b(4, 1), b(4, 0)], q.sticky_authority) == ["emit", "drop", "emit", "drop", "emit", "drop"]
    assert loop([b(0, 0), b(0, 0, "m", False), b(1, 1), b(1, 1, "n"), b(1, 0, "n")], q.sticky_authority) == ["emit", "emit", "emit", "drop", "emit"]
    assert loop([b(0, i) for i in range(10)], q.sticky_authority) == ["emit"] + ["drop"] * 9
    t = lambda at, publisher, elected=None, tracked=(): {"at_ns": at * S, "publisher": publisher, "elected": elected, "tracked": tracked}
    assert loop([t(0, 0), t(1, 1), t(2, 1, None, (1,)), t(3, 0, 0, (0, 1)), t(4, 1, 0, (0, 1)), t(10, 1, 0, (0, 1)), t(11, 0, 0, (0, 1))], q.tape_gate) == ["emit", "drop", "emit", "emit", "drop", "emit", "drop"]


def texts(spark, *rows):
    return spark.createDataFrame([(x if x is None or isinstance(x, str) else json.dumps(x),) for x in rows], "text string")


def test_public_frames(spark):
    level = lambda px, sz="1.5": {"px": px, "sz": sz, "n": 2}
    bbo = lambda coin, time, *sides: {"channel": "bbo", "data": {"coin": coin, "time": time, "bbo": list(sides)}}
    known = spark.createDataFrame([("BTC", 1, 7)], "symbol string, channel long, instrument_id long")
    got = public.quotes(texts(spark, bbo("BTC", 5, level("10"), level("11")), bbo("BTC", 0, level("10"), level("11")), bbo("BTC", 5, level("10"), None), bbo("X", 5, level("1"), level("2")), bbo("BTC", 5, level("-1"), level("2")), "no json", None), known).collect()
    assert [(r.symbol, r.bid, r.ask, r.bid_n, r.source_ts_ns) for r in got] == [("BTC", 10.0, 11.0, 2, 5_000_000)]
    trade = {"coin": "BTC", "side": "A", "px": "10.5", "sz": "2", "time": 6, "tid": 99}
    got = public.trades(texts(spark, {"channel": "trades", "data": [trade, trade | {"px": "x"}, trade | {"coin": "X"}, trade | {"side": "?"}]}), known).collect()
    assert [(r.price, r.side, r.trade_id, r.instrument_id) for r in got] == [(10.5, "sell", 99, 7), (10.5, "unknown", 99, 7)]
    fill = {"side": "bid", "baseAmount": 2.0, "quoteAmount": 21.0, "timestamp": "1700000123.5", "tradeSequenceNumber": "5"}
    got = public.fills(texts(spark, {"channel": "trades", "symbol": "BTC", "trades": [fill, {"side": 1, "baseAmount": "x"}, fill | {"baseAmount": 0.0}, fill | {"tradeSequenceNumber": "z"}, fill | {"timestamp": "q"}]}), known).collect()
    assert [(r.price, r.side, r.source_ts_ns) for r in got] == [(10.5, "buy", 1_700_000_123_000_000_000), (10.5, "buy", 0)]


def test_control_plane(spark):
    codes = lambda *x: sorted(((r.known, r.code) for r in public.subscribed_codes(texts(spark, *x)).collect()), key=repr)
    assert codes([{"multicast_groups": "a, S:b,p:c,,s:"}, {"multicast_groups": None}]) == [(True, "a"), (True, "b")]
    assert codes([{"other": "x"}]) == [(False, None)] and codes([]) == [] and codes("no json") == []
    groups = [{"code": "a", "multicast_ip": "1.2.3.4", "status": "Activated"}, {"code": "b", "multicast_ip": "1.2.3.5", "status": "pending"}]
    assert [tuple(r) for r in public.group_addresses(texts(spark, groups)).collect()] == [("a", "1.2.3.4")]
    slots = public.leader_slots(texts(spark, {"L1": [0, 3], "L2": [1]}).withColumn("first_slot", F.lit(100)))
    packets = spark.createDataFrame([(100,), (101,), (102,)], "slot long")
    assert sorted((r.slot, r.leader) for r in public.with_leader(packets, slots).collect() if r.leader) == [(100, "L1"), (101, "L2")]


def test_wire_numbers(spark):
    values = spark.createDataFrame([(x,) for x in (100.0, 0.1, 1e-9, 123456789.125, 0.0)], "x double")
    assert [r[0] for r in values.select(wire.number(F.col("x"))).collect()] == ["100", "0.1", "0", "123456789.125", "0"]
    assert [r[0] for r in values.select(wire.fixed(F.col("x"), -2)).collect()][:2] == ["100.00", "0.10"]
    levels = spark.createDataFrame([("BTC", 5, "bid", 10, 1, 1, 1), ("BTC", 5, "bid", 9, 2, 1, 2), ("BTC", 5, "ask", 11, 3, 2, 1)], "coin string, time_ms long, side string, price long, size long, n long, nth int")
    body = json.loads(wire.l2_book(levels, "coin", "time_ms").first().body)
    assert body == {"channel": "l2Book", "data": {"coin": "BTC", "time": 5, "levels": [[{"px": "10", "sz": "1", "n": 1}, {"px": "9", "sz": "2", "n": 1}], [{"px": "11", "sz": "3", "n": 2}]]}}
