"""Datagram logs and codecs on datagrams that the tests put together."""

import struct

import pyarrow as pa
import pytest

from tickloom.operators import codecs
from tickloom.plans import encoded
from tickloom.sources import datagrams as d


def message(kind, body, flags=0, length=None):
    return struct.pack("<BBH", kind, len(body) + 4 if length is None else length, flags) + body


def datagram(protocol, messages, version=1, channel=3, sequence=9, resets=1, magic=None, count=None):
    body = b"".join(messages)
    return struct.pack("<HBBQQBBH", d.MAGIC[protocol] if magic is None else magic, version, channel, sequence, 77, len(messages) if count is None else count, resets, 24 + len(body)) + body


QUOTE = message(0x03, struct.pack("<IHBBQqQqQHH4x", 42, 1, 3, 0, 1_780_609_924_758_000_000, 6788, 10657, -6790, (1 << 64) - 1, 5, 3))
TRADE = message(0x04, struct.pack("<IHBBQqQQQ", 42, 1, 1, 0, 5, 6789, 10, 11, 12))
DEFINITION_1 = message(0x02, struct.pack("<I16s17xbb35xH", 42, b"BTC\0junk", -2, -3, 7))
DEFINITION_3 = message(0x02, struct.pack("<IH64s17xbb35xH", 43, 2, "Ä-LONG".encode(), -4, 0, 8))
LEVEL = message(0x40, struct.pack("<IHBBIqQQHHBB2x", 1, 2, 0, 1, 9, -5, (1 << 64) - 2, 6, 0xFFFF, 4, 1, 0))
CLEAR = struct.pack("<IHBBIqQB3x", 1, 2, 2, 0, 9, 0, 6, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "arrival_seq long, payload binary")


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["arrival_seq"], r["ord"]))


def test_quotes_trades_and_definitions(spark):
    data = frame(spark, [datagram("top_of_book", [QUOTE, DEFINITION_1, TRADE]), datagram("top_of_book", [DEFINITION_3], version=3), None])
    m = d.messages(data, "top_of_book")
    quote = rows(codecs.decode(m, "top_of_book", "quote"))[0]
    assert (quote["bid_raw"], quote["ask_raw"], quote["ask_qty_raw"], quote["bid_n"], quote["channel"], quote["sequence"], quote["reset_count"]) == (6788, -6790, -1, 5, 3, 9, 1)
    assert rows(codecs.decode(m, "top_of_book", "trade"))[0]["cumulative_raw"] == 12
    one, three = rows(codecs.decode(m, "top_of_book", "definition"))
    assert (one["symbol"], one["price_exponent"], one["manifest_seq"], one["source_id"]) == ("BTC", -2, 7, None)
    assert (three["symbol"], three["price_exponent"], three["manifest_seq"], three["source_id"]) == ("Ä-LONG", -4, 8, 2)
    assert codecs.decode(m.limit(0), "top_of_book", "quote").collect() == []


def test_framing(spark):
    good = datagram("top_of_book", [TRADE, QUOTE])
    data = frame(spark, [good, good[:-1], datagram("top_of_book", [TRADE], magic=1), datagram("top_of_book", [TRADE], version=2), b"", datagram("top_of_book", [message(4, b"", length=3), TRADE]), datagram("top_of_book", [TRADE], count=9)])
    m = d.messages(data, "top_of_book")
    assert [(r["arrival_seq"], r["ord"], r["type"]) for r in rows(m)] == [(0, 0, 4), (0, 1, 3), (1, 0, 4), (6, 0, 4)]
    assert sorted((r["arrival_seq"], r["why"]) for r in d.refused(data, "top_of_book").collect()) == [(2, "magic"), (3, "version"), (4, "short")]


def test_price_levels(spark):
    data = frame(spark, [datagram("market_by_price", [LEVEL, message(0x41, CLEAR), message(0x41, CLEAR[:7] + b"\1" + CLEAR[8:]), message(0x40, LEVEL[4:] + b"\0")])])
    m = d.messages(data, "market_by_price")
    levels = rows(codecs.decode(m, "market_by_price", "level_update"))
    assert len(levels) == 1 and (levels[0]["price_raw"], levels[0]["order_count"], levels[0]["level_index"]) == (-5, None, 4)
    assert [r["ord"] for r in rows(codecs.decode(m, "market_by_price", "book_clear"))] == [1]
    got = codecs.decode(m, "market_by_price", "level_update").select(codecs.saturated(codecs.F.col("qty_raw")).alias("q"), codecs.scaled(codecs.F.col("price_raw"), codecs.F.lit(-2)).alias("p")).first()
    assert got.q == (1 << 63) - 1 and got.p == pytest.approx(-0.05)


def test_orders_and_midpoints(spark):
    add = message(0x10, struct.pack("<IHBBIQQqQ4x", 1, 2, 1, 0, 5, 99, 7, 1234, 8))
    m = d.messages(frame(spark, [datagram("market_by_order", [add])]), "market_by_order")
    assert {k: rows(codecs.decode(m, "market_by_order", "order_add"))[0][k] for k in ("order_id", "seq", "side", "price_raw", "qty_raw")} == {"order_id": 99, "seq": 5, "side": 1, "price_raw": 1234, "qty_raw": 8}
    mid = message(0x03, struct.pack("<IHBBQQq4x", 7, 1, 0, 2, 5, 6, 18_420))
    m = d.messages(frame(spark, [datagram("midpoint", [mid]), datagram("midpoint", [mid], version=3)]), "midpoint")
    assert [(r["arrival_seq"], r["mid_raw"]) for r in rows(codecs.decode(m, "midpoint", "midpoint"))] == [(0, 18_420)]


def test_logs(spark, tmp_path):
    records = [b"one", b"", b"three" * 1000]
    (tmp_path / "a.bin").write_bytes(b"".join(struct.pack("<I", len(x)) + x for x in records) + b"\5\0\0\0cut")
    got = d.read_log(spark, str(tmp_path / "a.bin")).orderBy("arrival_seq").collect()
    assert [bytes(r.payload) for r in got] == records and got[0].publisher is None
    (tmp_path / "b.bin").write_bytes(b"".join(struct.pack("<I4sB", len(x), bytes([10, 0, 0, i]), i % 2) + x for i, x in enumerate(records)))
    got = d.read_log(spark, str(tmp_path / "b.bin"), combined=True).orderBy("arrival_seq").collect()
    assert [(r.publisher, r.role, bytes(r.payload)) for r in got] == [(f"10.0.0.{i}", i % 2, x) for i, x in enumerate(records)]


def test_captures(spark, tmp_path):
    udp = lambda x: struct.pack(">HHHH", 1, 2, 8 + len(x), 0) + x
    ip = lambda x, protocol=17: struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(x), 0, 0, 1, protocol, 0, bytes([10, 0, 0, 1]), bytes([233, 0, 0, 2])) + x
    frame_ = lambda x, kind=0x0800: bytes(14) + struct.pack(">H", kind) + x
    packets = [frame_(ip(udp(b"one") + b"padding")), frame_(ip(udp(b"tcp"), 6)), frame_(ip(udp(b"arp")), 0x0806), b"short", frame_(ip(udp(TRADE)))]
    content = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 113) + b"".join(struct.pack("<IIII", 5, i, len(x), len(x)) + x for i, x in enumerate(packets))
    (tmp_path / "a.pcap").write_bytes(content + b"cut")
    got = d.read_capture(spark, str(tmp_path / "a.pcap")).orderBy("arrival_seq").collect()
    assert [(r.arrival_seq, r.recv_ts_ns, r.publisher, r.grp, bytes(r.payload)) for r in got] == [(0, 5_000_000_000, "10.0.0.1", "233.0.0.2", b"one"), (4, 5_000_004_000, "10.0.0.1", "233.0.0.2", TRADE)]


def test_a_batch_is_taken_in_parts():
    """A task's Python holds objects of IN_HAND rows, however many a batch has."""
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["x"]) for n in (10_000, 0, 5)]
    parts = list(d.in_hand(iter(batches)))
    assert max(p.num_rows for p in parts) == d.IN_HAND and [x for p in parts for x in p.column(0).to_pylist()] == [*range(10_000), *range(5)]


def test_packets_of_documents_need_no_python_and_midpoints_none_to_pack(spark):
    plans = {f.__name__: f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for f in (encoded.shred_headers, encoded.decoded_midpoints)}
    assert "MapInArrow" not in plans["shred_headers"] and plans["decoded_midpoints"].count("MapInArrow") == 2
