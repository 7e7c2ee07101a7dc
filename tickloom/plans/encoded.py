"""Queries over datagrams. Rows of the domain tables are packed as bytes by formats of their own, and decoded by the layouts of the library."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import codecs as k
from tickloom.operators import shreds
from tickloom.plans.ticks import TRADES_SQL
from tickloom.sources.datagrams import MAGIC, in_hand, messages, refused
from tickloom.sources.tables import instruments, level_updates, table, trades

# The bodies that these queries pack, little-endian.
QUOTE, TRADE = "<IHBBQqQqQHH4x", "<IHBBQqQQQ"
DEFINITION_1, DEFINITION_3 = "<I16s17xbb35xH", "<IH64s17xbb35xH"
LEVEL = "<IHBBIqQQHHBB2x"
MAX_U8 = (1 << 64) - 1


def _raw(price: str = "price"):
    return F.round(F.col(price) * 100).cast("long")


def _message(kind: int, body: bytes) -> bytes:
    return struct.pack("<BBH", kind, len(body) + 4, 0) + body


def _datagram(magic: int, channel: int, sequence: int, sent: list[bytes], version: int = 1) -> bytes:
    body = b"".join(sent)
    return struct.pack("<HBBQQBBH", magic, version, channel, sequence, 0, len(sent), 0, 24 + len(body)) + body


def _packed(rows: DataFrame, pack: Callable[..., bytes]) -> DataFrame:
    """arrival_seq and payload, which pack() makes of a row's other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_hand(batches):
            columns = [c.to_pylist() for c in batch.columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(*r) for r in zip(*columns, strict=True)], pa.binary())], names=["arrival_seq", "payload"])

    return rows.mapInArrow(run, "arrival_seq long, payload binary")


def _bytes(x: Column | int, size: int, signed: bool = False) -> Column:
    """A number as little-endian bytes, by built-in functions; nulls and what doesn't fit are refused."""
    x = (F.lit(x) if isinstance(x, int) else x).cast("long")
    most = (1 << min(63, 8 * size)) - 1
    fits = x if signed else F.when(x.between(0, most), x)
    digits = F.lpad(F.hex(F.coalesce(fits, F.raise_error(F.lit("no such number of %d bytes" % size)).cast("long"))), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(size)]))


def _zeros(size: int) -> Column:
    return F.unhex(F.lit("00" * size))


def _trade_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote and a trade an event; every 13th datagram is cut off in the trade, every 17th has another protocol's magic."""

    def pack(n, instrument, source, channel, at, price, size):
        quote = struct.pack(QUOTE, instrument, source, 0, 0, at, price - 1, size, price + 1, MAX_U8, 5, n % 3)
        trade = struct.pack(TRADE, instrument, source, n % 2, 0, at, -price, size, n, 0)
        whole = _datagram(MAGIC["midpoint"] if n % 17 == 0 else MAGIC["top_of_book"], channel, n, [_message(0x03, quote), _message(0x04, trade)])
        return whole[:-1] if n % 13 == 0 else whole

    return _packed(trades(spark, sf_dir).select("arrival_seq", "instrument_id", "source_id", "channel", F.col("source_us") * 1000, _raw(), "size"), pack)


def decoded_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(_trade_datagrams(spark, sf_dir), "top_of_book")
    return k.decode(m, "top_of_book", "trade").select("arrival_seq", "channel", "sequence", "ord", "instrument_id", "source_id", "source_ts", "price_raw", "qty_raw", "trade_id", "aggressor_side")


def decoded_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(_trade_datagrams(spark, sf_dir), "top_of_book")
    q = k.decode(m, "top_of_book", "quote")
    return q.select("arrival_seq", "ord", "bid_raw", "ask_raw", "bid_qty_raw", k.saturated(F.col("ask_qty_raw")).alias("ask_qty"), "bid_n", "ask_n", k.scaled(F.col("bid_raw"), F.lit(-2)).alias("bid"))


def refused_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refused(_trade_datagrams(spark, sf_dir), "top_of_book").select("arrival_seq", "why")


def decoded_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of both versions: the second has a source and long symbols."""

    def pack(n, channel, source, symbol, price_exponent, qty_exponent):
        if n % 2 == 0:
            return _datagram(MAGIC["market_by_order"], channel, n, [_message(0x02, struct.pack(DEFINITION_1, n, symbol.encode(), price_exponent, qty_exponent, n % 65536))])
        return _datagram(MAGIC["market_by_order"], channel, n, [_message(0x02, struct.pack(DEFINITION_3, n, source, symbol.encode(), price_exponent, qty_exponent, n % 65536))], 3)

    i = instruments(spark, sf_dir).select(F.col("instrument_id").alias("arrival_seq"), "channel", "source_id", "symbol", "price_exponent", "qty_exponent")
    return k.decode(messages(_packed(i, pack), "market_by_order"), "market_by_order", "definition").select("arrival_seq", "channel", "instrument_id", "source_id", "symbol", "price_exponent", "qty_exponent", "manifest_seq")


def decoded_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level updates; every 7th order's are longer than the protocol's and refused."""

    def pack(n, instrument, ask, order, line, price, qty):
        body = struct.pack(LEVEL, instrument, 0, ask, 0, order, price, qty, 0, 65535 if qty == 0 else line, 65535, 0, 0)
        return _datagram(MAGIC["market_by_price"], instrument, order, [_message(0x40, body + bytes(4) if order % 7 == 0 else body)])

    u = level_updates(spark, sf_dir).withColumn("arrival_seq", F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_partkey"))
    d = _packed(u.select("arrival_seq", "instrument_id", (F.col("side") == "ask").cast("int"), "l_orderkey", "l_linenumber", "price", "qty"), pack)
    found = k.decode(messages(d, "market_by_price"), "market_by_price", "level_update")
    return found.groupBy("instrument_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("price_raw").cast("long").alias("prices"), F.sum("qty_raw").cast("long").alias("sizes"), F.count("order_count").alias("counted"), F.count("level_index").alias("indexed"))


def decoded_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, at = F.col("arrival_seq"), F.col("source_us") * 1000
    body = F.concat(_bytes(F.col("instrument_id"), 4), _zeros(3), _bytes(n % 4, 1), _bytes(at, 8), _zeros(8), _bytes(_raw(), 8, signed=True), _zeros(4))
    mid = F.concat(_bytes(0x03, 1), _bytes(40, 1), _zeros(2), body)
    head = F.concat(_bytes(MAGIC["midpoint"], 2), _bytes(1, 1), _bytes(F.col("channel"), 1), _bytes(n, 8), _zeros(8), _bytes(2, 1), _zeros(1), _bytes(24 + 2 * 40, 2))
    d = trades(spark, sf_dir).select("arrival_seq", head.alias("head"), mid.alias("mid")).select("arrival_seq", F.concat("head", "mid", "mid").alias("payload"))
    found = k.decode(messages(d, "midpoint"), "midpoint", "midpoint")
    return found.select("arrival_seq", "ord", "instrument_id", "mid_raw", (F.col("quality_flags").bitwiseAND(F.lit(2)) != 0).alias("crossed"))


def shred_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy packets of documents: slot, index, kind and the hash of what was signed; short ones and unknown kinds aren't parsed."""
    n, body = F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary")
    kind = F.when(n % 5 == 0, 0x10).when(n % 2 == 0, 0x5A).otherwise(0xA5)
    head = F.concat(_zeros(64), _bytes(kind, 1), _bytes(n * 1_000_003, 8), _bytes(n % 1000, 4), _zeros(6), body)
    d = table(spark, sf_dir, "documents").select("doc_id", head.alias("head"))
    p = d.select("doc_id", F.when(n % 11 == 0, F.substring("head", 1, 70)).otherwise(F.col("head")).alias("payload"))
    return shreds.parse(p).select("doc_id", "parsed", "slot", "index", "kind", F.octet_length("message").alias("signed_bytes"))


def queries() -> dict:
    return {f.__name__: f for f in (decoded_trades, decoded_quotes, refused_datagrams, decoded_definitions, decoded_levels, decoded_midpoints, shred_headers)}


_RAW = "cast(round(price * 100) AS BIGINT)"


def oracle_sql() -> dict[str, str]:
    return {
        "decoded_trades": f"""WITH {TRADES_SQL} SELECT arrival_seq, channel, arrival_seq AS sequence, 1 AS ord, instrument_id, source_id, source_us * 1000 AS source_ts, -{_RAW} AS price_raw, size AS qty_raw, arrival_seq AS trade_id, arrival_seq % 2 AS aggressor_side
FROM t WHERE arrival_seq % 13 > 0 AND arrival_seq % 17 > 0""",
        "decoded_quotes": f"""WITH {TRADES_SQL} SELECT arrival_seq, 0 AS ord, {_RAW} - 1 AS bid_raw, {_RAW} + 1 AS ask_raw, size AS bid_qty_raw, 9223372036854775807 AS ask_qty, 5 AS bid_n, arrival_seq % 3 AS ask_n, ({_RAW} - 1) * pow(10.0, -2) AS bid FROM t WHERE arrival_seq % 17 > 0""",
        "refused_datagrams": "SELECT event_id AS arrival_seq, 'magic' AS why FROM events WHERE event_id % 17 = 0",
        "decoded_definitions": """SELECT p_partkey AS arrival_seq, p_size % 32 AS channel, p_partkey AS instrument_id, CASE WHEN p_partkey % 2 = 1 THEN 1 + p_partkey % 3 END AS source_id,
  substring(CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_name || '-' || p_partkey END, 1, CASE WHEN p_partkey % 2 = 0 THEN 16 ELSE 64 END) AS symbol, -2 AS price_exponent, 0 AS qty_exponent, p_partkey % 65536 AS manifest_seq FROM part""",
        "decoded_levels": """WITH u AS (SELECT l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS id, l_suppkey % 16 AS instrument_id, l_linenumber % 2 AS side, cast(floor(l_extendedprice / 100) AS BIGINT) AS price, cast(CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_quantity END AS BIGINT) AS qty, l_orderkey FROM lineitem)
SELECT instrument_id, side, count(*) AS n, cast(sum(price) AS BIGINT) AS prices, cast(sum(qty) AS BIGINT) AS sizes, count(nullif(qty, 0)) AS counted, 0 AS indexed FROM u WHERE l_orderkey % 7 > 0 GROUP BY ALL""",
        "decoded_midpoints": f"""WITH {TRADES_SQL} SELECT arrival_seq, ord, instrument_id, {_RAW} AS mid_raw, arrival_seq % 4 >= 2 AS crossed FROM t, (SELECT unnest([0, 1]) AS ord)""",
        "shred_headers": """WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, doc_id % 11 > 0 AND doc_id % 5 > 0 AS fine FROM documents)
SELECT doc_id, fine AS parsed, CASE WHEN fine THEN doc_id * 1000003 END AS slot, CASE WHEN fine THEN doc_id % 1000 END AS index, CASE WHEN fine THEN CASE WHEN doc_id % 2 = 0 THEN 'code' ELSE 'data' END END AS kind, CASE WHEN fine THEN n + 19 END AS signed_bytes FROM d""",
    }
