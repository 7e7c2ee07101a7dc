"""Messages of public JSON feeds and of the control plane, parsed by Spark: text in, typed rows out. What can't be read gives no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.dimensions import guarded

_LEVEL = "struct<px:string,sz:string,n:int>"
_BBO = f"struct<channel:string,data:struct<coin:string,time:bigint,bbo:array<{_LEVEL}>>>"
_TRADES = "struct<channel:string,data:array<struct<coin:string,side:string,px:string,sz:string,time:bigint,tid:bigint>>>"
_FILLS = "struct<channel:string,symbol:string,trades:array<string>>"
_FILL = "struct<side:string,baseAmount:double,quoteAmount:double,timestamp:string,tradeSequenceNumber:string>"
#: The most milliseconds and seconds that nanoseconds of a long can hold.
MOST_MS, MOST_S = (1 << 63) // 1_000_000, (1 << 63) // 1_000_000_000


def quotes(frames: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Two-sided quotes of `bbo` frames: symbol, bid, ask, sizes, counts, source_ts_ns. Symbols that `known` (symbol) lacks are dropped."""
    f = frames.select(F.from_json(text, _BBO).alias("f")).where("f.channel = 'bbo'")
    side = lambda i: F.get("f.data.bbo", F.lit(i))
    made = f.select(
        F.col("f.data.coin").alias("symbol"), guarded(side(0)["px"]).alias("bid"), guarded(side(0)["sz"]).alias("bid_size"), guarded(side(1)["px"]).alias("ask"), guarded(side(1)["sz"]).alias("ask_size"),
        side(0)["n"].alias("bid_n"), side(1)["n"].alias("ask_n"), F.col("f.data.time").alias("ms"),
    )
    fine = made.where("bid is not null and bid_size is not null and ask is not null and ask_size is not null").where((F.col("ms") > 0) & (F.col("ms") < MOST_MS))
    return fine.join(known.select("symbol").distinct(), "symbol", "left_semi").withColumn("source_ts_ns", F.col("ms") * 1_000_000).drop("ms")


def trades(frames: DataFrame, instruments: DataFrame, text: str = "text") -> DataFrame:
    """Trades of `trades` frames: symbol, channel, instrument_id, price, size, side (buy, sell or unknown), trade_id, source_ts_ns."""
    f = frames.select(F.from_json(text, _TRADES).alias("f")).where("f.channel = 'trades'").select(F.explode("f.data").alias("t"))
    side = F.when(F.col("t.side") == "B", "buy").when(F.col("t.side") == "A", "sell").otherwise("unknown")
    made = f.select(F.col("t.coin").alias("symbol"), guarded(F.col("t.px")).alias("price"), guarded(F.col("t.sz")).alias("size"), side.alias("side"), F.col("t.tid").alias("trade_id"), F.col("t.time").alias("ms"))
    fine = made.where("price is not null and size is not null").where((F.col("ms") > 0) & (F.col("ms") < MOST_MS))
    return fine.join(instruments.select("symbol", "channel", "instrument_id"), "symbol").withColumn("source_ts_ns", F.col("ms") * 1_000_000).drop("ms")


def fills(frames: DataFrame, instruments: DataFrame, text: str = "text") -> DataFrame:
    """Trades of the second feed: price = quote / base amount, whole seconds; a bad fill is skipped, its frame's others are not."""
    f = frames.select(F.from_json(text, _FILLS).alias("f")).where("f.channel = 'trades' and f.symbol is not null").select(F.col("f.symbol").alias("symbol"), F.explode("f.trades").alias("t"))
    t = f.select("symbol", F.from_json("t", _FILL).alias("t"))
    base, quote = guarded(F.col("t.baseAmount").cast("string")), guarded(F.col("t.quoteAmount").cast("string"))
    side = F.when(F.col("t.side") == "bid", "buy").when(F.col("t.side") == "ask", "sell").otherwise("unknown")
    seconds = F.substring_index("t.timestamp", ".", 1).try_cast("long")
    made = t.select("symbol", F.when(base > 0, quote / base).alias("price"), base.alias("size"), side.alias("side"), F.col("t.tradeSequenceNumber").try_cast("long").alias("trade_id"), F.when((seconds >= 0) & (seconds < MOST_S), seconds * 1_000_000_000).otherwise(0).alias("source_ts_ns"))
    return made.where("price is not null and trade_id is not null").join(instruments.select("symbol", "channel", "instrument_id"), "symbol")


def subscribed_codes(status: DataFrame, text: str = "text") -> DataFrame:
    """code: group codes of a status document (an array of entries). Tokens are `code` or `s:code`; other roles are left out.

    A document whose entries all lack the key says nothing: `known` is false on its one row without a code. An empty list is known and has no code.
    """
    entries = status.select(F.monotonically_increasing_id().alias("doc"), F.from_json(text, "array<map<string,string>>").alias("e")).where("e is not null")
    has = F.exists("e", lambda m: F.map_contains_key(m, "multicast_groups"))
    known = (F.size("e") == 0) | has
    tokens = F.flatten(F.transform("e", lambda m: F.split(F.coalesce(F.try_element_at(m, F.lit("multicast_groups")), F.lit("")), ",")))
    parts = entries.select("doc", known.alias("known"), F.explode_outer(F.transform(tokens, lambda x: F.trim(x))).alias("token"))
    role, code = F.lower(F.substring_index("token", ":", 1)), F.when(F.contains("token", F.lit(":")), F.expr("substring(token, instr(token, ':') + 1)")).otherwise(F.col("token"))
    fits = (F.col("token") != "") & (~F.contains("token", F.lit(":")) | (role == "s")) & (code != "")
    return parts.where(fits | ~F.col("known")).select("known", F.when(fits, code).alias("code")).distinct()


def group_addresses(groups: DataFrame, text: str = "text") -> DataFrame:
    """code, address of the activated groups of a group list."""
    rows = groups.select(F.explode(F.from_json(text, "array<struct<code:string,multicast_ip:string,status:string>>")).alias("g"))
    return rows.where(F.lower("g.status") == "activated").select("g.code", F.col("g.multicast_ip").alias("address"))


def leader_slots(schedules: DataFrame, text: str = "text") -> DataFrame:
    """slot, leader of schedules (first_slot, text: a map from leader to its slots relative to the first)."""
    by_leader = schedules.select("first_slot", F.explode(F.from_json(text, "map<string,array<bigint>>")).alias("leader", "slots"))
    return by_leader.select(F.explode(F.transform("slots", lambda s: F.col("first_slot") + s)).alias("slot"), "leader")


def with_leader(packets: DataFrame, slots: DataFrame) -> DataFrame:
    """packets with the leader of their slot; null where none is known, which fails closed later on."""
    return packets.join(slots, "slot", "left")
