"""Domain tables derived from the TPC-H-like tables and `events`, with integer arithmetic only so that SQL elsewhere agrees.

Every stream has an explicit total order; nothing relies on the order of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def floor_div(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("long")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade an event: arrival_seq, key columns, price, size, source_us."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("arrival_seq"), (1 + F.col("user_id") % 3).alias("source_id"), (F.col("user_id") % 4).alias("channel"), F.col("user_id").alias("instrument_id"),
        F.col("event_type").alias("symbol"), F.col("value").alias("price"), (1 + F.col("event_id") % 7).alias("size"), micros(F.col("ts")).alias("source_us"),
    )


def late_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades with an arrival of their own, up to three hours after their time: arrival_us, then arrival_seq, is their order."""
    return trades(spark, sf_dir).withColumn("arrival_us", F.col("source_us") + F.col("arrival_seq") * 7919 % 10800 * 1_000_000)


def mirrored(spark: SparkSession, sf_dir: str, publishers: int = 3) -> DataFrame:
    """The trades as several publishers deliver them: some dropped, each late by its own lag, ticks of ten minutes; ordered by (recv_us, publisher, event_id)."""
    pub = trades(spark, sf_dir).withColumn("publisher", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(publishers - 1).cast("long"))))
    pub = pub.where((F.col("arrival_seq") + F.col("publisher")) % 11 != 0)
    pub = pub.withColumn("recv_us", F.col("source_us") + (F.col("arrival_seq") * 7919 + F.col("publisher") * 104729) % 900 * 1_000_000)
    return pub.withColumn("tick", floor_div(F.col("source_us"), 600_000_000)).withColumnRenamed("arrival_seq", "event_id")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote a line item: symbol (brand), publisher, source_us (0: unknown), recv_us, bid, ask, sizes, counts; ordered by recv_us and the key columns."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    day = micros(F.col("l_shipdate"))
    recv = day + (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 900 * 1_000_000
    # some quotes have no time, some one from the future
    source = F.when(F.col("l_orderkey") % 97 == 0, 0).when(F.col("l_orderkey") % 89 == 0, recv + 10_000_000).otherwise(day)
    bid, ask = F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice") * (1 + F.col("l_tax"))
    return li.join(part, "l_partkey").select(
        "symbol", (F.col("l_suppkey") % 3).alias("publisher"), source.cast("long").alias("source_us"), recv.alias("recv_us"), bid.alias("bid"), ask.alias("ask"),
        F.col("l_quantity").alias("bid_size"), F.col("l_quantity").alias("ask_size"), F.col("l_linenumber").alias("bid_n"), F.col("l_linenumber").alias("ask_n"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


QUOTE_ORDER = ["recv_us", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "bid"]


def sources(spark: SparkSession) -> DataFrame:
    """The registered sources: id and name."""
    return spark.createDataFrame([(1, "ALPHA"), (2, "BETA")], "source_id long, name string")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instrument a part: its key (source_id, category, channel, instrument_id), symbol, exponents and venue."""
    p = table(spark, sf_dir, "part")
    source_id = 1 + F.col("p_partkey") % 3
    return p.select(
        F.col("p_partkey").alias("instrument_id"), (F.col("p_size") % 32).cast("long").alias("channel"), source_id.alias("source_id"), F.when(F.col("p_partkey") % 2 == 0, "perp").otherwise("sport").alias("category"),
        F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(F.concat_ws("-", "p_name", F.col("p_partkey").cast("string"))).alias("symbol"),
        F.lit(-2).alias("price_exponent"), F.lit(0).alias("qty_exponent"), F.when(source_id == 1, "ALPHA").when(source_id == 2, "BETA").otherwise(F.concat(F.lit("SOURCE_"), source_id.cast("string"))).alias("venue"),
    )


def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds, executions and cancels of orders: instrument_id, order_id, side, price, seq_kind (0 add, 1 execute, 2 cancel), seq_no and qty."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    whole = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("whole"))
    head = o.select("o_orderkey", (F.col("o_custkey") % 16).alias("instrument_id"), F.when(F.col("o_orderkey") % 2 == 0, "bid").otherwise("ask").alias("side"), floor_div(F.col("o_totalprice"), 1000).alias("price"), "o_orderstatus")
    key = ["instrument_id", F.col("o_orderkey").alias("order_id"), "side", "price"]
    adds = head.join(whole, "o_orderkey", "left").select(*key, F.lit(0).alias("seq_kind"), F.lit(0).cast("long").alias("seq_no"), (F.coalesce("whole", F.lit(0.0)) + F.col("o_orderkey") % 5).cast("long").alias("qty"))
    fills = li.where("l_linenumber >= 2").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq_no"), F.col("l_quantity").alias("q"))
    fills = fills.groupBy("o_orderkey", "seq_no").agg(F.sum("q").cast("long").alias("qty"))
    executes = head.join(fills, "o_orderkey").select(*key, F.lit(1).alias("seq_kind"), "seq_no", "qty")
    cancels = head.where("o_orderstatus = 'F' and o_orderkey % 9 = 0").select(*key, F.lit(2).alias("seq_kind"), F.lit(0).cast("long").alias("seq_no"), F.lit(0).cast("long").alias("qty"))
    return adds.unionByName(executes).unionByName(cancels)


def level_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute sizes of price levels, one a line item: instrument_id, side, price, qty (0 deletes), ordered by `LEVEL_ORDER`."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 16).alias("instrument_id"), F.when(F.col("l_linenumber") % 2 == 0, "bid").otherwise("ask").alias("side"), floor_div(F.col("l_extendedprice"), 100).alias("price"),
        F.when(F.col("l_orderkey") % 5 == 0, 0).otherwise(F.col("l_quantity")).cast("long").alias("qty"), micros(F.col("l_shipdate")).alias("ship_us"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


LEVEL_ORDER = ["ship_us", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receiver a supplier: venue, category, kind, port and liveness (0 up, 1 unregistered, 2 down)."""
    kinds = F.array(*map(F.lit, ("top_of_book", "market_by_price", "market_by_order", "midpoint")))
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("V"), (F.col("s_nationkey") % 5).cast("string")).alias("venue"), F.when(F.col("s_suppkey") % 2 == 0, "perp").otherwise("sport").alias("category"),
        F.get(kinds, F.floor(F.col("s_suppkey") / 3).cast("int") % 4).alias("kind"), (7000 + F.col("s_suppkey")).alias("port"), (F.floor(F.col("s_suppkey") / 2) % 3).cast("int").alias("liveness"),
    )
