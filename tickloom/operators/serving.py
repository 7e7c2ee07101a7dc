"""Serving and control queries over small dimensions: feeds, receivers, channels, and the verdicts shown to operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANKED = ("top_of_book", "market_by_price")


def select_feeds(feeds: DataFrame, venues: Sequence[str] = (), ports: Sequence[int] = ()) -> DataFrame:
    """Feeds of the named venues (in any case) with one of the ports; an empty selection takes all. Names and ports that no feed has are an error."""
    for column, wanted in ((F.upper("venue"), [v.upper() for v in venues]), (F.col("port"), list(ports))):
        if wanted:
            known = {r[0] for r in feeds.where(column.isin(wanted)).select(column).distinct().collect()}
            if lacking := sorted(set(wanted) - known):
                raise ValueError(f"no feed has {lacking}")
            feeds = feeds.where(column.isin(wanted))
    return feeds


def feed_kinds(instruments: DataFrame, books: DataFrame, depths: DataFrame, feeds: DataFrame) -> DataFrame:
    """instruments with feed_kind: by the book that is held, else by a depth of the symbol, else the only kind its universe has, else unknown."""
    only = feeds.groupBy("venue", "category").agg(F.min("kind").alias("_least"), F.max("kind").alias("_most"))
    found = instruments.join(books.select("instrument_id", "order_level"), "instrument_id", "left").join(depths.select("venue", "symbol", F.lit(True).alias("_depth")), ["venue", "symbol"], "left")
    found = found.join(only, ["venue", "category"], "left")
    kind = (
        F.when(F.col("order_level"), "market_by_order").when(~F.col("order_level"), "market_by_price").when(F.col("_depth"), "market_by_order")
        .when(F.col("_least") == F.col("_most"), F.col("_least")).otherwise("unknown")
    )
    return found.withColumn("feed_kind", kind).drop("order_level", "_depth", "_least", "_most")


def best_bid_ask(products: DataFrame, best: DataFrame, depth_best: DataFrame) -> DataFrame:
    """Inside market of every product that has one: from its price-level book, else from the depth of its symbol if the symbol is its own."""
    own = products.join(best, "instrument_id", "left")
    side = depth_best.select("venue", "symbol", *[F.col(c).alias("d_" + c) for c in ("bid", "bid_size", "ask", "ask_size")])
    both = own.join(side, ["venue", "symbol"], "left")
    from_book = F.col("bid").isNotNull() | F.col("ask").isNotNull()
    pick = lambda c: F.when(from_book, F.col(c)).when(~F.col("ambiguous"), F.col("d_" + c)).alias(c)
    found = both.select("product_id", *[pick(c) for c in ("bid", "bid_size", "ask", "ask_size")])
    return found.where("bid is not null or ask is not null")


def venue_health(receivers: DataFrame) -> DataFrame:
    """Per venue up: any receiver of a kind that carries quotes, or any at all if the venue has none of these. Liveness 0 is up."""
    carries, up = F.col("kind").isin("top_of_book", "midpoint"), F.col("liveness") == 0
    return receivers.groupBy("venue").agg(F.when(F.bool_or(carries), F.bool_or(carries & up)).otherwise(F.bool_or(up)).alias("up"), F.count(F.lit(1)).alias("receivers"))


def health_edges(health: DataFrame, order: str) -> DataFrame:
    """The rows at which a venue's health turns: status messages. The first row of a venue counts as a turn."""
    before = F.lag("up").over(W.partitionBy("venue").orderBy(order))
    return health.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col("up"))).drop("_before")


def diagnosis(detection: Column, delivering: Column, session_up: Column, session_known: Column, subscribed: Column, receivers: Column) -> Column:
    """The first rung of the ladder that fits."""
    traffic = lambda fine: F.when(receivers == 0, "no_receivers_running").when(~delivering, "subscribed_no_traffic").otherwise(fine)
    return (
        F.when(detection == "pending", "pending").when(detection == "cli_missing", "cli_missing").when(detection == "unavailable", "daemon_unreachable")
        .when(detection == "gating_disabled", traffic("gating_disabled")).when(~delivering & ~session_up, F.when(session_known, "tunnel_down").otherwise("tunnel_state_unknown"))
        .when(~subscribed, "no_market_data_subscriptions").otherwise(traffic("ok"))
    )


def classify_codes(codes: DataFrame, feeds: DataFrame, shred_prefix: str) -> DataFrame:
    """codes with class: market (a feed has it), shred (by prefix) or other."""
    known = feeds.select("code").distinct().withColumn("_known", F.lit(True))
    kind = F.when(F.col("_known"), "market").when(F.col("code").startswith(shred_prefix), "shred").otherwise("other")
    return codes.join(known, "code", "left").withColumn("class", kind).drop("_known")


def drop_preview(channels: DataFrame, still_admitted: DataFrame) -> DataFrame:
    """Channels that are admitted now, hold products, and that the new filter doesn't admit."""
    return channels.where("allowed and products > 0").join(still_admitted.where("admitted").select("code", "channel").distinct(), ["code", "channel"], "left_anti")


def reconcile(current: DataFrame, desired: DataFrame, key: Sequence[str]) -> DataFrame:
    """What to do so that `desired` runs: spawn the keys it has alone, abort those that only `current` has."""
    spawn = desired.select(*key).subtract(current.select(*key)).withColumn("action", F.lit("spawn"))
    return spawn.unionByName(current.select(*key).subtract(desired.select(*key)).withColumn("action", F.lit("abort")))


def purge_channels(rows: DataFrame, departed: DataFrame, key: Sequence[str] = ("source_id", "category", "channel")) -> DataFrame:
    """rows without those of departed channels, in their own universe only."""
    return rows.join(departed.select(*key).distinct(), list(key), "left_anti")


def expand_publishers(rows: DataFrame) -> DataFrame:
    """One publisher a channel: ranges lo to hi of each row expanded, ports = base + channel; a channel listed twice counts once.

    overflow: the port lies beyond 65,535 and is null.
    """
    each = rows.select("venue", "category", "base", F.explode(F.sequence("lo", "hi")).alias("channel")).distinct()
    port = F.col("base") + F.col("channel")
    return each.withColumn("overflow", port > 65535).withColumn("port", F.when(port <= 65535, port))


def registry_violations(feeds: DataFrame) -> DataFrame:
    """rule, venue, detail: every row of the registry that breaks a rule of it."""
    def found(df: DataFrame, rule: str, detail: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), "venue", detail.alias("detail"))

    twice = feeds.groupBy("venue", "category", "kind").count().where("count > 1")
    modes = feeds.groupBy("venue").agg(F.min("arbitration").alias("a"), F.max("arbitration").alias("b")).where("a <> b")
    trades = feeds.where(F.col("emit_trades") != F.col("kind").isin(*RANKED))
    orders = feeds.where("kind = 'market_by_order'").groupBy("venue").agg(F.min("category").alias("a"), F.max("category").alias("b")).where("a <> b")
    ports = feeds.groupBy("venue", "grp", "port").count().where("count > 1")
    return (
        found(twice, "duplicate_row", F.concat_ws("/", "category", "kind")).unionByName(found(modes, "arbitration_disagrees", F.concat_ws("/", "a", "b")))
        .unionByName(found(trades, "emit_trades_disagrees", F.concat_ws("/", "category", "kind"))).unionByName(found(orders, "orders_in_two_categories", F.concat_ws("/", "a", "b")))
        .unionByName(found(ports, "port_used_twice", F.concat_ws("/", "grp", F.col("port").cast("string"))))
    )


def status(instruments: DataFrame, health: DataFrame, bars: DataFrame) -> DataFrame:
    """One row a venue: up, receivers, products in the catalog, and products with history."""
    known = instruments.groupBy("venue").agg(F.count(F.lit(1)).alias("products"))
    held = bars.groupBy("venue").agg(F.count_distinct("instrument_id").alias("with_history"))
    all_ = known.join(health, "venue", "full").join(held, "venue", "full")
    return all_.select("venue", "up", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("receivers", "products", "with_history")])
