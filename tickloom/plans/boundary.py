"""Queries of the book at every datagram and as of a moment: price levels of `lineitem`, one market a supplier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import boundaries as b
from tickloom.sources.tables import HOUR_US, LEVEL_ORDER, level_updates, micros, table

MOMENT = ["ship_us", "l_orderkey"]
MONTH_US = 2_592_000_000_000


#: A market is a supplier, so l_suppkey orders nothing within it.
ORDER = [c for c in LEVEL_ORDER if c != "l_suppkey"]


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_updates(spark, sf_dir).withColumn("instrument_id", F.col("l_suppkey"))


def _month(at: Column) -> Column:
    return F.floor(at / MONTH_US)


def best_at_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.best_of(_updates(spark, sf_dir), MOMENT, ORDER, _month(F.col("ship_us")))


def depth_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best levels of each side after every datagram, added up, and whether they have to be published again."""
    depth = b.book_of(_updates(spark, sf_dir), MOMENT, ORDER, _month(F.col("ship_us")))
    total = lambda side: F.aggregate(side, F.lit(0).cast("long"), lambda t, x: t + x["size"])
    worst = lambda side: F.get(side, F.size(side) - 1)["price"]
    return depth.select("instrument_id", *MOMENT, "ord", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), total("bids").alias("bid_depth"), total("asks").alias("ask_depth"), worst("bids").alias("worst_bid"), worst("asks").alias("worst_ask"), "published")


def book_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best prices at a moment within two days of each line's: those after the market's last datagram until then."""
    li = table(spark, sf_dir, "lineitem")
    moment = micros(F.col("l_shipdate")) + ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 97 - 48) * HOUR_US
    asked = li.select(F.col("l_suppkey").alias("instrument_id"), moment.alias("at_us"), F.col("l_orderkey").alias("for_order"), "l_linenumber", "l_partkey")
    return b.best_as_of(asked, _updates(spark, sf_dir), MOMENT, ORDER, "at_us", _month)


def queries() -> dict:
    return {f.__name__: f for f in (best_at_boundaries, depth_changes, book_as_of)}


_LIVES = """lu AS (SELECT l_suppkey AS instrument_id, CASE WHEN l_linenumber % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, cast(floor(l_extendedprice / 100) AS BIGINT) AS price,
  cast(CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_quantity END AS BIGINT) AS qty, epoch_us(l_shipdate) AS ship_us, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
bd AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ship_us, l_orderkey) - 1 AS ord FROM (SELECT DISTINCT instrument_id, ship_us, l_orderkey FROM lu)),
lv AS (SELECT instrument_id, side, price, ord, arg_max(qty, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS size FROM lu JOIN bd USING (instrument_id, ship_us, l_orderkey) GROUP BY ALL),
lf AS (SELECT *, lead(ord) OVER (PARTITION BY instrument_id, side, price ORDER BY ord) AS ends FROM lv),
al AS (SELECT bd.instrument_id, bd.ship_us, bd.l_orderkey, bd.ord, side, price, size FROM bd LEFT JOIN lf ON lf.instrument_id = bd.instrument_id AND lf.ord <= bd.ord AND (ends IS NULL OR bd.ord < ends) AND size > 0)"""
_BEST = f"""{_LIVES}, be AS (SELECT instrument_id, ship_us, l_orderkey, ord, max(price) FILTER (side = 'bid') AS bid, arg_max(size, price) FILTER (side = 'bid') AS bid_size, min(price) FILTER (side = 'ask') AS ask, arg_min(size, price) FILTER (side = 'ask') AS ask_size,
  coalesce(max(price) FILTER (side = 'bid') > min(price) FILTER (side = 'ask'), false) AS crossed FROM al GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "best_at_boundaries": f"WITH {_BEST} SELECT * FROM be",
        "depth_changes": f"""WITH {_LIVES}, de AS (SELECT instrument_id, ship_us, l_orderkey, ord, coalesce(list([price, size] ORDER BY price DESC) FILTER (side = 'bid'), [])[:10] AS bids, coalesce(list([price, size] ORDER BY price) FILTER (side = 'ask'), [])[:10] AS asks FROM al GROUP BY ALL),
p AS (SELECT *, lag([bids, asks]) OVER (PARTITION BY instrument_id ORDER BY ord) AS before FROM de)
SELECT instrument_id, ship_us, l_orderkey, ord, len(bids)::INTEGER AS n_bids, len(asks)::INTEGER AS n_asks, coalesce(list_sum(list_transform(bids, lambda x: x[2])), 0)::BIGINT AS bid_depth, coalesce(list_sum(list_transform(asks, lambda x: x[2])), 0)::BIGINT AS ask_depth,
  bids[-1][1] AS worst_bid, asks[-1][1] AS worst_ask, before IS NULL OR before <> [bids, asks] AS published FROM p""",
        "book_as_of": f"""WITH {_BEST}, q AS (SELECT l_suppkey AS instrument_id, epoch_us(l_shipdate) + ((l_orderkey * 7919 + l_linenumber * 104729) % 97 - 48) * 3600000000 AS at_us, l_orderkey AS for_order, l_linenumber, l_partkey FROM lineitem),
k AS (SELECT instrument_id, ship_us, max(ord) AS ord FROM bd GROUP BY ALL)
SELECT q.*, bid, bid_size, ask, ask_size, coalesce(crossed, NULL) AS crossed FROM q ASOF LEFT JOIN k ON q.instrument_id = k.instrument_id AND q.at_us >= k.ship_us LEFT JOIN be ON be.instrument_id = k.instrument_id AND be.ord = k.ord""",
    }
