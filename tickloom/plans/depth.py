"""Queries over order books: order flow of `orders` and `lineitem`, price levels of `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import books as b
from tickloom.sources.tables import LEVEL_ORDER, level_updates, order_flow, table


def l3_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.order_book(order_flow(spark, sf_dir))


def l3_order_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.order_set(l3_book(spark, sf_dir)).select("instrument_id", "order_id", "nth")


def l3_price_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.price_fold(l3_book(spark, sf_dir))


def l3_top_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.top_levels(l3_price_fold(spark, sf_dir))


def l3_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.prints(order_flow(spark, sf_dir))


def l4_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.order_diffs(order_flow(spark, sf_dir))


def l3_valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of an order as its sequence: those up to the first that is missing."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3).alias("publisher"), "l_orderkey", F.col("l_linenumber").cast("long").alias("seq"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("seq_place"), "l_partkey")
    return b.valid_prefix(li, ["publisher", "l_orderkey"], "seq").select("publisher", "l_orderkey", "seq", "l_partkey")


def l2_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.level_book(level_updates(spark, sf_dir), LEVEL_ORDER)


def l2_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.best(l2_book(spark, sf_dir))


def l2_crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.crossed(l2_book(spark, sf_dir))


def accumulator_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.fold_with_clears(level_updates(spark, sf_dir), LEVEL_ORDER, F.col("l_orderkey") % 499 == 0)


def outward_clears(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some updates clear their side instead, some what lies at their price or further out."""
    action = F.when(F.col("l_orderkey") % 997 == 0, "clear").when(F.col("l_orderkey") % 101 == 0, "clear_from").otherwise("set")
    return b.fold_with_outward_clears(level_updates(spark, sf_dir).withColumn("action", action), LEVEL_ORDER, F.floor(F.col("ship_us") / 2_592_000_000_000))


def book_rebaseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.rebaseline(l2_book(spark, sf_dir))


def sigfig_l2book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.bucketed_levels(l3_price_fold(spark, sf_dir), 2, 1, 20, 100_000_000)


def sigfig_l2book_mantissa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.bucketed_levels(l3_price_fold(spark, sf_dir), 3, 5, 10, 100_000_000)


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots of two markets, one a thousand orders; every third promises a level more than it brings."""
    o = table(spark, sf_dir, "orders")
    k = F.floor(F.col("o_orderkey") / 1000).cast("long")
    rows = o.select((k * 2 + F.col("o_custkey") % 2).alias("snapshot_id"), (F.col("o_custkey") % 2).alias("instrument_id"), (k * 1000).alias("last_seq"), F.when(F.col("o_orderkey") % 2 == 0, "bid").otherwise("ask").alias("side"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("price"), (1 + F.col("o_orderkey") % 7).alias("qty"))
    levels = rows.groupBy("snapshot_id", "side", "price").agg(F.sum("qty").cast("long").alias("size"))
    begins = rows.groupBy("snapshot_id", "instrument_id", "last_seq").agg((F.count_distinct("side", "price") + (F.col("snapshot_id") % 3 == 0).cast("long")).alias("total"))
    return begins, levels


def snapshots_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.complete_snapshots(*_snapshots(spark, sf_dir))


def l2_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = level_updates(spark, sf_dir).select((F.col("l_suppkey") % 2).alias("instrument_id"), F.col("l_orderkey").alias("seq"), "side", F.floor(F.col("price") / 10).cast("long").alias("price"), "qty", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq_place"))
    return b.recovered(*_snapshots(spark, sf_dir), deltas)


def level_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that are left if a reset empties the book of its market."""
    u = level_updates(spark, sf_dir)
    cut = b.epochs(u, ["instrument_id"], LEVEL_ORDER, F.floor(F.col("ship_us") / 2_592_000_000_000), F.col("l_orderkey") % 701 == 0)
    last = cut.groupBy("instrument_id").agg(F.max("epoch").alias("epoch"))
    return b.level_book(cut.join(last, ["instrument_id", "epoch"]), LEVEL_ORDER)


def queries() -> dict:
    every = (snapshots_complete, l2_recovered, level_epochs, l3_book, l3_order_set, l3_price_fold, l3_top_levels, l3_prints, l4_diffs, l3_valid_prefix, l2_book, l2_best, l2_crossed, accumulator_fold, outward_clears, book_rebaseline, sigfig_l2book, sigfig_l2book_mantissa)
    return {f.__name__: f for f in every}


_FLOW = """w AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS whole FROM lineitem GROUP BY 1),
h AS (SELECT o_orderkey, o_custkey % 16 AS instrument_id, CASE WHEN o_orderkey % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, cast(floor(o_totalprice / 1000) AS BIGINT) AS price, o_orderstatus FROM orders),
fl AS (SELECT instrument_id, o_orderkey AS order_id, side, price, 0 AS seq_kind, 0::BIGINT AS seq_no, cast(coalesce(whole, 0) + o_orderkey % 5 AS BIGINT) AS qty FROM h LEFT JOIN w USING (o_orderkey)
  UNION ALL SELECT instrument_id, o_orderkey, side, price, 1, l_linenumber * 1000000 + l_partkey, cast(sum(l_quantity) AS BIGINT) FROM h JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber >= 2 GROUP BY ALL
  UNION ALL SELECT instrument_id, o_orderkey, side, price, 2, 0, 0 FROM h WHERE o_orderstatus = 'F' AND o_orderkey % 9 = 0)"""
_BOOK = f"""{_FLOW}, bk AS (SELECT instrument_id, order_id, side, price, cast(sum(CASE seq_kind WHEN 0 THEN qty WHEN 1 THEN -qty ELSE 0 END) AS BIGINT) AS size FROM fl
  GROUP BY ALL HAVING max(seq_kind) < 2 AND sum(CASE seq_kind WHEN 0 THEN qty WHEN 1 THEN -qty ELSE 0 END) > 0)"""
_FOLD = f"{_BOOK}, fd AS (SELECT instrument_id, side, price, cast(sum(size) AS BIGINT) AS size, count(*) AS n FROM bk GROUP BY ALL)"
_PLACE = "(ship_us, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_LEVELS = """lu AS (SELECT l_suppkey % 16 AS instrument_id, CASE WHEN l_linenumber % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, cast(floor(l_extendedprice / 100) AS BIGINT) AS price,
  cast(CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_quantity END AS BIGINT) AS qty, epoch_us(l_shipdate) AS ship_us, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"""
_L2 = f"{_LEVELS}, lv AS (SELECT * FROM (SELECT instrument_id, side, price, arg_max(qty, {_PLACE}) AS size FROM lu GROUP BY ALL) WHERE size > 0)"
_BEST = "instrument_id, max(price) FILTER (side = 'bid') AS bid, arg_max(size, price) FILTER (side = 'bid') AS bid_size, min(price) FILTER (side = 'ask') AS ask, arg_min(size, price) FILTER (side = 'ask') AS ask_size"


def _sigfig(n: int, mantissa: int, most: int) -> str:
    return f"""WITH {_FOLD}, i AS (SELECT *, price * 100000000 AS v, cast(pow(10, greatest(0, length(cast(price * 100000000 AS VARCHAR)) - {n})) AS BIGINT) * {mantissa} AS inc FROM fd),
k AS (SELECT instrument_id, side, CASE WHEN side = 'bid' OR v % inc = 0 THEN v - v % inc ELSE v - v % inc + inc END AS price, cast(sum(size) AS BIGINT) AS size, cast(sum(n) AS BIGINT) AS n FROM i GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS nth FROM k) WHERE nth <= {most}"""


_SNAPSHOTS = """sn AS (SELECT k * 2 + o_custkey % 2 AS snapshot_id, o_custkey % 2 AS instrument_id, k * 1000 AS last_seq, CASE WHEN o_orderkey % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, cast(floor(o_totalprice / 1000) AS BIGINT) AS price, 1 + o_orderkey % 7 AS qty
  FROM (SELECT *, cast(floor(o_orderkey / 1000) AS BIGINT) AS k FROM orders)),
ok AS (SELECT snapshot_id, instrument_id, last_seq, count(DISTINCT (side, price)) AS total FROM sn GROUP BY ALL HAVING snapshot_id % 3 > 0)"""


def oracle_sql() -> dict[str, str]:
    first = "CASE side WHEN 'bid' THEN 0 ELSE 1 END, CASE side WHEN 'bid' THEN -price ELSE price END"
    return {
        "snapshots_complete": f"WITH {_SNAPSHOTS} SELECT * FROM ok",
        "l2_recovered": f"""WITH {_SNAPSHOTS}, {_LEVELS}, la AS (SELECT instrument_id, max(snapshot_id) AS snapshot_id, max(last_seq) AS last_seq FROM ok GROUP BY instrument_id),
d AS (SELECT l_suppkey % 2 AS instrument_id, l_orderkey AS seq, side, cast(floor(price / 10) AS BIGINT) AS price, qty, row_number() OVER (PARTITION BY l_suppkey % 2, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lu),
g AS (SELECT d.instrument_id, seq - last_seq AS seq, side, price, qty, row_number() OVER (PARTITION BY d.instrument_id ORDER BY seq) AS n FROM d JOIN la USING (instrument_id) WHERE k = 1 AND seq > last_seq),
u AS (SELECT instrument_id, seq, side, price, qty FROM g WHERE seq = n UNION ALL SELECT la.instrument_id, 0, side, price, cast(sum(qty) AS BIGINT) FROM sn JOIN la USING (snapshot_id) GROUP BY ALL),
b AS (SELECT instrument_id, side, price, arg_max(qty, seq) AS size FROM u GROUP BY ALL)
SELECT b.*, (SELECT coalesce(max(seq), 0) FROM u WHERE u.instrument_id = b.instrument_id) AS applied FROM b WHERE size > 0""",
        "level_epochs": f"""WITH {_LEVELS}, e AS (SELECT *, count(*) FILTER (l_orderkey % 701 = 0) OVER (PARTITION BY instrument_id ORDER BY ship_us, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS epoch FROM lu),
m AS (SELECT *, max(epoch) OVER (PARTITION BY instrument_id) AS newest FROM e)
SELECT * FROM (SELECT instrument_id, side, price, arg_max(qty, {_PLACE}) AS size FROM m WHERE epoch = newest GROUP BY ALL) WHERE size > 0""",
        "l3_book": f"WITH {_BOOK} SELECT * FROM bk",
        "l3_order_set": f"WITH {_BOOK} SELECT instrument_id, order_id, row_number() OVER (PARTITION BY instrument_id ORDER BY {first}, order_id) AS nth FROM bk",
        "l3_price_fold": f"WITH {_FOLD} SELECT * FROM fd",
        "l3_top_levels": f"""WITH {_FOLD} SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY instrument_id, side) AS levels,
  row_number() OVER (PARTITION BY instrument_id, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS nth FROM fd) WHERE nth <= 10""",
        "l3_prints": f"WITH {_FLOW} SELECT instrument_id, order_id, seq_no, side, price, qty AS size, 0::BIGINT AS cumulative, false AS owns_tape FROM fl WHERE seq_kind = 1",
        "l4_diffs": f"""WITH {_FLOW}, s AS (SELECT *, CASE WHEN seq_kind = 2 THEN 0 ELSE greatest(0, sum(CASE seq_kind WHEN 0 THEN qty WHEN 1 THEN -qty ELSE 0 END) OVER (PARTITION BY instrument_id, order_id ORDER BY seq_kind, seq_no ROWS UNBOUNDED PRECEDING)) END AS size FROM fl),
p AS (SELECT *, lag(size) OVER (PARTITION BY instrument_id, order_id ORDER BY seq_kind, seq_no) AS before FROM s),
d AS (SELECT *, CASE WHEN size = 0 THEN 'remove' WHEN before > 0 THEN 'update' ELSE 'new' END AS diff FROM p)
SELECT instrument_id, order_id, seq_kind, seq_no, diff, cast(CASE WHEN diff = 'update' THEN before END AS BIGINT) AS orig_size, cast(size AS BIGINT) AS size FROM d""",
        "l3_valid_prefix": """WITH o AS (SELECT * FROM (SELECT l_orderkey % 3 AS publisher, l_orderkey, cast(l_linenumber AS BIGINT) AS seq, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1)
SELECT publisher, l_orderkey, seq, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY publisher, l_orderkey ORDER BY seq) AS n FROM o) WHERE n = seq""",
        "l2_book": f"WITH {_L2} SELECT * FROM lv",
        "l2_best": f"WITH {_L2} SELECT {_BEST} FROM lv GROUP BY instrument_id",
        "l2_crossed": f"WITH {_L2}, x AS (SELECT {_BEST} FROM lv GROUP BY instrument_id) SELECT instrument_id, coalesce(bid > ask, false) AS crossed FROM x",
        "accumulator_fold": f"""WITH {_LEVELS}, c AS (SELECT instrument_id, side, max({_PLACE}) AS since FROM lu WHERE l_orderkey % 499 = 0 GROUP BY ALL),
b AS (SELECT instrument_id, count(*) = 2 AS baselined FROM c GROUP BY instrument_id),
l AS (SELECT instrument_id, side, price, arg_max(qty, {_PLACE}) AS size FROM lu LEFT JOIN c USING (instrument_id, side) WHERE since IS NULL OR {_PLACE} >= since GROUP BY ALL)
SELECT instrument_id, side, price, size, coalesce(baselined, false) AS baselined FROM l LEFT JOIN b USING (instrument_id) WHERE size > 0""",
        "outward_clears": f"""WITH {_LEVELS}, c AS (SELECT instrument_id, side, {_PLACE} AS place, CASE WHEN l_orderkey % 997 = 0 THEN NULL ELSE price END AS bound FROM lu WHERE l_orderkey % 997 = 0 OR l_orderkey % 101 = 0),
u AS (SELECT instrument_id, side, price, arg_max(qty, {_PLACE}) AS size, max({_PLACE}) AS place FROM lu WHERE l_orderkey % 997 <> 0 AND l_orderkey % 101 <> 0 GROUP BY ALL)
SELECT instrument_id, side, price, size FROM u WHERE size > 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.instrument_id = u.instrument_id AND c.side = u.side AND c.place > u.place
  AND (bound IS NULL OR CASE u.side WHEN 'bid' THEN u.price <= bound ELSE u.price >= bound END))""",
        "book_rebaseline": f"""WITH {_L2}, s AS (SELECT instrument_id, row_number() OVER (PARTITION BY instrument_id ORDER BY {first}) AS ord, 'set' AS action, side, price, size FROM lv
  UNION ALL SELECT DISTINCT instrument_id, 0, 'clear', NULL, NULL, NULL FROM lv)
SELECT *, ord = max(ord) OVER (PARTITION BY instrument_id) AS "last" FROM s""",
        "sigfig_l2book": _sigfig(2, 1, 20),
        "sigfig_l2book_mantissa": _sigfig(3, 5, 10),
    }
