"""Queries over reference data, messages and the control plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import books as b
from tickloom.operators import candles as c
from tickloom.operators import dimensions as d
from tickloom.operators import serving as s
from tickloom.operators import wire
from tickloom.plans import depth, history
from tickloom.plans.ticks import TRADES_SQL
from tickloom.sources.tables import floor_div, instruments, micros, receivers, sources, table, trades

ARRIVAL_BUCKET = 10_000


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("source_id"), "s_suppkey")
    return d.source_labels(rows, sources(spark), ["s_suppkey"]).select("source_id", "label")


def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = instruments(spark, sf_dir).select("instrument_id", F.col("venue").alias("name"))
    return d.source_ids(rows, sources(spark).withColumnRenamed("source_id", "found"), "name").select("instrument_id", "name", F.col("found").alias("source_id"))


def channel_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    offset = F.when(F.col("instrument_id") % 2 == 0, 16)
    return instruments(spark, sf_dir).select("instrument_id", d.canonical_channel(F.col("channel"), offset).cast("long").alias("canonical"))


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).where("arrival_seq % 11 = 7")
    return t.select("instrument_id", "arrival_seq", (-(F.col("arrival_seq") % 4)).cast("int").alias("price_exponent"), (F.col("arrival_seq") % 2).cast("int").alias("qty_exponent"), "symbol", "source_id", "channel")


def precision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = trades(spark, sf_dir).where("arrival_seq % 11 <> 7").select("instrument_id", "arrival_seq", F.round(F.col("price") * 100).cast("long").alias("raw"))
    return d.precision_gate(prices, _definitions(spark, sf_dir), ["instrument_id"], "arrival_seq", floor_div(F.col("arrival_seq"), ARRIVAL_BUCKET)).select("arrival_seq", "instrument_id", "raw", "exponent", F.round("value", 6).alias("value"))


def manifest_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades(spark, sf_dir).select("channel", "arrival_seq", floor_div(F.col("arrival_seq"), 3000).alias("reset_count"), (F.col("arrival_seq") % 13 != 0).alias("valid"), (floor_div(F.col("arrival_seq"), 7) * 5003 % 65536).alias("seq"))
    return d.manifest_eras(rows, ["channel"], ["arrival_seq"], floor_div(F.col("arrival_seq"), ARRIVAL_BUCKET)).select("channel", "arrival_seq", "era")


def source_reveals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades(spark, sf_dir).select("instrument_id", "arrival_seq", F.when(F.col("arrival_seq") % 5 > 0, floor_div(F.col("arrival_seq"), 1000) % 3 + 1).alias("source_id"))
    return d.reveals(rows, ["instrument_id"], ["arrival_seq"], floor_div(F.col("arrival_seq"), ARRIVAL_BUCKET)).select("instrument_id", "arrival_seq", "source_id", "purged")


def catalog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.catalog(_definitions(spark, sf_dir), ["arrival_seq"], ["source_id", "channel", "instrument_id"])


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.product_ids(instruments(spark, sf_dir))


def product_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _products(spark, sf_dir).select("instrument_id", "ambiguous", "product_id")


def product_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol asked for by its bare id, by its full one, and in some malformed ways."""
    i = instruments(spark, sf_dir)
    bare, full = F.concat_ws(":", F.lower("venue"), "symbol"), F.concat(F.lit("#"), F.col("channel").cast("string"), F.lit("."), F.col("instrument_id").cast("string"))
    asked = F.array(bare, F.concat(bare, full), F.concat(bare, F.lit("#x")), F.col("symbol"), F.concat(bare, F.lit("-none")))
    return d.resolve(d.parse_ids(i.select(F.explode(asked).alias("id")).distinct()), i)


def products_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.page(_products(spark, sf_dir).select("product_id", *d.INSTRUMENT), 50, 100)


def symbol_prefix_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.symbol_prefixes(instruments(spark, sf_dir).withColumn("channel", F.col("channel") % 4))


def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    return asked.join(instruments(spark, sf_dir), "symbol").select("symbol", "channel", "instrument_id")


#: A client's subscriptions.
FILTERS = ({"venue": "alpha", "channel": 3}, {"source_name": "BETA", "type": "trade"}, {"symbol": "click", "channel": 1}, {"type": "status"})


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    venue = F.when(F.col("source_id") == 1, "ALPHA").when(F.col("source_id") == 2, "Beta").otherwise("SOURCE_3")
    kind = F.when(F.col("arrival_seq") % 9 == 0, "status").when(F.col("arrival_seq") % 2 == 0, "trade").otherwise("quote")
    return t.select("arrival_seq", venue.alias("venue"), kind.alias("type"), F.when(kind != "status", F.col("symbol")).alias("symbol"), F.when((kind != "status") & (F.col("arrival_seq") % 10 != 3), F.col("channel")).alias("channel"))


def subscription_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).where(d.subscription(FILTERS)).select("arrival_seq")


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = instruments(spark, sf_dir)
    return i.groupBy(F.col("venue").alias("code"), "channel").agg(F.count(F.lit(1)).alias("products"))


def _allowed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ALPHA", n) for n in (1, 2, 3, 5, 8)] + [("BETA", 7)], "code string, channel long")


def channel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.admitted(_channels(spark, sf_dir), _allowed(spark))


def drop_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _channels(spark, sf_dir).withColumn("allowed", F.col("channel") % 2 == 1)
    return s.drop_preview(now, d.admitted(now, _allowed(spark)))


def ts_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("recv_us", F.col("source_us") + (F.col("arrival_seq") % 8000 - 100) * 1_000_000)
    source = F.when(F.col("arrival_seq") % 6 == 0, 0).otherwise(F.col("source_us"))
    return t.select("arrival_seq", d.resolve_time(source, F.col("recv_us")).alias("us"))


def unattributable(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, other = d.attributable(trades(spark, sf_dir), _definitions(spark, sf_dir).where("instrument_id % 5 > 0"), ["source_id", "channel", "instrument_id"])
    count = lambda df, n: df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(n))
    return count(known, True).unionByName(count(other, False))


def numeric_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("c_custkey") % 7 == 0, "NaN").when(F.col("c_custkey") % 7 == 1, "x1").when(F.col("c_custkey") % 7 == 2, "Infinity").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", d.guarded(odd).alias("value"))


def latency_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    n = F.col("arrival_seq")
    source, kernel = F.when(n % 10 == 0, 0).otherwise(F.col("source_us")), F.when(n % 15 == 0, 0).otherwise(F.col("source_us") + n % 97)
    parts = d.latency_parts(source, kernel, F.col("source_us") + n % 97 + n % 31, F.col("source_us") + n % 97 + n % 31 + n % 17)
    return t.select("arrival_seq", *[x.cast("long").alias(k) for k, x in parts.items()])


def jq_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", wire.path(F.col("props"), ".k").alias("k"), wire.path(F.col("props"), ".none[0].x").alias("none"))


def message_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return wire.union(trade=t.select("arrival_seq", "symbol", "price"), definition=_definitions(spark, sf_dir).select("arrival_seq", "symbol", "price_exponent")).groupBy("type", "symbol").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("prices"), F.sum("price_exponent").cast("long").alias("exponents"))


def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments that both of two sources trade on."""
    t = trades(spark, sf_dir)
    return t.where("channel = 1").select("symbol", "instrument_id").intersect(t.where("source_id = 2").select("symbol", "instrument_id"))


def venue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.venue_health(receivers(spark, sf_dir))


def reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = receivers(spark, sf_dir)
    return s.reconcile(r.where("port % 3 > 0"), r.where("liveness < 2"), ["venue", "category", "kind", "port"])


def purged_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = instruments(spark, sf_dir)
    gone = spark.createDataFrame([(1, "perp", 4), (2, "sport", 9)], "source_id long, category string, channel long")
    return s.purge_channels(i, gone).groupBy("source_id", "category").agg(F.count(F.lit(1)).alias("n"))


def classify_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "shred-").otherwise("V"), (F.col("s_suppkey") % 9).cast("string")).alias("code")).distinct()
    return s.classify_codes(codes, receivers(spark, sf_dir).select(F.col("venue").alias("code")), "shred-")


def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    detection = F.get(F.array(*map(F.lit, ("pending", "cli_missing", "unavailable", "gating_disabled", "ok", "ok", "ok"))), (n % 7).cast("int"))
    bit = lambda k: F.floor(n / k) % 2 == 0
    return table(spark, sf_dir, "customer").select("c_custkey", s.diagnosis(detection, bit(7), bit(14), bit(28), bit(56), F.floor(n / 112) % 3).alias("code"))


def registry_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    base = F.when(F.col("n_nationkey") == 7, 65530).otherwise(7000 + 100 * F.col("n_nationkey"))
    rows = n.select(F.concat(F.lit("V"), (F.col("n_nationkey") % 5).cast("string")).alias("venue"), "n_name", F.col("n_regionkey").cast("string").alias("category"), base.cast("long").alias("base"), (F.col("n_nationkey") % 3).cast("long").alias("lo"), (F.col("n_nationkey") % 3 + 6).cast("long").alias("hi"))
    return s.expand_publishers(rows)


def registry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = receivers(spark, sf_dir)
    feeds = r.select("venue", "category", "kind", F.when(F.col("port") % 10 == 0, "quote").otherwise("book").alias("arbitration"), (F.col("port") % 4 == 0).alias("emit_trades"), (F.col("port") % 3).cast("string").alias("grp"), (F.col("port") % 20).alias("port"))
    return s.registry_violations(feeds)


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.accumulator_fold(spark, sf_dir)


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths by symbol, of brands: how many levels each side has."""
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("symbol")).agg((F.max("p_size") % 12).alias("bids"), (F.min("p_size") % 12).alias("asks"))


def book_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held(spark, sf_dir)
    return b.coverage(instruments(spark, sf_dir), held.drop("baselined"), held.groupBy("instrument_id").agg(F.bool_or("baselined").alias("baselined")), _depths(spark, sf_dir))


def feed_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = instruments(spark, sf_dir)
    books = i.where("instrument_id % 6 = 1").select("instrument_id", (F.col("instrument_id") % 12 == 1).alias("order_level"))
    depths = i.where("symbol like 'Brand#1%'").select("venue", "symbol").distinct()
    feeds = spark.createDataFrame([("ALPHA", "perp", "top_of_book"), ("BETA", "perp", "top_of_book"), ("BETA", "perp", "market_by_price"), ("BETA", "sport", "midpoint")], "venue string, category string, kind string")
    return s.feed_kinds(i, books, depths, feeds).select("instrument_id", "feed_kind")


def best_bid_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _products(spark, sf_dir)
    by_symbol = p.groupBy("venue", "symbol").agg(F.min("instrument_id").alias("bid"), F.lit(1).cast("long").alias("bid_size"), F.max("instrument_id").alias("ask"), F.lit(2).cast("long").alias("ask_size"))
    return s.best_bid_ask(p, b.best(depth.l2_book(spark, sf_dir)), by_symbol.where("bid % 3 > 0"))


def status_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = c.one_second_bars(trades(spark, sf_dir)).withColumn("venue", F.when(F.col("source_id") == 1, "ALPHA").when(F.col("source_id") == 2, "BETA").otherwise("SOURCE_3"))
    health = s.venue_health(receivers(spark, sf_dir).withColumn("venue", F.when(F.col("venue") == "V0", "ALPHA").otherwise(F.col("venue"))))
    return s.status(instruments(spark, sf_dir), health, bars)


def ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest trades of each product with the inside market of its instrument."""
    best = b.best(depth.l2_book(spark, sf_dir))
    return history.recent_trades_ring(spark, sf_dir).join(best, "instrument_id", "left").select("source_id", "channel", "instrument_id", "nth", "price", "size", "bid", "ask")


def queries() -> dict:
    every = (
        source_labels, source_ids, channel_canonical, precision_gate, manifest_eras, source_reveals, catalog_latest, product_ambiguity, product_resolve, products_page, symbol_prefix_rank, symbol_lookup,
        subscription_filter, channel_filter, drop_preview, ts_resolve, unattributable, numeric_guards, latency_decomposition, jq_path, message_union, shared_ids, venue_health, reconcile_plan, purged_catalog,
        classify_codes, diagnosis, registry_expand, registry_violations, book_coverage, feed_kind, best_bid_ask, status_venues, ticker,
    )
    return {f.__name__: f for f in every}


_VENUE = "CASE source_id WHEN 1 THEN 'ALPHA' WHEN 2 THEN 'BETA' ELSE 'SOURCE_' || source_id END"
_INSTRUMENTS = f"""i AS (SELECT *, {_VENUE} AS venue FROM (SELECT p_partkey AS instrument_id, cast(p_size % 32 AS BIGINT) AS channel, 1 + p_partkey % 3 AS source_id, CASE WHEN p_partkey % 2 = 0 THEN 'perp' ELSE 'sport' END AS category,
  CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_name || '-' || p_partkey END AS symbol FROM part))"""
_PRODUCTS = f"""{_INSTRUMENTS}, pr AS (SELECT *, venue || ':' || symbol || CASE WHEN ambiguous THEN '#' || channel || '.' || instrument_id ELSE '' END AS product_id
  FROM (SELECT *, count(*) OVER (PARTITION BY source_id, symbol) > 1 AS ambiguous FROM i))"""
_DEFINITIONS = f"""{TRADES_SQL}, df AS (SELECT instrument_id, arrival_seq, cast(-(arrival_seq % 4) AS INT) AS price_exponent, cast(arrival_seq % 2 AS INT) AS qty_exponent, symbol, source_id, channel FROM t WHERE arrival_seq % 11 = 7)"""
_RECEIVERS = """r AS (SELECT 'V' || s_nationkey % 5 AS venue, CASE WHEN s_suppkey % 2 = 0 THEN 'perp' ELSE 'sport' END AS category, ['top_of_book', 'market_by_price', 'market_by_order', 'midpoint'][cast(floor(s_suppkey / 3) AS INT) % 4 + 1] AS kind,
  7000 + s_suppkey AS port, cast(floor(s_suppkey / 2) AS INT) % 3 AS liveness FROM supplier)"""
_CHANNELS = f"{_INSTRUMENTS}, ch AS (SELECT venue AS code, channel, count(*) AS products FROM i GROUP BY ALL)"
_ADMITTED = "(code NOT IN ('ALPHA', 'BETA') OR (code = 'ALPHA' AND channel IN (1, 2, 3, 5, 8)) OR (code = 'BETA' AND channel = 7))"
_HEALTH = "venue, CASE WHEN bool_or(kind IN ('top_of_book', 'midpoint')) THEN bool_or(kind IN ('top_of_book', 'midpoint') AND liveness = 0) ELSE bool_or(liveness = 0) END AS up, count(*) AS receivers"


def oracle_sql() -> dict[str, str]:
    folds, l2, late = depth.oracle_sql()["accumulator_fold"], depth.oracle_sql()["l2_best"], history.oracle_sql()["recent_trades_ring"]
    traffic = lambda fine: f"CASE WHEN receivers = 0 THEN 'no_receivers_running' WHEN NOT delivering THEN 'subscribed_no_traffic' ELSE '{fine}' END"
    return {
        "source_labels": """SELECT s_suppkey + 1 AS source_id, CASE WHEN s_suppkey = 0 THEN 'ALPHA' WHEN s_suppkey = 1 THEN 'BETA' WHEN nth <= 64 THEN 'SOURCE_' || (s_suppkey + 1) ELSE 'UNREGISTERED' END AS label
FROM (SELECT s_suppkey, dense_rank() OVER (ORDER BY s_suppkey) - 2 AS nth FROM supplier)""",
        "source_ids": f"WITH {_INSTRUMENTS} SELECT instrument_id, venue AS name, CASE venue WHEN 'ALPHA' THEN 1 WHEN 'BETA' THEN 2 END::BIGINT AS source_id FROM i",
        "channel_canonical": f"WITH {_INSTRUMENTS} SELECT instrument_id, CASE WHEN instrument_id % 2 = 0 AND channel >= 16 THEN channel - 16 ELSE channel END AS canonical FROM i",
        "precision_gate": f"""WITH {_DEFINITIONS}, p AS (SELECT instrument_id, arrival_seq, cast(round(price * 100) AS BIGINT) AS raw FROM t WHERE arrival_seq % 11 <> 7)
SELECT p.arrival_seq, p.instrument_id, raw, price_exponent AS exponent, round(raw * pow(10.0, price_exponent), 6) AS value FROM p ASOF JOIN df ON p.instrument_id = df.instrument_id AND p.arrival_seq >= df.arrival_seq""",
        "manifest_eras": f"""WITH {TRADES_SQL}, m AS (SELECT channel, arrival_seq, cast(floor(arrival_seq / 3000) AS BIGINT) AS reset_count, arrival_seq % 13 <> 0 AS valid, cast(floor(arrival_seq / 7) AS BIGINT) * 5003 % 65536 AS seq FROM t),
b AS (SELECT *, lag(reset_count) OVER w AS r0, lag(valid) OVER w AS v0, (seq - lag(seq) OVER w + 65536) % 65536 AS ahead FROM m WINDOW w AS (PARTITION BY channel ORDER BY arrival_seq))
SELECT channel, arrival_seq, count(*) FILTER (r0 IS NULL OR r0 <> reset_count OR v0 <> valid OR (valid AND ahead > 0 AND ahead < 32768)) OVER (PARTITION BY channel ORDER BY arrival_seq) AS era FROM b""",
        "source_reveals": f"""WITH {TRADES_SQL}, s AS (SELECT instrument_id, arrival_seq, CASE WHEN arrival_seq % 5 > 0 THEN cast(floor(arrival_seq / 1000) AS BIGINT) % 3 + 1 END AS source_id FROM t),
b AS (SELECT *, lag(source_id) OVER (PARTITION BY instrument_id ORDER BY arrival_seq) AS purged FROM s WHERE source_id IS NOT NULL)
SELECT * FROM b WHERE purged IS DISTINCT FROM source_id""",
        "catalog_latest": f"""WITH {_DEFINITIONS} SELECT source_id, channel, instrument_id, arg_max(symbol, arrival_seq) AS symbol, arg_max(price_exponent, arrival_seq) AS price_exponent, arg_max(qty_exponent, arrival_seq) AS qty_exponent,
  count(DISTINCT (price_exponent, qty_exponent)) > 1 AS conflict FROM df GROUP BY ALL""",
        "product_ambiguity": f"WITH {_PRODUCTS} SELECT instrument_id, ambiguous, product_id FROM pr",
        "product_resolve": f"""WITH {_INSTRUMENTS}, a AS (SELECT lower(venue) || ':' || symbol AS bare, '#' || channel || '.' || instrument_id AS tail, * FROM i),
k AS (SELECT symbol AS id, 400 AS status, NULL AS src, NULL AS sym, NULL AS ch, NULL AS ins FROM a UNION SELECT bare || '#x', 400, NULL, NULL, NULL, NULL FROM a
  UNION SELECT bare || '-none', CASE WHEN contains(symbol, '#') THEN 400 ELSE 0 END, NULL, NULL, NULL, NULL FROM a UNION SELECT bare, CASE WHEN contains(symbol, '#') THEN 400 ELSE 0 END, CASE WHEN NOT contains(symbol, '#') THEN venue END, symbol, NULL, NULL FROM a UNION SELECT bare || tail, 0, venue, symbol, channel, instrument_id FROM a),
n AS (SELECT k.id, k.status AS s0, count(i.instrument_id) FILTER ((ch IS NULL OR ch = channel) AND (ins IS NULL OR ins = instrument_id)) AS hits,
    min((channel, instrument_id)) FILTER ((ch IS NULL OR ch = channel) AND (ins IS NULL OR ins = instrument_id) AND instrument_id IS NOT NULL) AS o FROM k LEFT JOIN i ON src = venue AND sym = symbol GROUP BY ALL)
SELECT id, CASE WHEN s0 = 400 THEN 400 WHEN hits = 0 THEN 404 WHEN hits = 1 THEN 200 ELSE 409 END AS status, hits, CASE WHEN hits = 1 THEN o[1] END AS channel, CASE WHEN hits = 1 THEN o[2] END AS instrument_id FROM n""",
        "products_page": f"""WITH {_PRODUCTS}, k AS (SELECT product_id, venue, category, channel, instrument_id, row_number() OVER (ORDER BY venue, category, channel, instrument_id) - 1 AS nth, count(*) OVER () AS whole FROM pr)
SELECT product_id, venue, category, channel, instrument_id, nth, CASE WHEN whole > 150 THEN 150 END AS next_cursor FROM k WHERE nth >= 100 AND nth < 150""",
        "symbol_prefix_rank": f"""WITH {_INSTRUMENTS}, p AS (SELECT venue, category, channel % 4 AS channel, split_part(symbol, '-', 1) AS prefix, count(*) AS n FROM i WHERE symbol <> '' GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY venue, category, channel ORDER BY n DESC, prefix) AS nth, count(*) OVER (PARTITION BY venue, category, channel) AS prefixes FROM p) WHERE nth <= 8""",
        "symbol_lookup": f"WITH {_INSTRUMENTS} SELECT symbol, channel, instrument_id FROM i WHERE symbol IN (SELECT p_brand FROM part)",
        "subscription_filter": f"""WITH {TRADES_SQL}, k AS (SELECT *, CASE WHEN arrival_seq % 9 = 0 THEN 'status' WHEN arrival_seq % 2 = 0 THEN 'trade' ELSE 'quote' END AS type FROM t),
m AS (SELECT arrival_seq, CASE source_id WHEN 1 THEN 'ALPHA' WHEN 2 THEN 'Beta' ELSE 'SOURCE_3' END AS venue, type, CASE WHEN type <> 'status' THEN symbol END AS sym, CASE WHEN type <> 'status' AND arrival_seq % 10 <> 3 THEN channel END AS ch FROM k)
SELECT arrival_seq FROM m WHERE (lower(venue) = 'alpha' AND CASE WHEN ch IS NULL THEN sym IS NULL ELSE ch = 3 END) OR (lower(venue) = 'beta' AND type = 'trade')
  OR ((sym IS NULL OR sym = 'click') AND CASE WHEN ch IS NULL THEN sym IS NULL ELSE ch = 1 END) OR type = 'status'""",
        "channel_filter": f"WITH {_CHANNELS} SELECT *, {_ADMITTED} AS admitted FROM ch",
        "drop_preview": f"WITH {_CHANNELS} SELECT code, channel, products, true AS allowed FROM ch WHERE channel % 2 = 1 AND NOT {_ADMITTED}",
        "ts_resolve": f"""WITH {TRADES_SQL}, r AS (SELECT arrival_seq, CASE WHEN arrival_seq % 6 = 0 THEN 0 ELSE source_us END AS src, source_us + (arrival_seq % 8000 - 100) * 1000000 AS recv FROM t)
SELECT arrival_seq, CASE WHEN src = 0 OR src > recv + 5000000 OR src + 3600000000 < recv THEN recv ELSE src END AS us FROM r""",
        "unattributable": f"""WITH {_DEFINITIONS}, k AS (SELECT DISTINCT source_id, channel, instrument_id FROM df WHERE instrument_id % 5 > 0)
SELECT symbol, k.instrument_id IS NOT NULL AS kept, count(*) AS n FROM t LEFT JOIN k USING (source_id, channel, instrument_id) GROUP BY ALL""",
        "numeric_guards": "SELECT c_custkey, CASE WHEN c_custkey % 7 > 2 AND c_acctbal >= 0 THEN c_acctbal END AS value FROM customer",
        "latency_decomposition": f"""WITH {TRADES_SQL}, p AS (SELECT arrival_seq, CASE WHEN arrival_seq % 10 > 0 THEN source_us END AS s, CASE WHEN arrival_seq % 15 > 0 THEN source_us + arrival_seq % 97 END AS k,
  source_us + arrival_seq % 97 + arrival_seq % 31 AS r, source_us + arrival_seq % 97 + arrival_seq % 31 + arrival_seq % 17 AS x FROM t)
SELECT arrival_seq, k - s AS network, r - k AS kernel, x - r AS process, x - s AS total FROM p""",
        "jq_path": "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none[0].x') AS none FROM events",
        "message_union": f"""WITH {_DEFINITIONS} SELECT 'trade' AS type, symbol, count(*) AS n, count(price) AS prices, NULL::BIGINT AS exponents FROM t GROUP BY symbol
UNION ALL SELECT 'definition', symbol, count(*), 0, cast(sum(price_exponent) AS BIGINT) FROM df GROUP BY symbol""",
        "shared_ids": f"WITH {TRADES_SQL} SELECT symbol, instrument_id FROM t WHERE channel = 1 INTERSECT SELECT symbol, instrument_id FROM t WHERE source_id = 2",
        "venue_health": f"WITH {_RECEIVERS} SELECT {_HEALTH} FROM r GROUP BY venue",
        "reconcile_plan": f"""WITH {_RECEIVERS} SELECT venue, category, kind, port, CASE WHEN liveness < 2 THEN 'spawn' ELSE 'abort' END AS action FROM r WHERE (liveness < 2) <> (port % 3 > 0)""",
        "purged_catalog": f"WITH {_INSTRUMENTS} SELECT source_id, category, count(*) AS n FROM i WHERE NOT (source_id = 1 AND category = 'perp' AND channel = 4) AND NOT (source_id = 2 AND category = 'sport' AND channel = 9) GROUP BY ALL",
        "classify_codes": f"""WITH {_RECEIVERS}, c AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'shred-' ELSE 'V' END || s_suppkey % 9 AS code FROM supplier)
SELECT code, CASE WHEN code IN (SELECT venue FROM r) THEN 'market' WHEN starts_with(code, 'shred-') THEN 'shred' ELSE 'other' END AS class FROM c""",
        "diagnosis": f"""WITH b AS (SELECT c_custkey, ['pending', 'cli_missing', 'unavailable', 'gating_disabled', 'ok', 'ok', 'ok'][c_custkey % 7 + 1] AS detection, cast(floor(c_custkey / 7) AS BIGINT) % 2 = 0 AS delivering,
  cast(floor(c_custkey / 14) AS BIGINT) % 2 = 0 AS up, cast(floor(c_custkey / 28) AS BIGINT) % 2 = 0 AS known, cast(floor(c_custkey / 56) AS BIGINT) % 2 = 0 AS subscribed, cast(floor(c_custkey / 112) AS BIGINT) % 3 AS receivers FROM customer)
SELECT c_custkey, CASE detection WHEN 'pending' THEN 'pending' WHEN 'cli_missing' THEN 'cli_missing' WHEN 'unavailable' THEN 'daemon_unreachable' WHEN 'gating_disabled' THEN {traffic('gating_disabled')}
  ELSE CASE WHEN NOT delivering AND NOT up THEN CASE WHEN known THEN 'tunnel_down' ELSE 'tunnel_state_unknown' END WHEN NOT subscribed THEN 'no_market_data_subscriptions' ELSE {traffic('ok')} END END AS code FROM b""",
        "registry_expand": """WITH n AS (SELECT 'V' || n_nationkey % 5 AS venue, cast(n_regionkey AS VARCHAR) AS category, cast(CASE WHEN n_nationkey = 7 THEN 65530 ELSE 7000 + 100 * n_nationkey END AS BIGINT) AS base, n_nationkey % 3 AS lo, n_nationkey % 3 + 6 AS hi FROM nation),
e AS (SELECT DISTINCT venue, category, base, unnest(range(lo, hi + 1))::BIGINT AS channel FROM n)
SELECT *, base + channel > 65535 AS overflow, CASE WHEN base + channel <= 65535 THEN base + channel END AS port FROM e""",
        "registry_violations": f"""WITH {_RECEIVERS}, f AS (SELECT venue, category, kind, CASE WHEN port % 10 = 0 THEN 'quote' ELSE 'book' END AS arb, port % 4 = 0 AS emits, cast(port % 3 AS VARCHAR) AS grp, port % 20 AS port FROM r)
SELECT 'duplicate_row' AS rule, venue, category || '/' || kind AS detail FROM f GROUP BY venue, category, kind HAVING count(*) > 1
UNION ALL SELECT 'arbitration_disagrees', venue, min(arb) || '/' || max(arb) FROM f GROUP BY venue HAVING min(arb) <> max(arb)
UNION ALL SELECT 'emit_trades_disagrees', venue, category || '/' || kind FROM f WHERE emits <> (kind IN ('top_of_book', 'market_by_price'))
UNION ALL SELECT 'orders_in_two_categories', venue, min(category) || '/' || max(category) FROM f WHERE kind = 'market_by_order' GROUP BY venue HAVING min(category) <> max(category)
UNION ALL SELECT 'port_used_twice', venue, grp || '/' || port FROM f GROUP BY venue, grp, port HAVING count(*) > 1""",
        "book_coverage": f"""WITH {_INSTRUMENTS}, a AS ({folds}), h AS (SELECT instrument_id, count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (side = 'ask') AS asks, bool_or(baselined) AS baselined FROM a GROUP BY instrument_id),
p AS (SELECT p_brand AS symbol, max(p_size) % 12 AS db, min(p_size) % 12 AS da FROM part GROUP BY p_brand)
SELECT i.instrument_id, CASE WHEN bids IS NOT NULL THEN 'book' WHEN db IS NOT NULL THEN 'depth' ELSE 'none' END AS source, cast(CASE WHEN bids IS NOT NULL THEN least(bids, 50) + least(asks, 50) WHEN db IS NOT NULL THEN db + da ELSE 0 END AS BIGINT) AS levels_returned,
  CASE WHEN bids IS NULL AND db IS NOT NULL THEN 10 ELSE 50 END AS levels_capped_at, CASE WHEN bids IS NOT NULL THEN baselined AND bids <= 50 AND asks <= 50 WHEN db IS NOT NULL THEN db < 10 AND da < 10 ELSE false END AS complete
FROM i LEFT JOIN h USING (instrument_id) LEFT JOIN p USING (symbol)""",
        "feed_kind": f"""WITH {_INSTRUMENTS} SELECT instrument_id, CASE WHEN instrument_id % 12 = 1 THEN 'market_by_order' WHEN instrument_id % 6 = 1 THEN 'market_by_price' WHEN symbol LIKE 'Brand#1%' THEN 'market_by_order'
  WHEN venue = 'ALPHA' AND category = 'perp' THEN 'top_of_book' WHEN venue = 'BETA' AND category = 'sport' THEN 'midpoint' ELSE 'unknown' END AS feed_kind FROM i""",
        "best_bid_ask": f"""WITH {_PRODUCTS}, l AS ({l2}), y AS (SELECT venue, symbol, min(instrument_id) AS bid, max(instrument_id) AS ask FROM pr GROUP BY ALL HAVING min(instrument_id) % 3 > 0),
o AS (SELECT product_id, ambiguous, l.bid IS NOT NULL OR l.ask IS NOT NULL AS own, l.bid AS b, l.bid_size AS bs, l.ask AS a, l.ask_size AS az, y.bid AS yb, y.ask AS ya FROM pr LEFT JOIN l USING (instrument_id) LEFT JOIN y USING (venue, symbol))
SELECT product_id, CASE WHEN own THEN b ELSE yb END AS bid, CASE WHEN own THEN bs WHEN yb IS NOT NULL THEN 1 END AS bid_size, CASE WHEN own THEN a ELSE ya END AS ask, CASE WHEN own THEN az WHEN ya IS NOT NULL THEN 2 END AS ask_size
FROM o WHERE own OR (NOT ambiguous AND yb IS NOT NULL)""",
        "status_venues": f"""WITH {_INSTRUMENTS}, {_RECEIVERS}, {TRADES_SQL}, v AS (SELECT {_HEALTH} FROM (SELECT * REPLACE (CASE venue WHEN 'V0' THEN 'ALPHA' ELSE venue END AS venue) FROM r) GROUP BY venue),
k AS (SELECT venue, count(*) AS products FROM i GROUP BY venue), h AS (SELECT {_VENUE} AS venue, count(DISTINCT instrument_id) AS with_history FROM t GROUP BY 1)
SELECT venue, up, coalesce(receivers, 0) AS receivers, coalesce(products, 0) AS products, coalesce(with_history, 0) AS with_history FROM k FULL JOIN v USING (venue) FULL JOIN h USING (venue)""",
        "ticker": f"WITH n AS ({late}), l AS ({l2}) SELECT source_id, channel, n.instrument_id, nth, price, size, bid, ask FROM n LEFT JOIN l ON n.instrument_id = l.instrument_id",
    }
