"""Queries over mirrored publishers: verdicts on quotes, depths, trades and packets, sequence checks, races between paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import arbitration as a
from tickloom.operators.matching import queue_pairs, unpaired
from tickloom.plans.ticks import COPIES_SQL
from tickloom.sources.tables import HOUR_US, QUOTE_ORDER, floor_div, mirrored, quotes, receivers, table

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "recv_us"]
COPY_ORDER = ["recv_us", "publisher", "event_id"]
#: Copies lie up to 15 minutes apart, so a margin of two minutes is one that paths can win by.
DAY_US, MARGIN_US, WINDOW_US = 86_400_000_000, 120_000_000, 900_000_000


def quote_content_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.quote_verdicts(quotes(spark, sf_dir), QUOTE_ORDER).select(*ROW, "verdict", "leader", "lead_us")


def depth_floor_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quotes(spark, sf_dir)
    level = lambda p, s: F.struct(F.col(p).alias("price"), F.col(s).alias("size"))
    depths = q.withColumn("bids", F.array(level("bid", "bid_size"))).withColumn("asks", F.array(level("ask", "ask_size")))
    return a.depth_verdicts(depths, QUOTE_ORDER).select(*ROW, "verdict", "leader", "lead_us")


def trade_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.trade_verdicts(mirrored(spark, sf_dir), COPY_ORDER).select("event_id", "publisher", "verdict", "winner", "lead_us")


def tick_win_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.win_share(a.floor_verdicts(mirrored(spark, sf_dir)))


def lead_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the copies lag by seconds: a thousandth of that spreads over the bounds
    verdicts = a.floor_verdicts(mirrored(spark, sf_dir))
    return a.lead_histogram(verdicts.withColumn("lead_us", F.floor(F.col("lead_us") / 1000).cast("long")))


def emit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.floor_verdicts(mirrored(spark, sf_dir)).groupBy("publisher", "symbol", "verdict").agg(F.count(F.lit(1)).alias("n"))


def sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mirrored(spark, sf_dir).withColumn("reset_count", floor_div(F.col("event_id"), 2500) % 256).withColumn("sequence", F.col("event_id") % 2500)
    return a.sequence_check(c, COPY_ORDER, ["publisher", "channel"], floor_div(F.col("recv_us"), HOUR_US)).select("event_id", "publisher", "check")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.race_pairs(mirrored(spark, sf_dir), ["symbol", "price", "size"], COPY_ORDER, (0, 1), WINDOW_US)


def race_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.lead_for(_pairs(spark, sf_dir), 0).select("symbol", "price", "size", "first", "second", "delta_us", "challenger", "lead_us")


def race_pairs_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path's copies, all that wait, in buckets as short as the window, so that queues are handed from one to the next."""
    return queue_pairs(mirrored(spark, sf_dir), ["symbol", "size"], COPY_ORDER, WINDOW_US, most=None, width_us=1)


def race_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mirrored(spark, sf_dir)
    return unpaired(c, queue_pairs(c, ["symbol", "price", "size"], COPY_ORDER, WINDOW_US), WINDOW_US, "recv_us")


def race_window_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.elect(a.lead_for(_pairs(spark, sf_dir), 0), DAY_US, MARGIN_US, 32, 0.4)


def transfer_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    path = lambda n: F.when(F.floor(F.col("o_orderkey") / n) % 4 > 0, F.floor(F.col("o_orderkey") / n) % 4)
    return o.select("o_orderkey", a.transfer_reason(path(1), path(4), path(16), path(64)).alias("reason"))


def tape_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.tape_owners(receivers(spark, sf_dir))


def markets_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets that each path leads, paths that lead none included."""
    led = a.floor_verdicts(mirrored(spark, sf_dir)).where("verdict = 'open'").groupBy("symbol").agg(F.max_by("publisher", F.struct("recv_us", "event_id")).alias("path"))
    paths = spark.range(4).select(F.col("id").alias("path"))
    return paths.join(led.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("markets"))


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    # copies of a text, wherever they are, share a slot now and then
    slot = F.pmod(F.col("doc_id"), F.lit(97)) * 10 + floor_div(F.col("doc_id"), 200)
    return d.select("doc_id", slot.alias("slot"), F.substring("sha", 1, 2).alias("fingerprint"), (F.col("doc_id") % 7 != 0).alias("valid"), (F.col("doc_id") % 3).alias("grp"), (F.col("doc_id") * 7919 % 1_000_003).alias("arrival"))


def shred_dedup_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _packets(spark, sf_dir)
    return a.shred_verdicts(p, 512, ["arrival", "doc_id"], floor_div(F.col("arrival"), 10_000)).select("doc_id", "slot", "fingerprint", "verdict")


def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal payloads by content, without the last 64 bytes of those that are signed anew (every fifth)."""
    d = table(spark, sf_dir, "documents").withColumn("b", F.coalesce("text", F.lit("")).cast("binary"))
    body = F.when(F.col("doc_id") % 5 == 0, F.substring("b", F.lit(1), F.greatest(F.lit(0), F.octet_length("b") - 64))).otherwise(F.col("b"))
    return d.groupBy(F.sha2(body, 256).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def queries() -> dict:
    every = (quote_content_verdicts, depth_floor_verdicts, trade_dedup, tick_win_share, lead_histogram, emit_counters, sequence_check, race_pairs, race_pairs_of_all, race_unpaired, race_window_election, transfer_reasons, tape_owner, markets_held, shred_dedup_verdicts, fingerprint_groups)
    return {f.__name__: f for f in every}


_QUOTES = """q AS (SELECT p_brand AS symbol, l_suppkey % 3 AS publisher, epoch_us(l_shipdate) + (l_orderkey * 7919 + l_linenumber * 104729) % 900 * 1000000 AS recv_us, epoch_us(l_shipdate) AS day,
  l_extendedprice * (1 - l_discount) AS bid, l_extendedprice * (1 + l_tax) AS ask, l_quantity AS sz, l_linenumber AS cnt, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT *, CASE WHEN l_orderkey % 97 = 0 THEN 0 WHEN l_orderkey % 89 = 0 THEN recv_us + 10000000 ELSE day END AS tick FROM q)"""


def _floored(where: str, content: str, led: str = "tick >= hw") -> str:
    order = "ORDER BY recv_us, l_orderkey, l_linenumber, l_partkey, l_suppkey, bid"
    return f"""f AS (SELECT *, max(tick) OVER (PARTITION BY symbol {order} ROWS UNBOUNDED PRECEDING) AS hw, first_value(publisher) OVER k AS leader, row_number() OVER k AS n_tick, recv_us - first_value(recv_us) OVER k AS lead_us
  FROM s WHERE {where} WINDOW k AS (PARTITION BY symbol, tick {order})),
c AS (SELECT *, row_number() OVER (PARTITION BY symbol, tick, publisher = leader {order}) AS n_side, row_number() OVER (PARTITION BY symbol, tick, publisher, {content} {order}) AS n_content FROM f),
v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, recv_us, CASE WHEN tick < hw THEN 'stale' WHEN n_tick = 1 THEN 'open'
  WHEN publisher <> leader THEN CASE WHEN n_side = 1 THEN 'contest' ELSE 'drop' END WHEN n_content = 1 THEN 'emit' ELSE 'drop' END AS verdict, CASE WHEN {led} THEN leader END AS leader, CASE WHEN {led} THEN lead_us END AS lead_us FROM c)"""


_CANON = "cast(round(bid * 1e8) AS DECIMAL(38, 0)), cast(round(sz * 1e8) AS DECIMAL(38, 0)), cast(round(ask * 1e8) AS DECIMAL(38, 0))"
_OUT = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, recv_us,"
_COPY_VERDICTS = f"""{COPIES_SQL}, l AS (SELECT *, max(tick) OVER (PARTITION BY symbol ORDER BY arrival_seq) AS hw, first_value(publisher) OVER k AS leader, row_number() OVER k AS n_tick, recv_us - first_value(recv_us) OVER k AS lead_us
  FROM n WINDOW k AS (PARTITION BY symbol, tick ORDER BY arrival_seq)),
c AS (SELECT *, row_number() OVER (PARTITION BY symbol, tick, publisher = leader ORDER BY arrival_seq) AS n_side, row_number() OVER (PARTITION BY symbol, tick, publisher, price ORDER BY arrival_seq) AS n_content FROM l),
v AS (SELECT *, CASE WHEN tick < hw THEN 'stale' WHEN n_tick = 1 THEN 'open' WHEN publisher <> leader THEN CASE WHEN n_side = 1 THEN 'contest' ELSE 'drop' END WHEN n_content = 1 THEN 'emit' ELSE 'drop' END AS verdict FROM c)"""
def _queues(signature: str, where: str = "true", most: int | None = 8) -> str:
    """Pairs pq, copy by copy: q holds when the copies that wait came, w is their path. most: how many wait at most; None if all do."""
    columns, last = signature.split(", "), "" if most is None else f"[-{most}:]"
    same = " AND ".join(f"tq.{c} = rq.{c}" for c in columns)
    return f"""tq AS (SELECT {signature}, publisher, recv_us, row_number() OVER (PARTITION BY {signature} ORDER BY recv_us, publisher, event_id) AS k FROM n WHERE {where}),
rq AS (SELECT {signature}, k, publisher AS w, [recv_us] AS q, NULL::BIGINT AS first, NULL::BIGINT AS second, NULL::BIGINT AS first_us, recv_us FROM tq WHERE k = 1
  UNION ALL SELECT {signature}, k, CASE WHEN met THEN w ELSE publisher END, CASE WHEN met THEN live[2:] ELSE list_append(live, recv_us){last} END, CASE WHEN met THEN w END, CASE WHEN met THEN publisher END, CASE WHEN met THEN live[1] END, recv_us
  FROM (SELECT *, len(live) > 0 AND w <> publisher AS met FROM (SELECT {", ".join("tq." + c for c in columns)}, tq.k, tq.publisher, tq.recv_us, rq.w, list_filter(rq.q, lambda x: tq.recv_us - x <= {WINDOW_US}) AS live FROM rq JOIN tq ON {same} AND tq.k = rq.k + 1))),
pq AS (SELECT {signature}, first, second, recv_us - first_us AS delta_us, first_us FROM rq WHERE first IS NOT NULL)"""


_RECURSIVE_COPIES = "RECURSIVE " + COPIES_SQL
_PAIRS = f"""{_RECURSIVE_COPIES}, {_queues("symbol, price, size", "publisher IN (0, 1)")}, d AS (SELECT *, 1 AS challenger, CASE WHEN second = 0 THEN -delta_us ELSE delta_us END AS lead_us FROM pq)"""


def oracle_sql() -> dict[str, str]:
    bounds = ", ".join(f"({b})" for b in a.LEAD_BOUNDS_NS)
    path = lambda n: f"nullif(cast(floor(o_orderkey / {n}) AS BIGINT) % 4, 0)"
    return {
        "quote_content_verdicts": f"""WITH {_QUOTES}, {_floored("tick <> 0 AND tick <= recv_us + 5000000", _CANON + ", cnt")} SELECT * FROM v
UNION ALL {_OUT} CASE WHEN tick = 0 THEN 'bypass' ELSE 'future' END AS verdict, NULL AS leader, NULL AS lead_us FROM s WHERE tick = 0 OR tick > recv_us + 5000000""",
        "depth_floor_verdicts": f"""WITH {_QUOTES}, {_floored("tick <= recv_us + 5000000", _CANON, "true")} SELECT * FROM v
UNION ALL {_OUT} 'future' AS verdict, NULL AS leader, NULL AS lead_us FROM s WHERE tick > recv_us + 5000000""",
        "trade_dedup": f"""WITH {COPIES_SQL} SELECT event_id, publisher, CASE WHEN event_id = 0 THEN 'bypass' WHEN k = 1 THEN 'emit' WHEN publisher <> winner THEN 'contest' ELSE 'drop' END AS verdict, winner, lead_us
FROM (SELECT *, row_number() OVER w AS k, first_value(publisher) OVER w AS winner, recv_us - first_value(recv_us) OVER w AS lead_us FROM n WINDOW w AS (PARTITION BY symbol, event_id ORDER BY recv_us, publisher, event_id))""",
        "tick_win_share": f"WITH {_COPY_VERDICTS}, o AS (SELECT publisher, count(*) FILTER (verdict = 'open') AS opened FROM v GROUP BY publisher) SELECT publisher, opened, opened / (SELECT sum(opened) FROM o) AS share FROM o",
        "lead_histogram": f"""WITH {_COPY_VERDICTS}, x AS (SELECT cast(floor(lead_us / 1000) AS BIGINT) * 1000 AS ns FROM v WHERE verdict = 'contest'), b(le_ns) AS (VALUES {bounds})
SELECT cast(le_ns AS BIGINT) AS le_ns, count(*) FILTER (ns <= le_ns) AS n FROM b, x GROUP BY le_ns UNION ALL SELECT NULL, count(*) FROM x""",
        "emit_counters": f"WITH {_COPY_VERDICTS} SELECT publisher, symbol, verdict, count(*) AS n FROM v GROUP BY ALL",
        "sequence_check": f"""WITH {COPIES_SQL}, d AS (SELECT *, cast(floor(event_id / 2500) AS BIGINT) % 256 AS reset_count, event_id % 2500 AS sequence, lag(cast(floor(event_id / 2500) AS BIGINT) % 256) OVER w AS before
  FROM n WINDOW w AS (PARTITION BY publisher, channel ORDER BY recv_us, publisher, event_id)),
e AS (SELECT *, count(*) FILTER (before IS NULL OR before <> reset_count) OVER (PARTITION BY publisher, channel ORDER BY recv_us, event_id) AS era FROM d),
m AS (SELECT *, max(sequence) OVER (PARTITION BY publisher, channel, era ORDER BY recv_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM e)
SELECT event_id, publisher, CASE WHEN before IS NULL THEN 'first' WHEN before <> reset_count THEN 'reset' WHEN sequence < newest THEN 'stale' ELSE 'ok' END AS "check" FROM m""",
        "race_pairs_of_all": f"WITH {_RECURSIVE_COPIES}, {_queues('symbol, size', most=None)} SELECT * FROM pq",
        "race_unpaired": f"""WITH {_RECURSIVE_COPIES}, {_queues('symbol, price, size')}, zd AS (SELECT max(recv_us) - {WINDOW_US} AS due FROM n),
pd AS (SELECT path, count(*) AS paired FROM (SELECT first AS path, first_us AS came FROM pq UNION ALL SELECT second, first_us + delta_us FROM pq), zd WHERE came < due GROUP BY path),
cs AS (SELECT publisher AS path, count(*) AS copies, count(*) FILTER (recv_us < due) AS n_due FROM n, zd GROUP BY publisher)
SELECT path, copies, n_due - coalesce(paired, 0) AS unpaired FROM cs LEFT JOIN pd USING (path)""",
        "race_pairs": f"WITH {_PAIRS} SELECT symbol, price, size, first, second, delta_us, challenger, lead_us FROM d",
        "race_window_election": f"""WITH {_PAIRS}, r AS (SELECT *, cast(floor(first_us / {DAY_US}) AS BIGINT) * {DAY_US} AS window_us FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY window_us, challenger ORDER BY lead_us) AS nth, count(*) OVER (PARTITION BY window_us, challenger) AS whole FROM r),
g AS (SELECT window_us, challenger, count(*) AS samples, count(*) FILTER (lead_us < -{MARGIN_US}) AS wins, max(lead_us) FILTER (nth = cast(floor(whole / 2) AS BIGINT) + 1) AS median_us FROM k GROUP BY ALL)
SELECT *, samples >= 32 AND wins / samples >= 0.4 AND median_us <= -{MARGIN_US} AS won FROM g""",
        "transfer_reasons": f"""SELECT o_orderkey, CASE WHEN before IS NULL THEN 'initial' WHEN before IS DISTINCT FROM aft THEN 'silence' WHEN aft IS DISTINCT FROM pub AND prev IS DISTINCT FROM pub THEN 'health' END AS reason
FROM (SELECT o_orderkey, {path(1)} AS prev, {path(4)} AS before, {path(16)} AS aft, {path(64)} AS pub FROM orders)""",
        "tape_owner": """WITH r AS (SELECT 'V' || s_nationkey % 5 AS venue, CASE WHEN s_suppkey % 2 = 0 THEN 'perp' ELSE 'sport' END AS category, ['top_of_book', 'market_by_price', 'market_by_order', 'midpoint'][cast(floor(s_suppkey / 3) AS INT) % 4 + 1] AS kind,
  7000 + s_suppkey AS port, cast(floor(s_suppkey / 2) AS INT) % 3 AS liveness FROM supplier),
k AS (SELECT *, row_number() OVER (PARTITION BY venue, category ORDER BY liveness, CASE kind WHEN 'top_of_book' THEN 0 ELSE 1 END, port) AS nth FROM r WHERE kind IN ('top_of_book', 'market_by_price'))
SELECT venue, category, kind, port, liveness FROM k WHERE nth = 1""",
        "markets_held": f"""WITH {_COPY_VERDICTS}, m AS (SELECT symbol, arg_max(publisher, (recv_us, event_id)) AS path FROM v WHERE verdict = 'open' GROUP BY symbol)
SELECT r.path, count(m.symbol) AS markets FROM range(4) r(path) LEFT JOIN m ON m.path = r.path GROUP BY r.path""",
        "shred_dedup_verdicts": """WITH p AS (SELECT doc_id, doc_id % 97 * 10 + cast(floor(doc_id / 200) AS BIGINT) AS slot, substring(sha256(coalesce(text, '')), 1, 2) AS fingerprint, doc_id % 7 <> 0 AS valid, doc_id % 3 AS grp, doc_id * 7919 % 1000003 AS arrival FROM documents),
t AS (SELECT *, max(slot) FILTER (valid) OVER (ORDER BY arrival, doc_id ROWS UNBOUNDED PRECEDING) AS tip, max(slot) FILTER (valid) OVER (ORDER BY arrival, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tip_before FROM p),
w AS (SELECT *, first_value(CASE WHEN valid AND slot >= tip - 512 THEN grp END IGNORE NULLS) OVER (PARTITION BY slot, fingerprint ORDER BY arrival, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS winner FROM t)
SELECT doc_id, slot, fingerprint, CASE WHEN winner IS NOT NULL AND slot >= coalesce(tip_before, 0) - 512 THEN CASE WHEN winner = grp THEN 'drop' ELSE 'duplicate' END WHEN valid THEN 'forward' ELSE 'drop' END AS verdict FROM w""",
        "fingerprint_groups": """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)
SELECT sha256(CASE WHEN doc_id % 5 = 0 THEN CASE WHEN octet_length(b) > 64 THEN unhex(substring(hex(b), 1, 2 * (octet_length(b) - 64))) ELSE ''::BLOB END ELSE b END) AS fingerprint, count(*) AS n, min(doc_id) AS first FROM b GROUP BY 1""",
    }
