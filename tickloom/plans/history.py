"""Queries over the candle history: late drops, retained bars, served candles, recent trades, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import candles as c
from tickloom.plans.ticks import TRADES_SQL
from tickloom.sources.tables import late_trades, table, trades

#: The events cover 30 days from 2024-01-01: a product keeps ten of them, and is asked at the end.
WINDOW, NOW = 864_000, 1_706_659_200


def _verdicts(spark: SparkSession, sf_dir: str, window: int = WINDOW) -> DataFrame:
    return c.late_verdicts(late_trades(spark, sf_dir), window)


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.retained_bars(_verdicts(spark, sf_dir), WINDOW)


def candles_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, 3600).select("arrival_seq", "sec", "newest", "accepted")


def late_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, 3600).groupBy("source_id").agg(F.count_if(~F.col("accepted")).alias("late"), F.count_if("accepted").alias("kept"))


def candles_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir)


def candles_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.served_candles(_bars(spark, sf_dir), NOW, WINDOW, 100)


def candles_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.retention(_bars(spark, sf_dir), 3600, 40, NOW, WINDOW)


def recent_trades_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.recent_trades(_verdicts(spark, sf_dir))


def history_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.occupancy(_bars(spark, sf_dir))


def sampling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of 300 seconds."""
    start = (F.floor(F.col("source_us") / 300_000_000) * 300).cast("long")
    return trades(spark, sf_dir).groupBy("symbol", start.alias("start")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("volume"))


def sliding_event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the same user did the same within six hours before."""
    rows = trades(spark, sf_dir)
    return c.repeats_within(rows, ["instrument_id", "symbol"], "source_us", 21_600_000_000).select("arrival_seq", "seen")


def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return c.sessions(events, ["user_id"], "ts", "6 hours")


def queries() -> dict:
    return {f.__name__: f for f in (candles_late_drop, late_drop_counts, candles_retained, candles_served, candles_retention, recent_trades_ring, history_occupancy, sampling_windows, sliding_event_dedup, idle_sessions)}


def _late(window: int) -> str:
    return f"""{TRADES_SQL}, a AS (SELECT *, source_us + (arrival_seq * 7919) % 10800 * 1000000 AS arrival_us, cast(floor(source_us / 1000000) AS BIGINT) AS sec FROM t),
m AS (SELECT *, max(sec) OVER (PARTITION BY source_id, channel, instrument_id ORDER BY arrival_us, arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a),
v AS (SELECT *, newest IS NULL OR sec + {window} >= newest AS accepted FROM m)"""


_RETAINED = f"""{_late(WINDOW)}, b AS (SELECT source_id, channel, instrument_id, sec, arg_min(price, (arrival_us, arrival_seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (arrival_us, arrival_seq)) AS close, cast(sum(size) AS BIGINT) AS volume FROM v WHERE accepted GROUP BY ALL),
r AS (SELECT * EXCLUDE newest FROM (SELECT *, max(sec) OVER (PARTITION BY source_id, channel, instrument_id) AS newest FROM b) WHERE sec >= newest - {WINDOW})"""


def oracle_sql() -> dict[str, str]:
    sizes = ", ".join(f"('{n}', {s})" for n, s in c.GRANULARITIES.items())
    return {
        "candles_late_drop": f"WITH {_late(3600)} SELECT arrival_seq, sec, newest, accepted FROM v",
        "late_drop_counts": f"WITH {_late(3600)} SELECT source_id, count(*) FILTER (NOT accepted) AS late, count(*) FILTER (accepted) AS kept FROM v GROUP BY source_id",
        "candles_retained": f"WITH {_RETAINED} SELECT * FROM r",
        "candles_served": f"""WITH {_RETAINED}, g(granularity, g) AS (VALUES {sizes}),
e AS (SELECT *, cast(floor(sec / g) AS BIGINT) * g AS start FROM r, g WHERE sec >= {NOW - WINDOW} AND sec < {NOW}),
k AS (SELECT granularity, source_id, channel, instrument_id, start, arg_min(open, sec) AS open, max(high) AS high, min(low) AS low, arg_max(close, sec) AS close, cast(sum(volume) AS BIGINT) AS volume FROM e GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY granularity, source_id, channel, instrument_id ORDER BY start DESC) AS nth FROM k) WHERE nth <= 100""",
        "candles_retention": f"""WITH {_RETAINED}, s AS (SELECT DISTINCT source_id, channel, instrument_id, CASE WHEN sec >= {NOW - WINDOW} AND sec < {NOW} THEN cast(floor(sec / 3600) AS BIGINT) * 3600 END AS start FROM r)
SELECT source_id, channel, instrument_id, coalesce(min(start), {NOW}) AS oldest, coalesce(max(start), {NOW}) AS newest, count(start) > 40 AS truncated, true AS held FROM s GROUP BY ALL""",
        "recent_trades_ring": f"""WITH {_late(WINDOW)} SELECT source_id, channel, instrument_id, nth, arrival_seq, price, size, source_us
FROM (SELECT *, row_number() OVER (PARTITION BY source_id, channel, instrument_id ORDER BY arrival_us DESC, arrival_seq DESC) AS nth FROM v WHERE accepted) WHERE nth <= 50""",
        "history_occupancy": f"WITH {_RETAINED} SELECT count(DISTINCT (source_id, channel, instrument_id)) AS products, count(*) AS buckets, count(*) * 93 + count(DISTINCT (source_id, channel, instrument_id)) * 24000 AS est_bytes FROM r",
        "sampling_windows": f"WITH {TRADES_SQL} SELECT symbol, cast(floor(source_us / 300000000) AS BIGINT) * 300 AS start, count(*) AS n, cast(sum(size) AS BIGINT) AS volume FROM t GROUP BY ALL",
        "sliding_event_dedup": f"""WITH {TRADES_SQL} SELECT arrival_seq, count(*) OVER (PARTITION BY instrument_id, symbol ORDER BY source_us RANGE BETWEEN 21600000000 PRECEDING AND 1 PRECEDING) AS seen FROM t""",
        "idle_sessions": """WITH g AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
s AS (SELECT *, count(*) FILTER (gap IS NULL OR gap >= 21600000000) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
    }
