"""Queries over trades and mirrored publishers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.operators.arbitration import floor_verdicts, win_rate
from tickloom.operators.candles import one_second_bars, rollup
from tickloom.sources.tables import mirrored, trades

GRANULARITIES = {"1m": 60, "1h": 3600, "1d": 86400}


def candles_1s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_second_bars(trades(spark, sf_dir))


def _rollup(seconds: int):
    return lambda spark, sf_dir: rollup(candles_1s(spark, sf_dir), seconds)


def quote_floor_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return floor_verdicts(mirrored(spark, sf_dir), numbered="arrival_seq").select("event_id", "publisher", "symbol", "arrival_seq", "verdict")


def quote_floor_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_floor_verdicts(spark, sf_dir).where("verdict in ('open', 'emit')").select("event_id", "publisher", "symbol", "arrival_seq")


def tick_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_rate(floor_verdicts(mirrored(spark, sf_dir)))


def queries() -> dict:
    return {f.__name__: f for f in (candles_1s, quote_floor_verdicts, quote_floor_admitted, tick_win_rate)} | {f"candles_rollup_{g}": _rollup(s) for g, s in GRANULARITIES.items()}


TRADES_SQL = """t AS (SELECT event_id AS arrival_seq, 1 + user_id % 3 AS source_id, user_id % 4 AS channel, user_id AS instrument_id,
  event_type AS symbol, value AS price, 1 + event_id % 7 AS size, epoch_us(ts) AS source_us FROM events)"""
_BARS = f"""{TRADES_SQL}, b AS (SELECT source_id, channel, instrument_id, cast(floor(source_us / 1000000) AS BIGINT) AS sec, arg_min(price, arrival_seq) AS open,
  max(price) AS high, min(price) AS low, arg_max(price, arrival_seq) AS close, cast(sum(size) AS BIGINT) AS volume FROM t GROUP BY ALL)"""
COPIES_SQL = f"""{TRADES_SQL}, p AS (SELECT t.arrival_seq AS event_id, channel, instrument_id, symbol, price, size, publisher, cast(floor(source_us / 600000000) AS BIGINT) AS tick,
    source_us + (t.arrival_seq * 7919 + publisher * 104729) % 900 * 1000000 AS recv_us
  FROM t, (SELECT unnest([0, 1, 2])::BIGINT AS publisher) WHERE (t.arrival_seq + publisher) % 11 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY recv_us, publisher, event_id) AS arrival_seq FROM p)"""
_VERDICTS = f"""{COPIES_SQL}, l AS (SELECT *, max(tick) OVER (PARTITION BY symbol ORDER BY arrival_seq) AS hw, first_value(publisher) OVER k AS leader, row_number() OVER k AS n_tick
  FROM n WINDOW k AS (PARTITION BY symbol, tick ORDER BY arrival_seq)),
c AS (SELECT *, row_number() OVER (PARTITION BY symbol, tick, publisher = leader ORDER BY arrival_seq) AS n_side,
  row_number() OVER (PARTITION BY symbol, tick, publisher, price ORDER BY arrival_seq) AS n_content FROM l),
v AS (SELECT event_id, publisher, symbol, arrival_seq, CASE WHEN tick < hw THEN 'stale' WHEN n_tick = 1 THEN 'open'
  WHEN publisher <> leader THEN CASE WHEN n_side = 1 THEN 'contest' ELSE 'drop' END WHEN n_content = 1 THEN 'emit' ELSE 'drop' END AS verdict FROM c)"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "candles_1s": f"WITH {_BARS} SELECT * FROM b",
        "quote_floor_verdicts": f"WITH {_VERDICTS} SELECT * FROM v",
        "quote_floor_admitted": f"WITH {_VERDICTS} SELECT event_id, publisher, symbol, arrival_seq FROM v WHERE verdict IN ('open', 'emit')",
        "tick_win_rate": f"WITH {_VERDICTS} SELECT publisher, count(*) FILTER (verdict = 'open') AS opened, count(*) FILTER (verdict = 'contest') AS contested FROM v GROUP BY publisher",
    }
    for g, s in GRANULARITIES.items():
        sql[f"candles_rollup_{g}"] = f"""WITH {_BARS} SELECT source_id, channel, instrument_id, cast(floor(sec / {s}) AS BIGINT) * {s} AS start, arg_min(open, sec) AS open,
  max(high) AS high, min(low) AS low, arg_max(close, sec) AS close, cast(sum(volume) AS BIGINT) AS volume FROM b GROUP BY ALL"""
    return sql
