"""OHLCV candles: one-second buckets by arrival, rolled up by bucket time; late drops, retention and recent trades.

A product is named by KEY. `window` is how many seconds of history a product keeps, `now` the second that a query is asked at; both
are parameters everywhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.ordered import running

KEY = ("source_id", "channel", "instrument_id")
WINDOW_SECONDS = 3600
#: Names and seconds of the granularities that are served.
GRANULARITIES = {"ONE_MINUTE": 60, "FIVE_MINUTE": 300, "FIFTEEN_MINUTE": 900, "THIRTY_MINUTE": 1800, "ONE_HOUR": 3600, "TWO_HOUR": 7200, "SIX_HOUR": 21_600, "ONE_DAY": 86_400}
CANDLE_LIMIT, TRADE_RING, TICKER_LIMIT = 350, 1000, 50
#: Bytes that a bucket, and a print of the ring, are taken to occupy.
BYTES_A_BUCKET, BYTES_A_PRINT = 93, 24


def second_of(us: Column) -> Column:
    return F.floor(us / 1_000_000).cast("long")


def one_second_bars(trades: DataFrame, key: Sequence[str] = KEY, order: Sequence[str] = ("arrival_seq",)) -> DataFrame:
    """Open and close go by arrival within a second. One partial aggregation, one shuffle on (key, sec)."""
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return trades.withColumn("sec", second_of(F.col("source_us"))).groupBy(*key, "sec").agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", place).alias("close"), F.sum("size").cast("long").alias("volume")
    )


def _rolled(key: Sequence[str]) -> list[Column]:
    return [F.min_by("open", "sec").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "sec").alias("close"), F.sum("volume").cast("long").alias("volume")]


def rollup(bars: DataFrame, seconds: int, key: Sequence[str] = KEY) -> DataFrame:
    """Candles of `seconds` (0 counts as 1): across buckets open and close go by bucket time."""
    seconds = max(1, seconds)
    start = (F.floor(F.col("sec") / seconds) * seconds).cast("long")
    return bars.withColumn("start", start).groupBy(*key, "start").agg(*_rolled(key))


def late_verdicts(trades: DataFrame, window: int = WINDOW_SECONDS, key: Sequence[str] = KEY) -> DataFrame:
    """trades (arrival_us, arrival_seq, source_us) with sec, newest (second seen before, null at first) and accepted.

    A trade is late if its second lies more than `window` before the newest that its product has seen; at the boundary it is kept.
    The newest second is a running value in two levels, so that a busy product is no single task.
    """
    seen = running(trades.withColumn("sec", second_of(F.col("source_us"))), list(key), ["arrival_us", "arrival_seq"], F.floor(F.col("arrival_us") / 3_600_000_000), newest=("max_before", F.col("sec")))
    return seen.withColumn("accepted", F.col("newest").isNull() | (F.col("sec") + window >= F.col("newest")))


def retained_bars(verdicts: DataFrame, window: int = WINDOW_SECONDS, key: Sequence[str] = KEY) -> DataFrame:
    """One-second bars of accepted trades, without those that lie more than `window` before the newest of their product."""
    bars = one_second_bars(verdicts.where("accepted"), key, ("arrival_us", "arrival_seq"))
    newest = bars.groupBy(*key).agg(F.max("sec").alias("_newest"))
    return bars.join(newest, list(key)).where(F.col("sec") >= F.col("_newest") - window).drop("_newest")


def served_candles(bars: DataFrame, now: int, window: int = WINDOW_SECONDS, limit: int = CANDLE_LIMIT, granularities: Mapping[str, int] = GRANULARITIES, key: Sequence[str] = KEY) -> DataFrame:
    """granularity, key, nth (1: newest), start, OHLCV of all granularities over [now - window, now), at most `limit` each. Empty intervals have no row."""
    inside = bars.where((F.col("sec") >= now - window) & (F.col("sec") < now))
    sizes = F.array(*[F.struct(F.lit(n).alias("granularity"), F.lit(s).cast("long").alias("g")) for n, s in granularities.items()])
    each = inside.select("*", F.inline(sizes)).withColumn("start", (F.floor(F.col("sec") / F.col("g")) * F.col("g")).cast("long"))
    rolled = each.groupBy("granularity", *key, "start").agg(*_rolled(key))
    nth = F.row_number().over(W.partitionBy("granularity", *key).orderBy(F.desc("start")))
    return rolled.withColumn("nth", nth).where(F.col("nth") <= limit)


def retention(bars: DataFrame, seconds: int, limit: int, now: int, window: int = WINDOW_SECONDS, key: Sequence[str] = KEY) -> DataFrame:
    """Per product that is held: oldest and newest candle (now if there is none) and whether `limit` cuts any."""
    inside = F.when((F.col("sec") >= now - window) & (F.col("sec") < now), (F.floor(F.col("sec") / max(1, seconds)) * max(1, seconds)).cast("long"))
    starts = bars.select(*key, inside.alias("start")).distinct()
    return starts.groupBy(*key).agg(
        F.coalesce(F.min("start"), F.lit(now).cast("long")).alias("oldest"), F.coalesce(F.max("start"), F.lit(now).cast("long")).alias("newest"), (F.count("start") > limit).alias("truncated"), F.lit(True).alias("held")
    )


def recent_trades(verdicts: DataFrame, limit: int = TICKER_LIMIT, key: Sequence[str] = KEY) -> DataFrame:
    """The newest accepted trades of each product by arrival, at most `limit` (and the ring's 1,000), nth = 1 the newest.

    Spark keeps only the first `limit` rows of each group before the shuffle too, so a busy product costs a task no more than others.
    """
    w = W.partitionBy(*key).orderBy(F.desc("arrival_us"), F.desc("arrival_seq"))
    return verdicts.where("accepted").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= min(limit, TRADE_RING)).select(*key, "nth", "arrival_seq", "price", "size", "source_us")


def occupancy(bars: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row: products, buckets and est_bytes."""
    per = bars.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("products"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("buckets"))
    return per.select("products", "buckets", (F.col("buckets") * BYTES_A_BUCKET + F.col("products") * (TRADE_RING * BYTES_A_PRINT)).alias("est_bytes"))


def sessions(events: DataFrame, key: Sequence[str], time: str, gap: str) -> DataFrame:
    """key, start_us, end_us (its last event's time) and n of each run of events with no idle time of `gap` between them."""
    found = events.groupBy(*key, F.session_window(time, gap)).agg(F.unix_micros(F.min(time)).alias("start_us"), F.unix_micros(F.max(time)).alias("end_us"), F.count(F.lit(1)).alias("n"))
    return found.drop("session_window")


def repeats_within(events: DataFrame, identity: Sequence[str], time_us: str, window_us: int) -> DataFrame:
    """events with seen: how many of the same identity lie within the window before; 0 means the event is not a repeat."""
    w = W.partitionBy(*identity).orderBy(time_us).rangeBetween(-window_us, -1)
    return events.withColumn("seen", F.count(F.lit(1)).over(w))
