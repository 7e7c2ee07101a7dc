"""Streams by watermark: candles, trades once an id, sessions. State is dropped as the watermark passes.

Spark's watermark is one for the whole stream, where the batch operators know a newest time per product: a stream drops at least
what they drop if its delay is the products' window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.candles import KEY


def timed(rows: DataFrame, us: str, late: str) -> DataFrame:
    """rows with a column at, their time, as the watermark with a delay of `late`."""
    return rows.withColumn("at", F.timestamp_micros(us)).withWatermark("at", late)


def bars(trades: DataFrame, late: str = "1 hour", every: str = "1 second", key: Sequence[str] = KEY) -> DataFrame:
    """Candles of `every`: open and close by arrival_seq."""
    found = timed(trades, "source_us", late).groupBy(*key, F.window("at", every).alias("w")).agg(
        F.min_by("price", "arrival_seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "arrival_seq").alias("close"), F.sum("size").cast("long").alias("volume")
    )
    return found.select(*key, F.unix_seconds("w.start").alias("sec"), "open", "high", "low", "close", "volume")


def first_of_id(trades: DataFrame, late: str = "10 seconds", key: Sequence[str] = ("symbol", "event_id"), us: str = "recv_us") -> DataFrame:
    """Each trade id once, the first that comes; ids are remembered for `late`."""
    return timed(trades, us, late).dropDuplicatesWithinWatermark(list(key))


def sessions(events: DataFrame, key: Sequence[str], us: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of events with no idle time of `gap` between them."""
    found = timed(events, us, late).groupBy(*key, F.session_window("at", gap).alias("w")).agg(F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count(F.lit(1)).alias("n"))
    return found.drop("w")
