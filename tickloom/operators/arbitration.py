"""Arbitration between mirrored publishers: the first to arrive opens a tick and leads it; the others contest it.

All operators take their key and order by name. The high water of a key is a running value in two levels (ordered.py); everything
else is windowed by (key, tick) or by identity, never by the key alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.matching import queue_pairs
from tickloom.operators.ordered import running

# Bounds of the lead histogram in nanoseconds.
LEAD_BOUNDS_NS = (50_000, 100_000, 250_000, 500_000, 1_000_000, 2_500_000, 5_000_000, 10_000_000, 25_000_000, 50_000_000, 100_000_000, 250_000_000, 500_000_000, 1_000_000_000)
#: A source time so far ahead of its arrival is refused.
FUTURE_SKEW_US = 5_000_000


def canon8(x: Column) -> Column:
    """A price or size as an integer of 10^-8: copies that encode one value differently have one identity."""
    return F.round(x * 1e8).cast("decimal(38,0)")


def floor_verdicts(copies: DataFrame, key: str = "symbol", content: str | Column = "price", order: Sequence[str] = ("recv_us", "publisher", "event_id"), bucket: Column | None = None, outside: Column | None = None, numbered: str | None = None, stale_led: bool = False) -> DataFrame:
    """copies with verdict (stale, open, contest, emit or drop), leader and lead_us: how long after its tick was opened a row came.

    content: what tells two rows of one tick and publisher apart. A row with a null tick is stale after any other. outside: a verdict for rows
    that don't take part; null for the others. numbered: also number the rows of a key, in a column of this name. Only rows whose tick
    is open have a leader; with stale_led stale ones too, and how long after it they came. Rows that are outside or stale meet in no window: a tick that is never open again, such as 0, is no hot key.
    """
    order = list(order)
    if bucket is None:
        bucket = F.floor(F.col(order[0]) / 3_600_000_000)
    rows = copies.withColumn("_outside", F.lit(None).cast("string") if outside is None else outside)
    made = {"_hw": ("max", F.when(F.col("_outside").isNull(), F.col("tick")))} | ({numbered: ("count", None)} if numbered else {})
    led = running(rows, [key], order, bucket, **made)
    stale = F.when(F.col("tick").isNull() | (F.col("tick") < F.col("_hw")), "stale")
    led = led.withColumn("_known", F.coalesce("_outside", stale)).withColumn("_content", F.when(F.col("_known").isNull(), F.col(content) if isinstance(content, str) else content))
    # columns, not expressions, so that one exchange serves all the windows
    led = led.withColumn("_tick", F.when(F.col("_known").isNull(), F.col("tick")).otherwise(F.xxhash64(*order))).withColumn("_open", F.col("_known").isNull())
    tick = [key, "_open", "_tick"]
    of_tick = W.partitionBy(*tick).orderBy(*order)
    led = led.withColumn("leader", F.first("publisher").over(of_tick)).withColumn("_n_tick", F.row_number().over(of_tick)).withColumn("_opened", F.first(order[0]).over(of_tick))
    led = led.withColumn("_leads", F.col("publisher") == F.col("leader"))
    by_side = W.partitionBy(*tick, "_leads").orderBy(*order)
    by_content = W.partitionBy(*tick, "publisher", "_content").orderBy(*order)
    led = led.withColumn("_n_side", F.row_number().over(by_side)).withColumn("_n_content", F.row_number().over(by_content))
    verdict = (
        F.when(F.col("_known").isNotNull(), F.col("_known")).when(F.col("_n_tick") == 1, "open")
        .when(F.col("publisher") != F.col("leader"), F.when(F.col("_n_side") == 1, "contest").otherwise("drop"))
        .when(F.col("_n_content") == 1, "emit").otherwise("drop")
    )
    in_play = lambda c: F.when(F.col("_known").isNull(), c)
    found = led.withColumn("verdict", verdict).withColumn("lead_us", in_play(F.col(order[0]) - F.col("_opened"))).withColumn("leader", in_play(F.col("leader")))
    found = found.drop("_content", "_hw", "_n_tick", "_opened", "_n_side", "_n_content", "_known", "_outside", "_open", "_tick", "_leads")
    if not stale_led:
        return found
    # who led a stale row's tick: the first row of the tick that takes part, by an aggregation, as such a tick may have many rows
    of_row = F.struct(F.col("publisher").alias("leader"), F.col(order[0]).alias("at"))
    led_by = rows.where("_outside is null").groupBy(F.col(key).alias("_led_key"), F.col("tick").alias("_led_tick")).agg(F.min_by(of_row, F.struct(*order)).alias("_led"))
    same = (found["verdict"] == "stale") & found[key].eqNullSafe(F.col("_led_key")) & found["tick"].eqNullSafe(F.col("_led_tick"))
    found = found.join(led_by, same, "left")
    late = F.col("verdict") == "stale"
    found = found.withColumn("leader", F.when(late, F.col("_led.leader")).otherwise(F.col("leader"))).withColumn("lead_us", F.when(late, F.col(order[0]) - F.col("_led.at")).otherwise(F.col("lead_us")))
    return found.drop("_led_key", "_led_tick", "_led")


def quote_verdicts(quotes: DataFrame, order: Sequence[str], key: str = "symbol") -> DataFrame:
    """Quotes with a verdict: bypass (no source time: forwarded as it is), future (refused), or floor_verdicts() by canonical content."""
    future = F.col("source_us") > F.col("recv_us") + FUTURE_SKEW_US
    content = F.struct(*[canon8(F.col(c)).alias(c) for c in ("bid", "bid_size", "ask", "ask_size")], "bid_n", "ask_n")
    outside = F.when(F.col("source_us") == 0, "bypass").when(future, "future")
    return floor_verdicts(quotes.withColumn("tick", F.col("source_us")), key, content, order, outside=outside).drop("tick")


def depth_verdicts(depths: DataFrame, order: Sequence[str], key: str = "symbol") -> DataFrame:
    """Depths (arrays bids and asks of price and size) with a verdict. A source time of 0 is a time like any other here; stale rows have their tick's leader too."""
    levels = lambda side: F.transform(side, lambda x: F.struct(canon8(x["price"]), canon8(x["size"])))
    content = F.struct(levels("bids").alias("b"), levels("asks").alias("a"))
    outside = F.when(F.col("source_us") > F.col("recv_us") + FUTURE_SKEW_US, "future")
    return floor_verdicts(depths.withColumn("tick", F.col("source_us")), key, content, order, outside=outside, stale_led=True).drop("tick")


def trade_verdicts(trades: DataFrame, order: Sequence[str], key: str = "symbol", trade_id: str = "event_id") -> DataFrame:
    """Trades with a verdict: the first of an id is emitted, another publisher's copy contests, the same one's is dropped; id 0 bypasses.

    Exact as long as the copies of an id are not spread over more than the reference's window of 8,192 ids of a key.
    """
    w = W.partitionBy(key, trade_id).orderBy(*order)
    seen = trades.withColumn("winner", F.first("publisher").over(w)).withColumn("_n", F.row_number().over(w)).withColumn("lead_us", F.col(order[0]) - F.first(order[0]).over(w))
    verdict = F.when(F.col(trade_id) == 0, "bypass").when(F.col("_n") == 1, "emit").when(F.col("publisher") != F.col("winner"), "contest").otherwise("drop")
    return seen.withColumn("verdict", verdict).drop("_n")


def win_rate(verdicts: DataFrame) -> DataFrame:
    """Ticks that each publisher opened and contested."""
    return verdicts.groupBy("publisher").agg(F.count_if(F.col("verdict") == "open").alias("opened"), F.count_if(F.col("verdict") == "contest").alias("contested"))


def win_share(verdicts: DataFrame) -> DataFrame:
    """Per publisher the ticks it opened, and their share of all opened ticks (null if there are none). One row a publisher is windowed."""
    opened = verdicts.groupBy("publisher").agg(F.count_if(F.col("verdict") == "open").alias("opened"))
    total = F.sum("opened").over(W.partitionBy())
    return opened.withColumn("total", total).select("publisher", "opened", F.when(F.col("total") > 0, F.col("opened") / F.col("total")).alias("share"))


def lead_histogram(verdicts: DataFrame, bounds_ns: Sequence[int] = LEAD_BOUNDS_NS) -> DataFrame:
    """le_ns, n: contested rows that came at most so long after their winner, cumulative; le_ns null counts all."""
    leads = verdicts.where("verdict = 'contest'").select((F.col("lead_us") * 1000).alias("ns"))
    one = leads.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("ns") <= b).alias(f"n{b}") for b in bounds_ns])
    rows = F.array(*[F.struct(F.lit(b).cast("long").alias("le_ns"), F.col(f"n{b}").alias("n")) for b in bounds_ns], F.struct(F.lit(None).cast("long").alias("le_ns"), F.col("n")))
    return one.select(F.inline(rows))


def sequence_check(datagrams: DataFrame, order: Sequence[str], channel: Sequence[str], bucket: Column) -> DataFrame:
    """datagrams with check: first, reset (another reset_count), stale (below the era's newest sequence) or ok.

    An era is a run of equal reset counts of a channel, found with running values: no task holds a channel.
    """
    known = running(datagrams, channel, order, bucket, _before=("last_before", F.col("reset_count")))
    turn = F.col("_before").isNull() | (F.col("_before") != F.col("reset_count"))
    eras = running(known, channel, order, bucket, _era=("sum", turn.cast("long")))
    seen = running(eras, [*channel, "_era"], order, bucket, _newest=("max_before", F.col("sequence")))
    check = F.when(F.col("_before").isNull(), "first").when(turn, "reset").when(F.col("sequence") < F.col("_newest"), "stale").otherwise("ok")
    return seen.withColumn("check", check).drop("_before", "_era", "_newest")


def race_pairs(trades: DataFrame, signature: Sequence[str], order: Sequence[str], paths: Sequence[int], window_us: int) -> DataFrame:
    """Copies of a trade that two of the paths delivered at most window_us apart, paired by waiting queues: signature, first, second, delta_us, first_us."""
    return queue_pairs(trades.where(F.col("publisher").isin(list(paths))), signature, order, window_us)


def lead_for(pairs: DataFrame, leader) -> DataFrame:
    """pairs with challenger and lead_us: negative when the challenger beat the leader; pairs without the leader are left out."""
    challenger = F.when(F.col("second") == leader, F.col("first")).when(F.col("first") == leader, F.col("second"))
    lead = F.when(F.col("second") == leader, -F.col("delta_us")).otherwise(F.col("delta_us"))
    return pairs.withColumn("challenger", challenger).where("challenger is not null").withColumn("lead_us", lead)


def elect(leads: DataFrame, interval_us: int, margin_us: int, min_samples: int = 32, least_rate: float = 0.8) -> DataFrame:
    """Per window: samples, wins and upper median of each challenger, and won: the one with the least median that clears all three bars."""
    samples = leads.withColumn("window_us", F.floor(F.col("first_us") / interval_us).cast("long") * interval_us)
    of = ["window_us", "challenger"]
    per = samples.groupBy(*of).agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("lead_us") < -margin_us).alias("wins"))
    # the median by how many samples lie in each range of leads, then within its range
    nth = running(samples.select(*of, "lead_us"), of, ["lead_us"], F.floor(F.col("lead_us") / 1_000_000), _n=("count", None))
    median = nth.join(per.select(*of, "samples"), of).where(F.col("_n") == F.floor(F.col("samples") / 2) + 1).select(*of, F.col("lead_us").alias("median_us"))
    found = per.join(median, of)
    fit = (F.col("samples") >= min_samples) & (F.col("wins") / F.col("samples") >= least_rate) & (F.col("median_us") <= -margin_us)
    best = F.min(F.when(fit, F.struct("median_us", "challenger"))).over(W.partitionBy("window_us"))
    return found.withColumn("_best", best).withColumn("won", F.coalesce(fit & (F.col("challenger") == F.col("_best.challenger")), F.lit(False))).drop("_best")


def transfer_reason(prev: Column, before: Column, after: Column, publisher: Column) -> Column:
    """Why authority over a market moved: initial, silence or health; null where it did not, or is counted elsewhere."""
    return F.when(before.isNull(), "initial").when(~before.eqNullSafe(after), "silence").when(~after.eqNullSafe(publisher) & ~prev.eqNullSafe(publisher), "health")


def tape_owners(receivers: DataFrame) -> DataFrame:
    """The row of each universe (venue, category) that serves its tape: least (liveness, rank of kind, port); only two kinds can."""
    rank = F.when(F.col("kind") == "top_of_book", 0).when(F.col("kind") == "market_by_price", 1)
    return receivers.withColumn("rank", rank).where("rank is not null").groupBy("venue", "category").agg(F.min(F.struct("liveness", "rank", "port", "kind")).alias("o")).select("venue", "category", "o.kind", "o.port", "o.liveness")


def shred_verdicts(packets: DataFrame, window: int, order: Sequence[str], bucket: Column) -> DataFrame:
    """packets (slot, fingerprint, valid, grp) with a verdict: forward, drop (invalid, or the winner's own copy) or duplicate.

    The first valid packet of a key wins and is remembered while its slot is within `window` of the newest valid slot. A valid packet
    below that horizon is forwarded and not remembered. The newest slot is a running maximum in two levels over all packets.
    """
    slot = F.when(F.col("valid"), F.col("slot"))
    one = packets.withColumn("_all", F.lit(0))
    tips = running(running(one, ["_all"], order, bucket, _tip=("max", slot)), ["_all"], order, bucket, _tip_before=("max_before", slot)).drop("_all")
    kept = F.col("valid") & (F.col("slot") >= F.col("_tip") - window)
    earlier = W.partitionBy("slot", "fingerprint").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    seen = tips.withColumn("winner", F.first(F.when(kept, F.col("grp")), ignorenulls=True).over(earlier))
    held = F.col("winner").isNotNull() & (F.col("slot") >= F.coalesce("_tip_before", F.lit(0)) - window)
    verdict = F.when(held, F.when(F.col("winner") == F.col("grp"), "drop").otherwise("duplicate")).when(F.col("valid"), "forward").otherwise("drop")
    return seen.withColumn("verdict", verdict).drop("_tip", "_tip_before", "winner")
