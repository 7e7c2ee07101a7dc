"""Order books: folds of order flow and of price levels, views of them and their wire forms.

A market is `instrument_id`; sides are "bid" and "ask". Best first means the highest bid and the lowest ask.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.ordered import running

DEPTH_LEVELS, BOOK_LEVELS = 10, 50
#: Adds, executions and cancels as `seq_kind`.
ADD, EXECUTE, CANCEL = 0, 1, 2


def best_first(price: str = "price") -> Column:
    """Ascending, a price that is better on its side comes first."""
    return F.when(F.col("side") == "bid", -F.col(price)).otherwise(F.col(price))


def order_book(flow: DataFrame) -> DataFrame:
    """The orders alive after all of a gap-free flow: not cancelled, and something left of what was added. One aggregation."""
    left = F.sum(F.when(F.col("seq_kind") == ADD, F.col("qty")).when(F.col("seq_kind") == EXECUTE, -F.col("qty")).otherwise(0))
    per = flow.groupBy("instrument_id", "order_id", "side", "price").agg(left.cast("long").alias("size"), F.max((F.col("seq_kind") == CANCEL).cast("int")).alias("_gone"))
    return per.where("size > 0 and _gone = 0").drop("_gone")


#: Prices (in their own units) that a bucket of an ordered book spans.
PRICES = 1000


def _numbered(rows: DataFrame, more: Sequence[str], name: str) -> DataFrame:
    """rows numbered within their market, bids first and best first. Counted by ranges of prices first: no task holds a market."""
    placed = rows.withColumn("_s", F.when(F.col("side") == "bid", 0).otherwise(1)).withColumn("_p", best_first())
    found = running(placed, ["instrument_id"], ["_s", "_p", *more], F.struct("_s", F.floor(F.col("_p") / PRICES).alias("_r")), **{name: ("count", None)})
    return found.drop("_s", "_p").withColumn(name, F.col(name).cast("int"))


def order_set(book: DataFrame) -> DataFrame:
    """book with nth, the deterministic order of a market's orders: bids first, best first, ties by order_id."""
    return _numbered(book, ["order_id"], "nth")


def price_fold(book: DataFrame) -> DataFrame:
    """Levels: size and number of the orders at each price."""
    return book.groupBy("instrument_id", "side", "price").agg(F.sum("size").cast("long").alias("size"), F.count(F.lit(1)).alias("n"))


def _best_levels(levels: DataFrame, n: int) -> DataFrame:
    """The n best levels of each side with nth; a rank that only this cut reads is taken in every task before the shuffle."""
    side = W.partitionBy("instrument_id", "side")
    return levels.withColumn("nth", F.row_number().over(side.orderBy(best_first()))).where(F.col("nth") <= n)


def top_levels(levels: DataFrame, n: int = DEPTH_LEVELS) -> DataFrame:
    """The n best levels of each side with nth, and levels: how many the side has."""
    many = levels.groupBy("instrument_id", "side").agg(F.count(F.lit(1)).alias("levels"))
    return _best_levels(levels, n).join(many, ["instrument_id", "side"])


def best(levels: DataFrame) -> DataFrame:
    """Best bid and ask of each market with their sizes; null where a side is empty."""
    at = {s: F.when(F.col("side") == s, F.col("price")) for s in ("bid", "ask")}
    return levels.groupBy("instrument_id").agg(
        F.max(at["bid"]).alias("bid"), F.max_by("size", at["bid"]).alias("bid_size"), F.min(at["ask"]).alias("ask"), F.min_by("size", at["ask"]).alias("ask_size")
    )


def crossed(levels: DataFrame) -> DataFrame:
    """Markets and whether their best bid lies above their best ask; a market with one side is not crossed."""
    return best(levels).select("instrument_id", F.coalesce(F.col("bid") > F.col("ask"), F.lit(False)).alias("crossed"))


def valid_prefix(deltas: DataFrame, key: Sequence[str], seq: str, width: int = 100_000) -> DataFrame:
    """The deltas of each key up to its first gap in `seq`, which starts at 1; of deltas that repeat a number the first by `seq_place` stays.

    A delta is in the prefix if as many numbers lie at or before it as it says: counted by ranges of `width` numbers first.
    """
    once = deltas.withColumn("_n", F.row_number().over(W.partitionBy(*key, seq).orderBy("seq_place"))).where("_n = 1").drop("_n")
    return running(once, key, [seq], F.floor(F.col(seq) / width), _n=("count", None)).where(F.col("_n") == F.col(seq)).drop("_n")


def complete_snapshots(begins: DataFrame, levels: DataFrame) -> DataFrame:
    """begins (snapshot_id, instrument_id, total, last_seq) of the snapshots that brought as many levels as they promised."""
    brought = levels.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("_n"))
    return begins.join(brought, "snapshot_id", "left").where(F.coalesce("_n", F.lit(0)) == F.col("total")).drop("_n")


def recovered(begins: DataFrame, levels: DataFrame, deltas: DataFrame) -> DataFrame:
    """Levels of each market after a loss: the complete snapshot that holds the latest delta, and the deltas (seq, side, price, qty) that go on from it without a gap.

    applied: how many deltas did. Deltas behind a gap wait for another snapshot; of those that repeat a number the first by seq_place counts.
    A market without a complete snapshot has no book. Only the snapshot's number and the count are kept per market and sent to all tasks: a
    shuffle by market would give a task the whole of one.
    """
    last = complete_snapshots(begins, levels).groupBy("instrument_id").agg(F.max(F.struct("last_seq", "snapshot_id")).alias("s")).select("instrument_id", "s.*")
    last = F.broadcast(last)
    after = deltas.join(last, "instrument_id").where("seq > last_seq").withColumn("seq", F.col("seq") - F.col("last_seq"))
    going = valid_prefix(after, ["instrument_id"], "seq").select("instrument_id", "seq", "side", "price", "qty")
    base = levels.join(last, ["snapshot_id"]).select("instrument_id", F.lit(0).cast("long").alias("seq"), "side", "price", F.col("size").alias("qty"))
    applied = going.groupBy("instrument_id").agg(F.max("seq").alias("applied"))
    return level_book(base.unionByName(going), ["seq"]).join(F.broadcast(applied), "instrument_id", "left").withColumn("applied", F.coalesce("applied", F.lit(0)))


def epochs(rows: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column, reset: Column) -> DataFrame:
    """rows with epoch: how many resets of its key lie at or before it. Operators that forget at a reset take it as one more key."""
    return running(rows, key, order, bucket, epoch=("sum", F.coalesce(reset.cast("long"), F.lit(0))))


def level_book(updates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Levels after all updates: the last size of each price, without those that ended at 0. One aggregation with partial combine."""
    last = updates.groupBy("instrument_id", "side", "price").agg(F.max_by("qty", F.struct(*order)).alias("size"))
    return last.where("size > 0")


def fold_with_clears(updates: DataFrame, order: Sequence[str], clears: Column) -> DataFrame:
    """Levels after updates some of which clear their side first, and baselined: both sides of the market were cleared once.

    The last clear of each side is found first; levels are then folded from what comes with it or after it.
    """
    place = F.struct(*order)
    marked = updates.withColumn("_place", place)
    last = marked.where(clears).groupBy("instrument_id", "side").agg(F.max("_place").alias("_from"))
    sides = last.groupBy("instrument_id").agg((F.count(F.lit(1)) == 2).alias("baselined"))
    live = marked.join(last, ["instrument_id", "side"], "left").where(F.col("_from").isNull() | (F.col("_place") >= F.col("_from")))
    return level_book(live, order).join(sides, "instrument_id", "left").withColumn("baselined", F.coalesce("baselined", F.lit(False)))


def fold_with_outward_clears(updates: DataFrame, order: Sequence[str], bucket: Column) -> DataFrame:
    """Levels after updates (action set, clear or clear_from) of sides: clear empties its side, clear_from all that lies at its price or further out.

    Outward is down for bids and up for asks. A level's last set stands unless a later clear reaches its price, so what counts for it is the
    clear that reaches furthest in from then on: a running extreme from the end. order: numeric columns; bucket: never falls along them. A
    clear_from without a price clears nothing.
    """
    reach = F.when(F.col("action") == "clear", F.lit((1 << 62))).when(F.col("action") == "clear_from", -best_first())
    back = updates.withColumns({f"_b{i}": -F.col(c) for i, c in enumerate(order)})
    met = running(back, ["instrument_id", "side"], [f"_b{i}" for i in range(len(order))], -bucket, _reach=("max_before", reach.cast("long")))
    last = met.where("action = 'set'").groupBy("instrument_id", "side", "price").agg(F.max_by(F.struct("qty", "_reach"), F.struct(*order)).alias("s"))
    stands = F.col("s._reach").isNull() | (-F.col("s._reach") > best_first())
    return last.where(stands & (F.col("s.qty") > 0)).select("instrument_id", "side", "price", F.col("s.qty").alias("size"))


def rebaseline(levels: DataFrame) -> DataFrame:
    """The messages that rebuild each book: ord 0 clears it, then one set a level, bids first and best first; last marks the end."""
    sets = _numbered(levels, [], "ord").select("instrument_id", "ord", F.lit("set").alias("action"), "side", "price", "size")
    clear = levels.select("instrument_id").distinct().select("instrument_id", F.lit(0).alias("ord"), F.lit("clear").alias("action"), *[F.lit(None).cast(t).alias(c) for c, t in (("side", "string"), ("price", "long"), ("size", "long"))])
    every = sets.unionByName(clear)
    n = every.groupBy("instrument_id").agg(F.max("ord").alias("_n"))
    return every.join(n, "instrument_id").withColumn("last", F.col("ord") == F.col("_n")).drop("_n")


def bucketed_levels(levels: DataFrame, sig_figs: int, mantissa: int = 1, n_levels: int = 20, scale: int = 1) -> DataFrame:
    """Levels merged into buckets of so many significant figures: bids round down, asks up, sizes and counts add, the n best stay.

    Prices are whole numbers of 10^-8 times `scale` units; all arithmetic is on integers.
    """
    v = (F.col("price") * scale).cast("long")
    digits = F.length(v.cast("string"))
    inc = F.pow(F.lit(10.0), F.greatest(F.lit(0), digits - sig_figs)).cast("long") * mantissa
    low = v - F.pmod(v, inc)
    bucket = F.when((F.col("side") == "bid") | (low == v), low).otherwise(low + inc)
    merged = levels.withColumn("price", bucket).groupBy("instrument_id", "side", "price").agg(F.sum("size").cast("long").alias("size"), F.sum("n").cast("long").alias("n"))
    return _best_levels(merged, n_levels)


def order_diffs(flow: DataFrame, order: Sequence[str] = ("seq_kind", "seq_no")) -> DataFrame:
    """What each change of an order publishes: new (size), update (from orig_size) or remove, against the size published before."""
    of = W.partitionBy("instrument_id", "order_id").orderBy(*order)
    step = F.when(F.col("seq_kind") == ADD, F.col("qty")).when(F.col("seq_kind") == EXECUTE, -F.col("qty")).otherwise(0)
    left = F.sum(step).over(of.rowsBetween(W.unboundedPreceding, 0)).cast("long")
    size = flow.withColumn("size", F.when(F.col("seq_kind") == CANCEL, 0).otherwise(F.greatest(left, F.lit(0))).cast("long"))
    before = F.lag("size").over(of)
    held = F.coalesce(before, F.lit(0)) > 0
    diff = F.when(F.col("size") == 0, "remove").when(held, "update").otherwise("new")
    return size.withColumn("diff", diff).withColumn("orig_size", F.when((F.col("diff") == "update"), before)).select("instrument_id", "order_id", *order, "diff", "orig_size", "size")


def prints(flow: DataFrame) -> DataFrame:
    """Executions as trade prints: their price and size, cumulative 0, and never the owner of the tape."""
    return flow.where(F.col("seq_kind") == EXECUTE).select("instrument_id", "order_id", "seq_no", "side", "price", F.col("qty").alias("size"), F.lit(0).cast("long").alias("cumulative"), F.lit(False).alias("owns_tape"))


def coverage(instruments: DataFrame, levels: DataFrame, baselined: DataFrame, depth: DataFrame, cap: int = BOOK_LEVELS, depth_levels: int = DEPTH_LEVELS) -> DataFrame:
    """Per instrument where its book is served from, how many levels, and complete: a claim about what was delivered.

    An accumulated book is complete if it was baselined and no side is cut by the cap; a depth (levels a side, by symbol) only if both
    sides have fewer levels than a depth holds; without either the book is empty and not complete.
    """
    per = levels.groupBy("instrument_id").agg(F.count_if(F.col("side") == "bid").alias("bids"), F.count_if(F.col("side") == "ask").alias("asks"))
    held = per.join(baselined, "instrument_id", "left")
    found = instruments.join(held, "instrument_id", "left").join(depth.select("symbol", F.col("bids").alias("d_bids"), F.col("asks").alias("d_asks")), "symbol", "left")
    source = F.when(F.col("bids").isNotNull(), "book").when(F.col("d_bids").isNotNull(), "depth").otherwise("none")
    returned = F.when(F.col("source") == "book", F.least("bids", F.lit(cap)) + F.least("asks", F.lit(cap))).when(F.col("source") == "depth", F.col("d_bids") + F.col("d_asks")).otherwise(0)
    whole = F.when(F.col("source") == "book", F.coalesce("baselined", F.lit(False)) & (F.col("bids") <= cap) & (F.col("asks") <= cap)).when(F.col("source") == "depth", (F.col("d_bids") < depth_levels) & (F.col("d_asks") < depth_levels)).otherwise(False)
    return found.withColumn("source", source).select("instrument_id", "source", returned.cast("long").alias("levels_returned"), F.when(F.col("source") == "depth", depth_levels).otherwise(cap).alias("levels_capped_at"), whole.alias("complete"))
