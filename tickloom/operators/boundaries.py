"""The book as it stands at every boundary: best prices, crossed or not, the best levels, and the book as of a moment.

book_of() and best_as_of() deal updates once, by market, and a task reads them in order: it holds the levels of one book. Markets of more
than LONG updates would be too much for one task. Their updates, and only theirs, take the way that the rest of this text is about.

A level's life is an interval of boundaries: from the datagram that set its size to the one that sets it anew. Boundaries are cut into blocks
of 2^BLOCK. A life goes to the block that it begins in and to the one that it ends in; of those that hold through a block only the best
count: the blocks between are cut into dyadic pieces (2^k blocks from a multiple of 2^k on), two for each k at most, the best levels of
every piece are kept and handed down. A task sweeps over the lives of one block at a time. No task holds such a market or its stream.

A market is `instrument_id`; a moment is the columns that order datagrams, the first of them a number.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.operators.books import DEPTH_LEVELS, best_first
from tickloom.operators.ordered import running

MARKET = "instrument_id"
#: A block has 2^BLOCK boundaries.
BLOCK = 10
#: Updates that a market has at most if a task reads them all.
LONG = 1 << 16
#: Rows of a batch that is sent on.
BATCH = 4_000


def boundaries(updates: DataFrame, moment: Sequence[str], bucket: Column) -> DataFrame:
    """instrument_id, moment and ord (from 0) of each datagram. bucket: a value that never falls along the moments of a market."""
    every = updates.select(MARKET, *moment).distinct()
    return running(every, [MARKET], moment, bucket, ord=("count", None)).withColumn("ord", F.col("ord") - 1)


def lives(updates: DataFrame, bounds: DataFrame, moment: Sequence[str], order: Sequence[str]) -> DataFrame:
    """instrument_id, side, price, size, since and until (boundaries; null if it never ends) of every level that updates (absolute sizes) made.

    Of a datagram's updates to a level the last by `order` counts; size 0 ends a level.
    """
    level = [MARKET, "side", "price"]
    last = updates.join(bounds, [MARKET, *moment]).groupBy(*level, "ord").agg(F.max_by("qty", F.struct(*order)).alias("size"))
    after = F.lead("ord").over(W.partitionBy(*level).orderBy("ord"))
    return last.withColumn("until", after).where("size > 0").select(*level, "size", F.col("ord").alias("since"), "until")


def _best(rows: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The n best levels of each side for each key."""
    nth = F.row_number().over(W.partitionBy(*by, "side").orderBy(best_first()))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def _covered(lives: DataFrame, blocks: int, n: int) -> DataFrame:
    """instrument_id, block, side, price, size: the n best lives of each side that hold through a whole block, and from the boundary before it."""
    top = max(0, (blocks - 1).bit_length())

    def pieces(k: Column) -> Column:
        first = F.expr(f"ceil((since div {1 << BLOCK} + 1) / power(2, k))").cast("long")
        end = F.expr(f"floor(coalesce(until div {1 << BLOCK}, {1 << top}) / power(2, k))").cast("long")
        node = lambda i: F.struct(k.alias("k"), i.alias("i"))
        return F.array(F.when((first < end) & (first % 2 == 1), node(first)), F.when((first < end) & (end % 2 == 1), node(end - 1)))

    cut = lives.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("_p", F.explode(pieces(F.col("k")))).where("_p is not null")
    each = _best(cut.select(MARKET, "side", "price", "size", F.col("_p.k").alias("k"), F.col("_p.i").alias("i")), [MARKET, "k", "i"], n)
    span = F.expr("cast(power(2, k) as bigint)")
    down = each.withColumn("block", F.explode(F.sequence(F.col("i") * span, (F.col("i") + 1) * span - 1))).where(F.col("block") < blocks)
    return _best(down.select(MARKET, "block", "side", "price", "size"), [MARKET, "block"], n)


class _Side:
    """The levels of a side that are alive, best first."""

    def __init__(self, sign: int):
        self.sign, self.ranks, self.sizes = sign, [], {}

    def begin(self, price, size) -> None:
        insort(self.ranks, self.sign * price)
        self.sizes[self.sign * price] = size

    def end(self, price) -> None:
        del self.ranks[bisect_left(self.ranks, self.sign * price)], self.sizes[self.sign * price]

    def best(self, n: int) -> list[tuple]:
        return [(self.sign * r, self.sizes[r]) for r in self.ranks[:n]]


def _swept(asked: list[int], lives: list[tuple], n: int) -> Iterator[tuple[list, list, bool]]:
    """bids, asks and published at each boundary of a block: asked, in order. lives: side, price, size, since and until."""
    book, at = {"bid": _Side(-1), "ask": _Side(1)}, asked[0] - 1
    turns = sorted([(max(since, at), 1, side, price, size) for side, price, size, since, _ in lives] + [(until, 0, side, price, 0) for side, price, _, _, until in lives if until is not None and until <= asked[-1]])
    i, seen = 0, None
    for o in [at, *asked]:
        moved = seen is None
        while i < len(turns) and turns[i][0] <= o:
            _, begins, side, price, size = turns[i]
            book[side].begin(price, size) if begins else book[side].end(price)
            i, moved = i + 1, True
        now = (book["bid"].best(n), book["ask"].best(n)) if moved else seen
        if o > at:
            yield *now, o == 0 or now != seen
        seen = now


def levels_at(bounds: DataFrame, lives: DataFrame, n: int = DEPTH_LEVELS) -> DataFrame:
    """bounds with bids and asks, the n best levels of each side as arrays of (price, size), best first; and published: false where both are as at the boundary before.

    A level without a price, or of another side, is none.
    """
    count = (bounds.agg(F.max("ord")).first()[0] or 0) + 1
    lives = lives.where("price is not null and side in ('bid', 'ask')")
    block = lambda c: F.expr(f"{c} div {1 << BLOCK}")
    # a life is sent to the block that it begins in, and to the one that it ends in
    ends = F.when(F.col("until").isNotNull() & (block("until") > block("since")), F.array(block("since"), block("until"))).otherwise(F.array(block("since")))
    part = lives.withColumn("block", F.explode(ends)).select(MARKET, "block", "side", "price", "size", "since", "until")
    blocks = (count - 1 >> BLOCK) + 1
    if blocks > 1:
        through = _covered(lives, blocks, n)
        part = part.unionByName(through.withColumn("since", F.col("block") * (1 << BLOCK) - 1).withColumn("until", F.lit(None).cast("long")))
    price, size = lives.schema["price"].dataType, lives.schema["size"].dataType
    level = T.ArrayType(T.StructType([T.StructField("price", price), T.StructField("size", size)]))
    schema = T.StructType([*bounds.schema.fields, T.StructField("bids", level), T.StructField("asks", level), T.StructField("published", T.BooleanType())])
    own = [c for c in bounds.columns if c not in (MARKET, "ord")]
    both = bounds.withColumn("block", block("ord")).withColumn("since", F.col("ord")).unionByName(part, allowMissingColumns=True)
    columns = [MARKET, "block", "ord", "side", "price", "size", "since", "until", *own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], names=types.names)

        rows = (r for batch in batches for r in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True))
        out = []
        for (market, _), group in groupby(rows, key=lambda r: r[:2]):
            asked, held = [], []
            for r in group:
                (held if r[2] is None else asked).append(r)
            if not asked:  # a level that is there still when its market's boundaries end
                continue
            for r, found in zip(asked, _swept([r[2] for r in asked], [r[3:8] for r in held], n), strict=True):
                values = {MARKET: market, "ord": r[2], **dict(zip(own, r[8:], strict=True))}
                out.append((*(values[c] for c in schema.names[:-3]), *found))
            while len(out) >= 4000:
                yield made(out[:4000])
                del out[:4000]
        if out:
            yield made(out)

    # by a hash of its own, so that no join's dealing stands in for it
    return both.select(columns).repartition(F.xxhash64(MARKET, "block")).sortWithinPartitions(MARKET, "block", "ord").mapInArrow(run, schema)


def best_at(bounds: DataFrame, lives: DataFrame) -> DataFrame:
    """bounds with bid, bid_size, ask, ask_size and crossed (bid above ask; false with an empty side) after each."""
    return _with_best(levels_at(bounds, lives, 1), bounds.columns)


def depth_at(bounds: DataFrame, lives: DataFrame, n: int = DEPTH_LEVELS) -> DataFrame:
    """levels_at() by another name: bounds with bids, asks and published."""
    return levels_at(bounds, lives, n)


def as_of(asked: DataFrame, bounds: DataFrame, moment: Sequence[str], at: str, bucket) -> DataFrame:
    """asked with ord: the market's last boundary whose moment begins at or before `at` (null before the first). asked must not repeat rows.

    bucket: as a function of a moment's first column. Found with a running value over both, in two levels.
    """
    one = bounds.select(MARKET, F.col(moment[0]).alias("_at"), F.lit(0).alias("_kind"), "ord")
    other = asked.select(MARKET, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*asked.columns).alias("_row")).withColumn("_tie", F.xxhash64("_row"))
    both = one.unionByName(other, allowMissingColumns=True).withColumn("_tie", F.coalesce(F.col("_tie"), F.col("ord")))
    found = running(both, [MARKET], ["_at", "_kind", "_tie"], bucket(F.col("_at")), _ord=("last", F.when(F.col("_kind") == 0, F.col("ord"))))
    return found.where("_kind = 1").select("_row.*", F.col("_ord").alias("ord"))


class _Book:
    """The levels of a market, and its n best a side as they were when last asked for."""

    def __init__(self, n: int):
        self.n, self.sides, self.moved, self.found = n, (_Side(1), _Side(-1)), False, ([], [])

    def set(self, bid: int, price, size) -> None:
        side = self.sides[bid]
        rank, sizes, ranks = side.sign * price, side.sizes, side.ranks
        at = bisect_left(ranks, rank)
        if size is not None and size > 0:
            if rank not in sizes:
                ranks.insert(at, rank)
            sizes[rank] = size
        elif rank in sizes:
            del ranks[at], sizes[rank]
        else:
            return
        self.moved = self.moved or at < self.n

    def best(self) -> tuple[list[tuple], list[tuple]]:
        """bids and asks; the same object as long as they stay."""
        if self.moved:
            now, self.moved = (self.sides[1].best(self.n), self.sides[0].best(self.n)), False
            self.found = self.found if now == self.found else now
        return self.found


def _levels(sides: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    """Levels of many moments, end to end."""
    ends, level = [0], kind.value_type
    for side in sides:
        ends.append(ends[-1] + len(side))
    values = [pa.array([x[i] for side in sides for x in side], level.field(i).type) for i in range(2)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, fields=list(level)), type=kind)


def _of_long(updates: DataFrame) -> DataFrame | None:
    """The markets that a task should not read whole, if there are any; one row for each LONG updates at most."""
    long = [r[0] for r in updates.groupBy(MARKET).agg(F.count(F.lit(1)).alias("_n")).where(f"_n > {LONG} and {MARKET} is not null").select(MARKET).collect()]
    return F.broadcast(updates.sparkSession.createDataFrame([(m,) for m in long], updates.select(MARKET).schema)) if long else None


def _dealt(updates: DataFrame, moment: Sequence[str], order: Sequence[str], asked: DataFrame | None = None, at: str | None = None) -> DataFrame:
    """Updates, and what is asked about them, by market and in order: what is asked after the datagrams that begin at its moment."""
    rest = [c for c in order if c not in (MARKET, *moment)]
    bid = F.when(F.col("side") == "bid", 1).when(F.col("side") == "ask", 0).cast("byte")
    rows = updates.select(MARKET, *moment, *rest, F.lit(0).cast("byte").alias("_kind"), bid.alias("_bid"), F.col("price").alias("_price"), F.col("qty").alias("_qty"))
    if asked is not None:
        rows = rows.unionByName(asked.select(MARKET, F.col(at).alias(moment[0]), F.lit(1).cast("byte").alias("_kind"), F.struct(*asked.columns).alias("_row")), allowMissingColumns=True)
    # by a hash of its own, so that no join's dealing stands in for it
    return rows.repartition(F.xxhash64(MARKET)).sortWithinPartitions(MARKET, moment[0], "_kind", *moment[1:], *rest)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _values(batch: pa.RecordBatch, names: Sequence[str]) -> list[list]:
    """Python's values of columns; numbers by a way that is quicker than to_pylist()."""

    def values(c: pa.Array) -> list:
        if not (pa.types.is_integer(c.type) or pa.types.is_floating(c.type)):
            return c.to_pylist()
        if c.null_count == 0:
            return c.to_numpy().tolist()
        found = c.fill_null(0).to_numpy().astype(object)
        found[c.is_null().to_numpy(zero_copy_only=False)] = None
        return found.tolist()

    return [values(_column(batch, n)) for n in names]


def _types(updates: DataFrame) -> tuple[T.DataType, T.DataType]:
    return updates.schema["price"].dataType, updates.schema["qty"].dataType


def book_of(updates: DataFrame, moment: Sequence[str], order: Sequence[str], bucket: Column, n: int = DEPTH_LEVELS) -> DataFrame:
    """levels_at() of all boundaries of updates: instrument_id, moment, ord (from 0), bids, asks and published after each datagram.

    order: columns that order a datagram's updates. bucket: a value that never falls along the moments of a market; only long markets need it.
    """
    price, size = _types(updates)
    level = T.ArrayType(T.StructType([T.StructField("price", price), T.StructField("size", size)]))
    key = [MARKET, *moment]
    schema = T.StructType([*updates.select(*key).schema.fields, T.StructField("ord", T.LongType()), T.StructField("bids", level), T.StructField("asks", level), T.StructField("published", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        out, last, whole, book, nth, seen = [], None, False, None, 0, None

        def ended() -> tuple:
            now = book.best()
            return *last, nth, *now, nth == 0 or now is not seen

        def made(rows: list[tuple]) -> pa.RecordBatch:
            *plain, bids, asks, published = zip(*rows, strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(plain, types, strict=False)]
            return pa.RecordBatch.from_arrays([*arrays, _levels(bids, types.field("bids").type), _levels(asks, types.field("asks").type), pa.array(published, pa.bool_())], names=types.names)

        for batch in batches:
            keys = zip(*_values(batch, key), strict=True)
            for k, bid, price, size in zip(keys, *_values(batch, ["_bid", "_price", "_qty"]), strict=True):
                if k != last:
                    if last is not None:
                        out.append(ended())
                        nth, seen = nth + 1, book.found
                    if last is None or k[0] != last[0]:
                        book, nth, seen = _Book(n), 0, None
                    last, whole = k, None not in k
                if whole and bid is not None and price is not None:
                    book.set(bid, price, size)
            while len(out) >= BATCH:
                yield made(out[:BATCH])
                del out[:BATCH]
        if last is not None:
            out.append(ended())
            yield made(out)

    long = _of_long(updates)
    short = updates if long is None else updates.join(long, MARKET, "left_anti")
    found = _dealt(short, moment, order).mapInArrow(run, schema)
    if long is None:
        return found
    rest = updates.join(long, MARKET, "left_semi")
    bounds = boundaries(rest, moment, bucket)
    return found.unionByName(levels_at(bounds, lives(rest, bounds, moment, order), n))


def _with_best(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The best level of each side as bid, bid_size, ask, ask_size, and crossed."""
    of = lambda side, c: F.get(side, F.lit(0))[c]
    found = found.select(*columns, of("bids", "price").alias("bid"), of("bids", "size").alias("bid_size"), of("asks", "price").alias("ask"), of("asks", "size").alias("ask_size"))
    return found.withColumn("crossed", F.coalesce(F.col("bid") > F.col("ask"), F.lit(False)))


def best_of(updates: DataFrame, moment: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """best_at() of all boundaries of updates: instrument_id, moment, ord, bid, bid_size, ask, ask_size and crossed."""
    return _with_best(book_of(updates, moment, order, bucket, 1), [MARKET, *moment, "ord"])


def best_as_of(asked: DataFrame, updates: DataFrame, moment: Sequence[str], order: Sequence[str], at: str, bucket: Callable[[Column], Column]) -> DataFrame:
    """asked with bid, bid_size, ask, ask_size and crossed after the market's last datagram that begins at or before `at`; all null before the first.

    bucket: as a function of a moment's first column.
    """
    price, size = _types(updates)
    new = [T.StructField("bid", price), T.StructField("bid_size", size), T.StructField("ask", price), T.StructField("ask_size", size), T.StructField("crossed", T.BooleanType())]
    schema = T.StructType([*asked.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        market, book, begun, best = None, None, False, ()
        for batch in batches:
            kinds = _column(batch, "_kind")
            asks = kinds.to_numpy() == 1
            markets, firsts, bids, prices, sizes = _values(batch, [MARKET, moment[0], "_bid", "_price", "_qty"])
            # what is asked has none of the further moments
            whole = (asks | np.logical_and.reduce([_column(batch, c).is_valid().to_numpy(zero_copy_only=False) for c in moment])).tolist()
            out = []
            for ask, m, when, bid, price, size, valid in zip(asks.tolist(), markets, firsts, bids, prices, sizes, whole, strict=True):
                if book is None or m != market:
                    market, book, begun, best = m, _Book(1), False, (None,) * 5
                if ask:
                    if book.moved:
                        (b, *_), (a, *_) = (x or [(None, None)] for x in book.best())
                        best = (*b, *a, b[0] is not None and a[0] is not None and b[0] > a[0])
                    out.append(best if begun and when is not None and m is not None else (None,) * 5)
                elif when is not None:
                    if not begun:
                        begun, best = True, (None, None, None, None, False)
                    if valid and bid is not None and price is not None:
                        book.set(bid, price, size)
            if out:
                kept = _column(batch, "_row").filter(pa.array(asks)).flatten()
                made = [pa.array(c, types.field(f.name).type) for c, f in zip(zip(*out, strict=True), new, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=types.names)

    long = _of_long(updates)
    short = (updates, asked) if long is None else tuple(x.join(long, MARKET, "left_anti") for x in (updates, asked))
    found = _dealt(short[0], moment, order, short[1], at).mapInArrow(run, schema)
    if long is None:
        return found
    updates, asked = (x.join(long, MARKET, "left_semi") for x in (updates, asked))
    bounds = boundaries(updates, moment, bucket(F.col(moment[0])))
    rest = as_of(asked, bounds, moment, at, bucket).join(best_at(bounds, lives(updates, bounds, moment, order)).drop(*moment), [MARKET, "ord"], "left").drop("ord")
    return found.unionByName(rest)
