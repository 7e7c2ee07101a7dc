"""Pairing copies that several paths deliver of one thing, by waiting queues: exact whatever copies are lost, and no task holds a key.

A copy waits until another path's copy of the same signature comes, or until it is older than the window. What comes meets the oldest
that waits; a path's own repeats queue up behind each other: all of them, or `most` at most if that is given (beyond, the oldest gives way). So
all that wait are of one path, and are its latest copies: a queue is known by that path and how many wait.

That makes the work divisible. The copies of a signature are cut into buckets of time no shorter than the window. A bucket that copies of
the window before it reach, or whose own reach the next, is first run from each queue that it could begin with, which gives a table: queue
before, queue after. They are run together: a copy of a path makes its queues one longer and all others one shorter, and queues that become equal
go on as one, so that a copy costs as much as in one run, however many wait. The tables of a signature are chained, bucket after bucket, and then every
bucket is run once more from the one queue it really starts with. Both runs deal copies by (signature, bucket) and read them in order as a
stream that holds queues only; only tables meet by signature. Python reads when copies came and by which path, never signatures: Spark says
where a bucket ends, and signatures are taken over by place.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

WAITING, WIDTH_US = 8, 3_600_000_000
#: Rows of a bucket, in this order: the queue it begins with, copies of the bucket before, its own, its own that may still wait in the next.
BEGIN, BEFORE, OWN, LATE = range(4)


class Queue:
    """When the copies that wait came, all of one path."""

    def __init__(self, path: int | None = None, held: Sequence[int] = ()):
        self.path, self.waits = path, deque(held)

    @property
    def held(self) -> list[int]:
        return list(self.waits)

    def offer(self, path: int, at: int, window: int, most: int | None = None) -> tuple[int, int] | None:
        """The copy that this one pairs with: its path, and when it came."""
        waits = self.waits
        while waits and at - waits[0] > window:
            waits.popleft()
        if waits and self.path != path:
            return self.path, waits.popleft()
        self.path = path
        waits.append(at)
        if most is not None and len(waits) > most:
            waits.popleft()
        return None

    def known_by(self) -> tuple[int | None, int]:
        return (self.path, len(self.waits)) if self.waits else (None, 0)


def _lists(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).tolist() for c in columns), strict=True)


def _taken(batch: pa.RecordBatch, columns: Sequence[str], at: Sequence[int], rows: Sequence[tuple], **made: pa.DataType) -> pa.RecordBatch:
    """These columns of the batch at some places, and beside them what was made there."""
    places = pa.array(at, pa.int32())
    kept = [batch.column(batch.schema.get_field_index(c)).take(places) for c in columns]
    new = zip(*rows, strict=True) if rows else ((),) * len(made)
    return pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) for v, t in zip(new, made.values(), strict=True))], names=[*columns, *made])


def _both(one: list[int] | None, other: list[int] | None) -> list[int] | None:
    if not one or not other:
        return one or other
    if len(one) < len(other):
        one, other = other, one
    one.extend(other)
    return one


class Queues:
    """All queues that a bucket may begin with, run together. before: when copies came, by path, that may wait.

    starts: what the queues were known by. The starts whose queue is empty now are `empty`; those with n copies of a path are legs[path][n - 1].
    """

    def __init__(self, before: dict[int, list[int]], window: int, most: int | None = None):
        self.window, self.most, self.came = window, most, {p: deque(held) for p, held in before.items()}
        self.starts, self.empty, self.legs = [(0, 0)], [0], {}
        for path, held in before.items():
            n = len(held) if most is None else min(len(held), most)
            self.legs[path] = deque([len(self.starts) + i] for i in range(n))
            self.starts.extend((path, i + 1) for i in range(n))

    def _live(self, path: int, at: int) -> deque:
        came = self.came.setdefault(path, deque())
        while came and at - came[0] > self.window:
            came.popleft()
        return came

    def offer(self, path: int, at: int) -> None:
        legs, empty = self.legs, self.empty
        for p in tuple(legs):
            leg, n = legs[p], len(self._live(p, at))
            while len(leg) > n:  # the oldest is too old: as long as what still can wait
                last = leg.pop()
                if leg:
                    leg[-1] = _both(leg[-1], last)
                else:
                    empty = _both(empty, last)
        met = None
        for p in tuple(legs):
            if p != path:
                if legs[p]:
                    met = _both(met, legs[p].popleft())
                if not legs[p]:
                    del legs[p]
        own = legs.setdefault(path, deque())
        if own or empty:
            own.appendleft(empty)
        if self.most is not None and len(own) > self.most:
            last = own.pop()
            own[-1] = _both(own[-1], last)
        self.empty = met
        self._live(path, at).append(at)

    def table(self) -> list[int | None]:
        """(path, how many, path after, how many after) of each start, end to end."""
        after = [(None, 0)] * len(self.starts)
        for path, leg in self.legs.items():
            for n, group in enumerate(leg, 1):
                for i in group or ():
                    after[i] = path, n
        return [x for start, end in zip(self.starts, after, strict=True) for x in (*start, *end)]


def _tables(batches: Iterator[pa.RecordBatch], keys: Sequence[str], window: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: (path, how many, path after, how many after) of each queue it may begin with, end to end."""
    before: dict[int, list[int]] = {}
    queues: Queues | None = None
    for batch in batches:
        places, found = [], []
        for i, (ends, kind, path, at) in enumerate(_lists(batch, "_ends", "_kind", "_path", "_at")):
            if kind == BEFORE:
                before.setdefault(path, []).append(at)
            else:
                queues = queues or Queues(before, window, most)
                queues.offer(path, at)
            if ends:
                places.append(i)
                found.append((queues.table() if queues else [],))
                before, queues = {}, None
        yield _taken(batch, [*keys, "_in"], places, found, _table=pa.list_(pa.int64()))


def _chained(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The queue that a bucket begins with, unless it is empty."""
    end = (0, 0)
    for batch in batches:
        places, found = [], []
        tables = batch.column(batch.schema.get_field_index("_table")).to_pylist()
        for i, ((follows,), table) in enumerate(zip(_lists(batch, "_follows"), tables, strict=True)):
            ends = {(p, n): after for p, n, *after in zip(*(table[k::4] for k in range(4)), strict=True)}
            path, waited = end if follows else (0, 0)
            # copies too old to reach this bucket don't wait any more
            n = max((m for p, m in ends if p == path and m <= waited), default=0)
            if n:
                places.append(i)
                found.append((path, n))
            end = ends[(path, n) if n else (0, 0)]
        yield _taken(batch, [*keys, "_in"], places, found, _path=pa.int64(), _at=pa.int64())


def _paired(batches: Iterator[pa.RecordBatch], keys: Sequence[str], window: int, most: int | None) -> Iterator[pa.RecordBatch]:
    queue, n = Queue(), 0
    for batch in batches:
        places, found = [], []
        for i, (ends, kind, path, at) in enumerate(_lists(batch, "_ends", "_kind", "_path", "_at")):
            if kind >= OWN:
                met = queue.offer(path, at, window, most)
                if met:
                    places.append(i)
                    found.append((met[0], path, at - met[1], met[1]))
            elif kind == BEGIN:
                queue.path, n = path, at
            elif n and path == queue.path:
                queue.waits.append(at)
                if len(queue.waits) > n:
                    queue.waits.popleft()
            if ends:
                queue, n = Queue(), 0
        yield _taken(batch, keys, places, found, first=pa.int64(), second=pa.int64(), delta_us=pa.int64(), first_us=pa.int64())


def _bound(step: Callable, *args) -> Callable:
    return lambda batches: step(batches, *args)


def queue_pairs(copies: DataFrame, signature: Sequence[str], order: Sequence[str], window_us: int, path: str = "publisher", most: int | None = WAITING, width_us: int = WIDTH_US) -> DataFrame:
    """The pairs: signature, first and second (paths), delta_us between them, first_us.

    order: columns that order the copies of a signature totally, the first of them when a copy came, in microseconds. most: how many
    copies of a path may wait; None if all of the window do. width_us: of a bucket of time; the window if that is longer.

    Defined cases: no rows give no rows; a null in the signature is a value like any other, and so is NaN; copies without a path or a time
    don't count.
    """
    at, width, keys = order[0], max(width_us, window_us, 1), [f"_k{i}" for i, _ in enumerate(signature)]
    bucket = F.floor(F.col(at) / width).cast("long")
    rows = copies.where(F.col(at).isNotNull() & F.col(path).isNotNull()).withColumn("_b", bucket)
    # what may still wait when the next bucket begins goes there as well
    late = F.col(at) + window_us >= (F.col("_b") + 1) * width
    to = lambda b, kind: F.struct(b.alias("_in"), F.lit(kind).alias("_kind"))
    dealt = rows.select("*", F.inline(F.when(late, F.array(to(F.col("_b"), LATE), to(F.col("_b") + 1, BEFORE))).otherwise(F.array(to(F.col("_b"), OWN)))))
    dealt = dealt.select(*(F.col(c).alias(k) for c, k in zip(signature, keys, strict=True)), "_in", "_kind", F.col(path).cast("long").alias("_path"), F.col(at).cast("long").alias("_at"), F.struct(*order).alias("_place"))
    schema = lambda more: T.StructType([*dealt.select(*keys).schema.fields, *T.StructType.fromDDL(more).fields])

    def in_order(rows: DataFrame) -> DataFrame:
        """A bucket's rows one after the other: whether it is the last, the kinds of the first and the last. A hash, sorted by first, is quickly compared."""
        w = W.partitionBy("_hash", *keys, "_in").orderBy("_kind", "_place")
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        rows = rows.withColumn("_hash", F.xxhash64(*keys, "_in"))
        return rows.select(*keys, "_in", F.lead(F.lit(1)).over(w).isNull().alias("_ends"), "_kind", "_path", "_at", F.first("_kind").over(whole).alias("_first"), F.last("_kind").over(whole).alias("_last"))

    # tables of the buckets that another hangs on
    linked = in_order(dealt).where((F.col("_last") == LATE) | (F.col("_first") == BEFORE) & (F.col("_last") == OWN)).drop("_first", "_last")
    tables = linked.mapInArrow(_bound(_tables, keys, window_us, most), schema("_in long, _table array<long>"))
    follows = F.coalesce(F.lag("_in").over(W.partitionBy(*keys).orderBy("_in")) == F.col("_in") - 1, F.lit(False))
    begins = tables.withColumn("_follows", follows).mapInArrow(_bound(_chained, keys), schema("_in long, _path long, _at long")).withColumn("_kind", F.lit(BEGIN))
    # not joined: a join may split a large partition, and with it a bucket
    known = in_order(dealt.unionByName(begins, allowMissingColumns=True)).where((F.col("_kind") >= OWN) | (F.col("_first") == BEGIN)).drop("_in", "_first", "_last")
    pairs = known.mapInArrow(_bound(_paired, keys, window_us, most), schema("first long, second long, delta_us long, first_us long"))
    return pairs.select(*(F.col(k).alias(c) for c, k in zip(signature, keys, strict=True)), "first", "second", "delta_us", "first_us")


def unpaired(copies: DataFrame, pairs: DataFrame, window_us: int, at: str, path: str = "publisher") -> DataFrame:
    """path, copies, unpaired: how many copies of each path the window passed without a pair: lost elsewhere, or seen on this path only."""
    newest = copies.agg(F.max(at)).first()[0]
    due = F.lit(newest).cast("long") - window_us
    sent = copies.where(F.col(at).isNotNull()).groupBy(F.col(path).cast("long").alias("path")).agg(F.count(F.lit(1)).alias("copies"), F.count_if(F.col(at) < due).alias("_due"))
    sides = F.array(F.struct(F.col("first").alias("path"), F.col("first_us").alias("at")), F.struct(F.col("second").alias("path"), (F.col("first_us") + F.col("delta_us")).alias("at")))
    paired = pairs.select(F.inline(sides)).where(F.col("at") < due).groupBy("path").agg(F.count(F.lit(1)).alias("_paired"))
    return sent.join(paired, "path", "left").select("path", "copies", (F.col("_due") - F.coalesce("_paired", F.lit(0))).alias("unpaired"))
