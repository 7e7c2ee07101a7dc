"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Targets: every source's share of the budget is proportional to its weight; a source whose share exceeds `max_epochs` times
its own size is clamped there and its excess is dealt to the others by weight, until nothing exceeds its cap.

Sampling: a source with target / size = w + f repeats every document w times, and once more the documents whose seeded
hash is below a threshold. The threshold comes from an exact histogram of words over 4,096 hash ranges, so the words
taken are within half a range (plus one document) of the target.

Defined cases. A null text has no words and is never taken. A null source is a source of its own, last in order. A source
without words has target 0. Rows that repeat an id are drawn together. An empty table gives an empty result. Other columns are
ignored by mix_plan() and returned by mix().
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import n_words, save

RANGES = 4096
BROADCAST_SOURCES = 100_000


def water_fill(sizes: Sequence[int], weights: Sequence[float], budget: float, max_epochs: float) -> list[float]:
    """Targets that add up to the budget (or to all caps, if they are less), none above max_epochs times its size."""
    targets, left, free = [0.0] * len(sizes), float(budget), list(range(len(sizes)))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole >= max_epochs * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / whole
            break
        for i in over:
            targets[i] = float(max_epochs * sizes[i])
        left -= sum(targets[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return targets


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """source, size (words) and u (range of the seeded hash of the id) of each row, and the columns `more`."""
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(RANGES)).cast("int")
    return docs.select(F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), u.alias("u"), *more)


def _drawn(sized: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """sized with source_size, target and times. The plan has one row a source and is broadcast: rows are not shuffled, whatever a source's share."""
    spark = sized.sparkSession
    histogram = save(sized.groupBy(F.col("source").alias("s"), "u").agg(F.sum("size").alias("words")))
    totals = sorted(((r["s"], r["words"]) for r in histogram.groupBy("s").agg(F.sum("words").alias("words")).collect()), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    targets = water_fill([n for _, n in totals], [float(weights[i % len(weights)]) for i in range(len(totals))], sum(n for _, n in totals), max_epochs)
    plan = [(s, n, t, min(int(t // n), int(max_epochs)) if n else 0) for (s, n), t in zip(totals, targets, strict=True)]
    # an Arrow table, as rows would start Python workers that stay beside those of other steps
    kinds = {"s": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "whole": pa.int32()}
    sources = spark.createDataFrame(pa.table({c: pa.array([p[i] for p in plan], kind) for i, (c, kind) in enumerate(kinds.items())}))
    # of each source at most RANGES rows: the last range that is taken once more is where the words come nearest to what is left
    gap = F.col("target") - F.col("whole") * F.col("source_size")
    upto = F.sum("words").over(W.partitionBy("hs").orderBy("u"))
    reached = histogram.withColumnRenamed("s", "hs").join(sources, F.col("hs").eqNullSafe(F.col("s"))).withColumn("off", F.abs(upto - gap))
    nearest = reached.groupBy("hs").agg(F.min(F.struct("off", "u")).alias("m"))
    cuts = sources.join(nearest, F.col("s").eqNullSafe(F.col("hs")), "left").select("s", "source_size", "target", "whole", F.when(F.col("m.off") < F.abs(gap), F.col("m.u")).otherwise(-1).alias("cut"))
    # beyond so many sources none can be hot in all of them, and the join may shuffle
    cuts = F.broadcast(cuts) if len(plan) <= BROADCAST_SOURCES else cuts
    once_more = (F.col("u") <= F.col("cut")) & (F.col("whole") < int(max_epochs))
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + once_more.cast("int")).cast("int")
    return sized.join(cuts, F.col("source").eqNullSafe(F.col("s"))).withColumn("times", times)


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words), times (repetitions).

    weights: by the order of the sources (code point, null last), repeating. One row a source reaches the driver.
    """
    sized = save(_sized(docs, seed, id_col, text_col, source_col, F.col(id_col).alias("doc_id")))
    return _drawn(sized, weights, max_epochs).select("doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), "times")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as many times as the mix takes it, with all their columns, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    drawn = _drawn(_sized(docs, seed, id_col, text_col, source_col, row), weights, max_epochs).where("times > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
