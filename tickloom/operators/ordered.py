"""Running values over an ordered stream, in two levels, so that a key with a large share of all rows is no single task.

The rows of a key are cut into buckets along their order (hours of their time, say). Each bucket is reduced to one row, what comes
before it is carried over these few rows, and within (key, bucket) a window does the rest: rows are shuffled once, by (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(rows: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column, **made: tuple[str, Column | None]) -> DataFrame:
    """rows with one more column for each of `made`, over the rows of its key up to and with its own.

    made: name = (kind, value). Kinds: count (rows; long), sum, max, last (the latest value that isn't null), and
    max_before and last_before, which leave out the row itself.
    order: columns that order the rows of a key totally. bucket: a value that never falls along that order.
    A null value counts for nothing; a key's first row has null for the *_before kinds. No rows give no rows.
    """
    place = F.struct(*order)
    values = {n: (kind, F.lit(1).cast("long") if v is None else v) for n, (kind, v) in made.items()}
    cut = rows.withColumn("_bucket", bucket)
    for n, (_, v) in values.items():
        cut = cut.withColumn("_v_" + n, v)

    def reduced(n: str, kind: str) -> Column:
        v = F.col("_v_" + n)
        return F.sum(v) if kind in ("count", "sum") else F.max(v) if kind.startswith("max") else F.max_by(v, F.when(v.isNotNull(), place))

    def over(n: str, kind: str, w) -> Column:
        v = F.col("_v_" + n)
        return F.sum(v).over(w) if kind in ("count", "sum") else F.max(v).over(w) if kind.startswith("max") else F.last(v, ignorenulls=True).over(w)

    before = W.partitionBy(*key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = cut.groupBy(*key, "_bucket").agg(*[reduced(n, kind).alias("_v_" + n) for n, (kind, _) in values.items()])
    carried = carried.select(*[F.col(k).alias("_k_" + k) for k in key], F.col("_bucket").alias("_b"), *[over(n, kind, before).alias("_c_" + n) for n, (kind, _) in values.items()])
    same = [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in key] + [F.col("_bucket").eqNullSafe(F.col("_b"))]
    held = cut.join(carried, same)
    upto = W.partitionBy(*key, "_bucket").orderBy(*order)

    def whole(n: str, kind: str) -> Column:
        inside, carry = over(n, kind, upto.rowsBetween(W.unboundedPreceding, -1 if kind.endswith("_before") else 0)), F.col("_c_" + n)
        if kind in ("count", "sum"):
            return F.coalesce(inside, F.lit(0)) + F.coalesce(carry, F.lit(0))
        return F.greatest(inside, carry) if kind.startswith("max") else F.coalesce(inside, carry)

    found = held.select("*", *[whole(n, kind).alias(n) for n, (kind, _) in values.items()])
    return found.select(*rows.columns, *made)
