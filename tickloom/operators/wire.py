"""Messages as JSON rows, and paths into JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tagged(**variants: DataFrame) -> DataFrame:
    """type, body: rows of several message types in one DataFrame, each as JSON; null fields are left out."""
    made = None
    for name, df in variants.items():
        rows = df.select(F.lit(name).alias("type"), F.to_json(F.struct(*df.columns)).alias("body"))
        made = rows if made is None else made.unionByName(rows)
    return made


def union(**variants: DataFrame) -> DataFrame:
    """Rows of several message types with all their columns, type first; a column that a type hasn't is null."""
    made = None
    for name, df in variants.items():
        rows = df.select(F.lit(name).alias("type"), "*")
        made = rows if made is None else made.unionByName(rows, allowMissingColumns=True)
    return made


def path(json: Column, steps: str) -> Column:
    """The value at a path such as .a[0].b as text; null where there is none, and null for JSON that isn't."""
    return F.get_json_object(json, "$" + steps)


def each(df: DataFrame, json: str, steps: str, name: str) -> DataFrame:
    """df with one row for every element of the array at a path such as .a[]; a row without it stays, with null."""
    items = F.from_json(path(F.col(json), steps.removesuffix("[]")), "array<string>")
    return df.select("*", F.explode_outer(items).alias(name))


def labels(rows: DataFrame, names: Mapping[str, Column]) -> DataFrame:
    """Counters: one row a combination of labels with its count."""
    return rows.groupBy(*[c.alias(n) for n, c in names.items()]).agg(F.count(F.lit(1)).alias("n"))


def number(x: Column) -> Column:
    """A price or size as plain text: at most eight decimals, no trailing zeros, never an exponent."""
    text = F.call_function("format_number", x, F.lit("0.00000000"))
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def fixed(x: Column, exponent: int) -> Column:
    """A number with the decimals of its exponent: -2 has two, 0 and above have none."""
    return F.call_function("format_number", x, F.lit("0" + ("." + "0" * -exponent if exponent < 0 else "")))


def l2_book(levels: DataFrame, coin: str, time_ms: str) -> DataFrame:
    """coin, body: a book as one message, its levels bids first and best first; levels: (coin, time_ms, side, price, size, n, nth), cut before."""
    side = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("nth", number(F.col("price").cast("double")).alias("px"), number(F.col("size").cast("double")).alias("sz"), "n")))), lambda x: F.struct(x["px"].alias("px"), x["sz"].alias("sz"), x["n"].alias("n")))
    made = levels.groupBy(coin, time_ms).agg(F.array(side("bid"), side("ask")).alias("levels"))
    data = F.struct(F.col(coin).alias("coin"), F.col(time_ms).alias("time"), "levels")
    return made.select(F.col(coin).alias("coin"), F.to_json(F.struct(F.lit("l2Book").alias("channel"), data.alias("data"))).alias("body"))
