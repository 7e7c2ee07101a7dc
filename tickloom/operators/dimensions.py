"""Reference data: names of sources, definitions as of a moment, the catalog of instruments, product ids, and predicates on messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.ordered import running

MAX_UNREGISTERED = 64
MAX_PREFIXES = 8
INSTRUMENT = ("venue", "category", "channel", "instrument_id")
FUTURE_SKEW_US, WINDOW_US = 5_000_000, 3_600_000_000


# -- names
def source_labels(rows: DataFrame, registered: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with label: the registered name, else SOURCE_<id> for the first 64 unregistered ids seen, else UNREGISTERED.

    The labels made here are broadcast: a top-k keeps at most 64 ids. How the registry is joined is left to its size.
    """
    named = rows.join(registered, "source_id", "left")
    unknown = named.where("name is null and source_id is not null").groupBy("source_id").agg(F.min(F.struct(*order)).alias("_seen"))
    first = unknown.orderBy("_seen").limit(MAX_UNREGISTERED).select("source_id", F.concat(F.lit("SOURCE_"), F.col("source_id").cast("string")).alias("_made"))
    label = F.coalesce("name", "_made", F.lit("UNREGISTERED"))
    return named.join(F.broadcast(first), "source_id", "left").withColumn("label", label).drop("name", "_made")


def source_ids(rows: DataFrame, registered: DataFrame, name: str) -> DataFrame:
    """rows with source_id: the id of an exactly equal registered name, else null."""
    return rows.join(registered.withColumnRenamed("name", name), name, "left")


def canonical_channel(channel: Column, offset: Column) -> Column:
    """The channel that a mirror's wire channel stands for; without an offset, or below it, itself."""
    return F.when(channel >= offset, channel - offset).otherwise(channel)


# -- definitions
def definition_as_of(rows: DataFrame, definitions: DataFrame, key: Sequence[str], order: str, bucket: Column, fields: Sequence[str]) -> DataFrame:
    """rows with the struct `definition`: fields of the latest definition of their key with a smaller or equal `order`; null before any.

    An as-of join without a task per key: both streams are laid side by side and the latest definition is a running value.
    """
    marked = rows.select("*", F.lit(None).cast(definitions.select(F.struct(*fields).alias("d")).schema["d"].dataType).alias("_d"), F.lit(1).alias("_row"))
    defs = definitions.select(*key, order, F.struct(*fields).alias("_d"), F.lit(0).alias("_row"))
    # at one place definitions come first
    found = running(marked.unionByName(defs, allowMissingColumns=True), key, [order, "_row"], bucket, definition=("last", F.col("_d")))
    return found.where("_row = 1").drop("_d", "_row")


def precision_gate(prices: DataFrame, definitions: DataFrame, key: Sequence[str], order: str, bucket: Column) -> DataFrame:
    """Prices whose instrument's own definition is known by then, scaled by it: value = raw * 10 ^ exponent. The others are dropped."""
    known = definition_as_of(prices, definitions, key, order, bucket, ["price_exponent"]).where("definition is not null")
    return known.withColumn("exponent", F.col("definition.price_exponent")).withColumn("value", F.col("raw").cast("double") * F.pow(F.lit(10.0), F.col("exponent"))).drop("definition")


def manifest_eras(rows: DataFrame, channel: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """rows (reset_count, valid, seq, count) with era: a running number that grows when a reset, an invalid manifest or a later one starts anew.

    A manifest is later if its 16-bit number lies less than half the circle ahead of the one before.
    """
    before = running(rows, channel, order, bucket, _before=("last_before", F.struct("reset_count", "valid", "seq")))
    b = F.col("_before")
    ahead = F.pmod(F.col("seq") - b["seq"], F.lit(65536))
    turn = b.isNull() | (b["reset_count"] != F.col("reset_count")) | (b["valid"] != F.col("valid")) | (F.col("valid") & (ahead > 0) & (ahead < 32768))
    return running(before.withColumn("_turn", turn.cast("long")), channel, order, bucket, era=("sum", F.col("_turn"))).drop("_before", "_turn")


def reveals(rows: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """The rows at which an instrument's source becomes known or changes, with purged: the source it had before."""
    seen = running(rows, key, order, bucket, purged=("last_before", F.col("source_id")))
    return seen.where(~F.col("source_id").eqNullSafe(F.col("purged")) & F.col("source_id").isNotNull())


def catalog(upserts: DataFrame, order: Sequence[str], key: Sequence[str] = INSTRUMENT, fields: Sequence[str] = ("symbol", "price_exponent", "qty_exponent")) -> DataFrame:
    """The latest entry of each instrument, and conflict: it was seen with more than one precision."""
    precision = F.struct("price_exponent", "qty_exponent")
    last = upserts.groupBy(*key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("e"), (F.min(precision) != F.max(precision)).alias("conflict"))
    return last.select(*key, "e.*", "conflict")


# -- products
def product_ids(instruments: DataFrame) -> DataFrame:
    """instruments with ambiguous (their symbol isn't unique within its source) and product_id."""
    of = W.partitionBy("source_id", "symbol")
    marked = instruments.withColumn("ambiguous", F.count(F.lit(1)).over(of) > 1)
    plain = F.concat_ws(":", "venue", "symbol")
    return marked.withColumn("product_id", F.when(F.col("ambiguous"), F.concat(plain, F.lit("#"), F.col("channel").cast("string"), F.lit("."), F.col("instrument_id").cast("string"))).otherwise(plain))


def parse_ids(ids: DataFrame, column: str = "id") -> DataFrame:
    """ids with source (upper case), symbol, channel and instrument_id (null if the id has none), and valid; nothing is guessed.

    An id is SOURCE:SYMBOL or SOURCE:SYMBOL#channel.instrument; only the last # counts.
    """
    x = F.col(column)
    at = F.locate(":", x)
    rest = F.substring(x, at + 1, F.length(x))
    tail = F.substring_index(rest, "#", -1)
    has = F.contains(rest, F.lit("#"))
    symbol = F.when(has, F.substring(rest, F.lit(1), F.length(rest) - F.length(tail) - 1)).otherwise(rest)
    fits = tail.rlike(r"^[0-9]+\.[0-9]+$")
    dot = F.locate(".", tail)
    channel, instrument = F.substring(tail, F.lit(1), dot - 1).try_cast("long"), F.substring(tail, dot + 1, F.length(tail)).try_cast("long")
    valid = (at > 1) & (symbol != "") & (~has | fits & F.coalesce(channel <= 255, F.lit(False)) & F.coalesce(instrument < 1 << 32, F.lit(False)))
    only = lambda c: F.when(F.col("valid"), c)
    found = ids.withColumn("valid", F.coalesce(valid, F.lit(False)))
    return found.select("*", only(F.upper(F.substring(x, F.lit(1), at - 1))).alias("source"), only(symbol).alias("symbol"), only(F.when(has, channel)).alias("channel"), only(F.when(has, instrument)).alias("instrument_id"))


def resolve(parsed: DataFrame, instruments: DataFrame, column: str = "id") -> DataFrame:
    """Each id with status (400 malformed, 404 none, 409 ambiguous, 200 one), hits and, if it is one, the instrument it names."""
    known = instruments.where(F.col("instrument_id").isNotNull()).select(F.upper("venue").alias("source"), "symbol", F.col("channel").alias("_ch"), F.col("instrument_id").alias("_in"))
    # a symbol of many instruments is counted before ids meet it; those that name one meet that one only
    one = F.min(F.struct(F.col("_ch").alias("channel"), F.col("_in").alias("instrument_id"))).alias("_one")
    n, name = F.count(F.lit(1)).alias("_n"), ["source", "symbol"]
    counts = known.groupBy(*name).agg(n, one).withColumns({"_ch": F.lit(None).cast("long"), "_in": F.lit(None).cast("long")}).unionByName(known.groupBy(*name, "_ch", "_in").agg(n, one).where("_ch is not null"))
    asked = parsed.select(column, "valid", *[F.col(c).alias("_a_" + c) for c in (*name, "channel", "instrument_id")])
    same = [F.col("_a_source") == F.col("source"), F.col("_a_symbol") == F.col("symbol"), F.col("_a_channel").eqNullSafe(F.col("_ch")), F.col("_a_instrument_id").eqNullSafe(F.col("_in"))]
    hit = asked.join(counts, same, "left")
    per = hit.groupBy(column, "valid").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("hits"), F.min("_one").alias("o"))
    status = F.when(~F.col("valid"), 400).when(F.col("hits") == 0, 404).when(F.col("hits") == 1, 200).otherwise(409)
    one = F.col("hits") == 1
    return per.select(column, status.alias("status"), "hits", F.when(one, F.col("o.channel")).alias("channel"), F.when(one, F.col("o.instrument_id")).alias("instrument_id"))


def page(products: DataFrame, limit: int | None, cursor: int = 0, order: Sequence[str] = INSTRUMENT) -> DataFrame:
    """A page of the catalog in its order, with nth from 0, and next_cursor where more remain. limit None: all from the cursor on."""
    if (limit is not None and limit < 1) or cursor < 0:
        raise ValueError("limit is at least 1, cursor at least 0")
    ranked = products.orderBy(*order).offset(cursor)
    # one row more than the page tells whether it is the last
    taken = ranked.limit(limit + 1) if limit is not None else ranked
    nth = taken.withColumn("nth", F.row_number().over(W.orderBy(*order)) - 1 + cursor) if limit is not None else taken.withColumn("nth", F.lit(None).cast("int"))
    if limit is None:
        return nth.withColumn("next_cursor", F.lit(None).cast("int"))
    more = F.count(F.lit(1)).over(W.partitionBy()) > limit
    return nth.withColumn("next_cursor", F.when(more, cursor + limit)).where(F.col("nth") < cursor + limit)


def symbol_prefixes(instruments: DataFrame, most: int = MAX_PREFIXES) -> DataFrame:
    """Per (venue, category, channel) the `most` prefixes (up to the first -) that most instruments have, ties by name, and how many there are."""
    of = ["venue", "category", "channel"]
    per = instruments.where("symbol <> ''").groupBy(*of, F.split_part("symbol", F.lit("-"), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*of)
    return per.withColumn("nth", F.row_number().over(w.orderBy(F.desc("n"), "prefix"))).withColumn("prefixes", F.count(F.lit(1)).over(w)).where(F.col("nth") <= most)


# -- predicates
def subscription(filters: Sequence[Mapping]) -> Column:
    """Whether a message (venue, symbol, channel, type) is wanted by any of the filters; without filters all are.

    venue, source_name and source mean the same, are compared without case and must all fit; type is exact and absolute. A message without a
    symbol passes a symbol filter; one without a channel passes a channel filter only if it has no symbol either.
    """
    def one(f: Mapping) -> Column:
        fits = F.lit(True)
        for k in ("venue", "source_name", "source"):
            if f.get(k) is not None:
                fits &= F.lower("venue") == f[k].lower()
        if f.get("type") is not None:
            fits &= F.col("type") == f["type"]
        if f.get("symbol") is not None:
            fits &= F.col("symbol").isNull() | (F.col("symbol") == f["symbol"])
        if f.get("channel") is not None:
            fits &= F.when(F.col("channel").isNull(), F.col("symbol").isNull()).otherwise(F.col("channel") == f["channel"])
        return F.coalesce(fits, F.lit(False))

    wanted = F.lit(not filters)
    for f in filters:
        wanted |= one(f)
    return wanted


def admitted(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """rows (code, channel) with admitted: a code that `allowed` (code, channel) doesn't mention admits every channel."""
    codes = allowed.select("code").distinct().withColumn("_mentioned", F.lit(True))
    pairs = allowed.select("code", "channel").distinct().withColumn("_listed", F.lit(True))
    found = rows.join(codes, "code", "left").join(pairs, ["code", "channel"], "left")
    return found.withColumn("admitted", F.col("_mentioned").isNull() | F.col("_listed").isNotNull()).drop("_mentioned", "_listed")


def resolve_time(source_us: Column, recv_us: Column, window_us: int = WINDOW_US) -> Column:
    """The time of a message: its source's, unless that is 0, over 5 s ahead of its arrival, or more than the window behind it."""
    return F.when((source_us == 0) | (source_us > recv_us + FUTURE_SKEW_US) | (source_us + window_us < recv_us), recv_us).otherwise(source_us)


def guarded(text: Column) -> Column:
    """A decimal from text; null unless it is finite and not negative."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (x >= 0) & (x < float("inf")), x)


def latency_parts(source: Column, kernel: Column, recv: Column, sent: Column) -> dict[str, Column]:
    """Network, kernel, process and total time between four timestamps; a part with an unknown (0) end is null."""
    s, k, r, t = (F.nullif(c, F.lit(0)) for c in (source, kernel, recv, sent))
    return {"network": k - s, "kernel": r - k, "process": t - r, "total": t - s}


def attributable(trades: DataFrame, instruments: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Trades whose instrument the catalog has, and those it hasn't."""
    known = instruments.select(*key).distinct()
    return trades.join(known, list(key), "left_semi"), trades.join(known, list(key), "left_anti")
