"""Line dedup: prefix doubling over line ids, spread over all partitions; later copies of repeated runs of lines are deleted.

Every line has a 128-bit id. In each round a suffix that shares its first k lines with another one gets the name of its first
2k lines (at the end: of exactly min_lines) from the names at its place and k lines on, and suffixes that share their name with none
are settled and leave. Those that share the last name are an interval of the suffix array whose longest common prefix is at least
min_lines. Names are hashes, as only equality within intervals is asked for.

Of an interval the first suffix stays: by id, then place. Every line that a later one's first min_lines lines cover is deleted.
Later starts that follow one another, with first occurrences that do so too, are one maximal repeated run: repeated_runs() returns them.
A line with a third of all occurrences is counted by partial aggregation, and dealt over many tasks by its document where names are joined.

With min_words, a run of fewer lines counts too if it holds min_words words, or makes up a whole document that has a word: then
its later occurrences are deleted. A short document that an earlier one holds as a run is a copy; the same few lines inside a longer
document are not.

Defined cases. Lines end at \\n only. A null text has no lines, an empty one has one empty line. A null id comes after all ids; rows
that repeat an id are ordered by a hash of their texts; rows that repeat both share all decisions and aren't copies of one another.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import join_hot, n_words, save

DOC = ["_none", "id", "th"]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_none, id, th, text: rows by what tells documents apart. Texts are hashed only where an id repeats: else th is 0."""
    ids = docs.groupBy(F.col(id_col).alias("id")).count()
    repeated = not ids.where("count > 1").isEmpty()
    th = F.coalesce(F.xxhash64(text_col), F.lit(0)) if repeated else F.lit(0).cast("long")
    base = docs.select(F.col(id_col).isNull().alias("_none"), F.col(id_col).alias("id"), th.alias("th"), F.col(text_col).alias("text"))
    base._repeated = repeated
    return base


def _name(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _shared(suffixes: DataFrame) -> DataFrame:
    """The suffixes whose name another one has too."""
    often = save(suffixes.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return save(join_hot(suffixes, often, "name", "id", "left_semi"))


def repeated_starts(base: DataFrame, min_lines: int) -> DataFrame:
    """_none, id, th, pos, name: suffixes that share their first min_lines lines with another."""
    lines = base.where("text is not null").select(*DOC, F.posexplode(F.transform(_lines(F.col("text")), lambda x: F.unhex(F.md5(x.cast("binary"))))).alias("pos", "name"))
    # rows that repeat id and text are one document
    lines = lines.dropDuplicates([*DOC, "pos"]) if base._repeated else lines
    now, k = _shared(lines), 1
    while k < min_lines:
        step = min(k, min_lines - k)
        on = now.select(*DOC, (F.col("pos") - step).alias("pos"), F.col("name").alias("next"))
        same = [F.col("x." + c).eqNullSafe(F.col("y." + c)) for c in [*DOC, "pos"]]
        paired = now.alias("x").join(on.alias("y"), same).select(*[F.col("x." + c) for c in [*DOC, "pos"]], _name(F.col("x.name"), F.col("y.next")).alias("name"))
        now, k = _shared(paired), k + step
    return now


def repeated_short_runs(base: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """_none, id, th, pos, k: later occurrences of runs of k < min_lines lines that hold min_words words or are whole documents."""
    lines = base.where("text is not null").select(*DOC, F.transform(_lines(F.col("text")), lambda x: F.struct(F.unhex(F.md5(x.cast("binary"))).alias("h"), n_words(x).alias("w"))).alias("l"))

    def run_of(k: int):
        return lambda i: F.struct(i.alias("pos"), _name(*[F.get("l", i + j)["h"] for j in range(k)]).alias("name"), sum((F.get("l", i + j)["w"] for j in range(k)), F.lit(0)).alias("w"))

    runs = []
    for k in range(1, min_lines):
        # lines before the last k - 1 start a run of k
        made = F.transform(F.sequence(F.lit(0), F.size("l") - k), run_of(k))
        found = lines.where(F.size("l") >= k).select(*DOC, (F.size("l") == k).alias("whole"), F.inline(made))
        runs.append(found.select(*DOC, "pos", F.lit(k).alias("k"), "name", (F.col("w") >= F.when(F.col("whole"), 1).otherwise(min_words)).alias("asks")))
    every = runs[0]
    for more in runs[1:]:
        every = every.union(more)
    place = F.struct(*DOC, "pos")
    first = every.groupBy("k", "name").agg(F.min(place).alias("first"), F.max("asks").alias("asked"), F.count(F.lit(1)).alias("n")).where("n > 1 and asked").drop("n", "asked")
    return every.where("asks").join(first, ["k", "name"]).where(~place.eqNullSafe(F.col("first"))).select(*DOC, "pos", "k")


def _later(starts: DataFrame) -> DataFrame:
    """The suffixes that aren't the first of their interval, with the first one's document and place."""
    place = F.struct(*DOC, "pos")
    first = save(starts.groupBy("name").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
    return join_hot(starts, first, "name", "id").where(~place.eqNullSafe(F.col("first"))).select(*DOC, "pos", "first")


def repeated_runs(docs: DataFrame, min_lines: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, lines, first_id, first_pos: maximal runs of min_lines lines or more that repeat an earlier place line by line."""
    later = _later(repeated_starts(_documents(docs, id_col, text_col), min_lines))
    # along a run, place and first place go up together
    source = [F.col("first." + c).alias("f" + c) for c in DOC]
    ahead = later.select(*DOC, "pos", *source, F.col("first.pos").alias("fpos")).withColumn("shift", F.col("pos") - F.col("fpos"))
    of = [*DOC, *["f" + c for c in DOC], "shift"]
    island = ahead.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy(*of).orderBy("pos")))
    runs = island.groupBy(*of, "island").agg(F.min("pos").alias("pos"), (F.count(F.lit(1)) + min_lines - 1).alias("lines"), F.min("fpos").alias("first_pos"))
    return runs.select(F.col("id").alias("doc_id"), "pos", "lines", F.col("fid").alias("first_id"), "first_pos")


def line_dedup(docs: DataFrame, min_lines: int = 3, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept (the text without later copies of runs of min_lines lines or more).

    min_words: shorter runs count too if they hold so many words or are a whole document.
    """
    base = _documents(docs, id_col, text_col)
    later = _later(repeated_starts(base, min_lines)).select(*DOC, "pos", F.lit(min_lines).alias("k"))
    if min_words is not None and min_lines > 1:
        later = later.union(repeated_short_runs(base, min_lines, min_words))
    gone = later.select(*DOC, F.explode(F.sequence("pos", F.col("pos") + F.col("k") - 1)).alias("pos")).groupBy(*DOC).agg(F.collect_set("pos").alias("gone"))
    gone = save(gone).select(*[F.col(c).alias("g" + c) for c in DOC], "gone")
    # texts are shuffled once at any size; what was found of them is the smaller side
    out = base.join(gone.hint("shuffle_hash"), [F.col(c).eqNullSafe(F.col("g" + c)) for c in DOC], "left").withColumn("lines", F.coalesce(_lines(F.col("text")), F.array().cast("array<string>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return out.select(F.col("id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))
