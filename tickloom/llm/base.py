"""Shared helpers: tables, tokens of text, and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (space, tab, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII white space that are not already one single space.
_UNEVEN_WHITE = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tickloom-"))
    return context.getCheckpointDir()


def save(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared checkpoint folder and read it back: lineage ends here, losing executors costs nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    saved = spark.read.schema(df.schema).parquet(path)
    saved._scratch = path
    return saved


def drop(*frames: DataFrame) -> None:
    """Delete tables written by save() that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of a batch of rows that goes to a Python worker.
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow() in batches of BATCH_BYTES, for the rest of the session.

    By default a batch has 10,000 rows or 64 MB, which an executor holds several times for each task: as vectors and as the stream that is sent,
    outside its heap, and in the worker.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def one_space(text: Column) -> Column:
    """Null as empty; every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN_WHITE, " ")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A key that more than this share of all rows have is hot; so there are fewer hot keys than this.
HOT_SHARE = 1024


def _salts(counts: DataFrame, key: str) -> DataFrame:
    """key, salts: keys with more than a HOT_SHARE-th of all rows that counts (key, n) has, and into how many parts they should be split."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where(F.col("n") * HOT_SHARE > total).select(key, F.ceil(F.col("n") * HOT_SHARE / F.lit(max(1, total))).cast("int").alias("salts"))


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """key, salts: keys of more than a HOT_SHARE-th of all rows; fewer than HOT_SHARE, so that they can be broadcast."""
    return _salts(save(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))), key)


def with_salt(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """rows with a column salt: 0, for hot keys one of its salts by the hash of `by`."""
    found = rows.join(F.broadcast(hot), key, "left")
    return found.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")).cast("int"), F.lit(0))).drop("salts")


def join_hot(rows: DataFrame, counted: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined on key with counted, a saved table that has each key once and n, its rows. Hot keys are dealt over tasks by the hash of `by`."""
    hot = _salts(counted, key)
    parts = counted.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return with_salt(rows, hot, key, by).join(parts, [key, "salt"], how).drop("salt")
