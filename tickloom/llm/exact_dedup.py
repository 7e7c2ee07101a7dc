"""Exact dedup: group by 128-bit content hash, keep the smallest id, compare bytes inside groups.

Only DataFrame functions are used.

Defined cases. A null text counts as empty. Texts are equal when they are identical after every run of ASCII white
space has become one space. A row with a null id never represents a group that has an id; a group without any id keeps
all its rows and has a null keep_id. Rows that repeat an id and a text each get a row, and carry the same decision.
An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import join_hot, one_space, save


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _decided(docs: DataFrame, id_col: str, text_col: str, content_hash: Callable[[Column], Column]) -> tuple[DataFrame, list[str]]:
    """id, h, keep, n, sha of each row, and t where two texts share a hash; and which of them tell texts apart."""
    base = docs.select(F.col(id_col).alias("id"), one_space(F.col(text_col)).alias("t")).withColumn("h", content_hash(F.col("t")))
    classes = base.groupBy("h", "t").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    found = save(classes.select("h", "keep", "n", F.unhex(F.sha2("t", 256)).alias("sha")))
    if found.groupBy("h").count().where("count > 1").isEmpty():
        # a group of copies may hold a third of all rows: its small rows are dealt by their ids
        return join_hot(base.select("id", "h"), found, "h", "id"), ["h"]
    return base.join(classes.withColumn("sha", F.unhex(F.sha2("t", 256))), ["h", "t"]), ["h", "t"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The text is a grouping key beside its hash, so bytes are compared where copies meet; the partial aggregation
    folds copies before the shuffle, and texts are shuffled once. Joining the decisions back needs the hash alone,
    unless two texts share one: then the text takes part in the join too.
    """
    joined, _ = _decided(docs, id_col, text_col, content_hash)
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """The rows of docs that exact_groups() keeps, with all their columns; rows are told apart by id and text, null ids too."""
    rows, key = _decided(docs, id_col, text_col, content_hash)
    gone = rows.where(~F.col("id").eqNullSafe(F.col("keep"))).select("id", *key).distinct()
    text = one_space(F.col(f"docs.`{text_col}`"))
    same = {"h": content_hash(text), "t": text}
    on = F.col(f"docs.`{id_col}`").eqNullSafe(F.col("gone.id"))
    for c in key:
        on &= same[c] == F.col("gone." + c)
    return docs.alias("docs").join(gone.alias("gone"), on, "left_anti")
