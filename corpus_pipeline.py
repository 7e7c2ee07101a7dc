"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.base import save, table
from tickloom.llm.bpe import encode
from tickloom.llm.exact_dedup import drop_copies
from tickloom.llm.minhash import drop_near_copies
from tickloom.llm.mixing import mix
from tickloom.llm.queries import public_tokenizer
from tickloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model trained on them and their labels doesn't reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles the one with the smallest id."""
    return drop_near_copies(docs, keep_null_ids=False)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row (little-endian unsigned 32-bit integers), and as text what they decode to.

    Columns of docs named n_tokens, ids or decoded give way to the stage's own.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "decoded")]
    return encode(docs, public_tokenizer(), keep=rest, decoded=True).withColumnRenamed("decoded", "text")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: SQL can express neither the trained model nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs)
    return docs
