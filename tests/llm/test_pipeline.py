"""The filtering stages of the pipeline on rows without ids and on ids that repeat."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import toxicity
from tickloom.llm.exact_dedup import drop_copies, md5_128

SCHEMA = "doc_id long, text string, source string"


def left(rows):
    return sorted((tuple(r)[:2] for r in rows.collect()), key=repr)


def test_toxic_rows_without_id_and_with_a_shared_id(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda *a, **b: {"": -6.9, "bad": 9.0})
    docs = spark.createDataFrame([(None, "a bad one", "s"), (None, "fine", "s"), (1, "bad", "s"), (1, "good", "s"), (2, None, "s")], SCHEMA)
    got = toxicity.drop_toxic(docs, None)
    assert got.columns == docs.columns and left(got) == sorted([(None, "fine"), (1, "good"), (2, None)], key=repr)


def test_exact_copies_without_id_and_with_a_shared_id(spark):
    docs = spark.createDataFrame([(1, "x y", "s"), (None, "x  y", "s"), (2, "x y", "s"), (2, "other", "s"), (None, "alone", "s"), (None, "alone", "s")], SCHEMA)
    want = sorted([(1, "x y"), (2, "other"), (None, "alone"), (None, "alone")], key=repr)
    for content_hash in (md5_128, lambda c: F.lit(1)):
        assert left(drop_copies(docs, content_hash=content_hash)) == want


def test_near_copies_without_id_and_with_a_shared_id(spark):
    r = random.Random(1)
    a, b, c = (" ".join(r.choices([f"w{k}" for k in range(300)], k=80)) for _ in range(3))
    docs = spark.createDataFrame([(1, a, "s"), (None, a + " end", "s"), (2, a + " more", "s"), (2, b, "s"), (None, c, "s")], SCHEMA)
    assert left(corpus_pipeline.near_dedup(spark, docs, "")) == sorted([(1, a), (2, b), (None, c)], key=repr)


@pytest.mark.parametrize("stage", [corpus_pipeline.toxicity, corpus_pipeline.near_dedup, corpus_pipeline.bpe])
def test_rows_reach_python_in_small_batches(spark, monkeypatch, stage):
    """An executor holds a batch several times for each task: on 0.51 GB that took more memory than it has."""
    monkeypatch.setattr(toxicity, "train", lambda *a, **b: {"": -6.9})
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: None)
    session = spark.newSession()
    stage(session, session.createDataFrame([(1, "a b", "s"), (2, "c", "s")], SCHEMA), "")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    texts = session.range(4000, numPartitions=1).select(F.repeat(F.lit("x"), 8192).alias("text"))
    got = texts.mapInArrow(sizes, "n long, size long").agg(F.sum("n"), F.max("size")).first()
    assert got[0] == 4000 and got[1] < 8 << 20


def test_words_of_the_model_are_held_once(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 3)
    words = [a + b + "ingly" for a in (x + y for x in "bcdfgklmpr" for y in "aeiou") for b in (x + y for x in "bcdfgklmpr" for y in "aeio")]
    rows = [(" ".join(random.Random(i).choices(words, k=20)) + ". " + " ".join(words[i % 100 : i % 100 + 300]), i % 2) for i in range(400)]
    tracemalloc.start()
    try:
        toxicity.fit(rows)
        # each occurrence by itself took 16 MB
        assert tracemalloc.get_traced_memory()[1] < 8e6
    finally:
        tracemalloc.stop()
