"""Substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from tickloom.llm.substrings import _pack_places, _sent, _unpack_places, substring_dedup, substring_digest

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("g", T.IntegerType())])


def brute(rows, n):
    words = [(i, (t or "").encode().split()) for i, t, _ in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            rank = (i is None, i or 0)
            first[key] = min(first.get(key, rank), rank)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (i is None, i or 0):
                gone |= set(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=1):
    r = random.Random(seed)
    passages = [[f"p{r.randrange(30)}" for _ in range(r.randrange(4, 40))] for _ in range(8)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randrange(0, 6)):
            w += r.choice(passages) if r.random() < 0.6 else [f"w{r.randrange(60)}" for _ in range(r.randrange(20))]
        rows.append((i if i % 17 else i - i % 3, r.choice([" ", "\n", " \t"]).join(w), 0))
    rows += [(None, rows[3][1], 0), (500, None, 0), (501, "", 0), (502, "one", 0), (503, "a " * 3000, 0), (504, "a " * 2000 + "é b", 0), (504, "a " * 2000 + "c", 0), rows[5], rows[5]]
    r.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for n, most in ((13, None), (5, 40), (13, 7)):
        got = sorted((tuple(r) for r in substring_digest(docs, n, most=most).collect()), key=repr)
        assert got == brute(rows, n)


def test_kept_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d", 0), (2, "x a  b\tc y", 0)], SCHEMA)
    assert {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring_dedup(docs, 3).collect()} == {1: (0, "a b c d"), 2: (3, "x y")}
    assert substring_digest(docs.where("doc_id > 9")).count() == 0


def test_settled_suffixes_keep_to_the_limit(spark):
    r = random.Random(2)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(400))
    docs = spark.createDataFrame([(i, 0, text) for i in range(60)], "id long, th long, text string").repartition(3)
    sizes = {x["g"]: x["total"] for x in _sent(docs, 13, 500).where("keys is null").groupBy("g").agg({"n": "sum"}).withColumnRenamed("sum(n)", "total").collect()}
    assert sum(sizes.values()) == 57 * 388 and max(sizes.values()) <= 500


def test_places_come_back_and_take_less_than_differences():
    r = np.random.default_rng(3)
    ids, pos = np.sort(r.integers(0, 3000, 2000)), r.integers(0, 500, 2000).astype(np.int32)
    ids[-3:] = np.iinfo(np.int64).max
    ths = np.where(ids % 5 == 0, r.integers(-(1 << 62), 1 << 62, 2000), 0)
    packed = _pack_places(ids, ths, pos)
    assert all((a == b).all() for a, b in zip(_unpack_places(*packed, 2000), (ids, ths, pos), strict=True))
    assert len(packed[2]) < 0.9 * len(pa.compress(np.diff(pos, prepend=np.int32(0)).tobytes(), codec="zstd", asbytes=True))


def test_texts_are_compressed_before_they_are_shuffled(spark):
    docs = spark.createDataFrame([(i, "many words of a text " * 50, 0) for i in range(4)], SCHEMA)
    plan = substring_digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert any("packed" in line and "MapInArrow" in line for line in plan.splitlines())
    assert not any("Exchange" in line and "text" in line for line in plan.splitlines())
