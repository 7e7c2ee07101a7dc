"""Ranked search against scores worked out document by document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tickloom.llm import lexical, queries
from tickloom.llm.lexical import Segment, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score long, term string", "item_id long, text string, rank int"


def words(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    held = [(i, Counter(w), len(w)) for i, text in docs if (w := words(text))]
    total, df = sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in {*items}:
        scores = []
        for i, c, n in held:
            m = 25 + (75 * n * len(held)) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, parts=3, **more):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], DOCS).repartition(parts)
    return sorted([tuple(r) for r in search(d, spark.createDataFrame([(*r, 1) for r in items], ITEMS), **more).collect()], key=str)


@pytest.mark.parametrize(("segment", "chunk", "block"), [(1 << 21, 1 << 21, 1 << 24), (50, 100, 1 << 24), (300, 1 << 21, 300)])
def test_equals_brute_force(spark, monkeypatch, segment, chunk, block):
    monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", segment)
    monkeypatch.setattr(lexical, "CHUNK_BYTES", chunk)
    some = random.Random(segment)
    vocabulary = [f"w{i}" for i in range(40)] + ["Naïve", "日本語日本語日本語", "ÀB", "aB", "x" * 30, "eightchr", "ninechars"]
    text = lambda n: some.choice([" ", "-", "\n"]).join(some.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(some.randint(0, 40))) for i in range(200)] + [(200, None), (201, ""), (202, "?! .."), (None, "w1 w2 w39"), (7, "w1 w2 w39"), (203, "w3 " * 3000)]
    docs += [(300 + i, docs[5][1]) for i in range(30)]  # ties
    items = [(i, text(some.randint(1, 12))) for i in range(25)] + [(25, None), (26, ""), (27, "nowhere"), (28, "w0 w0 W0"), (28, "w0 w0 W0"), (None, "w5 w39")]
    assert found(spark, docs, items, block_bytes=block) == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == [] and found(spark, [(1, "a")], []) == []


def test_long_text_and_few_documents(spark):
    docs = [(1, "needle " + "hay " * 400_000), (2, "hay")]
    assert found(spark, docs, [(1, "needle hay")]) == brute(docs, [(1, "needle hay")])


def test_reading_stops_when_bounds_prove_the_top():
    some = np.random.default_rng(0)
    docs, size = 20_000, 3
    held = [np.unique(np.where(some.random(size) < (0.9, 0.5, 0.003), np.arange(size), 0)) for _ in range(docs)]
    per, term = np.array([len(x) for x in held]), np.concatenate(held)
    segment = Segment(np.arange(docs), some.integers(20, 60, docs), per, term, np.ones(len(term), np.int64), np.array([100, 700, 6000]), docs, docs * 40)
    top, score, read = segment.best(np.arange(size), np.ones(size, np.int64), 10, 0, np.zeros(size, np.int64))
    full = np.bincount(np.repeat(np.arange(docs), per), segment.impacts, minlength=docs)
    assert sorted(score)[-10:] == sorted(full)[-10:] and read < len(term) / 10


def test_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    got = [tuple(r) for r in queries.op13_search(spark, path).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(con.execute(queries.OP13_SQL).fetchall())
