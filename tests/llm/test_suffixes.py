"""Suffix-array dedup against a brute-force version, over bytes."""

import random

import numpy as np
import pytest

from tickloom.llm import suffixes
from tickloom.llm.suffixes import NO_ID, multikey_order, suffix_dedup


def brute(docs, n):
    first, out = {}, []
    for i, text in docs:
        raw, key = (text or "").encode(), NO_ID if i is None else i
        for p in range(len(raw) - n + 1):
            first[raw[p : p + n]] = min(first.get(raw[p : p + n], key), key)
    for i, text in docs:
        raw, key = (text or "").encode(), NO_ID if i is None else i
        gone = np.zeros(len(raw) + 2, bool)
        for p in range(len(raw) - n + 1):
            if first[raw[p : p + n]] < key:
                gone[p + 1 : p + n + 1] = True
        edges = np.flatnonzero(np.diff(gone.astype(int))).reshape(-1, 2)
        out.append((i, len(raw), int(gone.sum()), [tuple(map(int, e)) for e in edges], bytes(b for b, g in zip(raw, gone[1:-1]) if not g)))
    return sorted(out, key=str)


def found(docs, n=50, **more):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_dedup(docs, n, **more).collect()], key=str)


def odd_docs(seed):
    some = random.Random(seed)
    words = ["alpha", "beta", "naïve", "日本", "x" * 60, "the quick brown fox jumps over the lazy dog near"]
    passages = [" ".join(some.choice(words) for _ in range(some.randint(1, 12))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [some.choice([some.choice(passages), str(some.random()), "ab" * some.randint(0, 60), " " * some.randint(0, 200)]) for _ in range(some.randint(0, 5))]
        docs.append((some.choice([i, i, i, 5, None]), None if some.random() < 0.1 else "".join(parts)))
    return [*docs, (1000, "q" * 9000), (999, "q" * 4000), (1001, ""), (1002, "\0" * 300), (1003, "\0" * 200)]


@pytest.mark.parametrize(("n", "most", "held"), [(50, None, 1 << 18), (50, 200, 64), (7, 100, 64), (2, 300, 1 << 18), (13, 50, 1 << 18)])
def test_equals_brute_force(spark, monkeypatch, n, most, held):
    monkeypatch.setattr(suffixes, "HELD_SUFFIXES", held)
    docs = odd_docs(n)
    rows = [(i, text, 1, "x") for i, text in docs]
    table = spark.createDataFrame(rows, "doc_id long, text string, n long, rows string").repartition(3)
    assert found(table, n, most=most) == brute(docs, n)


def test_long_texts_that_share_a_passage(spark):
    some = random.Random(3)
    long_ = [" ".join(str(some.randint(0, 10**6)) for _ in range(20_000)) for _ in range(3)]
    docs = [(i, long_[i % 3][7 * i :] + " tail " + str(i) * 60) for i in range(9)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs, 50)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert found(empty) == [] and found(empty.repartition(3)) == []


def test_multikey_order():
    some = np.random.default_rng(0)
    rows, last = some.integers(0, 2, (500, 19)).astype(np.uint8), some.integers(0, 3, 500)
    rows[:, 5:] *= 0
    order, head = multikey_order(rows, last)
    keys = [(r.tobytes(), int(x)) for r, x in zip(rows[order], last[order])]
    assert keys == sorted(keys) and [i == 0 or keys[i][0] != keys[i - 1][0] for i in range(500)] == head.tolist()
