"""Vector codes against Lloyd's rounds without bounds, in Python's integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm.codes import Codebooks, code_table, compress, restored

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id long"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes) if code[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    codes = assign()
    errors = [sum(far(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes)]
    labels = {}
    for (_, _, label), e in zip(kept, errors):
        labels[label] = labels.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{x:02x}" for x in code), e, labels[label], sha) for (i, _, label), code, e in zip(kept, codes, errors)], key=str)


def found(docs, **more):
    return sorted([tuple(r) for r in code_table(docs, **more).collect()], key=str)


@pytest.mark.parametrize(("count", "grid"), [(400, None), (300, 3), (9, None), (1, None)])
def test_equals_lloyd(spark, count, grid):
    some = np.random.default_rng(count)
    v = some.normal(0, 0.2, (count, 16)) if grid is None else some.integers(0, grid, (count, 16)) / 4096  # a grid has ties everywhere
    rows = [(int(i), [float(np.float32(x)) for x in r], None if i % 5 == 0 else int(i % 3)) for i, r in enumerate(v)]
    rows += [(None, rows[0][1], 1), (0, rows[-1][1], None), (-5, None, 1), (-4, [], 1), (-3, [float("nan")] * 16, 1), (-2, [math.inf] + [0.0] * 15, 1), (-1, [None] + [0.0] * 15, 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    assert found(table) == brute(rows)


def test_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert found(table) == brute([(r.vec_id, r.embedding, r.label) for r in table.collect()])


def test_empty_other_lengths_and_too_large(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, [0.5] * 16, 1, "x", 1), (2, [0.5] * 8, 1, "x", 1), (3, [0.5] * 9, 1, "x", 1)]
    assert [r[0] for r in found(spark.createDataFrame(rows, SCHEMA))] == [1]
    with pytest.raises(ValueError, match="after scaling"):
        compress(spark.createDataFrame([(1, [1e30] * 16, 1, "x", 1)], SCHEMA))


def test_bounds_spare_scans():
    some = np.random.default_rng(1)
    middles = some.integers(-4000, 4000, (16, 8))
    x = (middles[some.integers(0, 16, 5000)] + some.integers(-50, 50, (5000, 8)))[:, None, :]
    books = Codebooks(middles[None].copy())
    code, upper, lower = np.zeros((5000, 1), np.int64), np.zeros((5000, 1), np.float32), np.zeros((5000, 1), np.float32)
    assert books.assigned(x, code, upper, lower) == 5000
    sums = np.stack([x[code[:, 0] == e, 0].sum(axis=0) for e in range(16)])[None]
    books = books.moved(sums, np.bincount(code[:, 0], minlength=16)[None])
    assert books.assigned(x, code, upper, lower) == 0 and (code[:, 0] == books.scan(x[:, 0], 0).argmin(axis=1)).all()


def test_restored(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    codes, books = compress(table, entries=64)
    both = restored(codes, books).join(table, "vec_id").select("vector", F.col("embedding").cast("array<double>").alias("e")).collect()
    near = sum(sum((a - b) ** 2 for a, b in zip(r.vector, r.e)) for r in both)
    assert near < 0.9 * sum(sum(b**2 for b in r.e) for r in both)
