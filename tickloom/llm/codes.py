"""Vector code compression: parts of vectors as indexes into integer codebooks, made by Lloyd's rounds with Hamerly's bounds.

A component x becomes the integer floor(4096 x); a vector is cut into 8 equal parts; each part position has a codebook of 16 entries.
A round assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index) and moves each entry to
the floor of the mean of its parts.

With every part its code, an upper bound on the distance to its entry and a lower bound on the distance to the second-nearest are
kept in a table from round to round. When entries move, the upper bound grows by its own entry's step and the lower one falls by the
longest step of the others. Only where the upper bound isn't strictly below the lower one are distances worked out again: first
the one to its entry, then, if that isn't enough, all of them, in integers. Bounds are rounded outwards, so a tie always gets the scan.

Each round reads the table once and writes the next, with one more row a task that holds the sums of its parts. What the driver
sees of a round are these sums, added up: one number a component and entry.

Defined cases. Vectors that are null, or hold null or non-finite components, have no code, nor have vectors whose length isn't that of
the smallest id's or no multiple of the parts. Ids may repeat or be null: each row has its own code, and where first entries are picked null comes after all ids, equal
ids by their integers. With fewer rows than entries there are as many entries as rows. An empty table gives an empty result. Null
labels count as one label. Components too large for exact 64-bit distances raise an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop, join_hot, save

_STATE = "id long, label string, ints array<int>, code array<tinyint>, upper array<float>, lower array<float>, sums array<long>"


def _outward(x: np.ndarray, way: float) -> np.ndarray:
    """As 32-bit numbers, rounded towards `way`."""
    return np.nextafter(x.astype(np.float32), np.float32(way))


class Codebooks:
    """Integer entries by part, entry and place within the part; steps: how far each entry came in the last round."""

    def __init__(self, entries: np.ndarray, steps: np.ndarray | None = None):
        self.entries, self.steps = entries, steps

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries at the floor of the mean of their parts; those without parts stay."""
        to = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        return Codebooks(to, np.sqrt(((to - self.entries) ** 2).sum(axis=2).astype(np.float64)))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def scan(self, x: np.ndarray, part: int) -> np.ndarray:
        """Squared distances of some parts at this position to all entries."""
        return ((x[:, None, :] - self.entries[part][None]) ** 2).sum(axis=2)

    def own(self, x: np.ndarray, part: int, code: np.ndarray) -> np.ndarray:
        return ((x - self.entries[part][code]) ** 2).sum(axis=1)

    def assigned(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings code and bounds of x (rows, parts, places) up to date, in place; how many parts were scanned.

        Without steps nothing is known of the bounds and every part is scanned.
        """
        scanned = 0
        for part in range(x.shape[1]):
            mine = x[:, part]
            if self.steps is None:
                open_ = np.arange(len(x))
            else:
                step, c = self.steps[part], code[:, part]
                others = np.array([np.delete(step, e).max(initial=0) for e in range(len(step))])
                upper[:, part] = _outward(upper[:, part].astype(np.float64) + step[c], np.inf)
                lower[:, part] = _outward(lower[:, part].astype(np.float64) - others[c], -np.inf)
                open_ = np.flatnonzero(~(upper[:, part] < lower[:, part]))
                upper[open_, part] = _outward(np.sqrt(self.own(mine[open_], part, c[open_]).astype(np.float64)), np.inf)
                open_ = open_[~(upper[open_, part] < lower[open_, part])]
            scanned += len(open_)
            d = self.scan(mine[open_], part)
            best = d.argmin(axis=1)
            code[open_, part] = best
            rows = np.arange(len(open_))
            upper[open_, part] = _outward(np.sqrt(d[rows, best].astype(np.float64)), np.inf)
            if d.shape[1] > 1:
                d[rows, best] = np.iinfo(np.int64).max
                lower[open_, part] = _outward(np.sqrt(d.min(axis=1).astype(np.float64)), -np.inf)
            else:
                lower[open_, part] = np.inf
        return scanned


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, k = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(x.ravel(), kind))


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, parts: int) -> DataFrame:
    """id, label, ints of the rows that have a code."""
    v = F.col("vector")
    good = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(good)
    return rows.select("id", "label", F.transform("vector", lambda x: F.floor(x * scale)).alias("ints"))


def _round(state: DataFrame, books: Codebooks, fresh: bool) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast((books.entries, books.steps))
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, total, names = Codebooks(*shared.value), np.zeros((parts, entries, 1 + width), np.int64), [c.split()[0] for c in _STATE.split(", ")]
        types = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.list_(pa.int64())]
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = _matrix(batch.column(2), np.int64).reshape(n, parts, width)
            if fresh:
                code, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
            else:
                code, upper, lower = _matrix(batch.column(3), np.int64), _matrix(batch.column(4), np.float32), _matrix(batch.column(5), np.float32)
            books.assigned(x, code, upper, lower)
            for p in range(parts):
                for e in np.unique(code[:, p]):
                    mine = code[:, p] == e
                    total[p, e, 0] += mine.sum()
                    total[p, e, 1:] += x[mine, p].sum(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(code, pa.int8()), _lists(upper, pa.float32()), _lists(lower, pa.float32()), pa.nulls(n, types[6])], names=names)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types[:6]], _lists(total.reshape(1, -1), pa.int64())], names=names)

    return save(state.mapInArrow(run, _STATE))


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """The codes, and the codebooks. Codes: vec_id, label, code (index of each part), error (squared distance over all parts).

    entries: at most 127. scale: a power of two keeps the integers exact.
    """
    now = before = save(_kept(vectors, id_col, vector_col, label_col, scale, parts))
    first = now.orderBy(F.col("id").asc_nulls_last(), F.array_size("ints"), "ints").limit(entries).collect()
    if not first:
        return now.select(F.col("id").alias("vec_id"), "label", F.lit(None).cast("array<tinyint>").alias("code"), F.lit(None).cast("long").alias("error")), None
    size = len(first[0]["ints"])
    bound = math.isqrt((1 << 62) // size) // 2
    now = now.where(F.array_size("ints") == size)
    outside = now.agg(F.max(F.greatest(F.array_max("ints"), -F.array_min("ints"))).alias("m")).first()["m"]
    if outside > min(bound, 2**31 - 1):
        raise ValueError(f"a component is {outside} after scaling; distances are exact up to {min(bound, 2**31 - 1)}")
    first = [r["ints"] for r in first if len(r["ints"]) == size]
    if len(first) < entries:
        first = [r["ints"] for r in now.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()]
    books = Codebooks(np.array(first, np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2).copy())
    shape = books.entries.shape
    now = now.select("id", "label", F.col("ints").cast("array<int>").alias("ints"))
    state = now
    for turn in range(rounds):
        after = _round(state, books, fresh=turn == 0)
        sums = after.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        total = np.zeros(shape[0] * shape[1] * (1 + shape[2]), np.int64)
        for r in sums:
            total[r["at"]] = r["x"]
        total = total.reshape(shape[0], shape[1], -1)
        books = books.moved(total[..., 1:], total[..., 0])
        drop(before)
        state, before = after.where("sums is null"), after
    return _coded(state, books, fresh=rounds == 0), books


def _coded(state: DataFrame, books: Codebooks, fresh: bool) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast((books.entries, books.steps))
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Codebooks(*shared.value)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = _matrix(batch.column(2), np.int64).reshape(n, parts, width)
            if fresh:
                code, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
            else:
                code, upper, lower = _matrix(batch.column(3), np.int64), _matrix(batch.column(4), np.float32), _matrix(batch.column(5), np.float32)
            books.assigned(x, code, upper, lower)
            error = sum(books.own(x[:, p], p, code[:, p]) for p in range(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(code, pa.int8()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, "vec_id long, label string, code array<tinyint>, error long")


def restored(codes: DataFrame, books: Codebooks, scale: int = 4096) -> DataFrame:
    """vec_id and the vector that a code stands for: the middle of the cells of its integers."""
    entries = books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _matrix(batch.column(1), np.int64)
            x = np.concatenate([entries[p][code[:, p]] for p in range(len(entries))], axis=1) if len(batch) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists((x + 0.5) / scale, pa.float64())], names=["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def code_table(vectors: DataFrame, **more) -> DataFrame:
    """One row per coded vector: vec_id, code (two hex digits a part), error, label_error (summed over equal labels), codebooks_sha256."""
    codes, books = compress(vectors, **more)
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    # null labels are one key; no label's text begins without "="
    codes = save(codes.select("vec_id", hexed.alias("code"), "error", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("key")))
    sums = save(codes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")))
    sha = F.lit(books.sha256() if books else None).cast("string")
    return join_hot(codes, sums, "key", "vec_id").select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))
