"""Embedding near-dedup: PCA-ordered tiled comparison with suffix-norm bounds.

Equal vectors of a label form one class. Classes are turned onto the principal axes of all vectors, ordered by label and leading
coordinates, and cut into tiles of TILE vectors. The first coordinates are dealt into cells as wide as a link can reach: two tiles
meet only if they hold neighbouring cells, and the boxes of their leading coordinates are near enough to hold a link. Between two tiles the leading dimensions are multiplied first; what the remaining dimensions can add is at most the
product of the suffix norms, and a pair is left as soon as its cosine can't reach the threshold. What is left is confirmed
by the cosine of the original vectors in double precision. A tile pair returns a count and a root a vector, never its pairs.

Defined cases. Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with
nothing. Vectors of different lengths don't link. Rows that repeat a vector link with one another, whatever their ids. A null id
never represents a component that has an id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import save
from .components import components

TILE, LEADING, STEPS, SLACK = 2048, 4, (8, 24), 1e-9


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, so that nothing overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _by_length(lengths: pa.Array, vectors: pa.Array, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """The packed vectors of a batch as one matrix for each length."""
    for d in lengths.unique().to_pylist():
        held = vectors.filter(pc.equal(lengths, d))
        yield d, np.frombuffer(b"".join(held.to_pylist()), kind).astype(float).reshape(-1, d)


def _principal_axes(classes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """For each length of vectors the axes of their second moments, strongest first; d * d numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x in _by_length(batch.column(0), batch.column(1), kind):
                x = _unit(x)
                sums[d] = sums.get(d, 0.0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["d", "i", "row"])

    parts = classes.select("d", "v").mapInArrow(run, "d int, i int, row array<double>").select("d", "i", F.posexplode("row").alias("j", "x"))
    found: dict[int, np.ndarray] = {}
    for r in parts.groupBy("d", "i", "j").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["d"], np.zeros((r["d"], r["d"])))[r["i"], r["j"]] = r["x"]
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for d, m in found.items()}


def _cells(p: np.ndarray, reach: float) -> np.ndarray:
    """The cell of each vector by its leading coordinates but the last; vectors of a link lie in neighbouring cells."""
    return np.floor(p[:, :-1] / (reach * (1 + 1e-6) + 1e-9)).astype(np.int64)


def _beside(cells: Column) -> Column:
    """All cells (of one, two or three numbers) beside those of an array, themselves included."""
    steps = F.array(*[F.array(*map(F.lit, s)) for s in product((-1, 0, 1), repeat=LEADING - 1)])
    return F.array_distinct(F.flatten(F.transform(cells, lambda c: F.transform(steps, lambda s: F.zip_with(c, F.slice(s, F.lit(1), F.size(c)), lambda a, b: a + b)))))


def _tiles(classes: DataFrame, kind: str, axes, reach: float, most: int) -> DataFrame:
    """One row a tile: tile, label, d, ids, times and vectors as binary, and the box of the leading coordinates."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, keys = batch.column(2), [None] * batch.num_rows
            for d, x in _by_length(lengths, batch.column(4), kind):
                p = _unit(x) @ axes.value[d][:, :LEADING]
                near = np.concatenate((_cells(p, reach), p[:, -1:]), axis=1).tolist()
                for i, k in zip(np.flatnonzero(lengths.to_numpy() == d), near, strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.float64()))], names=[*batch.schema.names, "near"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def tile() -> pa.RecordBatch:
            v = np.frombuffer(b"".join(r["v"] for r in held), kind).reshape(len(held), -1)
            p = _unit(v.astype(float)) @ axes.value[held[0]["d"]][:, :LEADING]
            ids, times = (np.array([r[k] for r in held], np.int64) for k in ("c", "times"))
            made = [ids[0], held[0]["label"], held[0]["d"], ids.tobytes(), times.tobytes(), v.tobytes(), p.min(axis=0).tolist(), p.max(axis=0).tolist(), np.unique(_cells(p, reach), axis=0).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, arrow, strict=True)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == most or (held[0]["label"], held[0]["d"]) != (row["label"], row["d"])):
                    yield tile()
                    held.clear()
                held.append(row)
        if held:
            yield tile()

    names = ["tile", "label", "d", "ids", "times", "vs", "low", "high", "cells"]
    arrow = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int64()))]
    turned = save(classes.select("c", "label", "d", "times", "v").mapInArrow(turn, "c long, label string, d int, times long, v binary, near array<double>"))
    dealt = turned.repartitionByRange("label", "d", "near", "c").sortWithinPartitions("label", "d", "near", "c")
    return save(dealt.mapInArrow(cut, "tile long, label string, d int, ids binary, times binary, vs binary, low array<double>, high array<double>, cells array<array<bigint>>"))


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest position that each of n nodes reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs of rows with cosine >= least."""
    ux, uy = _unit(x.astype(float)), _unit(y.astype(float))
    px, py = ux @ axes, uy @ axes
    ends = [*(s for s in STEPS if s < px.shape[1]), px.shape[1]]
    tails = [(np.sqrt((px[:, e:] ** 2).sum(axis=1)), np.sqrt((py[:, e:] ** 2).sum(axis=1))) for e in ends]
    found_i, found_j = [], []
    for at in range(0, len(x), 256):
        sums = px[at : at + 256, : ends[0]] @ py[:, : ends[0]].T
        i, j = np.nonzero(sums + tails[0][0][at : at + 256, None] * tails[0][1][None, :] >= least - SLACK)
        s, i = sums[i, j], i + at
        for (a, b), (tx, ty) in zip(zip(ends, ends[1:], strict=False), tails[1:], strict=True):
            s = s + np.einsum("kd,kd->k", px[i, a:b], py[j, a:b])
            fine = s + tx[i] * ty[j] >= least - SLACK
            i, j, s = i[fine], j[fine], s[fine]
        fine = np.einsum("kd,kd->k", ux[i], uy[j]) >= least
        found_i.append(i[fine]), found_j.append(j[fine])
    return np.concatenate(found_i), np.concatenate(found_j)


def near_vectors(vectors: DataFrame, least: float = 0.8, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. Vectors are compared within a label."""
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for value in batch.column(2).to_pylist():
                v = np.array([np.nan if x is None else x for x in value or [np.nan]], kind)
                packed.append(v.tobytes() if np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "label", "v"])

    narrow = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    rows = save(narrow.mapInArrow(pack, "id long, label string, v binary").withColumn("v", F.when(F.col("label").isNotNull(), F.col("v"))))
    # rows find their class again by 128 bits of hash; classes are numbered once and saved, so no two share a number
    key = {"h1": F.xxhash64("label", "v"), "h2": F.xxhash64("v", "label", F.lit(1))}
    usable = rows.where("v is not null")
    classes = usable.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times")).withColumns(key)
    classes = save(classes.withColumn("c", F.monotonically_increasing_id()).withColumn("d", F.expr(f"cast(length(v) / {int(kind[2])} as int)")))
    axes = spark.sparkContext.broadcast(_principal_axes(classes, kind))
    reach = (2 - 2 * least) ** 0.5
    tiles = _tiles(classes, kind, axes, reach, tile)
    box = tiles.select("tile", "label", "d", "low", "high", F.explode("cells").alias("cell"))
    other = tiles.select("label", "d", F.col("tile").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(_beside(F.col("cells"))).alias("cell"))
    gaps = sum((F.pow(F.greatest(F.lit(0.0), F.get("low", F.lit(k)) - F.get("high2", F.lit(k)), F.get("low2", F.lit(k)) - F.get("high", F.lit(k))), F.lit(2)) for k in range(1, LEADING)), F.pow(F.greatest(F.lit(0.0), F.get("low", F.lit(0)) - F.get("high2", F.lit(0)), F.get("low2", F.lit(0)) - F.get("high", F.lit(0))), F.lit(2)))
    meet = box.join(other, ["label", "d", "cell"]).where("tile <= other").where(F.coalesce(gaps, F.lit(0.0)) <= reach**2 + SLACK).select("tile", "other").distinct()
    held = tiles.select("tile", "d", "ids", "times", "vs")
    pairs = meet.join(held, "tile").join(held.select(F.col("tile").alias("other"), F.col("ids").alias("ids2"), F.col("times").alias("times2"), F.col("vs").alias("vs2")), "other")
    pairs = pairs.select((F.col("tile") == F.col("other")).alias("same"), "d", "ids", "times", "vs", "ids2", "times2", "vs2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same, d, ids, times, vs, ids2, times2, vs2 = (batch.column(c)[k].as_py() for c in range(8))
                a, ta, b, tb = (np.frombuffer(z, np.int64) for z in (ids, times, ids2, times2))
                i, j = linked(np.frombuffer(vs, kind).reshape(-1, d), np.frombuffer(vs2, kind).reshape(-1, d), axes.value[d], least)
                if same:
                    i, j = i[i < j], j[i < j]
                else:
                    j, a, ta, tb = j + len(a), np.concatenate((a, b)), np.concatenate((ta, tb)), np.concatenate((ta, tb))
                both = tb if not same else ta
                n = np.bincount(i, weights=both[j], minlength=len(a)) + np.bincount(j, weights=both[i], minlength=len(a))
                has = np.flatnonzero(n)
                root = a[_roots(i, j, len(a))] if len(has) else a
                yield pa.RecordBatch.from_arrays([pa.array(a[has]), pa.array(n[has].astype(np.int64)), pa.array(root[has])], names=["c", "n", "root"])

    found = save(pairs.mapInArrow(compare, "c long, n long, root long"))
    label = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("c").agg(F.sum("n").alias("n"))
    named = classes.select("c", "h1", "h2", "id", "times").join(links, "c", "left").join(label, F.col("c") == F.col("node"), "left").select("h1", "h2", "id", F.coalesce("component", "c").alias("comp"), (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    named = named.join(named.groupBy("comp").agg(F.min("id").alias("component_id")), "comp").select("h1", "h2", "n_links", "component_id")
    out = rows.select("id", *[F.when(F.col("v").isNotNull(), k).alias(n) for n, k in key.items()]).join(named, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
