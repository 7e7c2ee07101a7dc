"""Substring dedup: prefix-partitioned suffix trees over words.

A suffix starts at every word that has a whole window (13 words) left in its document. Suffixes are dealt into groups by prefixes
of variable length: a prefix is lengthened (1, 2, 4, 8, 13 words) only while more suffixes share it than one group may hold, by
counts over all suffixes. A group holds every suffix of its prefixes, so its subtrees are whole; sorting its suffixes brings
the leaves of each internal node together. Nodes of a window's depth whose leaves lie in several documents are the repeats; nothing
deeper changes what is removed, so subtrees are cut there, and runs of neighbouring windows make up the maximal repeats.

A window that a third of all documents share is folded before the exchange: of the documents that a task has in hand only
the smallest asks the group, the others are settled at once. Settled suffixes travel in blocks, dealt by hash over groups of their
own, whose number grows with all suffixes so that they too hold about `most` at most.

A window is known by a 64-bit hash of its words within the group of its prefix's own hash. Groups hold 2^18 suffixes, or a 4,096th
of all, but at most 2^24: the driver's table of prefixes grows with the corpus divided by that.

Defined cases. A null text has no words. Texts with fewer words than a window lose nothing. A row with a null id comes after all
ids, and rows without ids or of one id never take words from one another. Rows that repeat an id and a text share all decisions.
An empty table gives an empty result; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import save
from .words import mix64, windows, word_hashes

CELLS, FAN = 4096, 256
CHUNK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max


def _pack(x: np.ndarray) -> bytes:
    """Compressed with the first bytes of all values together, then all second bytes and so on: the higher ones are mostly alike."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(packed, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind)[:, 0]


def _pack_places(ids: np.ndarray, ths: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Differences of neighbours; a position starts anew where its row has another id or hash."""
    i, t, p = (np.diff(x, prepend=x.dtype.type(0)) for x in (ids, ths, pos))
    return _pack(i), _pack(t), _pack(np.where((i != 0) | (t != 0), pos, p))


def _unpack_places(ids: bytes, ths: bytes, pos: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, t, p = (_unpack(x, n, kind) for x, kind in ((ids, np.int64), (ths, np.int64), (pos, np.int32)))
    head = np.flatnonzero(np.concatenate(([True], (i[1:] != 0) | (t[1:] != 0))))
    total = np.cumsum(p, dtype=np.int32)
    before = np.repeat(total[head] - p[head], np.diff(np.append(head, n)))
    return np.cumsum(i), np.cumsum(t), total - before


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some documents at a time: (id, th) of each, and of all their words the hash and the document."""
    ids, ths, texts, size = [], [], [], 0

    def made():
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        h, first, _ = word_hashes(b"\n".join(texts))
        return np.array(ids, np.int64), np.array(ths, np.int64), h, np.searchsorted(starts, first, "right") - 1

    for batch in batches:
        for i, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode()
            ids.append(NO_ID if i is None else i), ths.append(th), texts.append(raw)
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield made()
                ids, ths, texts, size = [], [], [], 0
    if texts:
        yield made()


def _lengths(n: int) -> list[int]:
    return [*(k for k in (1 << i for i in range(n.bit_length())) if k < n), n]


def _placed(h: np.ndarray, at: np.ndarray, n: int, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each suffix in `at` (-1: none yet); the suffixes that are still open, and their cells at the next level."""
    group, open_, node = np.full(len(at), -1), np.arange(len(at)), np.zeros(len(at), np.int64)
    lengths = _lengths(n)
    for depth, length in enumerate(lengths):
        fan = CELLS if depth == 0 else FAN
        # the remainders of the hash alone would be those of the window's key at full depth
        cell = node * fan + (mix64(windows(h, length)[at[open_]] + np.uint64(length)) % np.uint64(fan)).astype(np.int64)
        if depth == len(levels):
            return group, open_, cell
        to = levels[depth][cell]
        group[open_] = to
        still = to < 0
        open_, node = open_[still], -1 - to[still]
        if not len(open_):
            break
    return group, open_, node


def _suffixes(owner: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, np.int64)


def _prefixes(base: DataFrame, n: int, most: int | None) -> tuple[list[np.ndarray], int, int, int]:
    """For each level the group of every cell, or -1 - node where a longer prefix decides; the number of groups; of suffixes; and `most`."""
    levels: list[np.ndarray] = []
    groups, inner, total = 0, 1, 0
    for depth in range(len(_lengths(n))):
        width = inner * (CELLS if depth == 0 else FAN)
        shared = base.sparkSession.sparkContext.broadcast(levels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(width, np.int64)
            for _, _, h, owner in _chunks(batches):
                at = _suffixes(owner, n)
                if len(at):
                    counts += np.bincount(_placed(h, at, n, shared.value)[2], minlength=width)
            has = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(counts[has])], names=["cell", "n"])

        counts = np.zeros(width, np.int64)
        for r in base.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            counts[r["cell"]] = r["n"]
        total = total or int(counts.sum())
        most = most or int(min(max(counts.sum() // 4096, 1 << 18), 1 << 24))
        last = depth == len(_lengths(n)) - 1
        over = (counts > most) & (not last)
        to = groups + np.cumsum(np.where(over, 0, counts)) // most
        groups, inner = int(to[-1]) + 1, int(over.sum())
        to[over] = -1 - np.arange(inner)
        levels.append(to)
        if not inner:
            break
    return levels, groups, total, most


def _sent(base: DataFrame, n: int, most: int | None) -> DataFrame:
    """g, n, keys, ids, ths, pos: parts of groups; without keys what is settled already."""
    levels, groups, total, most = _prefixes(base, n, most)
    # a quarter of `most` on average, as the hash doesn't deal evenly
    passes, block = 4 * (total // most + 1), max(1, most // 16)
    shared = base.sparkSession.sparkContext.broadcast(levels)
    names = ["g", "n", "keys", "ids", "ths", "pos"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for turn, (ids, ths, h, owner) in enumerate(_chunks(batches)):
            at = _suffixes(owner, n)
            if not len(at):
                continue
            first = np.searchsorted(owner, np.arange(len(ids)))
            key, who, pos = windows(h, n)[at], owner[at], (at - first[owner[at]]).astype(np.int32)
            order = np.lexsort((ids[who], key))
            head = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            least = ids[who[order]][np.flatnonzero(head)][np.cumsum(head) - 1]
            later = np.zeros(len(at), bool)
            later[order] = ids[who[order]] > least
            group = _placed(h, at, n, shared.value)[0]
            # what is settled already travels without keys
            settled = np.flatnonzero(later)
            seed = mix64(mix64(ids[who[settled[::block]]].astype(np.uint64)) ^ pos[settled[::block]].astype(np.uint64)) + np.uint64((task << 32) + turn)
            group[settled] = np.repeat(groups + (mix64(seed) % np.uint64(passes)).astype(np.int64), block)[: len(settled)]
            order = np.lexsort((pos, who, group))
            cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                part = order[a:b]
                rows.append((int(group[part[0]]), b - a, None if later[part[0]] else key[part].tobytes(), *_pack_places(ids[who[part]], ths[who[part]], pos[part])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=names)

    return base.mapInArrow(send, "g long, n long, keys binary, ids binary, ths binary, pos binary")


def _repeats(base: DataFrame, n: int, most: int | None) -> DataFrame:
    """id, th, pos: first word of each window that also starts in a document with a smaller id."""

    def subtrees(rows: pd.DataFrame) -> pd.DataFrame:
        ids, ths, pos = map(np.concatenate, zip(*map(_unpack_places, rows["ids"], rows["ths"], rows["pos"], rows["n"]), strict=True))
        if rows["keys"].iloc[0] is not None:
            key = np.frombuffer(b"".join(rows["keys"]), np.uint64)
            order = np.argsort(key, kind="stable")
            head = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
            least = np.repeat(np.minimum.reduceat(ids[order], head), np.diff(np.append(head, len(order))))
            hit = order[ids[order] > least]
            ids, ths, pos = ids[hit], ths[hit], pos[hit]
        return pd.DataFrame({"id": ids, "th": ths, "pos": pos})

    return _sent(base, n, most).groupBy("g").applyInPandas(subtrees, "id long, th long, pos int")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, th, size (bytes) and the text compressed."""
    for batch in batches:
        raw = [(x.as_py() or "").encode() for x in batch.column(2)]
        packed = [pa.compress(x, codec="zstd", asbytes=True) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, raw), pa.int64()), pa.array(packed, pa.binary())], names=["id", "th", "size", "packed"])


def _with_repeats(docs: DataFrame, n: int, id_col: str, text_col: str, most: int | None) -> DataFrame:
    """id, size, packed, at: the starts of repeated windows of each row. Texts are shuffled, and so compressed before."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = base.withColumn("id", F.coalesce("id", F.lit(int(NO_ID)).cast("long")))
    repeated = not base.groupBy("id").count().where("count > 1").isEmpty()
    base = base.withColumn("th", F.coalesce(F.xxhash64("text"), F.lit(0)) if repeated else F.lit(0).cast("long"))
    found = save(_repeats(base.select("id", "th", "text"), n, most).groupBy("id", "th").agg(F.collect_list("pos").alias("at")))
    texts = base.select("id", "th", "text").mapInArrow(_packed, "id long, th long, size long, packed binary")
    return texts.join(found.hint("shuffle_hash"), ["id", "th"], "left").select(F.when(F.col("id") != int(NO_ID), F.col("id")).alias("id"), "size", "packed", "at")


def _mask(n_words: int, at, n: int) -> np.ndarray:
    """True for the words that no repeated window covers."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) == 0


def _kept(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bytes]]]]:
    for batch in batches:
        made = []
        for size, packed, at in zip(*batch.columns[1:], strict=True):
            words = pa.decompress(packed.as_py(), decompressed_size=size.as_py(), codec="zstd", asbytes=True).split()
            total = len(words)
            if at.is_valid:
                words = list(compress(words, _mask(total, at.values.to_numpy(), n)))
            made.append((total, total - len(words), b" ".join(words)))
        yield batch, made


def substring_dedup(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its words without repeats, joined by one space).

    n: words of a window. most: suffixes a group may hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made in _kept(batches, n):
            totals, removed, kept = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return _with_repeats(docs, n, id_col, text_col, most).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def substring_digest(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made in _kept(batches, n):
            totals, removed, kept = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_repeats(docs, n, id_col, text_col, most).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
