"""Suffix-array dedup over UTF-8 bytes: sampled splitters range-partition suffixes, buckets sort them token by token.

A string of n bytes (50) is a repeat if it also starts in a document with a smaller id; every byte that a repeat covers is removed.

Which suffixes stand for a text. Of the grams (16 bytes) inside a window of n bytes the one with the least hash is its anchor, the
leftmost of equals. Equal windows have equal anchors at equal places, so it is enough to sort the suffixes that start at anchors,
one in about eighteen, each with the bytes before it that its windows reach.

1. The grams of all anchors, 5 bytes each, meet in buckets by hash; which of them occur twice goes back as one bit each. It only
   leaves out suffixes that can't repeat; a false hit costs work, never rows.
2. The other suffixes are sorted: splitters sampled from all suffixes cut their order into buckets, a bucket sorts by its leading 8
   bytes, then what is tied by the next 8, and so on (multikey quicksort with tokens of a word). Of equal contexts the smallest
   document stays undecided, the windows of the others are repeats. A suffix shares with its neighbours the longest prefix it has with
   any other; at a bucket's ends the splitters stand for the neighbours beyond. Only windows within that prefix are left, and are sorted.
3. A window within the prefix that its suffix shares with a splitter may be repeated across that boundary. Those windows, whole, meet by
   hash and are sorted in the same way; all but the smallest document's are repeats.

A task sends only the smallest document of equal contexts, so a passage that a third of all documents share comes once a task.
What is decided travels along in blocks dealt evenly. Texts never move: the decisions for a partition of docs come back to it, and rows
meet them by place (zip). So docs has to give the same rows in the same order when a task runs again, as scans of files do.

Defined cases. A null text is empty. Texts shorter than n lose nothing. A row with a null id comes after all ids; rows without ids or of
one id never take bytes from one another. An empty table gives an empty result; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import save
from .words import mix64

NO_ID = np.iinfo(np.int64).max
CHUNK_BYTES = 1 << 20
#: Anchors, and suffixes, that a task holds before it sends them.
HELD_ANCHORS, HELD_SUFFIXES = 1 << 23, 1 << 17
_BASE = 0x9E3779B97F4A7C15  # fixed value: an odd base of the polynomial hash
_LOW = np.uint64(0xFFFFFFFF)


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, kind: type | str, width: int = 0) -> np.ndarray:
    size = n * np.dtype(kind).itemsize * max(1, width)
    flat = np.frombuffer(pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True) if size else b"", kind)
    return flat.reshape(n, width) if width else flat


def _gram_bytes(n: int) -> int:
    """The largest power of two up to a third of a window."""
    return 1 << max(0, (max(1, n // 3)).bit_length() - 1)


def _gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    h, size, power = raw.astype(np.uint64) + np.uint64(1), 1, _BASE
    while size < k:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power % (1 << 64)
    return mix64(h)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours."""
    out, size = x, 1
    while 2 * size <= w:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    return out if size == w else np.minimum(out[: len(x) - w + 1], out[w - size : len(x) - size + 1])


def _anchors(raw: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of the windows that have it, and the hash of its gram; raw: texts of these lengths, one after another."""
    k = _gram_bytes(n)
    if len(raw) < n:
        return (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
    h = _gram_hashes(raw, k)
    at = _least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), n - k + 1) & _LOW
    p = np.flatnonzero(np.arange(len(at)) <= np.repeat(np.cumsum(lengths) - n, lengths)[: len(at)])
    a = at[p].astype(np.int64)
    cuts = np.flatnonzero(np.diff(a, prepend=-1))
    a = a[cuts]
    return a, p[cuts], p[np.append(cuts[1:], len(p)) - 1] if len(p) else a, h[a]


def _keyed(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and 40 bits, of each gram."""
    x = mix64(h + np.uint64(1))
    return ((x >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), x & np.uint64((1 << 40) - 1)


def _chunks(rows: Iterator[tuple[int, str | None]]) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Ids, lengths, and the bytes of some documents at a time."""
    ids, texts, size = [], [], 0

    def made():
        return ids, np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8)

    for i, text in rows:
        raw = (text or "").encode()
        ids.append(i), texts.append(raw)
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield made()
            ids, texts, size = [], [], 0
    if ids:
        yield made()


def _cut(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=False):
        yield int(bucket[order[a]]), order[a:b]


def _send_grams(part: int, rows: Iterator[tuple[int, str | None]], n: int, buckets: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(bucket, part, turn, how many, keys); turn -1: the documents of the part."""
    held, size, turn, docs = [], 0, 0, 0

    def sent():
        bucket, key = _keyed(np.concatenate(held), buckets)
        for b, at in _cut(bucket):
            yield b, part, turn, len(at), np.ascontiguousarray(key[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()

    for ids, lengths, raw in _chunks(rows):
        docs += len(ids)
        held.append(_anchors(raw, lengths, n)[3])
        size += len(held[-1])
        if size >= HELD_ANCHORS:
            yield from sent()
            held, size, turn = [], 0, turn + 1
    if size:
        yield from sent()
    if docs:
        yield part % buckets, part, -1, docs, b""


def _twice(sent: pa.Table) -> pa.Table:
    """For each part and turn one bit a gram: does it occur again?"""
    rows = sorted(_rows(sent), key=lambda r: r[1:3])
    raw = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, 5)
    key = np.zeros((len(raw), 8), np.uint8)
    key[:, :5] = raw
    key = key.view("<u8").ravel()
    order = np.argsort(key)
    ranked = key[order]
    equal = np.concatenate(([False], ranked[1:] == ranked[:-1], [False]))
    again = np.zeros(len(key), bool)
    again[order] = equal[1:] | equal[:-1]
    made, end = [], 0
    for bucket, part, turn, n, keys in rows:
        end += len(keys) // 5
        made.append((bucket, part, turn, n, np.packbits(again[end - len(keys) // 5 : end]).tobytes()))
    return _table(made, _REPLIES)


class _Again:
    """The bits of one part, read in the order in which it sent its grams."""

    def __init__(self, replies: list[tuple[int, int, int, bytes]], buckets: int):
        self.flat = [np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) for _, _, n, bits in sorted(replies)]
        counts = np.zeros(buckets, np.int64)
        for b, _, n, _ in replies:
            counts[b] += n
        self.flat = np.concatenate(self.flat) if self.flat else np.zeros(0, bool)
        self.next, self.buckets = np.cumsum(counts) - counts, buckets

    def of(self, h: np.ndarray) -> np.ndarray:
        bucket, _ = _keyed(h, self.buckets)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
        found = self.flat[self.next[bucket] + rank]
        self.next += counts
        return found


def multikey_order(rows: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes, ties by `last`; and which rows, in that order, begin a run of equals.

    Sorts by the leading token of 8 bytes, and what is tied by the next one.
    """
    n, width = rows.shape
    tokens = np.zeros((n, -(-width // 8) * 8), np.uint8)
    tokens[:, :width] = rows
    tokens = tokens.view(">u8").astype(np.uint64)
    order = np.argsort(tokens[:, 0], kind="stable") if n else np.zeros(0, np.int64)
    head = np.ones(n, bool)
    head[1:] = tokens[order[1:], 0] != tokens[order[:-1], 0]
    for depth in range(1, tokens.shape[1] + 1):
        tied = np.flatnonzero(~head | np.append(~head[1:], False))
        if not len(tied):
            break
        run, rest = np.cumsum(head)[tied], order[tied]
        if depth == tokens.shape[1]:
            order[tied] = rest[np.lexsort((last[rest], run))]
            break
        value = tokens[rest, depth]
        moved = np.lexsort((value, run))
        order[tied] = rest[moved]
        value, same = value[moved], np.zeros(len(tied), bool)
        same[1:] = (run[1:] == run[:-1]) & (value[1:] == value[:-1])
        head[tied] = ~same
    return order, head


def _later(order: np.ndarray, head: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """In that order, the rows of a run whose document isn't the run's smallest."""
    mine = ids[order]
    return mine > np.repeat(mine[head], np.diff(np.append(np.flatnonzero(head), len(order)))) if len(order) else np.zeros(0, bool)


def _contexts(raw: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """A row for each anchor: its suffix, the bytes before it from right to left, and how long both are."""
    reach = n - _gram_bytes(n)
    right, left = hi + n - a, a - lo
    out = np.zeros((len(a), n + reach + 2), np.uint8)
    to = np.arange(n)
    inside = to < right[:, None]
    out[:, :n][inside] = raw[(a[:, None] + to)[inside]]
    to = np.arange(reach)
    inside = to < left[:, None]
    out[:, n : n + reach][inside] = raw[(a[:, None] - 1 - to)[inside]]
    out[:, -2], out[:, -1] = right, left
    return out


def _row_type(width: int) -> str:
    return f"S{width}"


def _send_suffixes(part: int, pairs: Iterator, n: int, buckets: int, splitters: np.ndarray, blocks: int) -> Iterator[tuple]:
    """(bucket, part, how many, rows, ids, starts, lengths of the runs of windows); without rows what is decided already."""
    again, base, held, size = None, 0, [], 0

    def sent():
        rows, ids, lo, more = (np.concatenate(x) for x in zip(*held, strict=True))
        order, head = multikey_order(rows, ids)
        later = _later(order, head, ids)
        gone, order = order[later], order[~later]
        yield from _decided(part, lo[gone], more[gone] + 1, len(splitters) + 1, blocks)
        rows = np.ascontiguousarray(rows[order])
        ends = np.searchsorted(rows.view(_row_type(rows.shape[1])).ravel(), splitters, "right")
        for b, at in enumerate(np.split(np.arange(len(order)), ends)):
            if len(at):
                yield b, part, len(at), _pack(rows[at]), _pack(ids[order[at]]), _pack(lo[order[at]]), _pack((more[order[at]] + 1).astype(np.int32)), None

    def docs():
        nonlocal again
        for (i, text), reply in pairs:
            if again is None:
                again = _Again(reply, buckets)
            yield i, text

    for ids, lengths, raw in _chunks(docs()):
        a, lo, hi, h = _anchors(raw, lengths, n)
        open_ = again.of(h)
        a, lo, hi = a[open_], lo[open_], hi[open_]
        who = np.array([NO_ID if i is None else i for i in ids], np.int64)[np.searchsorted(np.cumsum(lengths), a, "right")]
        for i in range(0, len(a), HELD_SUFFIXES):
            s = slice(i, i + HELD_SUFFIXES)
            held.append((_contexts(raw, a[s], lo[s], hi[s], n), who[s], base + lo[s], (hi - lo)[s]))
            size += len(a[s])
            if size >= HELD_SUFFIXES:
                yield from sent()
                held, size = [], 0
        base += len(raw)
    if size:
        yield from sent()


def _decided(part: int, lo: np.ndarray, count: np.ndarray, first: int, blocks: int) -> Iterator[tuple]:
    """Runs of repeated windows, in blocks that are dealt evenly over `blocks` buckets from `first` on."""
    for i in range(0, len(lo), HELD_SUFFIXES // 8):
        s = slice(i, i + HELD_SUFFIXES // 8)
        to = int(mix64(np.array([part * 1_000_003 + int(lo[i])], np.uint64))[0] % np.uint64(blocks))
        yield first + to, int(part), len(lo[s]), None, None, _pack(lo[s]), _pack(count[s].astype(np.int32)), None


_GRAMS = "bucket int, part int, turn int, n int, keys binary"
_REPLIES = "bucket int, part int, turn int, n int, bits binary"
#: Suffixes or windows of one part (or of `parts`, one each), their documents, and the starts and lengths of runs of windows.
_ROWS = "bucket int, part int, n int, rows binary, ids binary, lo binary, count binary, parts binary"
_FOUND = "part int, n int, lo binary, count binary"


def _rows(table: pa.Table) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _gathered(rows: list[tuple], width: int) -> tuple[np.ndarray, ...]:
    made = []
    for _, part, n, packed, ids, lo, count, parts in rows:
        of = np.full(n, part) if parts is None else _unpack(parts, n, np.int32).astype(np.int64)
        made.append((_unpack(packed, n, np.uint8, width), _unpack(ids, n, np.int64), _unpack(lo, n, np.int64), _unpack(count, n, np.int32).astype(np.int64), of))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def _shared(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with its other, from the start."""
    apart = rows != others
    return np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])


def _hashes(rows: np.ndarray) -> np.ndarray:
    n, width = rows.shape
    tokens = np.zeros((n, -(-width // 8) * 8), np.uint8)
    tokens[:, :width] = rows
    tokens = tokens.view("<u8")
    h = np.zeros(n, np.uint64)
    for j in range(tokens.shape[1]):
        h = mix64(h ^ tokens[:, j]) * np.uint64(_BASE)
    return h


def _again_in(h: np.ndarray) -> np.ndarray:
    order = np.argsort(h)
    equal = np.concatenate(([False], h[order][1:] == h[order][:-1], [False]))
    out = np.zeros(len(h), bool)
    out[order] = equal[1:] | equal[:-1]
    return out


def _sort_suffixes(sent: pa.Table, n: int, splitters: np.ndarray, windows: int, blocks: int) -> pa.Table:
    """Step 2 in one bucket: runs of repeated windows, and those windows that may be repeated in another bucket."""
    rows = _rows(sent)
    b = rows[0][0]
    if rows[0][3] is None:
        return _table([(windows + b - len(splitters) - 1, *r[1:]) for r in rows], _ROWS)
    reach = n - _gram_bytes(n)
    context, ids, lo, count, part = _gathered(rows, n + reach + 2)
    order, head = multikey_order(context, ids)
    later = _later(order, head, ids)
    gone = order[later]
    found = [(part[gone], lo[gone], count[gone])]
    # prefixes that distinct neighbours share; the splitters around the bucket bound those of the suffixes beyond it
    suffix = context[order, :n]
    first = np.flatnonzero(head)
    between = _shared(suffix[first[1:]], suffix[first[:-1]])
    beyond = np.zeros(len(order), np.int64)
    for i in (b - 1, b):
        if 0 <= i < len(splitters):
            beyond = np.maximum(beyond, _shared(suffix, np.frombuffer(bytes(splitters[i]).ljust(n, b"\0")[:n], np.uint8)[None]))
    most = np.maximum(np.maximum(np.append(0, between), np.append(between, 0))[np.cumsum(head) - 1], beyond)[~later]
    beyond, order = beyond[~later], order[~later]
    # a window that starts o bytes before its anchor needs n - o bytes of the suffix
    left = context[order, -1].astype(np.int64)
    low = np.maximum(left - count[order] + 1, n - most)
    out = []
    for o in range(reach + 1):
        some = np.flatnonzero((low <= o) & (o <= left))
        at = order[some]
        window = np.concatenate((context[at, n : n + o][:, ::-1], context[at, : n - o]), axis=1)
        h = _hashes(window)
        out_of = beyond[some] >= n - o
        look = np.flatnonzero(_again_in(h) | out_of)
        at, window, h, out_of = at[look], window[look], h[look], out_of[look]
        sort, heads = multikey_order(window, ids[at])
        late = _later(sort, heads, ids[at])
        gone = at[sort[late]]
        found.append((part[gone], lo[gone] + _left(context, gone) - o, np.ones(len(gone), np.int64)))
        rest = sort[~late]
        rest = rest[out_of[rest]]
        start = lo[at] + _left(context, at) - o
        for to, these in _cut((h[rest] % np.uint64(windows)).astype(np.int64)):
            these = rest[these]
            out.append((to, -1, len(these), _pack(window[these]), _pack(ids[at[these]]), _pack(start[these]), _pack(np.ones(len(these), np.int32)), _pack(part[at[these]].astype(np.int32))))
    part, lo, count = (np.concatenate(x) for x in zip(*found, strict=True))
    for p, these in _cut(part):
        out += _decided(p, lo[these], count[these], windows, blocks)
    return _table(out, _ROWS)


def _left(context: np.ndarray, at: np.ndarray) -> np.ndarray:
    return context[at, -1].astype(np.int64)


def _sort_windows(sent: pa.Table, n: int) -> pa.Table:
    """Step 3 in one bucket: only what is repeated."""
    rows = _rows(sent)
    if rows[0][3] is None:
        return _table([(part, n, lo, count) for _, part, n, _, _, lo, count, _ in rows], _FOUND)
    window, ids, lo, count, part = _gathered(rows, n)
    order, head = multikey_order(window, ids)
    gone = order[_later(order, head, ids)]
    return _table([(p, len(at), _pack(lo[gone[at]]), _pack(count[gone[at]].astype(np.int32))) for p, at in _cut(part[gone])], _FOUND)


def _removed(pairs: Iterator, n: int) -> Iterator[tuple]:
    """id, n_bytes, n_removed, spans, kept of each document of a part."""
    lo = end = None

    def docs():
        nonlocal lo, end
        for (i, text), reply in pairs:
            if lo is None:
                lo = np.concatenate([np.zeros(0, np.int64), *(_unpack(a, k, np.int64) for k, a, _ in reply)])
                end = lo + np.concatenate([np.zeros(0, np.int64), *(_unpack(c, k, np.int32).astype(np.int64) for k, _, c in reply)]) - 1 + n
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], end[order]
            yield i, text

    base = 0
    for ids, lengths, raw in _chunks(docs()):
        a, b = np.searchsorted(lo, (base, base + len(raw)))
        steps = np.zeros(len(raw) + 1, np.int64)
        np.add.at(steps, lo[a:b] - base, 1)
        np.add.at(steps, end[a:b] - base, -1)
        gone = np.cumsum(steps[:-1]) > 0
        stop = np.cumsum(lengths)
        for i, s, e in zip(ids, stop - lengths, stop, strict=True):
            mine = gone[s:e]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8)))
            yield i, int(e - s), int(mine.sum()), [(int(x), int(y)) for x, y in edges.reshape(-1, 2)], bytearray(raw[s:e][~mine].tobytes())
        base += len(raw)


def _met(rows, replies: DataFrame, columns: list[str], counts: dict[int, int]):
    """Rows of each partition, the first with all replies to it, the others with None."""

    def first(part: int, got: Iterator) -> Iterator:
        all_ = [tuple(r) for r in got]
        if part in counts.value:
            yield all_
            for _ in range(counts.value[part] - 1):
                yield None

    counts = replies.sparkSession.sparkContext.broadcast(counts)
    dealt = replies.repartitionById(rows.getNumPartitions(), "part").select(*columns).rdd.map(tuple)
    return rows.zip(dealt.mapPartitionsWithIndex(first))


def suffix_dedup(docs: DataFrame, n: int = 50, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (start and end of the removed runs, in bytes), kept (the other bytes).

    n: bytes of a string. most: suffixes a bucket may hold; by default a 4,096th of all, between 2^18 and 2^22.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    rows = base.rdd.map(tuple)
    if not rows.getNumPartitions():
        return spark.createDataFrame([], schema)
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    anchors = 2 * total // (n - _gram_bytes(n) + 2) + 1
    most = most or int(min(max(anchors // 4096, 1 << 18), 1 << 22))
    buckets = anchors // most + 1
    blocks, windows = buckets, buckets

    sent = rows.mapPartitionsWithIndex(lambda i, it: _send_grams(i, it, n, buckets))
    grams = spark.createDataFrame(sent, _GRAMS, verifySchema=False)
    replies = save(grams.groupBy("bucket").applyInArrow(_twice, _REPLIES))
    counts = {r["part"]: r["n"] for r in replies.where("turn = -1").select("part", "n").collect()}

    splitters = _splitters(base, n, buckets, anchors)
    pairs = _met(rows, replies.where("turn >= 0"), ["bucket", "turn", "n", "bits"], counts)
    sent = pairs.mapPartitionsWithIndex(lambda i, it: _send_suffixes(i, it, n, buckets, splitters, blocks))
    suffixes = spark.createDataFrame(sent, _ROWS, verifySchema=False)
    found = suffixes.groupBy("bucket").applyInArrow(lambda sent: _sort_suffixes(sent, n, splitters, windows, blocks), _ROWS)
    found = save(found.groupBy("bucket").applyInArrow(lambda sent: _sort_windows(sent, n), _FOUND))

    pairs = _met(rows, found, ["n", "lo", "count"], counts)
    return spark.createDataFrame(pairs.mapPartitions(lambda it: _removed(it, n)), schema, verifySchema=False)


#: Sampled suffixes for each splitter, and the share of a sampled document's suffixes.
SAMPLES, SHARE = 32, 16


def _splitters(base: DataFrame, n: int, buckets: int, anchors: int) -> np.ndarray:
    """Up to buckets - 1 contexts, ascending, that cut a sample of all suffixes evenly."""
    docs = min(1.0, SAMPLES * SHARE * buckets / anchors)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        for i, (_, lengths, raw) in enumerate(_chunks(rows())):
            a, lo, hi, _ = _anchors(raw, lengths, n)
            at = np.flatnonzero(mix64(np.arange(len(a)).astype(np.uint64) + np.uint64(i << 32)) % np.uint64(SHARE) == 0)
            made = _contexts(raw, a[at], lo[at], hi[at], n)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in made], pa.binary())], names=["row"])

    if buckets == 1:
        return np.zeros(0, _row_type(1))
    got = sorted(bytes(r["row"]) for r in base.sample(docs, seed=1).select("id", "text").mapInArrow(sample, "row binary").collect())
    cuts = sorted({got[i * len(got) // buckets] for i in range(1, buckets)}) if got else []
    return np.array(cuts, _row_type(2 * n))
