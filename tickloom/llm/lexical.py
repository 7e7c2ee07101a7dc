"""Ranked lexical search: each item's best documents by integer impacts, postings processed score at a time.

Terms are runs of letters, digits and all that isn't ASCII, only A-Z lower-cased. One pass over the documents makes the index: for each
document its number of terms, and which of the items' terms it holds how often. Document frequencies, the number of documents and of
all terms are counted over the whole index. Then every task takes its documents in segments. In a segment the postings of a
term lie by exact impact, highest first, and an item reads those of all its terms downwards, level by level, adding up scores. It stops
once what unread postings can add at most is below the k-th best score so far, of this segment or an earlier one of the task: then no unseen
document can enter, and documents whose score with that bound reaches the k-th are completed from the index and ranked. Each task
returns k documents an item at most; of these the best are the result.

Items are taken in blocks of bounded text (BLOCK_BYTES), whose terms every task gets; more items are more blocks, each a pass.

Defined cases. Null texts have no terms; an item without terms, or whose terms no document holds, has no row. Scores of 0 don't count. Documents
may repeat an id: each row is ranked, in any order among themselves; a null id comes after all ids of an equal score. Items are distinct pairs of id and text: rows that repeat both are one item. An
empty table gives an empty result; other columns are ignored. Document ids are integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import save
from .words import run_hashes

NO_ID = np.iinfo(np.int64).max
BLOCK_BYTES, CHUNK_BYTES, SEGMENT_POSTINGS = 16 << 20, 2 << 20, 1 << 21

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    _, starts, ends = run_hashes(raw, ~_TERM)
    return [raw[a:b].lower() for a, b in zip(starts, ends, strict=True)]  # bytes: only A-Z change


def _eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place of raw (which has 8 more at its end) as one number."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))


class Vocabulary:
    """Terms of a block of items, found in texts by hash and confirmed by their bytes."""

    def __init__(self, items: list[list[bytes]]):
        self.terms = sorted({t for item in items for t in item})
        joined = b" ".join(self.terms)
        h, starts, ends = run_hashes(joined, ~_TERM)
        self.order = np.argsort(h)
        self.h, self.lengths = h[self.order], (ends - starts)[self.order]
        if len(self.h) > 1 and (self.h[1:] == self.h[:-1]).any():
            raise ValueError("two terms have one hash")
        self.first, self.last = self._ends(np.frombuffer(joined + b"\0" * 8, np.uint8), starts, ends)
        self.first, self.last = self.first[self.order], self.last[self.order]
        at = {t: i for i, t in enumerate(self.terms)}
        self.items = []
        for item in items:
            counts = Counter(at[t] for t in item)
            self.items.append((np.array(sorted(counts), np.int64), np.array([counts[t] for t in sorted(counts)], np.int64)))

    @staticmethod
    def _ends(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first eight bytes of each term (fewer if it is shorter) and the last ones (0 if there are no others)."""
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        eights, size = _eights(raw), ends - starts
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(size, 8).astype(np.uint64)))
        return eights[starts] & keep, np.where(size > 8, eights[np.maximum(ends - 8, 0)], np.uint64(0))

    def found(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte of every term of text; which of those are in the vocabulary, and as what."""
        h, starts, ends = run_hashes(text, ~_TERM, lower=True)
        if not len(self.h) or not len(h):
            return starts, np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = np.flatnonzero((self.h[at] == h) & (self.lengths[at] == ends - starts))
        at = at[hit]
        lower = np.frombuffer(text.lower() + b"\0" * 8, np.uint8)
        first, last = self._ends(lower, starts[hit], ends[hit])
        same = (first == self.first[at]) & (last == self.last[at])
        for i in np.flatnonzero(same & (self.lengths[at] > 16)):
            same[i] = text[starts[hit[i]] : ends[hit[i]]].lower() == self.terms[self.order[at[i]]]
        return starts, hit[same], self.order[at[same]]


def _index(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """id, n (terms with repeats), term and tf (of the vocabulary, ascending) of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    def made(ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        starts, hit, term = shared.value.found(b"\n".join(texts))
        owner = np.searchsorted(begin, starts, "right") - 1
        n = np.bincount(owner, minlength=len(texts))
        width = len(shared.value.terms) + 1
        pairs, tf = np.unique(owner[hit] * width + term, return_counts=True)
        of = pairs // width
        some = np.flatnonzero(n)
        per = np.bincount(of, minlength=len(texts))[some]
        offsets = np.concatenate(([0], np.cumsum(per)))
        id_ = pa.array([ids[i] for i in some], pa.int64())
        return pa.RecordBatch.from_arrays([id_, pa.array(n[some], pa.int64()), lists(offsets, pairs % width), lists(offsets, tf)], names=["id", "n", "term", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                ids.append(i), texts.append(raw)
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield made(ids, texts)

    return save(docs.mapInArrow(run, "id long, n long, term array<int>, tf array<int>"))


def _frequencies(index: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(df[has])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in index.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class Segment:
    """Postings of some documents, of each term by falling impact."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, per: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, total: int):
        sizes, back = np.unique(n, return_inverse=True)
        m = np.array([25 + 75 * int(x) * docs // total for x in sizes], np.int64)[back]
        self.ids, self.offsets, self.terms = ids, np.concatenate(([0], np.cumsum(per))), term
        doc = np.repeat(np.arange(len(ids)), per)
        self.impacts = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((-self.impacts, term))
        self.doc, self.impact = doc[order], self.impacts[order]
        self.starts = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.score = np.zeros(len(ids), np.int64)

    def best(self, item: np.ndarray, times: np.ndarray, k: int, floor: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of the k highest scores (ties all kept) that reach floor, their scores, and how many postings were read.

        wanted: zeros for every term, given back as zeros.
        """
        at, end = self.starts[item].copy(), self.starts[item + 1]
        self.score[:] = 0
        score, read, kth, seen = self.score, 0, floor, np.zeros(0, np.int64)
        while True:
            open_ = np.flatnonzero(at < end)
            heads = self.impact[at[open_]] * times[open_]
            rest = int(heads.sum())
            if rest < max(kth, 1) or not len(open_):
                break
            level = max(1, int(heads.max()) * 5 // 8)  # every exact impact from the highest down to here
            for j in open_[heads >= level]:
                mine = self.impact[at[j] : end[j]]
                upto = at[j] + len(mine) - np.searchsorted(mine[::-1], -(-level // int(times[j])), "left")
                score[self.doc[at[j] : upto]] += self.impact[at[j] : upto] * times[j]  # a document is once in a term's postings
                read += int(upto - at[j])
                at[j] = upto
            seen = np.flatnonzero(score)
            if len(seen) >= k:
                kth = max(kth, int(np.partition(score[seen], len(seen) - k)[len(seen) - k]))
        # what may still be among the k: completed from the documents' own terms
        some = seen[score[seen] + rest >= max(kth, 1)]
        wanted[item] = times
        per = self.offsets[some + 1] - self.offsets[some]
        flat = np.repeat(self.offsets[some] - np.cumsum(per) + per, per) + np.arange(per.sum())
        full = np.zeros(len(some), np.int64)
        np.add.at(full, np.repeat(np.arange(len(some)), per), self.impacts[flat] * wanted[self.terms[flat]])
        wanted[item] = 0
        if len(full) > k:
            kth = max(kth, int(np.partition(full, len(full) - k)[len(full) - k]))
        top = (full >= kth) & (full > 0)
        return some[top], full[top], read


def _ranked(index: DataFrame, vocabulary: Vocabulary, weight: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    """item, id, score: for each task the k best documents of every item."""
    shared = index.sparkSession.sparkContext.broadcast((vocabulary.items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        top: list[list[tuple[int, int]]] = [[] for _ in items]
        wanted, held, size = np.zeros(len(weight), np.int64), [], 0

        def taken():
            segment = Segment(*(np.concatenate(x) for x in zip(*held, strict=True)), weight, docs, total)
            for i, (item, times) in enumerate(items):
                full = len(top[i]) == k
                found, score, _ = segment.best(item, times, k, -top[i][-1][0] if full else 0, wanted)
                if len(found):
                    top[i] = sorted([*top[i], *zip((-score).tolist(), segment.ids[found].tolist(), strict=True)])[:k]

        for batch in batches:
            if not len(batch):
                continue
            terms_ = batch.column(2)
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            held.append((ids, batch.column(1).to_numpy(), np.diff(terms_.offsets.to_numpy()), terms_.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy().astype(np.int64)))
            size += len(held[-1][3])
            if size >= SEGMENT_POSTINGS:
                taken()
                held, size = [], 0
        if held:
            taken()
        rows = [(i, None if d == NO_ID else d, -s) for i, best in enumerate(top) for s, d in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "id", "score"])

    return index.select("id", "n", "term", "tf").mapInArrow(run, "item int, id long, score long")


def weights(docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 docs + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _block(docs: DataFrame, rows: list[Row], k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = [(r, t) for r in rows if (t := terms(r["text"]))]
    items = spark.createDataFrame([(i, r["id"]) for i, (r, _) in enumerate(rows)], "item int, item_id long")
    vocabulary = Vocabulary([t for _, t in rows])
    index = _index(docs, vocabulary)
    count, total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = weights(count, _frequencies(index, len(vocabulary.terms)))
    best = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    found = _ranked(index, vocabulary, weight, count, max(1, total), k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.join(F.broadcast(items), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item, all of those above 0 if there are fewer."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        if any(terms(r["text"]) for r in rows):
            part = _block(base, rows, k)
            found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
