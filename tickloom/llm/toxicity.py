"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels alone.

A sentence scores p = sigmoid(bias + the weights of its distinct words and of their stems: their first 3 to 8 letters, so that forms
of one word are learned together); a document scores 1 - product of (1 - p) over its distinct
sets of words: sentences that repeat count once, in fitting and in scoring. The gradient of
the document's log-likelihood reaches each sentence in proportion to its own share of the blame, so the sentences that offend are
found without sentence labels: offending_sentences() returns them.

The model is fitted in one task on a bounded sample (SAMPLE_ROWS labelled rows, the smallest by a hash of their ids, and
SAMPLE_BYTES of text, without texts of more than a 16th of that). Words and stems that fewer than MIN_DOCUMENTS of them hold, or
whose documents are toxic less than LIFT times as often as all, have no weight. Each round of fitting leaves out a share of the words and
stems (DROPOUT), always the same ones, so that a word learns its part even where others beside it explain the documents already.
Every text is scored whole.

Defined cases. A null or empty text has no sentences: its score is the score of one empty sentence. Without labelled rows all
scores are 0. Repeated rows score alike; of labels that repeat an id the largest counts. Rows with a null id are scored,
never learned from, and not held out. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import warnings
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import map_arrow

SAMPLE_ROWS, SAMPLE_BYTES, MIN_DOCUMENTS = 6000, 64 << 20, 4
LONGEST_SHARE = 16
LIFT, STEMS = 2.0, range(3, 9)
CACHED_WORDS = 300_000
EPOCHS, RATE, SPARSITY, DROPOUT = 200, 0.1, 1e-4, 0.3
_SENTENCE = regex.compile(r"[^.!?\n]+")
_WORD = regex.compile(r"[\p{L}\p{M}']+")


def _sentences(text: str | None) -> Iterator[tuple[int, str]]:
    return ((m.start(), m[0]) for m in _SENTENCE.finditer(text or ""))


def _words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def _features(word: str) -> list[str]:
    """The word, and its stems marked with ^, which no word holds."""
    return [word, *("^" + word[:k] for k in STEMS if k < len(word))]


class _Lookup(dict):
    """word -> which of its features are known; forgets when it grows too large."""

    def __init__(self, known):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = tuple(f for f in _features(word) if f in self.known)
        return found

    def of(self, bag) -> set[str]:
        return {f for w in bag for f in self[w]}


def fit(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Weights of words and stems, and the bias under the empty word, from (text, label) rows: Adam on the noisy-or likelihood with dropout, soft-thresholded."""
    held, seen, bad = [], Counter(), Counter()
    # a word is held once, and a sentence as the numbers of its words
    number: dict[str, int] = {}
    for text, label in rows:
        bags = {frozenset(_words(s)) for _, s in _sentences(text)} or {frozenset()}
        held.append([array("i", [number.setdefault(w, len(number)) for w in bag]) for bag in bags])
        found = {f for w in frozenset().union(*bags) for f in _features(w)}
        seen.update(found)
        if label:
            bad.update(found)
    least = LIFT * sum(label for _, label in rows) / max(1, len(rows))
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= MIN_DOCUMENTS and bad[f] >= least * n))}
    del seen, bad
    words, lookup = list(number), _Lookup(vocabulary)
    sentence, feature, owner = array("q"), array("q"), array("q")
    for d, bags in enumerate(held):
        for bag in bags:
            found = [vocabulary[f] for f in lookup.of(words[k] for k in bag)]
            sentence.extend([len(owner)] * len(found))
            feature.extend(found)
            owner.append(d)
    sentence, feature, owner = (np.frombuffer(x, dtype=np.int64) for x in (sentence, feature, owner))
    del held, number, words, lookup
    y = np.array([label for _, label in rows], dtype=float)
    w = np.zeros(len(vocabulary) + 1)
    w[-1] = -5.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    drawn = np.random.default_rng(0)
    for step in range(1, EPOCHS + 1):
        stays = drawn.random(len(vocabulary)) >= DROPOUT
        z = np.bincount(sentence, weights=(w[:-1] * stays)[feature], minlength=len(owner)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)))
        pull = np.where(y[owner] > 0, p * (clean / np.maximum(1 - clean, 1e-9))[owner], -p)
        g = np.append(np.bincount(feature, weights=pull[sentence], minlength=len(vocabulary)) * stays, pull.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        size = RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        w += size * m / (1 - 0.9**step)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - size[:-1] * SPARSITY, 0)
    return {word: float(w[i]) for word, i in vocabulary.items() if w[i]} | {"": float(w[-1])}


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> dict[str, float]:
    """The model; labels of rows that are held out are not read."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lengths = texts.select("id", F.octet_length("text").alias("n"), F.xxhash64("text").alias("th")).join(known, "id")
    # one long text doesn't keep out all that come after it
    drawn = lengths.where(F.col("n") <= size // LONGEST_SHARE).orderBy(F.xxhash64("id", F.lit(10)), "id", "th").limit(rows)
    # at most `rows` rows reach this window
    drawn = drawn.withColumn("upto", F.sum("n").over(W.orderBy(F.xxhash64("id", F.lit(10)), "id", "th").rowsBetween(W.unboundedPreceding, 0))).where(F.col("upto") <= size)
    chosen = drawn.select("id", "th", "y").distinct()
    sample = texts.withColumn("th", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "th"]).select("id", "y", "text").dropDuplicates(["id", "y", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r["id"], r["y"], r["text"]) for b in batches for r in b.to_pylist())
        model = fit([(text, y) for _, y, text in found]) if found else {}
        yield pa.RecordBatch.from_arrays([pa.array(list(model), pa.string()), pa.array(list(model.values()), pa.float64())], names=["word", "weight"])

    model = {r["word"]: r["weight"] for r in map_arrow(sample.coalesce(1), run, "word string, weight double").collect()}
    if not model and not lengths.isEmpty():
        warnings.warn(f"no labelled text has {size // LONGEST_SHARE} bytes or fewer: nothing is learned, all scores are 0", stacklevel=2)
    return model


class _Model:
    """A model ready to score: of each word the features that have a weight are looked up once."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.lookup = weights, _Lookup({f for f in weights if f})

    def sentence(self, bag) -> float:
        z = self.weights[""] + sum(self.weights[f] for f in sorted(self.lookup.of(bag)))
        return 1 / (1 + float(np.exp(-z))) if z > -700 else 0.0

    def text(self, text: str | None) -> float:
        """Score of a text, over the same sets of words that fit() sees."""
        if not self.weights:
            return 0.0
        clean = 1.0
        sentences = dict.fromkeys(s for _, s in _sentences(text))
        for bag in dict.fromkeys(frozenset(_words(s)) for s in sentences) or [frozenset()]:
            clean *= 1 - self.sentence(bag)
        return min(1.0, max(0.0, 1 - clean))


def score(docs: DataFrame, model: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document, nothing shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Model(shared.value)
        for batch in batches:
            made = [known.text(value.as_py()) for value in batch.column(2)]
            found = pa.array(made, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found, pa.array([int(x >= 0.5) for x in made], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_arrow(narrow, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def offending_sentences(docs: DataFrame, model: dict[str, float], least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start (code points), sentence and score of every sentence that scores at least `least` by itself."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "start", "sentence", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Model(shared.value)
        for batch in batches:
            at, starts, texts, scores = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                for start, s in _sentences(value.as_py()) if known.weights else []:
                    if (p := known.sentence(_words(s))) >= least:
                        at.append(i), starts.append(start), texts.append(s), scores.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(texts, pa.string()), pa.array(scores, pa.float64())], names=names)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_arrow(narrow, run, f"doc_id {kind}, start long, sentence string, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the model, trained on them and their labels, doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Model(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([known.text(value.as_py()) < 0.5 for value in batch.column(at)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
