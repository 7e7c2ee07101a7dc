"""BPE encoding and decoding: speculate and verify.

Each pre-token is first cut greedily into the longest entries of the vocabulary. The cut is the result of the merges if and
only if every entry is what the merges make of its own bytes and no merge crosses the border of two neighbours. Borders
are checked for all new pre-tokens at once with NumPy: both sides are unrolled, latest merge first, and a merge that joins
them before either side is used up refutes the cut. Only pre-tokens with a refuted border are merged exactly.

Defined cases. A null text counts as empty and has no tokens. Strings of special tokens inside a text become that token, as in
the tokenizers library. Texts of any length are cut into pieces at safe places, so memory doesn't grow with them.
Repeated rows are encoded alike; an empty table gives an empty result; other columns are returned only if named in `keep`.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import map_arrow

# The pre-token pattern of byte-level BPE, and its visible characters for the 256 bytes.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

PIECE_CHARS = 1 << 20
#: Words of so many bytes are merged by scanning; of so many words the tokens are remembered, and as many from before.
SHORT_WORD, CACHED_WORDS = 64, 300_000
_SAFE_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def _byte_of_char() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(_PLAIN_BYTES)]
    return {chr(b): b for b in _PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}


def _unsettled() -> frozenset[str]:
    """Letters and digits that the regex module knows and Python's own tables don't: library versions disagree on them."""
    known = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)])))
    return frozenset(c for c in known if unicodedata.category(c) == "Cn")


class Vocabulary:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library.

    Inside, entries are numbered by age: 256 bytes, then one entry a merge. `ids` maps that to the vocabulary's ids.
    """

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take their surroundings aren't supported")
        byte_of = _byte_of_char()
        to_bytes = lambda s: bytes(byte_of[c] for c in s)
        char_of = {b: c for c, b in byte_of.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.entries = [bytes([b]) for b in range(256)]
        names = [char_of[b] for b in range(256)]
        index = {c: i for i, c in enumerate(names)}
        left, right = [-1] * 256, [-1] * 256
        for a, b in pairs:
            if a + b in index:
                raise ValueError("two merges make the same entry")
            left.append(index[a])
            right.append(index[b])
            index[a + b] = len(names)
            names.append(a + b)
            self.entries.append(to_bytes(a + b))
        self.size = len(names)
        self.left, self.right = np.array(left), np.array(right)
        self.ids = np.array([model["vocab"][x] for x in names], dtype="<u4")
        keys = self.left[256:] * self.size + self.right[256:]
        order = np.argsort(keys)
        self.keys, self.made = keys[order], order + 256
        self.merge = {(a, b): 256 + i for i, (a, b) in enumerate(zip(left[256:], right[256:], strict=True))}
        self.number = {x: i for i, x in enumerate(self.entries)}
        # for each three bytes the lengths of the entries that start with them, longest first
        lengths: dict[bytes, set[int]] = {}
        for x in self.entries:
            if len(x) > 2:
                lengths.setdefault(x[:3], set()).add(len(x))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.sound: dict[int, bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        by_id = {int(i): x for i, x in zip(self.ids, self.entries, strict=True)} | {i: x.encode() for x, i in self.special.items()}
        self.by_id = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.raw, self._library, self._odd = raw, None, _unsettled()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # -- speculate
    def greedy(self, word: bytes) -> list[int]:
        get, lengths, out, i, n = self.number.get, self.lengths, [], 0, len(word)
        while i < n:
            for k in lengths.get(word[i : i + 3], ()):
                if i + k <= n and (t := get(word[i : i + k])) is not None:
                    break
            else:
                k = 2 if i + 1 < n else 1
                if (t := get(word[i : i + k])) is None:
                    k, t = 1, word[i]
            out.append(t)
            i += k
        return out

    # -- verify
    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border between entry a and entry b, for many pairs at once."""
        end = self.size
        x, y = a.copy(), b.copy()
        used_x, used_y = np.full(len(a), end), np.full(len(a), end)
        fine, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(live):
            p, q = x[live], y[live]
            k = p * end + q
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            m = np.where(self.keys[at] == k, self.made[at], end)
            # of equal merges the leftmost goes first: so x's own merge wins a tie, y's loses it
            crossed = (m < used_x[live]) & (m <= used_y[live]) & (m < end)
            fine[live[crossed]] = False
            live = live[~crossed & (np.maximum(p, q) >= 256)]
            p, q = x[live], y[live]
            older = p > q
            lx, ly = live[older], live[~older]
            used_x[lx] = x[lx]
            x[lx] = self.right[x[lx]]
            used_y[ly] = y[ly]
            y[ly] = self.left[y[ly]]
        return fine

    def _is_sound(self, t: int) -> bool:
        if t not in self.sound:
            self.sound[t] = self.exact(self.entries[t]) == [t]
        return self.sound[t]

    # -- repair
    def exact(self, word: bytes) -> list[int]:
        """Merge by age, leftmost first."""
        tokens, n = list(word), len(word)
        if n < 2:
            return tokens
        if n <= SHORT_WORD:
            return self._exact_short(tokens)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        merge = self.merge
        heap = [(m, i) for i in range(n - 1) if (m := merge.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j < 0 or merge.get((tokens[i], tokens[j])) != m:
                continue
            tokens[i], tokens[j] = m, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (k := merge.get((m, tokens[after[i]]))) is not None:
                    heapq.heappush(heap, (k, i))
            if before[i] >= 0 and (k := merge.get((tokens[before[i]], m))) is not None:
                heapq.heappush(heap, (k, before[i]))
        return [t for t in tokens if t >= 0]

    def _exact_short(self, tokens: list[int]) -> list[int]:
        """As exact(): a scan for the oldest merge of a few pairs is faster than a heap."""
        get, none = self.merge.get, self.size
        made = [get(pair, none) for pair in pairwise(tokens)]
        while made and (m := min(made)) < none:
            i = made.index(m)
            tokens[i] = m
            del tokens[i + 1], made[i]
            if i < len(made):
                made[i] = get((m, tokens[i + 1]), none)
            if i:
                made[i - 1] = get((tokens[i - 1], m), none)
        return tokens

    def encode_words(self, words: Sequence[bytes]) -> list[list[int]]:
        guesses = [self.greedy(w) for w in words]
        flat = np.fromiter((t for g in guesses for t in g), dtype=np.int64)
        if not len(flat):
            return guesses
        owner = np.repeat(np.arange(len(guesses)), [len(g) for g in guesses])
        inner = np.nonzero(owner[1:] == owner[:-1])[0]
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)[back]
        wrong = set(owner[inner[~fine]].tolist())
        unsound = [t for t in np.unique(flat).tolist() if not self._is_sound(t)]
        if unsound:
            wrong |= set(owner[np.isin(flat, unsound)].tolist())
        for i in wrong:
            guesses[i] = self.exact(words[i])
        return guesses

    # -- texts
    def _split(self, text: str) -> list[str]:
        if not text.isascii() and not self._odd.isdisjoint(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_str(self.raw).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return _PRE_TOKEN.findall(text)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.special_pattern.split(text) if self.special_pattern else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            for piece in pieces(part):
                words = self._split(piece)
                if len(self.words) > CACHED_WORDS:
                    self.words, self.older = {}, self.words
                cache, older = self.words, self.older
                new = [w for w in set(words) if w not in cache]
                if older:
                    cache.update((w, older[w]) for w in new if w in older)
                    new = [w for w in new if w not in cache]
                if new:
                    for w, tokens in zip(new, self.encode_words([w.encode() for w in new]), strict=True):
                        cache[w] = self.ids[tokens].tobytes()
                out += map(cache.__getitem__, words)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


_PRE_TOKEN = regex.compile(PRE_TOKEN)


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces that have the same pre-tokens: cut before a single space between two letters."""
    start = 0
    while len(text) - start > most and (cut := _SAFE_CUT.search(text, start + most)):
        yield text[start : cut.start()]
        start = cut.start()
    if start < len(text):
        yield text[start:]


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(raw: str) -> Vocabulary:
    """One a worker process."""
    if hash(raw) not in _loaded:
        _loaded.clear()
        _loaded[hash(raw)] = Vocabulary(raw)
    return _loaded[hash(raw)]


def _with_columns(df: DataFrame, keep: Sequence[str], made: str, fields: Sequence[T.StructField], source: str, function) -> DataFrame:
    """df's columns `keep`, then what function makes of each value of `source`; a few MB a batch."""
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, made_rows = 0, 0, []
            values = batch.column(len(keep))
            for i, value in enumerate(values):
                made_rows.append(function(value.as_py()))
                size += sum(len(x) for x in made_rows[-1] if isinstance(x, (bytes, str)))
                if size > 4 << 20 or i + 1 == len(values):
                    columns = [pa.array(c, type=t) for c, t in zip(zip(*made_rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, i + 1 - start) for k in range(len(keep))), *columns], names=schema.names)
                    start, size, made_rows = i + 1, 0, []

    arrow = {T.BinaryType(): pa.binary(), T.StringType(): pa.string(), T.LongType(): pa.int64()}
    types = [arrow[f.dataType] for f in fields]
    return map_arrow(df.select(*keep, source), run, schema)


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The columns `keep`, n_tokens, ids (binary: little-endian unsigned 32-bit integers) and, if wanted, the text decoded from them.

    vocabulary: path of the JSON file on the driver; its content (a few MB, whatever the corpus) is broadcast. Columns in `keep`
    with one of the names above are an error.
    """
    if clash := {"n_tokens", "ids", "decoded"} & set(keep):
        raise ValueError(f"can't keep columns named {sorted(clash)} beside the result's own")
    with open(vocabulary, encoding="utf-8") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def function(text: str | None) -> tuple:
        v = _vocabulary(raw.value)
        ids = v.encode(text or "")
        return (len(ids) // 4, ids, v.decode(ids)) if decoded else (len(ids) // 4, ids)

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.StringType())] if decoded else [])]
    return _with_columns(docs, keep, "ids", fields, text_col, function)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and text, the inverse of encode()."""
    with open(vocabulary, encoding="utf-8") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())
    return _with_columns(encoded, keep, "text", [T.StructField("text", T.StringType())], ids_col, lambda ids: (_vocabulary(raw.value).decode(ids or b""),))


def digest(encoded: DataFrame) -> DataFrame:
    """encode()'s columns with SHA-256 of the ids and of the decoded text in their place."""
    rest = [c for c in encoded.columns if c not in ("ids", "decoded")]
    return encoded.select(*rest, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
