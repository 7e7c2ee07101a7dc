"""MinHash near-dedup: signature-coordinate inverted join with prefix and skip merging, links confirmed on full shingle sets.

Documents with the same shingle set form one class. Each class has 64 MinHash coordinates, and is posted under each
coordinate-value pair. Values are ordered by how many classes share them, rarest first: two classes that agree in at least
`matches` coordinates must share a value among their first 64 - matches + 1 (the prefix), so only prefixes are posted, and
values of a frequent passage fall out of nearly all of them. A value that one class alone has is skipped.

Within a list all members are merged with one pivot; a pair that agrees in too few coordinates is skipped before its texts are
read. What is linked needs no further comparison, so a group of near copies costs a pair a member. Lists that then still hold classes
of different components are gone through in blocks of members, block against block, by sketches of 64 bytes; a block returns the
members that have a counterpart in another component, never the pairs. Those members meet once more in blocks with their texts: links are
confirmed there on full sets, and only links that join two components of a block leave it, so that output is linear in the members
however many pairs agree. A link that lies within a component already found is not looked for: components, not all pairs, are the result.

The number of matches asked for lies five standard deviations below what a pair at the threshold has on average: at Jaccard
0.85 that is 40 of 54.4 expected, which fewer than one pair in 10^5 misses.

Defined cases. A null or blank text has an empty set and links with nothing. A text with fewer words than a shingle
is one shingle. Rows that repeat an id are one node if their texts agree; with other texts each keeps its own set and the id
is shared by their components' smallest ids. A null id never represents a component that has an id. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import hot_keys, map_arrow, save, with_salt
from .components import components
from .words import mix64, shingles

COORDINATES = 64
#: Members of a block that is compared by sketches, and words of one that is compared by texts.
BLOCK, BLOCK_WORDS = 2048, 1 << 20
_SEEDS = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _ADDENDS = _SEEDS[:COORDINATES] | np.uint64(1), _SEEDS[COORDINATES:]


def matches_for(percent: int) -> int:
    """Coordinates that a pair at the threshold agrees in, less five standard deviations."""
    p = percent / 100
    return max(1, int(COORDINATES * p - 5 * (COORDINATES * p * (1 - p)) ** 0.5))


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest value of each of the 64 hashes over a set that isn't empty, 32 bits each; a few MB at a time."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        part = s[i : i + 4096]
        np.minimum(least, (part[None, :] * _FACTORS[:, None] + _ADDENDS[:, None]).min(axis=1), out=least)
    return (mix64(least) >> np.uint64(32)).astype("<u4")


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """id, th (hash of the text), n (set size), h1, h2 (the set's hash), sig (64 x 4 bytes), sketch (the lowest byte of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, a, b, sigs, sketches = [], [], [], [], []
            for value in batch.column(2):
                s = shingles(value.as_py(), n)
                sizes.append(len(s))
                a.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
                b.append(int(mix64(s ^ _SEEDS[0]).sum(dtype=np.uint64).view(np.int64)))
                sig = signature(s) if len(s) else None
                sigs.append(None if sig is None else sig.tobytes())
                sketches.append(None if sig is None else sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sketches, pa.binary())], names=["id", "th", "n", "h1", "h2", "sig", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs, run, f"id {kind}, th long, n long, h1 long, h2 long, sig binary, sketch binary")


def _posted(classes: DataFrame, prefix: int) -> DataFrame:
    """value, c: each class under the values of its prefix that other classes share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, COORDINATES).astype(np.uint64)
            values = mix64(sigs | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))[None, :]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), COORDINATES))], names=["value", "c"])

    posts = save(map_arrow(classes.select("c", "sig"), run, "value long, c long"))
    shared = posts.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # values that are not shared are the rarest: they take up the head of each prefix
    ranked = posts.join(shared, "value").select("c", F.struct("df", "value").alias("v"))
    lists = ranked.groupBy("c").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    taken = F.slice("vs", F.lit(1), F.greatest(F.lit(0), F.lit(prefix - COORDINATES) + F.size("vs")))
    return lists.select("c", F.explode(taken).alias("v")).select(F.col("v.value").alias("value"), "c")


def _beside_pivots(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """p, salt, c and held's columns of c: the members of each pivot p, dealt by pivot, after the pivot itself (c = p).

    A pivot with more than a 1,024th of all pairs is salted; there are fewer than 1,024 of these, so their table is small.
    """
    hot = hot_keys(pairs, "p")
    members = with_salt(pairs, hot, "p", "c")
    pivots = members.select("p", "salt").distinct().withColumn("c", F.col("p"))
    both = pivots.unionByName(members.select("p", "salt", "c")).join(held, "c")
    return both.repartition("p", "salt").sortWithinPartitions("p", "salt", F.col("c") != F.col("p"))


def _agree(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (p, c) whose set sizes allow the threshold and that agree in enough coordinates."""
    matches = matches_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # signature and set size of the pivot that the last batch ended with
        for batch in batches:
            p, c, n = (batch.column(k).to_numpy() for k in (0, 1, 2))
            sigs = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u4").reshape(-1, COORDINATES)
            at = np.maximum.accumulate(np.where(p == c, np.arange(len(p)), -1))
            sig, size = sigs[at], n[at]
            if len(at) and at[0] < 0:
                sig[at < 0], size[at < 0] = before
            fine = (p != c) & (100 * n >= percent * size) & (100 * size >= percent * n) & ((sigs == sig).sum(axis=1) >= matches)
            if len(at):
                before = (sig[-1], size[-1])
            yield batch.select([0, 1]).filter(pa.array(fine))

    return map_arrow(_beside_pivots(pairs, classes.select("c", "n", "sig")).select("p", "c", "n", "sig"), run, "p long, c long")


def _texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """c, text: one text of each class in wanted."""
    named = wanted.join(classes.select("c", "rep"), "c")
    found = named.join(docs.select("id", "th", "text"), F.col("rep.id").eqNullSafe(F.col("id")) & (F.col("rep.th") == F.col("th")))
    return save(found.dropDuplicates(["c"]).select("c", "text"))


def _is_link(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * common >= percent * (len(left) + len(right) - common)


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b): pairs (p, c) with 100 * intersection >= percent * union on the full sets. A pivot's text travels once a salt."""
    wanted = pairs.select("c").union(pairs.select("p")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            fine = []
            for p, c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                right = shingles(text.as_py(), n)
                if p == c:
                    left = right
                fine.append(p != c and _is_link(left, right, percent))
            yield batch.select([0, 1]).rename_columns(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return map_arrow(_beside_pivots(pairs, _texts(wanted, classes, docs)).select("p", "c", "text"), run, "a long, b long")


def _blocks(posts: DataFrame, weight: str, most: int) -> DataFrame:
    """value, i, j, c, label, block: each member of a list once for every block that its own block has to meet.

    A component that fills a block in a list has blocks of its own, which never meet one another; small ones share blocks, dealt
    by hash. A block holds about `most` of the column `weight`.
    """
    of_label = save(posts.groupBy("value", "label").agg(F.sum(weight).alias("nl")))
    small = F.coalesce(F.sum(F.when(F.col("nl") < most, F.col("nl"))), F.lit(0))
    of_list = of_label.groupBy("value").agg(small.alias("ns"))
    own = F.col("nl") >= most
    spread = F.pmod(F.xxhash64("c"), F.ceil(F.col("nl") / most))
    shared = F.pmod(F.xxhash64("label"), F.ceil(F.greatest(F.lit(1), F.col("ns")) / most))
    placed = posts.join(of_label, ["value", "label"]).join(of_list, "value")
    placed = save(placed.select("value", "c", "label", F.when(own, F.xxhash64("label", spread)).otherwise(shared).alias("block"), F.when(own, F.col("label")).alias("single")))
    lists = placed.select("value", "block", "single").distinct().groupBy("value").agg(F.collect_list(F.struct("block", "single")).alias("all"))
    meets = F.filter("all", lambda o: (o["block"] == F.col("block")) & F.col("single").isNull() | (o["block"] != F.col("block")) & ~F.coalesce(o["single"] == F.col("single"), F.lit(False)))
    dealt = placed.join(lists, "value").select("value", "c", "label", "block", F.explode(meets).alias("o"))
    return dealt.select("value", F.least("block", "o.block").alias("i"), F.greatest("block", "o.block").alias("j"), "c", "label", "block")


def _compared(tasks: DataFrame, held: DataFrame, function, schema: str) -> DataFrame:
    """What function makes of each pair of blocks (value, i, j), as an Arrow batch with held's columns of every member."""
    columns = ["value", "i", "j", "c", "label", "block", *[x for x in held.columns if x != "c"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch if left is None else pa.concat_batches([left, batch])
            starts = _starts(t)
            for a, b in zip(starts, starts[1:], strict=False):
                yield function(t.slice(a, b - a))
            # the last pair of blocks may go on in the next batch
            left = t.slice(starts[-1])
        if left is not None:
            yield function(left)

    return map_arrow(tasks.join(held, "c").repartition("value", "i", "j").sortWithinPartitions("value", "i", "j").select(*columns), run, schema)


def _starts(t: pa.RecordBatch) -> np.ndarray:
    """First row of each run of equal (value, i, j)."""
    keys = [t.column(k).to_numpy() for k in range(3)]
    return np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))


class _Members:
    """The members of two blocks, and which of them a member has to be compared with."""

    def __init__(self, t: pa.RecordBatch, percent: int):
        i, j, self.c, self.label, self.block, self.n = (t.column(k).to_numpy() for k in (1, 2, 3, 4, 5, 6))
        self.sketch = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        self.same, self.label, self.percent, self.matches = i[0] == j[0], self.label.copy(), percent, matches_for(percent)

    def counterparts(self, r: int) -> np.ndarray:
        """Later members of other components whose sizes and sketches agree with member r's."""
        n, at = self.n[r + 1 :], self.label[r + 1 :] != self.label[r]
        if not self.same:
            at &= self.block[r + 1 :] != self.block[r]
        q = r + 1 + np.flatnonzero(at & (100 * n >= self.percent * self.n[r]) & (100 * self.n[r] >= self.percent * n))
        return q[(self.sketch[q] == self.sketch[r]).sum(axis=1) >= self.matches]


def _between_blocks(posts: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between different components of one list, as many as it takes to join them within each pair of blocks."""

    def agreeing(t: pa.RecordBatch) -> pa.RecordBatch:
        m = _Members(t, percent)
        has = np.zeros(t.num_rows, bool)
        for r in range(t.num_rows):
            q = m.counterparts(r)
            if len(q):
                has[r] = has[q] = True
        return t.select([0, 3, 4, 6]).filter(pa.array(has))

    sketches = classes.select("c", "n", "sketch")
    fine = _compared(_blocks(posts.withColumn("one", F.lit(1)), "one", BLOCK), sketches, agreeing, "value long, c long, label long, n long")
    fine = save(fine.distinct())
    texts = _texts(fine.select("c").distinct(), classes, docs)

    def links(t: pa.RecordBatch) -> pa.RecordBatch:
        m = _Members(t, percent)
        sets: dict[int, np.ndarray] = {}

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles(t.column(8)[k].as_py(), shingle)
            return sets[k]

        a, b = [], []
        for r in range(t.num_rows):
            for q in m.counterparts(r):
                # a link found for this member may have joined the two components
                if m.label[q] != m.label[r] and _is_link(set_of(r), set_of(q), percent):
                    m.label[m.label == m.label[q]] = m.label[r]
                    a.append(min(m.c[r], m.c[q])), b.append(max(m.c[r], m.c[q]))
            sets.pop(r, None)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    tasks = _blocks(fine.withColumn("words", F.col("n") + F.lit(64)), "words", BLOCK_WORDS)
    return _compared(tasks, sketches.join(texts, "c"), links, "a long, b long").distinct()


def _near_rows(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """As near_groups(), with th, the hash of each row's text."""
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    rows = save(_signed(base, shingle))
    key = ["h1", "h2", "n"]
    full = rows.where("n > 0")
    # the smallest id that isn't null represents a class
    rep = F.coalesce(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "th"))), F.min(F.struct("id", "th")))
    classes = full.groupBy(*key).agg(rep.alias("rep"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    # numbered once and saved: equal sets have one number, and no two sets share one
    classes = save(classes.withColumn("c", F.monotonically_increasing_id()))
    matches = matches_for(percent)
    posts = save(_posted(classes, COORDINATES - matches + 1))
    pivot = posts.groupBy("value").agg(F.min_by("c", F.xxhash64("c")).alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1")
    star = save(posts.join(pivot, "value").where("c <> p").select("p", "c").distinct())
    links = save(_confirmed(save(_agree(star, classes, percent)), classes, base, shingle, percent))
    label = save(components(links))
    labelled = posts.join(label, posts.c == label.node, "left").select("value", "c", F.coalesce("component", "c").alias("label"))
    mixed = labelled.groupBy("value").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("c").alias("u")).where("x <> y").select("value")
    # pairs with the pivot are settled; without it, a list of one component is done
    rest = labelled.join(pivot, "value").where("c <> p").join(mixed, "value", "left_semi").select("value", "c", "label")
    open_ = rest.groupBy("value").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("value")
    more = save(_between_blocks(save(rest.join(open_, "value", "left_semi")), classes, base, shingle, percent))
    if not more.isEmpty():
        links = save(links.union(more))
        label = save(components(links))
    # labels are numbers of classes: the smallest id of a component is what its classes bring along
    named = classes.join(label, classes.c == label.node, "left").select(*key, F.coalesce("component", "c").alias("label"), F.col("rep.id").alias("id"))
    least_id = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of_class = named.join(least_id, "label").select(*[F.col(k).alias("c" + k) for k in key], "component_id")
    out = rows.join(of_class, [rows[k] == F.col("c" + k) for k in key], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "th")


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links of Jaccard >= percent / 100), kept."""
    return _near_rows(docs, shingle, percent, id_col, text_col).drop("th")


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", keep_null_ids: bool = True) -> DataFrame:
    """The rows of docs that near_groups() keeps, with all their columns; rows are told apart by id and text.

    keep_null_ids: rows without an id stay even if near_groups() doesn't keep them.
    """
    gone = _near_rows(docs, shingle, percent, id_col, text_col).where(~F.col("kept"))
    if keep_null_ids:
        gone = gone.where("doc_id is not null")
    gone = gone.select("doc_id", "th").distinct().alias("gone")
    on = F.col(f"docs.`{id_col}`").eqNullSafe(F.col("gone.doc_id")) & (F.xxhash64(F.col(f"docs.`{text_col}`")) == F.col("gone.th"))
    return docs.alias("docs").join(gone, on, "left_anti")
