"""Sharding by histogram sort: exact byte counts below probe keys, refined until every splitter fits, then one exchange.

Rows are ordered by (hash of the text, hash of the id), so equal texts lie side by side. Each pass counts, over all
partitions, the exact bytes below the probes inside the intervals that are still open: 128 probes a splitter, so a
pass brings at most 128 rows a splitter to the driver, whatever the size of the table. A splitter is fixed once the
edge of a probe is within the tolerance of its target, or once no finer key exists.

Equal texts stay in one shard, whatever that does to the tolerance, as long as they fill no more than GROUP_SHARE of a shard; a larger
group is cut by the hash of its ids.

Defined cases. A null text has no bytes (size 16, CRC of the empty text). Null ids are hashed like one more id.
Rows that repeat an id and a text can't be told apart by key and stay together. Fewer rows than shards leave shards
empty. An empty table gives an empty result. Other columns of the input are ignored, unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import save

#: Both keys are hashes of 63 bits, refined by 7 bits a pass.
KEY_BITS, STEP = 63, 7
OVERHEAD = 16
GROUP_SHARE = 0.5


def _hash63(c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 1)


def _prefix(level: int) -> Column:
    """The leading (level + 1) * STEP bits of (k1, k2): of k2 once k1 has none left."""
    per_key = KEY_BITS // STEP
    return F.shiftright("k1", KEY_BITS - STEP * (level + 1)) if level < per_key else F.shiftright("k2", 2 * KEY_BITS - STEP * (level + 1))


def splitters(keyed: DataFrame, targets: Sequence[float], tolerance: float, group: float) -> list[tuple[int, int]]:
    """For each target the (k1, k2) such that the bytes of the rows with smaller keys are about the target; equal texts of at most `group` bytes aren't cut."""
    per_key = KEY_BITS // STEP
    # interval of each open splitter: first key, bytes below it
    open_: dict[int, dict] = {i: {"k1": 0, "k2": 0, "below": 0} for i in range(len(targets))}
    done: dict[int, tuple[int, int]] = {}
    for level in range(2 * per_key):
        if not open_:
            break
        rows = keyed
        if level == per_key:
            rows = rows.where(F.col("k1").isin({o["k1"] for o in open_.values()}))
        elif level > per_key:
            wanted = {(o["k1"], o["k2"] >> (2 * KEY_BITS - STEP * level)) for o in open_.values()}
            rows = rows.withColumn("p", _prefix(level - 1)).where(F.struct("k1", "p").isin([F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in wanted]))
        elif level:
            rows = rows.where(_prefix(level - 1).isin({o["k1"] >> (KEY_BITS - STEP * level) for o in open_.values()}))
        first = F.lit(0).cast("long") if level < per_key else F.col("k1")
        histogram: dict[tuple[int, int], list] = {}
        for r in rows.groupBy(first.alias("a"), _prefix(level).alias("p")).agg(F.sum("size").alias("b"), F.min("k1").alias("lo"), F.max("k1").alias("hi")).collect():
            histogram.setdefault((r["a"], r["p"] >> STEP), []).append(r)
        for r in histogram.values():
            r.sort(key=lambda x: x["p"])
        for i, o in list(open_.items()):
            if level < per_key:
                inside = histogram.get((0, o["k1"] >> (KEY_BITS - STEP * level)), [])
                shift, edge = KEY_BITS - STEP * (level + 1), lambda p, s=KEY_BITS - STEP * (level + 1): (p << s, 0)
            else:
                shift = 2 * KEY_BITS - STEP * (level + 1)
                inside = histogram.get((o["k1"], o["k2"] >> (shift + STEP)), [])
                edge = lambda p, s=shift, a=o["k1"]: (a, p << s)
            below, best, crossing = o["below"], None, None
            edges = []
            for r in inside:
                edges.append((abs(below - targets[i]), edge(r["p"])))
                if below < targets[i] <= below + r["b"]:
                    crossing = (r, below)
                below += r["b"]
            if inside:
                edges.append((abs(below - targets[i]), edge(inside[-1]["p"] + 1)))
            best = min(edges, default=(0, (o["k1"], o["k2"])))
            whole = level == per_key - 1 and crossing is not None and crossing[0]["b"] <= group
            if crossing is None or best[0] <= tolerance or whole or level == 2 * per_key - 1:
                done[i] = best[1]
                del open_[i]
                continue
            r, under = crossing
            o |= {"below": under}
            if level < per_key:
                o["k1"] = r["p"] << shift
                if level == per_key - 1:
                    o["k2"] = 0
            else:
                o["k2"] = r["p"] << shift
    return [done[i] for i in range(len(targets))]


def _numbered(docs: DataFrame, n_shards: int, id_col: str, text_col: str, keep: Sequence[str], tolerance: float, rows_a_slice: int) -> DataFrame:
    """id, size, crc, shard, slot, and the columns `keep` as a struct kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), _hash63(text).alias("k1"), _hash63(F.col(id_col)).alias("k2")]
    keyed = save(docs.select(*keys, *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else [])))
    total, n_rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    shard_bytes = total / n_shards
    cuts = splitters(keyed.select("k1", "k2", "size"), [shard_bytes * i for i in range(1, n_shards)], tolerance * shard_bytes, GROUP_SHARE * shard_bytes) if n_rows else []
    shard = F.lit(0)
    for a, b in cuts:
        shard = shard + F.when((F.col("k1") > a) | (F.col("k1") == a) & (F.col("k2") >= b), 1).otherwise(0)
    slices = max(16, n_rows // (n_shards * rows_a_slice))
    dealt = keyed.withColumn("shard", shard.cast("int")).withColumn("slice", F.pmod("k2", F.lit(slices)).cast("int"))
    # n_shards * slices rows: a row for each slice of each shard
    before = dealt.groupBy("shard", "slice").count().withColumn("start", F.sum("count").over(W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)))
    numbered = dealt.withColumn("n", F.row_number().over(W.partitionBy("shard", "slice").orderBy("k1", "k2", "id")))
    slot = (F.coalesce("start", F.lit(0)) + F.col("n") - 1).alias("slot")
    return numbered.join(before.select("shard", "slice", "start"), ["shard", "slice"]).select("id", "size", "crc", "shard", slot, *(["kept"] if keep else []))


def histogram_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), tolerance: float = 0.01, rows_a_slice: int = 500_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the columns in `keep`, one row per document.

    tolerance: how far a splitter may be from its target, as a share of one shard's bytes. A shard is numbered in slices
    dealt by the hash of the id, of about rows_a_slice rows, so that no task has to hold a shard. Columns in `keep` with one of the
    names above are an error.
    """
    if clash := {"doc_id", "size", "text_crc32", "shard", "slot"} & set(keep):
        raise ValueError(f"can't keep columns named {sorted(clash)} beside the result's own")
    found = _numbered(docs, n_shards, id_col, text_col, keep, tolerance, rows_a_slice)
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "slot", *[F.col(f"kept.`{c}`").alias(c) for c in keep])


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all columns of docs as Parquet, one folder a shard, rows in slot order within a file.

    Columns shard and slot are the result's; docs' own columns of these names are replaced.
    """
    rest = [c for c in docs.columns if c not in ("shard", "slot", id_col)]
    out = _numbered(docs, n_shards, id_col, text_col, rest, 0.01, 500_000)
    out = out.select(F.col("id").alias(id_col), "kept.*", "shard", "slot")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
