"""Packets of shreds: headers and Merkle roots read with built-in functions alone, and what to do with a packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Places and sizes in a packet, and the prefixes of hashed nodes.
SIGNATURE, VARIANT, SLOT, INDEX, FEC_SET, HEADER, N_DATA, POSITION, PROOF = 64, 64, 65, 73, 79, 83, 83, 87, 20
LEAF, NODE = b"\x00SOLANA_MERKLE_SHREDS_LEAF".hex(), b"\x01SOLANA_MERKLE_SHREDS_NODE".hex()
#: The high half of a Merkle variant byte: kind, and whether it was signed anew. Two whole bytes are legacy kinds.
MERKLE = {0x40: ("code", False), 0x60: ("code", False), 0x70: ("code", True), 0x80: ("data", False), 0x90: ("data", False), 0xB0: ("data", True)}
LEGACY = {0x5A: "code", 0xA5: "data"}


def little_endian(packet: Column, at: int, size: int) -> Column:
    """An unsigned number of up to 7 bytes, or the long of 8; null where the packet ends before it."""
    digits = F.hex(F.substring(packet, at + 1, size))
    turned = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.when(F.length(digits) == 2 * size, F.conv(turned, 16, -10 if size == 8 else 10).try_cast("long"))


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parse(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """packets with slot, index, kind (data or code), resigned, message (what was signed) and parsed.

    Of a legacy packet the message is all behind the signature; of a Merkle packet the root that its proof leads to, if its place in the
    batch fits the proof. A packet that is too short or of no known kind isn't parsed: its columns are null.
    """
    p = F.col(payload)
    byte = little_endian(p, VARIANT, 1)
    high = byte.bitwiseAND(F.lit(0xF0))
    legacy = F.lit(None).cast("string")
    for value, kind in LEGACY.items():
        legacy = F.when(byte == value, kind).otherwise(legacy)
    merkle, again = F.lit(None).cast("string"), F.lit(False)
    for value, (kind, resigned) in MERKLE.items():
        merkle, again = F.when(high == value, kind).otherwise(merkle), again | ((high == value) & F.lit(resigned))
    head = packets.withColumns({"_legacy": legacy, "slot": little_endian(p, SLOT, 8), "index": little_endian(p, INDEX, 4), "_n": byte.bitwiseAND(F.lit(0x0F)).cast("int")})
    head = head.withColumn("kind", F.coalesce("_legacy", merkle)).withColumn("resigned", F.col("_legacy").isNull() & again)
    place = F.when(F.col("kind") == "data", F.col("index") - little_endian(p, FEC_SET, 4)).otherwise(little_endian(p, N_DATA, 2) + little_endian(p, POSITION, 2))
    start = F.octet_length(p) - F.col("_n") * PROOF - F.when(F.col("resigned"), SIGNATURE).otherwise(0)
    head = head.withColumn("_place", place.cast("long")).withColumn("_start", start.cast("int"))
    fits = (F.col("_start") >= SIGNATURE) & (F.col("_place") >= 0)
    leaf = _sha(F.unhex(F.lit(LEAF)), F.substring(p, F.lit(SIGNATURE + 1), F.col("_start") - SIGNATURE))
    first = F.struct(leaf.alias("node"), F.col("_place").alias("at"))

    def up(s: Column, k: Column) -> Column:
        own, other, prefix = F.substring(s["node"], F.lit(1), F.lit(PROOF)), F.substring(p, F.col("_start") + k * PROOF + 1, F.lit(PROOF)), F.unhex(F.lit(NODE))
        return F.struct(F.when(s["at"] % 2 == 0, _sha(prefix, own, other)).otherwise(_sha(prefix, other, own)).alias("node"), F.shiftright(s["at"], 1).alias("at"))

    steps = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))
    root = F.aggregate(steps, first, up)
    head = head.withColumn("_root", F.when(fits, root))
    found = F.when(F.col("_root.at") == 0, F.col("_root.node"))
    message = F.when(F.octet_length(p) < HEADER, None).when(F.col("_legacy").isNotNull(), F.substring(p, F.lit(SIGNATURE + 1), F.octet_length(p))).when(F.col("kind").isNotNull(), found)
    out = head.withColumn("message", message).withColumn("parsed", F.col("message").isNotNull())
    only = {c: F.when(F.col("parsed"), F.col(c)) for c in ("slot", "index", "kind", "resigned")}
    return out.withColumns(only).drop("_legacy", "_n", "_place", "_start", "_root")


def policy(parsed: Column, leader: Column, verdict: Column) -> Column:
    """What is done with a packet: one that can't be parsed is forwarded (nothing is lost), one without a known leader is dropped (nothing is forged)."""
    return F.when(~parsed, "forward").when(leader.isNull(), "drop").otherwise(verdict)
