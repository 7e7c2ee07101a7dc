import hashlib
import struct

from pyspark.sql import functions as F

from tickloom.operators import shreds as s

LEAF, NODE = b"\x00SOLANA_MERKLE_SHREDS_LEAF", b"\x01SOLANA_MERKLE_SHREDS_NODE"


def sha(*parts):
    return hashlib.sha256(b"".join(parts)).digest()


def packet(variant, slot=(1 << 63) - 5, index=9, fec=7, body=b"text" * 9, proof=(), tail=b""):
    return bytes(64) + struct.pack("<BQIHI", variant, slot, index, 1, fec) + body + b"".join(proof) + tail


def test_roots_lead_up_the_proof(spark):
    proof = [bytes([k]) * 20 for k in range(2)]
    p = packet(0x82, proof=proof)
    node = sha(LEAF, p[64 : len(p) - 40])
    # place 2: even first, odd then
    want = sha(NODE, proof[1], sha(NODE, node[:20], proof[0])[:20])
    code = packet(0x72, body=struct.pack("<HHH", 1, 1, 1) + b"x" * 20, proof=proof, tail=b"s" * 64)
    rows = [p, code, packet(0x82, index=20, proof=proof), packet(0xA5), packet(0x80), packet(0x10), packet(0x82, index=3, proof=proof), b"short", None, packet(0x8F)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, payload binary")
    got = {r.i: r for r in s.parse(df).collect()}
    assert bytes(got[0].message) == want and (got[0].slot, got[0]["index"], got[0].kind, got[0].resigned) == ((1 << 63) - 5, 9, "data", False)
    node = sha(LEAF, code[64 : len(code) - 104])
    assert bytes(got[1].message) == sha(NODE, proof[1], sha(NODE, node[:20], proof[0])[:20]) and (got[1].kind, got[1].resigned) == ("code", True)
    assert bytes(got[3].message) == rows[3][64:] and got[3].kind == "data"
    # place 13 doesn't fit two steps; place 2 none; no such kind; before the set; too short; nothing; a proof longer than the packet
    assert [i for i in got if not got[i].parsed] == [2, 4, 5, 6, 7, 8, 9] and got[2].slot is None
    assert s.parse(df.limit(0)).collect() == []


def test_policy(spark):
    df = spark.createDataFrame([(False, None, "drop"), (True, None, "forward"), (True, "L", "duplicate")], "parsed boolean, leader string, verdict string")
    assert [r[0] for r in df.select(s.policy(F.col("parsed"), F.col("leader"), F.col("verdict"))).collect()] == ["forward", "drop", "duplicate"]
