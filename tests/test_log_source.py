"""Logs split by bytes against the reader of whole files."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tickloom.sources import datagrams as d
from tickloom.sources import log_source as s


def payloads(n, seed=0):
    some = random.Random(seed)
    # bodies full of what looks like lengths and magic numbers
    traps = [struct.pack("<IHB", some.randint(24, 90), some.choice(list(d.MAGIC.values())), 1) for _ in range(20)]
    out = []
    for i in range(n):
        body = b"".join(some.choices(traps, k=some.randint(0, 12)))
        out.append(struct.pack("<HBBQQBBH", some.choice([0x445A, 0x4444, 0x4442]), 1, i % 7, i, 77, 0, 1, 24 + len(body)) + body)
    return out


def read(spark, path, **options):
    s.register(spark)
    return spark.read.format("datagram_log").options(**options).load(path)


@pytest.mark.parametrize("split", [211, 4096, 1 << 20])
def test_plain_and_combined_logs_split_anywhere(spark, tmp_path, split):
    records = payloads(120)
    plain = b"".join(struct.pack("<I", len(x)) + x for x in records)
    (tmp_path / "a.bin").write_bytes(plain + b"\x30\0\0\0cut")
    found = read(spark, str(tmp_path / "a.bin"), split_bytes=split)
    assert found.rdd.getNumPartitions() == -(-(len(plain) + 7) // split)
    assert [bytes(r.payload) for r in found.orderBy("offset").collect()] == records
    (tmp_path / "b.bin").write_bytes(b"".join(struct.pack("<I4sB", len(x), bytes([10, 0, 0, i % 3]), i % 2) + x for i, x in enumerate(records)))
    whole = d.read_log(spark, str(tmp_path / "b.bin"), combined=True).orderBy("arrival_seq").collect()
    parts = read(spark, str(tmp_path / "b.bin"), format="combined", split_bytes=split).orderBy("offset").collect()
    assert [(r.publisher, r.role, r.payload) for r in parts] == [(r.publisher, r.role, r.payload) for r in whole]


def capture(n):
    udp = lambda x: struct.pack(">HHHH", 1, 2, 8 + len(x), 0) + x
    ip = lambda x, i: struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(x), 0, 0, 1, 6 if i % 9 == 0 else 17, 0, bytes([10, 0, 0, i % 3]), bytes([233, 0, 0, i % 2])) + x
    packets = [bytes(14) + b"\x08\x00" + ip(udp(x), i) for i, x in enumerate(payloads(n, 1))]
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 113) + b"".join(struct.pack("<IIII", 1_700_000_000 + i, i, len(x), len(x)) + x for i, x in enumerate(packets))


@pytest.mark.parametrize("split", [997, 1 << 20])
def test_captures_with_filters_taken_by_the_reader(spark, tmp_path, split):
    (tmp_path / "a.pcap").write_bytes(capture(150) + b"cut")
    whole = [(r.recv_ts_ns, r.publisher, r.grp, r.payload) for r in d.read_capture(spark, str(tmp_path / "a.pcap")).orderBy("arrival_seq").collect()]
    found = read(spark, str(tmp_path / "a.pcap"), format="capture", split_bytes=split)
    assert [(r.recv_ts_ns, r.publisher, r.grp, r.payload) for r in found.orderBy("offset").collect()] == whole
    until = 1_700_000_060 * 10**9
    some = found.where((F.col("publisher") == "10.0.0.1") & F.col("grp").isin("233.0.0.0", "x") & (F.col("recv_ts_ns") < until))
    assert [(r.recv_ts_ns, r.payload) for r in some.orderBy("offset").collect()] == [(t, p) for t, source, group, p in whole if source == "10.0.0.1" and group == "233.0.0.0" and t < until]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "10.0.0.1" not in plan.split("Filter")[1].split("\n")[0] if "Filter" in plan else True


def test_folders_empty_files_and_what_is_refused(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "empty.bin").write_bytes(b"")
    (tmp_path / "x" / "one.bin").write_bytes(b"".join(struct.pack("<I", len(p)) + p for p in payloads(3)))
    assert read(spark, str(tmp_path / "x")).count() == 3
    with pytest.raises(Exception, match="cooked"):
        read(spark, str(tmp_path / "x"), format="capture").count()
    with pytest.raises(Exception, match="plain, combined or capture"):
        read(spark, str(tmp_path / "x"), format="other").count()


def test_wrong_guesses_are_an_error_never_lost_records(tmp_path, monkeypatch):
    records = payloads(40)
    path = tmp_path / "a.bin"
    path.write_bytes(b"".join(struct.pack("<I", len(x)) + x for x in records))
    monkeypatch.setattr(s, "CHAIN", 0)
    monkeypatch.setattr(s._Log, "plausible", lambda self, place: True)
    reader = s.DatagramLogReader({"path": str(path), "split_bytes": "300"})
    with pytest.raises(ValueError, match="a record begins at byte"):
        for part in reader.partitions():
            list(reader.read(part))


def test_memory_is_bounded_by_blocks(tmp_path):
    path = tmp_path / "big.bin"
    record = payloads(1)[0] + bytes(50_000)
    with path.open("wb") as f:
        for _ in range(1500):
            f.write(struct.pack("<I", len(record)) + record)
    reader = s.DatagramLogReader({"path": str(path), "split_bytes": str(16 << 20)})
    sizes = [(len(b), b.nbytes) for part in reader.partitions() for b in reader.read(part)]
    assert sum(n for n, _ in sizes) == 1500 and max(x for _, x in sizes) < 2 << 20 and len(reader.partitions()) == 5
