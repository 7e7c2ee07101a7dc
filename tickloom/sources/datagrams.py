"""Logs of datagrams: length-prefixed records in files, split into rows, and the framing of a datagram walked into messages.

Files are read by Spark (binaryFile) and split in tasks; everything else is a function of one datagram.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Sizes of the headers, the versions and magic numbers of the protocols, little-endian.
HEADER, MESSAGE_HEADER = struct.Struct("<HBBQQBBH"), struct.Struct("<BBH")
MAGIC = {"top_of_book": 0x445A, "market_by_order": 0x4444, "market_by_price": 0x4442, "midpoint": 0x4D44}
VERSIONS = {"top_of_book": (1, 3), "market_by_order": (1, 3), "market_by_price": (1, 3), "midpoint": (1,)}
MESSAGES = "channel int, sequence long, send_ts long, reset_count int, version int, ord int, type int, flags int, length int, body binary"


#: Datagrams or messages that a task's Python has in hand as objects.
IN_HAND = 1024


def in_hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of IN_HAND rows."""
    return (batch.slice(k, IN_HAND) for batch in batches for k in range(0, batch.num_rows, IN_HAND))


def read_log(spark: SparkSession, path: str, combined: bool = False) -> DataFrame:
    """file, arrival_seq (order within its file), publisher and role (null in plain logs) and payload of each record.

    Records are [u32 length][payload], in combined logs [u32 length][4 bytes of address][1 byte of role][payload]. A file that ends within a
    record gives the records before it.
    """
    prefix = 5 if combined else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, at = [], 0
                while at + 4 + prefix <= len(content):
                    size = int.from_bytes(content[at : at + 4], "little")
                    start = at + 4 + prefix
                    if start + size > len(content):
                        break
                    source = ".".join(map(str, content[at + 4 : at + 8])) if combined else None
                    rows.append((file, len(rows), source, content[at + 8] if combined else None, content[start : start + size]))
                    at = start + size
                for k in range(0, len(rows), 4096):
                    columns = zip(*rows[k : k + 4096], strict=True)
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "arrival_seq", "publisher", "role", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, arrival_seq long, publisher string, role int, payload binary")


# Little-endian captures, their header, a packet's header, and the link type of "cooked" Linux captures.
PCAP_MAGIC = {0xA1B2C3D4: 1000, 0xA1B23C4D: 1}
PCAP_HEADER, PACKET_HEADER, COOKED = struct.Struct("<IHHiIII"), struct.Struct("<IIII"), 113


def _udp(packet: bytes) -> tuple[str, str, bytes] | None:
    """Source, destination and payload of a UDP packet over IPv4 in a cooked frame."""
    if len(packet) < 44 or packet[14:16] != b"\x08\x00" or packet[16] >> 4 != 4:
        return None
    header = (packet[16] & 15) * 4
    udp = packet[16 + header :]
    if header < 20 or len(udp) < 8 or packet[25] != 17:
        return None
    address = lambda at: ".".join(map(str, packet[at : at + 4]))
    return address(28), address(32), udp[8 : max(8, min(int.from_bytes(udp[4:6], "big"), len(udp)))]


def _packets(content: bytes, file: str) -> Iterator[tuple]:
    """Number, time in nanoseconds and UDP parts of a capture's packets; it ends where the last packet is cut off."""
    magic, *_, link = PCAP_HEADER.unpack_from(content)
    if magic not in PCAP_MAGIC or link != COOKED:
        raise ValueError(f"{file} is no capture of a cooked Linux link")
    at, n = PCAP_HEADER.size, 0
    while at + PACKET_HEADER.size <= len(content):
        seconds, fraction, size, _ = PACKET_HEADER.unpack_from(content, at)
        at += PACKET_HEADER.size
        if found := _udp(content[at : at + size]):
            yield n, seconds * 1_000_000_000 + fraction * PCAP_MAGIC[magic], *found
        at, n = at + size, n + 1


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """file, arrival_seq, recv_ts_ns, publisher, grp and payload of every UDP datagram in captures of cooked Linux links.

    Which sources, groups, protocols or seconds are wanted is a filter on the result. A capture of another link type is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(file, *packet) for packet in _packets(content, file)]
                for k in range(0, len(rows), 4096):
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                    columns = zip(*rows[k : k + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "arrival_seq", "recv_ts_ns", "publisher", "grp", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, arrival_seq long, recv_ts_ns long, publisher string, grp string, payload binary")


def _walk(payload: bytes | None, protocol: str) -> Iterator[tuple]:
    """The messages of one datagram; none if its magic or version is another's, and no more after one that is cut off."""
    if payload is None or len(payload) < HEADER.size:
        return
    magic, version, channel, sequence, send_ts, count, resets, declared = HEADER.unpack_from(payload)
    if magic != MAGIC[protocol] or version not in VERSIONS[protocol]:
        return
    end, at = min(declared, len(payload)), HEADER.size
    for n in range(count):
        if at + MESSAGE_HEADER.size > end:
            return
        kind, length, flags = MESSAGE_HEADER.unpack_from(payload, at)
        if length < MESSAGE_HEADER.size or at + length > end:
            return
        # readers are bounded by the datagram, not by the message: a body may go on behind its declared length
        yield channel, _signed(sequence), _signed(send_ts), resets, version, n, kind, flags, length, payload[at + MESSAGE_HEADER.size : at + MESSAGE_HEADER.size + 256]
        at += length


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def messages(datagrams: DataFrame, protocol: str, keep: tuple[str, ...] = ("arrival_seq",), payload: str = "payload") -> DataFrame:
    """The columns `keep` of each datagram and one row a message: header fields, ord, type, flags, length and body (256 bytes at most are a message's).

    Unsigned 64-bit fields are the long of the same bits.
    """
    kept = [datagrams.schema[k] for k in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), MESSAGES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        names = [*keep, *(x.split()[0] for x in MESSAGES.split(", "))]
        for batch in in_hand(batches):
            owner, rows = [], []
            for i, value in enumerate(batch.column(len(keep)).to_pylist()):
                found = list(_walk(value, protocol))
                owner += [i] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keep))), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return datagrams.select(*keep, payload).mapInArrow(run, schema)


def refused(datagrams: DataFrame, protocol: str, payload: str = "payload") -> DataFrame:
    """Datagrams whose framing is refused, with why: short, magic or version."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in datagrams.schema.fields) + ", why string"
    place, magic, versions, least = datagrams.columns.index(payload), MAGIC[protocol].to_bytes(2, "little"), VERSIONS[protocol], HEADER.size

    def reason(p: bytes | None) -> str | None:
        if p is None or len(p) < least:
            return "short"
        return "magic" if p[:2] != magic else None if p[2] in versions else "version"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_hand(batches):
            why = pa.array([reason(p) for p in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, why], names=[*batch.schema.names, "why"]).filter(why.is_valid())

    return datagrams.mapInArrow(run, schema)
