"""Logs and captures as a data source that splits files by bytes and takes filters: `spark.read.format("datagram_log")`.

A partition is a range of a file's bytes and gives the records that begin in it. Where a record begins isn't written anywhere, so a partition
looks for the first place in its range from which a chain of records holds (CHAIN of them, or to the file's end): plausible lengths, and
datagrams of a known magic and version that are framed as they say, or packet headers of a capture. A partition that comes to the end of its range knows
where the next record really begins, and checks that the next partition will find the same place; as the first one starts at the file's own start,
all of them are right if every check holds, and one that doesn't is an error, never a lost or doubled record. Memory is bounded by a block
and a record, whatever the file's size.

Options: path (a file, or a folder whose files are read; any file system that Arrow opens), format (plain, combined or capture),
split_bytes. Filters on publisher, role, grp and recv_ts_ns are taken by the reader, so that payloads of other rows aren't handed on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tickloom.sources.datagrams import COOKED, HEADER, MAGIC, PACKET_HEADER, PCAP_HEADER, PCAP_MAGIC, VERSIONS, _udp

SPLIT_BYTES, BLOCK_BYTES, CHAIN, LONGEST = 128 << 20, 1 << 20, 8, 1 << 16
_OPENINGS = {(magic, v) for name, magic in MAGIC.items() for v in VERSIONS[name]}
SCHEMA = "file string, offset long, recv_ts_ns long, publisher string, grp string, role int, payload binary"
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary())
_COMPARED = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class _Bytes:
    """A file read in blocks; what lies before the last place asked for isn't kept."""

    def __init__(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.file = fs.open_input_file(inner)
        self.size, self.begin, self.held = self.file.size(), 0, b""

    def at(self, place: int, n: int) -> bytes:
        """n bytes from place on, fewer at the file's end."""
        if not self.begin <= place <= place + n <= self.begin + len(self.held):
            self.begin, self.held = place, self.file.read_at(min(max(BLOCK_BYTES, n), max(0, self.size - place)), place)
        return self.held[place - self.begin : place - self.begin + n]


class _Log:
    """Records [u32 length][address and role, in combined logs][payload]."""

    start = 0

    def __init__(self, data: _Bytes, prefix: int):
        self.data, self.prefix = data, prefix

    def length(self, place: int) -> int | None:
        """Bytes of the record at place; None if it is cut off."""
        head = self.data.at(place, 4)
        size = 4 + self.prefix + int.from_bytes(head, "little")
        return size if len(head) == 4 and place + size <= self.data.size else None

    def plausible(self, place: int) -> bool:
        """A record's length, and a datagram in it that is framed as its header says."""
        size = int.from_bytes(self.data.at(place, 4), "little")
        if not HEADER.size <= size <= LONGEST:
            return False
        raw = self.data.at(place + 4 + self.prefix, size)
        if len(raw) < HEADER.size or (int.from_bytes(raw[:2], "little"), raw[2]) not in _OPENINGS:
            return False
        *_, count, _, declared = HEADER.unpack_from(raw)
        at = HEADER.size
        for _ in range(count):
            length = raw[at + 1] if at + 4 <= len(raw) else 0
            if length < 4:
                return False
            at += length
        return max(at, HEADER.size) <= declared <= size

    def cut_off(self, place: int) -> bool:
        """The file ends within a record that may begin here."""
        head = self.data.at(place, 4)
        size = int.from_bytes(head, "little")
        return len(head) < 4 or HEADER.size <= size <= LONGEST and place + 4 + self.prefix + size > self.data.size

    def row(self, place: int, size: int) -> tuple | None:
        raw = self.data.at(place, size)
        source = (".".join(map(str, raw[4:8])), None, raw[8]) if self.prefix else (None, None, None)
        return None, *source, raw[4 + self.prefix :]


class _Capture:
    """Packets of a capture of a cooked Linux link."""

    start = PCAP_HEADER.size

    def __init__(self, data: _Bytes):
        self.data = data
        head = data.at(0, PCAP_HEADER.size)
        magic, *_, link = PCAP_HEADER.unpack(head) if len(head) == PCAP_HEADER.size else (0, 0)
        if magic not in PCAP_MAGIC or link != COOKED:
            raise ValueError("no capture of a cooked Linux link")
        self.unit = PCAP_MAGIC[magic]
        first = self._head(self.start)
        self.second = first[0] if first else 0

    def _head(self, place: int) -> tuple | None:
        head = self.data.at(place, PACKET_HEADER.size)
        return PACKET_HEADER.unpack(head) if len(head) == PACKET_HEADER.size else None

    def length(self, place: int) -> int | None:
        head = self._head(place)
        size = PACKET_HEADER.size + (head[2] if head else 0)
        return size if head and place + size <= self.data.size else None

    def plausible(self, place: int) -> bool:
        head = self._head(place)
        return head is not None and abs(head[0] - self.second) < 30 * 86_400 and head[1] * self.unit < 10**9 and head[2] <= head[3] and 16 <= head[2] <= LONGEST

    def cut_off(self, place: int) -> bool:
        return self._head(place) is None or self.plausible(place) and self.length(place) is None

    def row(self, place: int, size: int) -> tuple | None:
        seconds, fraction, *_ = self._head(place)
        found = _udp(self.data.at(place + PACKET_HEADER.size, size - PACKET_HEADER.size))
        return found and (seconds * 1_000_000_000 + fraction * self.unit, found[0], found[1], None, found[2])


def _first(log: _Log | _Capture, place: int) -> int:
    """The first place from `place` on at which a chain of records holds; the file's end if there is none."""
    if place <= log.start:
        return log.start
    while place < log.data.size:
        at, held = place, 0
        while held < CHAIN and at < log.data.size and log.plausible(at):
            size = log.length(at)
            if size is None:
                break
            at, held = at + size, held + 1
        if held == CHAIN or held and (at >= log.data.size or log.cut_off(at)):
            return place
        place += 1
    return log.data.size


class _Range(InputPartition):
    def __init__(self, file: str, begin: int, end: int):
        super().__init__((file, begin, end))
        self.file, self.begin, self.end = file, begin, end


class DatagramLogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.format = options["path"], options.get("format", "plain")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        if self.format not in ("plain", "combined", "capture"):
            raise ValueError(f"format is plain, combined or capture, not {self.format}")
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _COMPARED and f.attribute[0] in ("publisher", "role", "grp", "recv_ts_ns"):
                self.filters.append((SCHEMA_NAMES.index(f.attribute[0]), type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, inner = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        root = self.path[: len(self.path) - len(inner)] if "://" in self.path and self.path.endswith(inner) else ""
        info = fs.get_file_info(inner)
        files = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
        return [_Range(root + f.path, at, min(at + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, max(1, f.size), self.split)]

    def _opened(self, file: str) -> _Log | _Capture:
        data = _Bytes(file)
        return _Capture(data) if self.format == "capture" else _Log(data, 5 if self.format == "combined" else 0)

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        log, held, size = self._opened(part.file), [], 0
        place = _first(log, part.begin)
        while place < part.end:
            n = log.length(place)
            if n is None:
                place = log.data.size
                break
            found = log.row(place, n)
            row = found and (part.file, place, *found)
            if row and all(row[i] is not None and _COMPARED[kind](row[i], value) for i, kind, value in self.filters):
                held.append(row)
                size += n
            place += n
            if size >= BLOCK_BYTES or len(held) >= 4096:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)
        if part.end < log.data.size and place < log.data.size and (found := _first(self._opened(part.file), part.end)) != place:
            raise ValueError(f"{part.file}: a record begins at byte {place}, but from byte {part.end} on it looks as if one began at {found}; read it with a larger split_bytes")


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=SCHEMA_NAMES)


class DatagramLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "datagram_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DatagramLogReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it hand filters to sources written in Python."""
    spark.dataSource.register(DatagramLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
