"""Bodies of messages as typed columns: each message type has a layout of little-endian fields, read for a whole batch at once.

Unsigned 64-bit fields come as the long of the same bits; sizes of price levels beyond a long stay at its largest value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.sources.datagrams import in_hand

# Message types and the places of their fields behind the message header. u: unsigned, i: signed, s: text, with bytes.
_TRADE = "instrument_id:u4@0 source_id:u2@4 aggressor_side:u1@6 trade_flags:u1@7 source_ts:u8@8 price_raw:i8@16 qty_raw:u8@24 trade_id:u8@32 cumulative_raw:u8@40"
_MANIFEST = "channel_id:u1@0 valid:u1@1 manifest_seq:u2@4 instrument_count:u4@8 ts:u8@12"
_DEFINITION_1 = "instrument_id:u4@0 symbol:s16@4 price_exponent:i1@37 qty_exponent:i1@38 manifest_seq:u2@74"
_DEFINITION_3 = "instrument_id:u4@0 source_id:u2@4 symbol:s64@6 price_exponent:i1@87 qty_exponent:i1@88 manifest_seq:u2@124"
_RESET = "instrument_id:u4@0 reason:u1@4 new_anchor_seq:u8@8 ts:u8@16"
_SNAPSHOT_END = "instrument_id:u4@0 anchor_seq:u8@4 snapshot_id:u4@12"
LAYOUTS = {
    "top_of_book": {
        0x01: ("heartbeat", ""), 0x02: ("definition", ""), 0x04: ("trade", _TRADE), 0x05: ("channel_reset", "ts:u8@0"), 0x06: ("end_of_session", "ts:u8@0"), 0x07: ("manifest", _MANIFEST),
        0x03: ("quote", "instrument_id:u4@0 source_id:u2@4 update_flags:u1@6 source_ts:u8@8 bid_raw:i8@16 bid_qty_raw:u8@24 ask_raw:i8@32 ask_qty_raw:u8@40 bid_n:u2@48 ask_n:u2@50"),
    },
    "market_by_order": {
        0x01: ("heartbeat", ""), 0x02: ("definition", ""), 0x04: ("trade", _TRADE), 0x06: ("end_of_session", "ts:u8@0"), 0x07: ("manifest", _MANIFEST),
        0x10: ("order_add", "instrument_id:u4@0 source_id:u2@4 side:u1@6 order_flags:u1@7 seq:u4@8 order_id:u8@12 enter_ts:u8@20 price_raw:i8@28 qty_raw:u8@36"),
        0x11: ("order_cancel", "instrument_id:u4@0 source_id:u2@4 reason:u1@6 seq:u4@8 order_id:u8@12 ts:u8@20"),
        0x12: ("order_execute", "instrument_id:u4@0 source_id:u2@4 aggressor_side:u1@6 exec_flags:u1@7 seq:u4@8 order_id:u8@12 trade_id:u8@20 ts:u8@28 price_raw:i8@36 qty_raw:u8@44"),
        0x13: ("batch_boundary", "batch_id:u4@0 ts:u8@4"), 0x14: ("instrument_reset", _RESET), 0x22: ("snapshot_end", _SNAPSHOT_END),
        0x20: ("snapshot_begin", "instrument_id:u4@0 anchor_seq:u8@4 total:u4@12 snapshot_id:u4@16 last_instrument_seq:u4@20 ts:u8@24"),
        0x21: ("snapshot_order", "snapshot_id:u4@0 order_id:u8@4 side:u1@12 order_flags:u1@13 enter_ts:u8@16 price_raw:i8@24 qty_raw:u8@32"),
    },
    "market_by_price": {
        0x01: ("heartbeat", "ts:u8@4"), 0x02: ("definition", ""), 0x04: ("trade", _TRADE), 0x06: ("end_of_session", "ts:u8@0"), 0x07: ("manifest", _MANIFEST), 0x13: ("batch_boundary", "batch_id:u4@0 ts:u8@4"), 0x14: ("instrument_reset", _RESET),
        0x20: ("snapshot_begin", "instrument_id:u4@0 anchor_seq:u8@4 total:u4@12 snapshot_id:u4@16 last_instrument_seq:u4@20 ts:u8@24 depth_bound:u4@32"), 0x22: ("snapshot_end", _SNAPSHOT_END),
        0x40: ("level_update", "instrument_id:u4@0 source_id:u2@4 side:u1@6 action:u1@7 seq:u4@8 price_raw:i8@12 qty_raw:u8@20 ts:u8@28 order_count:u2@36 level_index:u2@38 update_reason:u1@40 level_flags:u1@41"),
        0x41: ("book_clear", "instrument_id:u4@0 source_id:u2@4 clear_side:u1@6 scope:u1@7 seq:u4@8 from_price_raw:i8@12 ts:u8@20 clear_reason:u1@28"),
        0x42: ("snapshot_level", "snapshot_id:u4@0 price_raw:i8@4 qty_raw:u8@12 order_count:u2@20 side:u1@22 level_flags:u1@23"),
    },
    "midpoint": {
        0x01: ("heartbeat", ""), 0x02: ("definition", "instrument_id:u4@0 symbol:s16@4 price_exponent:i1@37 default_method:u1@38 manifest_seq:u2@56"), 0x06: ("end_of_session", "ts:u8@0"), 0x07: ("manifest", _MANIFEST),
        0x03: ("midpoint", "instrument_id:u4@0 source_id:u2@4 method:u1@6 quality_flags:u1@7 book_ts:u8@8 compute_ts:u8@16 mid_raw:i8@24"),
    },
}
#: Bodies of definitions by version, with the least length that they declare.
DEFINITIONS = {1: (_DEFINITION_1, 76), 3: (_DEFINITION_3, 126)}
NO_COUNT = 0xFFFF
#: Messages of price levels have exactly these lengths, headers included.
EXACT = {"heartbeat": 16, "trade": 52, "end_of_session": 12, "manifest": 24, "batch_boundary": 16, "instrument_reset": 28, "snapshot_begin": 40, "snapshot_end": 20, "level_update": 48, "book_clear": 36, "snapshot_level": 32}
MESSAGE_HEADER = 4


def _fields(layout: str) -> list[tuple[str, str, int, int]]:
    """name, kind, size and place of each field."""
    made = []
    for field in layout.split():
        name, rest = field.split(":")
        kind, place = rest.split("@")
        made.append((name, kind[0], int(kind[1:]), int(place)))
    return made


def read_fields(messages: DataFrame, layout: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep` of messages and the fields of their bodies; messages whose body is too short for the layout are left out."""
    fields = _fields(layout)
    need = max((place + size for _, _, size, place in fields), default=0)
    schema = ", ".join([*(f"`{k}` {messages.schema[k].dataType.simpleString()}" for k in keep), *(f"{n} {'string' if k == 's' else 'long'}" for n, k, _, _ in fields)])
    form = np.dtype({"names": [n for n, *_ in fields], "formats": [f"S{size}" if kind == "s" else f"<{kind}{size}" for _, kind, size, _ in fields], "offsets": [place for *_, place in fields], "itemsize": max(1, need)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_hand(batches):
            bodies = batch.column(len(keep)).to_pylist()
            rows = np.frombuffer(b"".join(x[:need] for x in bodies), form) if need else np.zeros(len(bodies), form)
            columns = []
            for name, kind, _, _ in fields:
                if kind == "s":
                    # up to the first NUL, whatever follows it
                    columns.append(pa.array([x.split(b"\0", 1)[0].decode(errors="replace") for x in rows[name].tolist()], pa.string()))
                else:
                    columns.append(pa.array(rows[name].astype(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *columns], names=[*keep, *(n for n, *_ in fields)])

    long_enough = messages.where(F.octet_length("body") >= need)
    return long_enough.select(*keep, "body").mapInArrow(run, schema)


def decode(messages: DataFrame, protocol: str, name: str, keep: tuple[str, ...] = ("arrival_seq", "channel", "sequence", "reset_count", "ord")) -> DataFrame:
    """The messages of one type of a protocol, typed. Null bodies give no row, nor do lengths that the protocol refuses."""
    number, layout = next((k, v[1]) for k, v in LAYOUTS[protocol].items() if v[0] == name)
    of = messages.where(F.col("type") == number)
    if protocol == "market_by_price" and name in EXACT:
        of = of.where(F.col("length") == EXACT[name])
    if name == "definition" and protocol != "midpoint":
        made = None
        for version, (by_version, least) in DEFINITIONS.items():
            rows = read_fields(of.where((F.col("version") == version) & (F.col("length") - MESSAGE_HEADER >= least)), by_version, keep)
            made = rows if made is None else made.unionByName(rows, allowMissingColumns=True)
        return made
    found = read_fields(of, layout, keep)
    if name == "book_clear":
        # both sides can only be cleared whole
        found = found.where((F.col("clear_side") != 2) | (F.col("scope") == 0))
    for c in ("order_count", "level_index"):
        if c in found.columns:
            found = found.withColumn(c, F.when(F.col(c) != NO_COUNT, F.col(c)))
    return found


def scaled(raw: Column, exponent: Column) -> Column:
    """A fixed-point number as a double."""
    return raw.cast("double") * F.pow(F.lit(10.0), exponent)


def saturated(qty: Column) -> Column:
    """A size whose bits are an unsigned long: beyond a long it stays at the largest one."""
    return F.when(qty < 0, F.lit((1 << 63) - 1)).otherwise(qty)
