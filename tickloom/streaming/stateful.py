"""Operators whose verdict on a row depends on verdicts before it: typed state of a key, on a stream or on a whole table.

Spark keeps the state of each key and deals rows by key. Of one micro-batch the rows of a key are put in order and held by a task, so the
source's trigger bounds them; between micro-batches the source has to deliver them in order. State is read once and written once a
key and micro-batch: a call to the state store costs about half a millisecond, so it isn't asked row by row.

On a table that isn't a stream the same steps run once over all rows: Spark sorts them by key and order, and a task reads them one after
another, so that it holds a key's state and never its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State of a key (None at first) and a row: the new state and the row's own new columns. States may be changed in place.
Step = Callable[[object, Row], tuple[object, tuple]]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Kept:
    """How a state object is kept: schema of its typed columns, and the way there and back."""

    def __init__(self, schema: str, pack: Callable[[object], tuple] = tuple, unpack: Callable[[Row], object] = tuple):
        self.schema, self.pack, self.unpack = schema, pack, unpack


def _place(row: Row, order: Sequence[str]) -> tuple:
    return tuple((row[c] is not None, row[c]) for c in order)


class _Steps(StatefulProcessor):
    def __init__(self, order: Sequence[str], step: Step, kept: Kept, columns: Sequence[str], names: Sequence[str], idle_ms: int | None):
        self.order, self.step, self.kept, self.columns, self.names, self.idle_ms = list(order), step, kept, list(columns), list(names), idle_ms
        self.fields = T.StructType.fromDDL(kept.schema).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.kept.schema, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        state, out = None if held is None else self.kept.unpack(Row(*self.fields)(*held)), Row(*self.names)
        for row in sorted(rows, key=lambda r: _place(r, self.order)):
            state, made = self.step(state, row)
            yield out(*[row[c] for c in self.columns], *made)
        self.state.update(self.kept.pack(state))

    def handleInitialState(self, key, first: Row, timers) -> None:
        self.state.update(tuple(first[c] for c in self.fields))

    def close(self) -> None:
        pass


#: Rows of a batch that a table's steps send on.
BATCH = 2_000


def _row(value, kind: T.DataType):
    """A value that Arrow gives, with rows for its structs."""
    if value is None or not isinstance(kind, (T.StructType, T.ArrayType)):
        return value
    if isinstance(kind, T.ArrayType):
        return [_row(v, kind.elementType) for v in value]
    return Row(*kind.names)(*[_row(value[f.name], f.dataType) for f in kind.fields])


def values_of(column: pa.Array) -> list:
    """Python's values of a column; of numbers, and of strings that repeat, by ways that are quicker than to_pylist()."""
    kind = column.type
    if column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    if column.null_count == 0 and (pa.types.is_string(kind) or pa.types.is_large_string(kind)):
        found = column.dictionary_encode()
        if 4 * len(found.dictionary) < len(column):
            words = found.dictionary.to_pylist()
            return [words[i] for i in found.indices.to_numpy().tolist()]
    return column.to_pylist()


def _over_table(rows: DataFrame, key: Sequence[str], order: Sequence[str], step: Step, kept: Kept, made: str, first: DataFrame | None, reads: Sequence[str] | None, values: Mapping[str, Callable[[pa.Array], list]]) -> DataFrame:
    """in_order() of a table: a key's rows are a run of sorted ones. A state to begin with comes before them, as a row of its own."""
    new, fields = T.StructType.fromDDL(made), T.StructType.fromDDL(kept.schema)
    schema, columns = T.StructType([*rows.schema.fields, *new.fields]), list(rows.columns)
    read = columns if reads is None else list(dict.fromkeys([*key, *reads]))
    steps = rows.withColumn("_own", F.lit(True))
    begins = first is not None
    if begins:
        began = first.select(*key, F.struct(*fields.names).alias("_first"), F.lit(False).alias("_own"))
        steps = steps.unionByName(began, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(new)

        def each() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    part = batch.slice(at, BATCH)
                    given = [values.get(c, values_of)(part.column(part.schema.get_field_index(c))) for c in read]
                    firsts = part.column(part.schema.get_field_index("_first")).to_pylist() if begins else None
                    own = part.column(part.schema.get_field_index("_own"))
                    yield (part.filter(own) if begins else part).select(columns), [dict(zip(read, v, strict=True)) for v in zip(*given, strict=True)], values_of(own), firsts

        last, state = None, None
        for part, found, own, firsts in each():
            out = []
            for i, row in enumerate(found):
                k = tuple(row[c] for c in key)
                if k != last:
                    last, state = k, None
                if own[i]:
                    state, new_values = step(state, row)
                    out.append(new_values)
                else:
                    state = kept.unpack(_row(firsts[i], fields))
            if out:
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=schema.names)

    # by a hash of its own: a repartition by columns that a join has just dealt by would be left out, and such a join may split a key
    dealt = steps.repartition(F.xxhash64(*key)).sortWithinPartitions(*key, "_own", *order)
    return dealt.mapInArrow(run, schema)


def in_order(rows: DataFrame, key: Sequence[str], order: Sequence[str], step: Step, kept: Kept, made: str, idle_ms: int | None = None, first: DataFrame | None = None, reads: Sequence[str] | None = None, values: Mapping[str, Callable[[pa.Array], list]] | None = None) -> DataFrame:
    """rows with more columns (`made`, as DDL), by step(state, row) over the rows of a key in order; nulls come first.

    idle_ms: forget a key that got no row for so long (by the cluster's clock); None keeps it for ever. first: states to begin with,
    the key's columns and those of kept.schema, one row a key. No rows give no rows; values come through as they are, nulls too.
    reads: the columns that the step reads (all by default); on a table no others become Python's. values: how a table's columns do, where
    rows as dicts aren't wanted.
    """
    if not rows.isStreaming:
        return _over_table(rows, key, order, step, kept, made, first, reads, values or {})
    spark = rows.sparkSession
    spark.streams  # noqa: B018  starts what state stores register with; a table's query doesn't by itself
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(made).fields])
    steps = _Steps(order, step, kept, rows.columns, schema.names, idle_ms)
    return rows.groupBy(*key).transformWithState(steps, schema, "append", "none" if idle_ms is None else "processingTime", first.groupBy(*key) if first is not None else None)
