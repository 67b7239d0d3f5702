"""Arrow batches in pieces that bound what a worker turns into objects at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pyarrow as pa


def slices(batches: Iterable[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def gathered(rows: Iterable[tuple], kinds: Sequence[pa.DataType], names: Sequence[str], most: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, however few rows each input gives: a batch costs far more than a row."""
    rows = iter(rows)
    while some := list(islice(rows, most)):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names=list(names))


def objects(column: pa.Array) -> list:
    """``to_pylist`` with structs as tuples; lists and structs are taken apart by columns, which is far quicker than by values."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        values, out, at = objects(column.flatten()), [], 0
        for n in column.value_lengths().fill_null(-1).to_numpy().tolist():
            out.append(None if n < 0 else values[at : at + n])
            at += max(n, 0)
        return out
    if pa.types.is_struct(column.type) and not column.null_count:
        return list(zip(*map(objects, column.flatten())))
    number = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    if pa.types.is_string(column.type) or (number and not column.null_count):
        # Several times as fast as one value after the other.
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()
