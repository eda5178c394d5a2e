"""Small helpers for functions that run inside ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def ints(column: pa.Array) -> np.ndarray:
    """A null-free integer column as numpy."""
    return column.to_numpy(zero_copy_only=False)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch from numpy arrays, lists or Arrow arrays in the order of ``schema``."""
    made = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column (``kind`` items) or binary column from a flat array and n+1 offsets in items."""
    if pa.types.is_binary(kind):
        data = np.ascontiguousarray(values)
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, each group as one table; the input is sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [ints(b.column(b.schema.get_field_index(k))) for k in keys]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(int(c[0]) for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
        last = tuple(int(c[-1]) for c in columns)
    if held:
        yield pa.Table.from_batches(held)
