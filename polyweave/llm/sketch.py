"""Count-min sketches over a distributed column of 64-bit keys.

Every task counts its own keys into a sparse partition sketch (only the cells
that it touched); the partition sketches are merged block by block, and what
the later passes need, a bit per cell that says "at least two" and, where asked,
one per cell of the first row that says "very many", is broadcast. The broadcast
has a fixed size of ``(depth + 1) * 2**bits / 8`` bytes at most whatever the
corpus, as has what the driver gathers; a larger corpus makes the
estimates larger, never smaller, so users of the sketch lose nothing and only
pass on more rows. ``bits_for`` chooses ``bits`` with the corpus, up to a bound.

Counted are ``2**fine`` cells, which may be more than the broadcast has: a cell
of the broadcast is set if one of the fine cells it covers is. So a large corpus
fills it with the keys that do repeat, and not with all keys.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyweave.llm import arrowkit as A
from polyweave.llm.textkit import mix64

BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS

#: Most bits of the cells that are counted.
FINE = 36

#: Stands in the differences of cells for a step of as many that ends at no cell.
_STEP = (1 << 16) - 1

PARTIAL = "block int, cells binary, counts binary, tags binary"
PARTIAL_FIELDS = [("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary()), ("tags", pa.binary())]
_PARTIAL = pa.schema(PARTIAL_FIELDS)
_MERGED = pa.schema([("block", pa.int32()), ("many", pa.binary()), ("heavy", pa.binary())])

#: Keys that a task gathers before it writes them out as partition sketch rows.
_GATHER = 1 << 20


def bits_for(rows: DataFrame, bytes_per_cell: float, most: int, least: int = 16) -> int:
    """Bits of a sketch with a cell for so many bytes of ``rows``, as the plan estimates their size."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(math.ceil(math.log2(max(size / bytes_per_cell, 1))), least), most)


def fine_for(rows: DataFrame, bytes_per_cell: float, bits: int) -> int:
    """Bits of the cells to count for a broadcast of ``2**bits`` cells: as many as ``rows`` ask for."""
    return min(max(bits, bits_for(rows, bytes_per_cell, FINE)), bits + 19)


def cells_of(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of every key in one row of the sketch."""
    salt = np.uint64(((row + 1) * 0xC2B2AE3D27D4EB4F) & ((1 << 64) - 1))
    return (mix64(keys ^ salt) >> np.uint64(64 - bits)).astype(np.int64)


def block_bits(bits: int, fine: int) -> int:
    """Bits of the fine cells of a block, which covers a byte of the broadcast at least."""
    return BLOCK_BITS if fine <= bits else max(BLOCK_BITS, min(fine - 12, 22), fine - bits + 3)


def _steps(cells: np.ndarray, at: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells as differences within their blocks, which begin at ``at``, and the n+1 offsets of the blocks in them."""
    local = (cells & cells.dtype.type((1 << inner) - 1)).astype(np.int64)
    step = np.diff(local, prepend=0)
    step[at] = local[at]
    skips = step // _STEP
    ends = np.cumsum(skips + 1)
    out = np.full(int(ends[-1]), _STEP, np.uint16)
    out[ends - 1] = step - skips * _STEP
    return out, np.append(ends[at] - skips[at] - 1, ends[-1])


def _cells(steps: pa.Scalar) -> np.ndarray:
    """The cells that ``_steps`` gave for a block."""
    step = np.frombuffer(steps.as_buffer(), np.uint16)
    return np.cumsum(step, dtype=np.int64)[step != _STEP]


class Counter:
    """Partition sketch of one task: the rows of a sketch from ``first`` up to ``depth``."""

    def __init__(self, bits: int, depth: int, first: int = 0, fine: int | None = None):
        self.bits, self.fine, self.first, self.depth, self.keys, self.held = bits, fine or bits, first, depth, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.held += len(keys)
        if self.held >= _GATHER:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What was gathered, as rows; counts stop at 255."""
        if not self.held:
            return
        keys = np.concatenate(self.keys)
        self.keys, self.held = [], 0
        inner = block_bits(self.bits, self.fine)
        for row in range(self.first, self.depth):
            cells = np.sort(cells_of(keys, row, self.fine).astype(np.uint32 if self.fine <= 32 else np.int64))
            new = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            counts = np.minimum(np.diff(np.append(new, len(cells))), 255).astype(np.uint8)
            cells = cells[new]
            blocks = cells >> cells.dtype.type(inner)
            at = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
            offsets = np.append(at, len(cells))
            shift = np.int32(row << max(self.fine - inner, 0))
            yield A.batch(
                _PARTIAL, blocks[at].astype(np.int32) + shift,
                A.ragged(*_steps(cells, at, inner), pa.binary()), A.ragged(counts, offsets, pa.binary()), [None] * len(at),
            )


class TagCounter:
    """Partition sketch of two rows: distinct tags per cell, up to two, and plain counts."""

    def __init__(self, bits: int, fine: int | None = None):
        self.bits, self.fine, self.parts, self.held = bits, fine or bits, [], 0

    def add(self, keys: np.ndarray, tags: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, tags))
        self.held += len(keys)
        if self.held >= _GATHER:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, tags = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.held = [], 0
        plain = Counter(self.bits, 2, first=1, fine=self.fine)
        plain.keys, plain.held = [keys], len(keys)
        yield from plain.rows()
        cells = cells_of(keys, 0, self.fine)
        order = np.lexsort((tags, cells))
        cells, tags = cells[order], tags[order]
        first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        last = np.append(first[1:], len(cells)) - 1
        counts = np.where(tags[first] != tags[last], 2, 1).astype(np.uint8)
        cells, tags = cells[first], tags[first]
        inner = block_bits(self.bits, self.fine)
        blocks = cells >> inner
        at = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
        offsets = np.append(at, len(cells))
        yield A.batch(
            _PARTIAL, blocks[at].astype(np.int32), A.ragged(*_steps(cells, at, inner), pa.binary()),
            A.ragged(counts, offsets, pa.binary()), A.ragged(tags, offsets, pa.binary()),
        )


class Planes:
    """The merged sketch as later passes see it."""

    def __init__(self, bits: int, depth: int):
        self.bits, self.depth = bits, depth
        self.many = np.zeros((depth, max(1 << bits, BLOCK) >> 3), dtype=np.uint8)
        self.heavy: np.ndarray | None = None

    def repeated(self, keys: np.ndarray, rows: tuple[int, ...] | None = None) -> np.ndarray:
        """Whether each key is estimated to have been counted twice or more, by all rows of the sketch or those given."""
        out = np.ones(len(keys), dtype=bool)
        for row in range(self.depth) if rows is None else rows:
            cells = cells_of(keys, row, self.bits)
            out &= (self.many[row][cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 != 0
        return out

    def is_heavy(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is estimated to have the heavy count; by the first row of the sketch."""
        if self.heavy is None:
            return np.zeros(len(keys), dtype=bool)
        cells = cells_of(keys, 0, self.bits)
        return (self.heavy[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 != 0


def merge(partial: DataFrame, bits: int, depth: int, heavy: int | None = None, fine: int | None = None) -> Planes:
    """Add up the partition sketches; every reducer holds one block at a time, its counters or its fine cells. ``heavy`` (255 at most) is the count that is very many."""
    fine = fine or bits
    inner = block_bits(bits, fine)
    per_row, block_cells, covers = 1 << max(fine - inner, 0), 1 << inner, 1 << (fine - bits)

    def packed(bits: np.ndarray) -> bytes:
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, seen = None, np.zeros(BLOCK, np.uint16), np.zeros(BLOCK, np.uint64)

        def ended() -> pa.RecordBatch:
            return A.batch(_MERGED, [now], [packed(counts >= 2)], [packed(counts >= heavy) if heavy and now < per_row else None])

        for b in batches:
            for block, cells, n, tags in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                if block != now:
                    if now is not None:
                        yield ended()
                    now = block
                    counts[:] = 0
                    seen[:] = 0
                cells, n = _cells(cells), np.frombuffer(n.as_buffer(), np.uint8)
                if tags.is_valid:  # a cell with this tag only gains nothing
                    tags = np.frombuffer(tags.as_buffer(), np.uint64)
                    n = np.where((counts[cells] == 1) & (seen[cells] == tags) & (n == 1), 0, n)
                    seen[cells] = tags
                counts[cells] = np.minimum(counts[cells] + n, 255)
        if now is not None:
            yield ended()

    def fold_fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def ended() -> pa.RecordBatch:
            cells, n = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
            tags = np.concatenate([x[2] for x in parts]) if parts[0][2] is not None else None
            order = np.argsort(cells, kind="stable") if tags is None else np.lexsort((tags, cells))
            cells, n = cells[order], n[order].astype(np.int64)
            new = np.concatenate(([True], cells[1:] != cells[:-1]))
            if tags is not None:  # rows of a cell and tag are one, but for those that had met another tag
                tags = tags[order]
                n[1:][~new[1:] & (tags[1:] == tags[:-1]) & (n[1:] == 1)] = 0
            first = np.flatnonzero(new)
            counts = np.add.reduceat(n, first)

            def plane(least: int) -> bytes:
                bits = np.zeros(block_cells // covers, dtype=bool)
                bits[cells[first[counts >= least]] // covers] = True
                return packed(bits)

            return A.batch(_MERGED, [now], [plane(2)], [plane(heavy) if heavy and now < per_row else None])

        for b in batches:
            for block, cells, n, tags in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                if block != now:
                    if now is not None:
                        yield ended()
                    now, parts = block, []
                tags = np.frombuffer(tags.as_buffer(), np.uint64).copy() if tags.is_valid else None
                parts.append((_cells(cells), np.frombuffer(n.as_buffer(), np.uint8).copy(), tags))
        if now is not None:
            yield ended()

    out = Planes(bits, depth)
    if heavy:
        out.heavy = np.zeros_like(out.many[0])
    merged = partial.where(F.col("block").isNotNull()).repartition("block").sortWithinPartitions("block")
    for r in merged.mapInArrow(fold if fine == bits else fold_fine, "block int, many binary, heavy binary").collect():
        row, block = divmod(r.block, per_row)
        many = np.frombuffer(zlib.decompress(bytes(r.many)), np.uint8)
        at = slice(block * len(many), (block + 1) * len(many))
        out.many[row, at] = many
        if r.heavy:
            out.heavy[at] = np.frombuffer(zlib.decompress(bytes(r.heavy)), np.uint8)
    return out
