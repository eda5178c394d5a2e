"""Vectorised text primitives shared by the training-data operators.

All functions work on a whole Arrow column at once: they look at the UTF-8
bytes of the column as one numpy array and never loop over words in Python.
Words are maximal runs of bytes outside ``SPACE`` (0x20 and 0x09-0x0D), which
is the byte form of ``[^\\x20\\x09-\\x0D]+``; a word never spans two rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; bounds the working set of one Python worker.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Byte table that lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)

#: Odd multipliers of the n-gram polynomials; two of them make a 128-bit digest.
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 row offsets into them (null rows are empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, first = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=first + n + 1)[first:]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes each; a longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word offsets of the rows (n+1)."""
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, folded eight bytes at a time."""
    lengths = ends - starts
    out = lengths.astype(np.uint64) * _M1
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    todo, at = None, 0
    while True:
        rows = np.flatnonzero(lengths > at) if todo is None else todo[lengths[todo] > at]
        if not len(rows):
            return out
        block = eight[starts[rows] + at]
        left = np.minimum(lengths[rows] - at, 8).astype(np.uint64)
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
        out[rows] = mix64(out[rows] ^ block) * _M1
        todo, at = rows, at + 8


def ngrams(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Order-sensitive hash of each run of ``n`` consecutive items (shorter by n-1), by doubling."""
    if len(hashes) < n:
        return hashes[:0]
    mask, power = (1 << 64) - 1, {1: hashes}
    width = 1
    while width * 2 <= n:
        half = power[width]
        power[width * 2] = half[:-width] * np.uint64(pow(base, width, 1 << 64)) + half[width:]
        width *= 2
    out, done = None, 0
    for width in sorted(power, reverse=True):
        if done + width <= n:
            part = power[width]
            if out is None:
                out = part
            else:
                m = len(hashes) - done - width + 1
                out = out[:m] * np.uint64(pow(base, width, 1 << 64) & mask) + part[done : done + m]
            done += width
    return mix64(out)


def row_of(word_offsets: np.ndarray) -> np.ndarray:
    """Row number of every word."""
    return np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))
