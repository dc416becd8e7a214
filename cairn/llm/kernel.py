"""Byte-level numpy kernels over Arrow string columns.

Texts are never decoded: a column's UTF-8 buffer is viewed as one uint8 array and words are
runs of bytes that aren't ASCII white space. Word hashes come from one prefix sum of
byte * R**position modulo 2**64, so a word of any length costs two lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd, under 2**62: a product with a 64-bit value fits SQL's HUGEINT.
R = 0x2B5AD4CE9F1D3A75 | 1
PAIR = 0x1F4E5A7B6D2C9083 | 1
SPREAD = 0x27D4EB2F165667C5 | 1
MASK = (1 << 64) - 1
R_INV = pow(R, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 19)
        for k, base in enumerate((R, R_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without copying; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: int | str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text (one row at least), which bounds memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        _, offsets = buffers(column)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of a slice: byte bounds, the row each is in, and each row's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        word = ~space[data]
        before = np.zeros(n + 1, bool)
        before[1:] = word
        before[offsets[:-1]] = False
        begins = word & ~before[:n]
        after = np.zeros(n + 1, bool)
        after[:n] = word
        after[offsets[1:]] = False
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(word & ~after[1:]) + 1
        self.range = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.range)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def first(self) -> np.ndarray:
        """True at the first word of a row."""
        x = np.zeros(len(self.starts) + 1, bool)
        x[self.range[:-1]] = True
        return x[:-1]

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        return span_hashes(self.data if data is None else data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """sum of data[s + i] * R**i over each span, modulo 2**64."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[:-1], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    """The top bits of a multiplicative hash."""
    return ((h * np.uint64(SPREAD)) >> np.uint64(64 - bits)).astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; empty ranges give 0."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] times each, concatenated."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total) + shift
