"""UTF-8 bytes of an Arrow text column as numpy arrays, and vectorised hashes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial hash (fixed value: golden ratio of 2^64).
MULT = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
INVERSE = pow(MULT, -1, 1 << 64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is an empty one."""
    col = column.fill_null("") if column.null_count else column
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1, offset=col.offset * 8)
    if len(col) == 0 or col.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``most`` text bytes (a longer text stays whole, alone)."""
    _, off = utf8(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: equal values stay equal, bits are spread."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(MULT))


_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the multiplier and of its inverse, kept for the next call."""
    if len(_POWERS[0]) <= n:
        for i, base in enumerate((MULT, INVERSE)):
            p = np.full(2 * n + 2, base, U64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[i] = p
    return _POWERS[0][:n + 1], _POWERS[1][:n + 1]


class Prefix:
    """Polynomial prefix hashes (mod 2^64) of a byte array: the hash of any slice in O(1)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _powers(n)
        self.sum = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_CODES[data] * up[:n], out=self.sum[1:])

    def every(self, size: int) -> np.ndarray:
        """Hash of every slice of ``size`` bytes, by its start (not comparable with ``slice``)."""
        h = self.sum[size:] - self.sum[:-size]
        h *= self.down[:len(h)]
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(32)
        return h

    def slice(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end]; the length is part of it."""
        h = (self.sum[end] - self.sum[start]) * self.down[start]
        return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; a word never crosses rows."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= space[1:]
    tails = off[1:][off[:-1] < off[1:]] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1
