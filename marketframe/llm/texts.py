"""Words, windows and hashes of whole Arrow batches of texts, as array arithmetic over their UTF-8 bytes.

A batch is taken in chunks of about CHUNK bytes (a longer text is a chunk of its own), so that memory stays bounded whatever the
row count. White space and letters A-Z are single bytes in UTF-8, so byte classes give the same words as the patterns over code
points. Null texts count as empty ones.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_SPLIT = np.ones(256, dtype=bool)
SPACE_SPLIT[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Powers:
    """BASE ** i and its inverse modulo 2 ** 64, grown on demand and kept per worker."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + 1)
            for name, step in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, step, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


class Chunk:
    """Some rows of a batch: rows first..last, their bytes, and the offset of each row in them."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.rows = first, data, offsets, len(offsets) - 1
        self._sums = None

    def words(self, inside: np.ndarray = SPACE_SPLIT, lower: bool = False) -> None:
        """Fill starts, ends (byte positions), row (within the chunk) and hash of every word, in text order."""
        data, off, n = self.data, self.offsets, len(self.data)
        member = inside[data]
        begins, stops = member.copy(), member.copy()
        begins[1:] &= ~member[:-1]
        stops[:-1] &= ~member[1:]
        edges = off[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        begins[edges] |= member[edges]
        stops[edges - 1] |= member[edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.row = np.searchsorted(off, self.starts, side="right") - 1
        up, _ = Powers.upto(n + 1)
        values = BYTE_VALUE[LOWER[data]] if lower else BYTE_VALUE[data]
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=self._sums[1:])
        self.hash = self.span_hash(self.starts, self.ends)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes in [start, end), after words()."""
        _, down = Powers.upto(len(self.data) + 1)
        return mix((self._sums[ends] - self._sums[starts]) * down[starts])

    def count(self, keep: np.ndarray | None = None) -> np.ndarray:
        """Words per row, or of those that keep marks."""
        return np.bincount(self.row if keep is None else self.row[keep], minlength=self.rows)

    def code_points(self) -> np.ndarray:
        """Code points before each byte position, counted from the start of the chunk."""
        out = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def chunks(column: pa.Array, size: int = CHUNK):
    """The chunks of a string column, in order; every row is in exactly one."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset:]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, n)
        yield Chunk(first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


def window_hash(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of size words, and whether it lies within one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        acc = (acc ^ hashes[j:j + n]) * np.uint64(0xFF51AFD7ED558CCD)
        acc ^= acc >> np.uint64(29)
    return mix(acc), row[:n] == row[size - 1:]


def row_sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sum of a value per row of the chunk."""
    return np.bincount(row, weights=values, minlength=rows)


def distinct_per_row(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs ordered by both, and how often each occurs."""
    if not len(row):
        return row, hashes, np.zeros(0, dtype=np.int64)
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return r[at], h[at], np.diff(np.append(at, len(r)))
