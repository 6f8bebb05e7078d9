"""Arrays sorted by hash."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from marketframe.llm.texts import mix


class HashArray:
    """Keys sorted by hash with one or more values each, found through an index of the leading bits."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        h = mix(keys)
        order = np.argsort(h)
        self.hash, self.values = h[order], [v[order] for v in values]
        self.bits = max(4, int(len(keys)).bit_length())
        lead = (self.hash >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of every key, -1 where absent."""
        h = mix(keys)
        lead = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        out = np.full(len(keys), -1, dtype=np.int32)
        open_ = np.flatnonzero(at < end)
        for j in range(self.longest):
            p = at[open_] + j
            same = self.hash[p] == h[open_]
            out[open_[same]] = p[same]
            open_ = open_[~same]
            open_ = open_[at[open_] + j + 1 < end[open_]]
        return out


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed counts."""
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


class Tally:
    """Counts of 64-bit keys within a task, merged as they come and handed on when there are more than most of them."""

    def __init__(self, names: tuple[str, str], most: int = 2_000_000, rows: int = 100_000):
        self.names, self.most, self.rows = list(names), most, rows
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > self.most:
            key, n = merge_counts(self.keys, self.counts)
            self.keys, self.counts, self.waiting = [key], [n], len(key)
            if self.waiting > self.most // 2:
                yield from self.end()

    def end(self):
        if self.keys:
            key, n = merge_counts(self.keys, self.counts)
            self.keys, self.counts, self.waiting = [], [], 0
            for i in range(0, len(key), self.rows):
                yield pa.RecordBatch.from_arrays([pa.array(key[i:i + self.rows].view(np.int64)), pa.array(n[i:i + self.rows])], names=self.names)
