"""Hashed bitmaps of fixed size, filled by Spark and broadcast: a filter that never loses a key and lets others through when crowded."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from marketframe.llm.storage import arrays

#: bits of one bitmap: 4 MB, whatever the number of keys
BITS = 1 << 25


def fill(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap of the long column k of keys, as 64-bit words. At most bits / 64 rows reach the driver."""
    at = F.pmod(F.col("k"), F.lit(bits))
    found = arrays(keys.select(F.shiftright(at, 6).alias("w"), (at.bitwiseAND(F.lit(63))).cast("int").alias("b"))
                   .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")))
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found["w"]] = found["v"].view(np.uint64)
    return out


def holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the bitmap."""
    at = np.mod(np.asarray(keys).view(np.int64), len(bitmap) * 64)
    return ((bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def row_key(*columns: str) -> Column:
    """One long for a row."""
    return F.xxhash64(*columns).alias("k")
