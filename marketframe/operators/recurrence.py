"""Exponentially weighted means (adjust=False) as block-wise prefix sums instead of a row-by-row fold.

With decay q = 1 - alpha the recurrence y(t) = q*y(t-1) + alpha*x(t) is linear, so a block of rows can be evaluated on
its own, scaled by q^-j inside the block, and corrected by the state left by the blocks before it. No task ever needs a
whole history: windows span one block, and the table of block states has one row per block.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from marketframe.operators.windows import by_asset, ordered, running

LAST_BITS = 1e-18     # states decayed below this cannot change a double any more


@dataclass(frozen=True)
class Ewm:
    value: str
    alpha: float
    out: str


def block_length(alpha: float) -> int:
    """Longest block whose scaling q^-j stays below 1e60."""
    return max(8, min(256, int(60 * math.log(10) / -math.log(1 - alpha))))


def ewm(df: DataFrame, specs: list[Ewm], keys=("asset_id",), order: str = "ts") -> DataFrame:
    """Add one column per spec. Each mean starts at the first non-null value.

    The values of one call must be null on the same rows, and nulls may only lead.
    """
    keys = list(keys)
    block = min(block_length(s.alpha) for s in specs)
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    by_block = ordered(keys, "_b")
    j = F.pmod(F.col("_k"), F.lit(block))
    df = df.withColumn("_k", F.count(specs[0].value).over(running(ordered(keys, order))) - 1)
    df = df.withColumn("_b", F.floor(F.col("_k") / block))
    weighted = {}
    for i, s in enumerate(specs):
        q = F.lit(1 - s.alpha)
        weight = F.when(F.col("_k") == 0, 1.0).otherwise(s.alpha)
        weighted[f"_l{i}"] = F.when(F.col("_k") >= 0, F.sum(weight * F.col(s.value) * F.pow(q, -j)).over(inside)
                                    * F.pow(q, j))
    df = df.withColumns(weighted)
    names = list(weighted)
    ends = df.where((F.col("_k") >= 0) & (j == block - 1)).select(
        *keys, (F.col("_b") + 1).alias("_b"), *[F.col(n).alias(f"_e{n}") for n in names])
    carries = {}
    for s, n in zip(specs, names):
        depth = max(1, math.ceil(math.log(LAST_BITS) / (block * math.log(1 - s.alpha))))
        carry = F.col(f"_e{n}")
        for back in range(1, depth):
            carry = carry + F.coalesce(F.lag(f"_e{n}", back).over(by_block), F.lit(0.0)) * (1 - s.alpha) ** (block * back)
        carries[f"_c{n}"] = carry
    df = df.join(ends.withColumns(carries).drop(*[f"_e{n}" for n in names]), [*keys, "_b"], "left")
    for s, n in zip(specs, names):
        df = df.withColumn(s.out, F.col(n) + F.coalesce(F.col(f"_c{n}"), F.lit(0.0)) * F.pow(F.lit(1 - s.alpha), j + 1))
    return df.drop("_k", "_b", *names, *carries)


def trailing_ewm(df: DataFrame, column: str, alpha: float, value: str, n: int, out: str, w=None) -> DataFrame:
    """The mean an n-bar slice ending here would give when seeded at its own first bar, from the full-history one.

    Both obey the same recurrence, so they differ by the decayed difference of their seeds; slices shorter than n
    start at the first bar and are the full-history mean itself.
    """
    q = (1 - alpha) ** (n - 1)
    seed_gap = F.lag(F.col(value) - F.col(column), n - 1).over(w or by_asset())
    return df.withColumn(out, F.col(column) + F.coalesce(seed_gap * q, F.lit(0.0)))
