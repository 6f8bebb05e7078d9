"""Ordered linear recurrences y(t) = a(t) * y(t-1) + b(t) over groups of any size.

Two such steps compose into one of the same form, so every block of rows is reduced to a single step, the steps of the
blocks are scanned the same way one level up, and the state entering a block is then applied to its rows. With the order
split into levels (day, id range, id) no task sees more than one block of one level.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marketframe.session import durable


def _scan_blocks(df: DataFrame, block: list[str], order: str) -> DataFrame:
    """Composite step from the start of the block through each row (_pa, _pb) and up to just before it (_ea, _eb)."""
    extra = ["_pa", "_pb", "_ea", "_eb"]
    schema = StructType(df.schema.fields + [StructField(c, DoubleType()) for c in extra])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        last, pa, pb = None, 1.0, 0.0
        for pdf in batches:
            keys = list(zip(*[pdf[k] for k in block]))
            out = np.empty((4, len(pdf)))
            for i, (key, a, b) in enumerate(zip(keys, pdf["_a"].to_numpy(), pdf["_b"].to_numpy())):
                if key != last:
                    last, pa, pb = key, 1.0, 0.0
                out[2, i], out[3, i] = pa, pb
                pa, pb = a * pa, a * pb + b
                out[0, i], out[1, i] = pa, pb
            yield pdf.assign(**dict(zip(extra, out)))

    return df.repartition(*block).sortWithinPartitions(*block, order).mapInPandas(run, schema)


def affine_scan(df: DataFrame, keys: list[str], levels: list[str], a: str, b: str, before: str, after: str) -> DataFrame:
    """Add the state before and after each row, starting from 0, in the order of `levels` inside `keys`."""
    base = df.withColumns({"_a": F.col(a).cast("double"), "_b": F.col(b).cast("double")})
    block = [*keys, *levels[:-1]]
    local = _scan_blocks(base, block, levels[-1])
    if len(levels) == 1:
        return local.withColumns({before: F.col("_eb"), after: F.col("_pb")}).drop("_a", "_b", "_pa", "_pb", "_ea", "_eb")
    local = durable(local)
    ends = local.groupBy(*block).agg(F.max_by("_pa", levels[-1]).alias("_ba"), F.max_by("_pb", levels[-1]).alias("_bb"))
    enter = f"_in{len(levels)}"
    entering = affine_scan(ends, keys, levels[:-1], "_ba", "_bb", enter, f"_out{len(levels)}").select(*block, enter)
    out = local.join(entering, block)
    return out.withColumns({before: F.col("_ea") * F.col(enter) + F.col("_eb"), after: F.col("_pa") * F.col(enter) + F.col("_pb")}).drop(
        "_a", "_b", "_pa", "_pb", "_ea", "_eb", enter)
