"""Running totals over groups of any size.

A plain window would put one group into one task. Here the order is split into levels, coarse to fine (say day, id range,
id): sums per block of rows are aggregated map-side and written once, prefix sums run over that small table level by
level, and only the finest level runs over rows, inside one block at a time. The rows themselves are shuffled once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marketframe.session import durable

ID_RANGE = 1 << 16


def id_block(column: str):
    """Ranges of ids; a unique id bounds the rows per range by ID_RANGE."""
    return F.floor(F.col(column) / ID_RANGE)


def _rows_before(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _carried(blocks: DataFrame, keys: list[str], levels: list[str], columns: dict[str, str], agg, combine) -> DataFrame:
    """For every block the aggregate of `columns` over all earlier blocks of its key, as {column: output}.

    Earlier blocks of the same coarse level come from a window inside that level, everything before it from the coarse
    level's own (recursively carried) totals.
    """
    here = _rows_before([*keys, *levels[:-1]], levels[-1])
    out = blocks.withColumns({f"_h_{o}": agg(c).over(here) for c, o in columns.items()})
    if len(levels) > 1:
        names = [*keys, *levels[:-1]]
        coarse = blocks.groupBy(*names).agg(*[agg(c).alias(c) for c in columns])
        above = _carried(coarse, keys, levels[:-1], columns, agg, combine).select(*names, *[F.col(o).alias(f"_u_{o}") for o in columns.values()])
        out = out.join(above, names).withColumns({o: combine(F.col(f"_h_{o}"), F.col(f"_u_{o}")) for o in columns.values()})
        return out.drop(*[f"_{p}_{o}" for o in columns.values() for p in "hu"])
    return out.withColumns({o: F.col(f"_h_{o}") for o in columns.values()}).drop(*[f"_h_{o}" for o in columns.values()])


def prefix_totals(df: DataFrame, keys: list[str], levels: list[str], totals: dict[str, str], lowest: str | None = None) -> DataFrame:
    """Add running sums {value: output} per key in the order of `levels` (the last level orders single rows).

    `lowest` adds the running minimum of the first sum, needed where a balance may not fall below zero.
    """
    block = [*keys, *levels[:-1]]
    fine = Window.partitionBy(*block).orderBy(levels[-1]).rowsBetween(Window.unboundedPreceding, 0)
    inside = {f"_in_{o}": F.sum(v).over(fine) for v, o in totals.items()}
    first = next(iter(totals.values()))
    sums = [F.sum(v).alias(o) for v, o in totals.items()]
    if lowest:
        source = df.withColumn("_p", inside[f"_in_{first}"])
        blocks = source.groupBy(*block).agg(*sums, F.min("_p").alias("_min"))
    else:
        blocks = df.groupBy(*block).agg(*sums)
    blocks = durable(blocks)
    plus = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    offsets = {o: f"_off_{o}" for o in totals.values()}
    table = _carried(blocks, keys, levels[:-1], offsets, F.sum, plus)
    if lowest:
        reached = table.withColumn("_reached", F.col("_min") + F.col(f"_off_{first}"))
        table = _carried(reached, keys, levels[:-1], {"_reached": "_low_before"}, F.min, F.least)
    extra = ["_low_before"] if lowest else []
    out = df.withColumns(inside).join(table.select(*block, *offsets.values(), *extra), block)
    if lowest:
        out = out.withColumn("_lo", F.min(f"_in_{first}").over(fine))
    out = out.withColumns({o: F.col(f"_in_{o}") + F.col(f"_off_{o}") for o in totals.values()})
    if lowest:
        out = out.withColumn(lowest, F.least(F.col("_lo") + F.col(f"_off_{first}"), "_low_before"))
    return out.drop(*inside, *offsets.values(), "_low_before", "_lo")
