"""Window building blocks.

Rolling frames here are strict: like pandas rolling(n), a value is null until n observations are in the frame, while
Spark frames alone would already aggregate a shorter one.

Bound on group size: panels are keyed by (asset_id, ts DATE), curves by (portfolio_id, ts DATE), so one window partition
holds at most one row per calendar day. Tables without that bound (fills, signals, trades) use operators/prefix.py,
aggregates, or per-group top-k with WindowGroupLimit instead.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def ordered(keys, order="ts") -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def by_asset() -> WindowSpec:
    return ordered("asset_id")


def trailing(n: int, w: WindowSpec | None = None, end: int = 0) -> WindowSpec:
    return (w or by_asset()).rowsBetween(end - n + 1, end)


def running(w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_asset()).rowsBetween(Window.unboundedPreceding, 0)


def roll(agg: Callable[[Column], Column], x, n: int, w: WindowSpec | None = None, end: int = 0, least: int | None = None) -> Column:
    """agg(x) over the last n rows (ending `end` rows from here), null until `least` (default n) non-null values."""
    col = F.col(x) if isinstance(x, str) else x
    frame = trailing(n, w, end)
    return F.when(F.count(col).over(frame) >= (n if least is None else least), agg(col).over(frame))


def with_means(df: DataFrame, x: str, lengths: dict[str, int], w: WindowSpec | None = None) -> DataFrame:
    """Strict rolling means of a column without nulls, as differences of one running sum.

    A sliding frame visits every row of the frame again; the running sum costs the same for any length, which pays off
    when many or long means are taken over one panel.
    """
    w = w or by_asset()
    df = df.withColumns({"_sum": F.sum(x).over(running(w)), "_at": F.row_number().over(w)})
    means = {name: F.when(F.col("_at") >= n, (F.col("_sum") - F.coalesce(F.lag("_sum", n).over(w), F.lit(0.0))) / n)
             for name, n in lengths.items()}
    return df.withColumns(means).drop("_sum", "_at")


def with_deviations(df: DataFrame, x: str, lengths: dict[str, int], w: WindowSpec | None = None) -> DataFrame:
    """Strict rolling sample deviations from running sums of x and x*x; for values around zero such as returns.

    Nulls of x may only lead (the first return of a series has none).
    """
    w = w or by_asset()
    df = df.withColumns({"_s1": F.sum(x).over(running(w)), "_s2": F.sum(F.col(x) * F.col(x)).over(running(w)),
                         "_at": F.count(x).over(running(w))})
    out = {}
    for name, n in lengths.items():
        s1 = F.col("_s1") - F.coalesce(F.lag("_s1", n).over(w), F.lit(0.0))
        s2 = F.col("_s2") - F.coalesce(F.lag("_s2", n).over(w), F.lit(0.0))
        out[name] = F.when(F.col("_at") >= n, F.sqrt(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / (n - 1)))
    return df.withColumns(out).drop("_s1", "_s2", "_at")


def pct_change(x: str, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.col(x) / F.lag(x, k).over(w or by_asset()) - 1


def log_return(x: str = "close", k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.ln(F.col(x) / F.lag(x, k).over(w or by_asset()))


def row_index(w: WindowSpec | None = None) -> Column:
    return F.row_number().over(w or by_asset()).cast("long")


def shifted_signal(df: DataFrame, raw: str = "raw", out: str = "signal", w: WindowSpec | None = None) -> DataFrame:
    """The one-bar delay that keeps a signal free of look-ahead; the first bar is flat."""
    return df.withColumn(out, F.lag(raw, 1, 0).over(w or by_asset()).cast("long"))


def state_changes(df: DataFrame, event: str = "event", initial: str = "FLAT", out: str = "direction",
                  w: WindowSpec | None = None) -> DataFrame:
    """Rows where the held state changes; `event` is the state asked for on this row, null for 'keep'."""
    held = df.withColumn("_state", F.coalesce(F.last(event, ignorenulls=True).over(running(w)), F.lit(initial)))
    before = F.lag("_state", 1, initial).over(w or by_asset())
    return held.withColumn("_before", before).where(F.col("_state") != F.col("_before")) \
        .withColumnRenamed("_state", out).drop("_before")


def first_of_month(ts: str = "ts", w: WindowSpec | None = None) -> Column:
    """True on the first row of each calendar month (also on the very first row)."""
    return F.coalesce(F.trunc(ts, "month") != F.lag(F.trunc(ts, "month")).over(w or by_asset()), F.lit(True))
