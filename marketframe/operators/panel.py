"""Reads and reshapes of the bar panel. All of them are lazy and stay in long form unless said otherwise."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marketframe.operators.asof import asof_join
from marketframe.operators.windows import by_asset, ordered, row_index


def bars_between(bars: DataFrame, asset_id: str, start: str, end: str) -> DataFrame:
    """Bars of one asset, both ends inclusive, in time order."""
    return bars.where((F.col("asset_id") == asset_id)
                      & F.col("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("ts")


def wide_panel(bars: DataFrame, assets: list[str]) -> DataFrame:
    """One column of closes per asset; dates without any of them do not appear."""
    return bars.where(F.col("asset_id").isin(assets)).groupBy("ts").pivot("asset_id", assets).agg(F.first("close"))


def adjusted(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Split and dividend adjustment at query time; raw prices stay as stored."""
    joined = asof_join(bars, factors, ["asset_id"], "ts", "effective_date",
                       ["cumulative_split_factor", "cumulative_div_adjustment"])
    split = F.coalesce("cumulative_split_factor", F.lit(1.0))
    div = F.coalesce("cumulative_div_adjustment", F.lit(0.0))
    return joined.withColumns({"adj_close": F.col("close") * split + div, "adj_open": F.col("open") * split,
                               "adj_high": F.col("high") * split, "adj_low": F.col("low") * split})


def with_adjustment_factor(bars: DataFrame) -> DataFrame:
    return bars.withColumn("factor", F.when(F.col("close") > 0, F.col("adj_close") / F.col("close")).otherwise(1.0))


def before(bars: DataFrame, as_of: str) -> DataFrame:
    """Point-in-time view: strictly before the clock."""
    return bars.where(F.col("ts") < F.lit(as_of).cast("date"))


def current_bar(bars: DataFrame, as_of: str) -> DataFrame:
    """The latest bar at or before the clock."""
    return bars.where(F.col("ts") <= F.lit(as_of).cast("date")).groupBy("asset_id").agg(
        F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"), F.max_by("volume", "ts").alias("volume"))


def latest_n(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars per asset; the rank filter becomes a per-group limit before the shuffle."""
    w = Window.partitionBy("asset_id").orderBy(F.desc("ts"))
    return bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def latest_released(macro: DataFrame, as_of: str) -> DataFrame:
    return macro.where(F.col("release_date") <= F.lit(as_of).cast("date")).groupBy("series_id").agg(
        F.max_by("value", "release_date").alias("value"), F.max("release_date").alias("release_date"))


def last_n_days(curves: DataFrame, days: int) -> DataFrame:
    newest = curves.agg(F.max("ts")).scalar()
    return curves.where(F.col("ts") >= F.date_sub(newest, days))


def warmed_up(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn("_n", row_index()).where(F.col("_n") > n).drop("_n")


def every_nth(curves: DataFrame, n: int, key: str) -> DataFrame:
    w = ordered(key)
    return curves.withColumn("_n", F.row_number().over(w)).where(F.col("_n") % n == 0).drop("_n")


def first_bar(bars: DataFrame) -> DataFrame:
    """Buy-and-hold entry: the first bar of each asset."""
    return bars.groupBy("asset_id").agg(F.min("ts").alias("ts"), F.min_by("close", "ts").alias("close")).withColumn(
        "direction", F.lit("LONG"))


def ffill_panel(bars: DataFrame) -> DataFrame:
    """Calendar-complete panel: each close is repeated until the asset trades again or the calendar ends.

    Every bar is expanded over the calendar days up to the next bar of its asset and matched with the days that have any
    bar, so no asset-by-date grid is ever built.
    """
    newest = bars.agg(F.max("ts")).scalar()
    until = F.coalesce(F.date_sub(F.lead("ts").over(by_asset()), 1), newest)
    spread = bars.select("asset_id", "close", F.col("ts").alias("_from"), until.alias("_to")).select(
        "asset_id", "close", F.explode(F.sequence("_from", "_to")).alias("ts"))
    return spread.join(bars.select("ts").distinct(), "ts").select("ts", "asset_id", "close")
