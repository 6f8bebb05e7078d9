"""Combining the signals of several strategies into one direction per asset and day."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_day(signals: DataFrame) -> DataFrame:
    """The signal of each strategy that stands at the end of a day: later ones replace earlier ones."""
    w = Window.partitionBy("asset_id", "day", "strategy_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return (signals.withColumn("day", F.col("ts").cast("date")).withColumn("_n", F.row_number().over(w))
            .where("_n = 1").drop("_n"))


def numeric(direction: str = "direction") -> Column:
    return F.when(F.col(direction) == "LONG", 1.0).when(F.col(direction) == "SHORT", -1.0).otherwise(0.0)


def direction_of(score: Column, threshold: float = 0.25) -> Column:
    return F.when(score > threshold, "LONG").when(score < -threshold, "SHORT").otherwise("FLAT")


def majority(votes: DataFrame, keys=("asset_id", "day")) -> DataFrame:
    """Plurality with ties going to LONG, then SHORT; confidence is the winner's share."""
    share = {d: F.count(F.when(F.col("direction") == d, 1)) for d in ("LONG", "SHORT", "FLAT")}
    agg = votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"_{d}") for d, c in share.items()])
    top = F.greatest("_LONG", "_SHORT", "_FLAT")
    return agg.withColumns({
        "direction": F.when(F.col("_LONG") == top, "LONG").when(F.col("_SHORT") == top, "SHORT").otherwise("FLAT"),
        "confidence": top / F.col("n"), "net_score": (F.col("_LONG") - F.col("_SHORT")) / F.col("n")}).drop("_LONG", "_SHORT", "_FLAT")


def weighted(votes: DataFrame, keys=("asset_id", "day"), threshold: float = 0.25) -> DataFrame:
    """Confidence-weighted mean direction; the count replaces a total confidence of zero."""
    agg = votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("_c"),
                                   F.sum(F.col("confidence") * numeric()).alias("_s"))
    score = F.col("_s") / F.when(F.col("_c") == 0, F.col("n")).otherwise(F.col("_c"))
    return agg.withColumn("net_score", score).withColumns({
        "direction": direction_of(F.col("net_score"), threshold), "confidence": F.least(F.lit(1.0), F.abs("net_score"))}).drop("_c", "_s")


def orthogonal(votes: DataFrame, keys=("asset_id", "day"), threshold: float = 0.25) -> DataFrame:
    """Strategies of one type pointing the same way count once, with their mean confidence."""
    collapsed = votes.groupBy(*keys, "signal_type", "direction").agg(F.avg("confidence").alias("confidence"))
    return weighted(collapsed, keys, threshold)


def breakdown(votes: DataFrame, keys=("asset_id", "day"), least: int = 2) -> DataFrame:
    """Contributing strategies and their votes, one entry per strategy, where at least `least` voted."""
    entry = F.struct("strategy_id", "direction")
    agg = votes.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_v")).where(F.size("_v") >= least)
    return agg.select(*keys, F.array_join(F.col("_v.strategy_id"), ",").alias("contributors"),
                      F.map_from_entries("_v").alias("votes"))
