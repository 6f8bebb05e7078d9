"""Key-based writes, de-duplication, routing and set operations."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

# Event routes and the order in which simultaneous events are taken.
ROUTES = {"purchase": "FILL", "error": "RISK", "signup": "ORDER", "click": "SIGNAL"}
PRIORITY = ["FILL", "RISK", "ORDER", "SIGNAL", "BAR"]


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert view: one row per key, the last in the given order.

    Written as rank = 1 so that Spark limits every group to one row per map task before the shuffle; a key with any
    number of versions costs the reducers one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti"))


def event_log(df: DataFrame, event_type: str, ts: str, fields: list[str]) -> DataFrame:
    """Audit rows with a JSON payload of the scalar fields."""
    scalar = [f for f in fields if df.schema[f].dataType.typeName() not in ("array", "map", "struct", "binary")]
    return df.select(F.col(event_type), F.unix_timestamp(F.col(ts).cast("timestamp")).alias("epoch"),
                     F.to_json(F.struct(*scalar)).alias("payload"))


def first_positions(df: DataFrame, symbol: str, position: str) -> DataFrame:
    return df.groupBy(symbol).agg(F.min(position).alias("position"))


def routed_events(events: DataFrame) -> DataFrame:
    route = F.lit("BAR")
    for event_type, name in ROUTES.items():
        route = F.when(F.col("event_type") == event_type, name).otherwise(route)
    return events.withColumn("route", route)


def timeline(events: DataFrame, ts: str, seq: str) -> DataFrame:
    """Global order by time, then route priority, then arrival; a range-partitioned sort."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("route")) - 1
    return events.select(F.col(ts).alias("ts"), F.col(seq).alias("seq"), "route", rank.alias("priority")).orderBy(
        "ts", "priority", "seq")


def union_of_universes(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def common_index(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return a.select(*columns).intersect(b.select(*columns))


def merge_bars(cached: DataFrame, fresh: DataFrame, keep: int) -> DataFrame:
    """Append re-read bars, drop exact repeats, keep the newest rows per asset."""
    w = Window.partitionBy("asset_id").orderBy(F.desc("ts"))
    merged = cached.unionByName(fresh).dropDuplicates()
    return merged.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")
