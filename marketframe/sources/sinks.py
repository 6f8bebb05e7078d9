"""Batch sinks: append with a run date, upsert by partition, JSON export."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketframe.operators.sets import keep_last


def append_run(df: DataFrame, path: str, run_date: str) -> None:
    """Results of one run; re-running a date replaces that date only."""
    (df.withColumn("run_date", F.lit(run_date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date").parquet(path))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], partition: str, path: str) -> None:
    """Rewrite only the partitions that receive rows; inside them the incoming row wins.

    `existing` must not be read from `path` itself while it is overwritten: pass a snapshot or another location.
    """
    touched = incoming.select(partition).distinct()
    old = existing.join(touched, partition, "left_semi").withColumn("_seq", F.lit(0))
    merged = keep_last(old.unionByName(incoming.withColumn("_seq", F.lit(1))), keys, ["_seq"]).drop("_seq")
    (merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def write_bars(bars: DataFrame, path: str) -> None:
    """Layout of the bar store: partitions by year, clustered by asset and date inside a file, so range scans prune."""
    (bars.withColumn("year", F.year("ts")).repartitionByRange("year", "asset_id").sortWithinPartitions("asset_id", "ts")
     .write.mode("overwrite").partitionBy("year").parquet(path))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
