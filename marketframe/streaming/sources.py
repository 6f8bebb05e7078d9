"""File streams and the sinks the streaming jobs write to."""
from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketframe.session import shared_dir


def table_stream(spark: SparkSession, path: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table directory or file as a stream, with the schema of what is there now."""
    location = f"{path}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(location).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a glob matches a single file as well as a table directory; a plain path has to be a directory
    return reader.parquet(f"{path}/{name}[.]parquet")


def ticks(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events as price ticks with a zoned timestamp, which watermarks need."""
    events = table_stream(spark, path, "events", files_per_trigger)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).select(
        "event_id", "ts", "user_id", F.col("event_type").alias("asset_id"), F.col("value").alias("price"))


def replay(df: DataFrame, time: str, job: str, unit: str = "year", files: int = 4) -> DataFrame:
    """A stored table as a stream in order of time: `files` files per unit of time, written unit after unit, and as many read per micro-batch.

    Rows of one unit come in any order, so a watermark on the stream needs a delay of one unit, whatever the span of the table.
    """
    spark, where = df.sparkSession, new_location(df.sparkSession, f"{job}-feed")
    units = [r.u for r in df.select(F.date_trunc(unit, F.col(time)).alias("u")).where("u IS NOT NULL").distinct().orderBy("u").collect()]
    df.limit(0).write.parquet(where)
    for u in units:
        df.where(F.date_trunc(unit, F.col(time)) == F.lit(u)).repartition(files).write.mode("append").parquet(where)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(where)


def run_with_history(stream: DataFrame, history: DataFrame, job: str, rows: int, compute: Callable[[DataFrame], DataFrame], out_schema,
                     key: str = "asset_id", time: str = "ts") -> DataFrame:
    """Indicators of a bar stream that starts warm: every micro-batch is computed behind the last `rows` bars of each key before it.

    Those come from the stored history and from the batches written so far, so the first live bar has full windows and a restart
    resumes with them. A micro-batch brings later bars than those before it, and overwrites its own folder when it is replayed.
    """
    spark = stream.sparkSession
    where = new_location(spark, job)
    columns = stream.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(*columns)
        past = history.select(*columns)
        if batch_id:
            past = past.union(spark.read.schema(batch.schema).parquet(*[f"{where}/bars/batch={i}" for i in range(batch_id)]).select(*columns))
        batch.write.mode("overwrite").parquet(f"{where}/bars/batch={batch_id}")
        starts = batch.groupBy(key).agg(F.min(time).alias("_start"))
        newest = Window.partitionBy(key).orderBy(F.desc(time))
        before = (past.join(starts, key).where(F.col(time) < F.col("_start")).withColumn("_n", F.row_number().over(newest))
                  .where(F.col("_n") <= rows).withColumn("_live", F.lit(False)).drop("_n", "_start"))
        both = before.unionByName(batch.withColumn("_live", F.lit(True)))
        compute(both).where("_live").select(*out_schema.fieldNames()).write.mode("overwrite").parquet(f"{where}/out/batch={batch_id}")

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(out_schema).parquet(f"{where}/out").select(*out_schema.fieldNames())


def new_location(spark: SparkSession, job: str) -> str:
    return os.path.join(shared_dir(spark), "streams", f"{job}-{uuid.uuid4().hex[:12]}")


def run_to_parquet(stream: DataFrame, job: str, mode: str = "append") -> DataFrame:
    """Process everything available, append to Parquet exactly once, and read the result back."""
    spark = stream.sparkSession
    where = new_location(spark, job)
    (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{where}/out")
     .option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def run_batches(stream: DataFrame, job: str, transform: Callable[[DataFrame], DataFrame], out_schema) -> DataFrame:
    """Apply a batch transformation to each micro-batch.

    A batch overwrites its own folder, so a batch replayed after a failure leaves the same files.
    """
    spark = stream.sparkSession
    where = new_location(spark, job)

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{where}/out/batch={batch_id}")

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(out_schema).parquet(f"{where}/out").select(*out_schema.fieldNames())
