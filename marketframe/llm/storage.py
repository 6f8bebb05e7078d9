"""Intermediate tables as Parquet in the shared folder: they cut lineage, survive lost executors and are read by column."""
from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame

from marketframe.session import shared_dir


#: rows per Arrow batch: texts and pages may be long, and a batch stands in memory on both sides
BATCH_ROWS = "1000"


def small_batches(spark) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


class Shelf:
    """Tables of one job. drop() removes one that nothing reads any more; those that a returned DataFrame still reads go with the driver."""

    def __init__(self, spark, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self.clear)

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """The table that df is written to; by is a column whose values become folders."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, partitionBy=by)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._remove(self.paths.pop(id(df)))

    def clear(self) -> None:
        """Remove what is left of the job. A driver that is killed leaves it to whoever clears the shared folder."""
        with contextlib.suppress(Exception):
            self._remove(self.root)

    def _remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def arrays(df: DataFrame) -> dict:
    """A result of bounded size as one NumPy array per column, without a Python object per row."""
    found = df.toArrow()
    return {name: found.column(name).to_numpy() for name in found.column_names}
