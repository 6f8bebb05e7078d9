"""Session settings the engine relies on, and where durable scratch data goes."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str = "8", app: str = "marketframe") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
               .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
               .config("spark.driver.memory", "12g")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(spark: SparkSession) -> SparkSession:
    """Settings that results depend on, also in sessions that others have made."""
    for key in ("spark.sql.session.timeZone", "spark.sql.sources.partitionOverwriteMode"):
        if spark.conf.get(key, None) != DEFAULTS[key]:
            spark.conf.set(key, DEFAULTS[key])
    return spark


#: application id -> temporary folder, for local masters without a shared one
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one only on a local master where it is unset."""
    app = spark.sparkContext.applicationId
    current = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(app)
    if not current:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # the setting is fixed once a session runs, so the folder is remembered here
        current = _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return current


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives lost executors."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(os.path.join(shared_dir(spark), "lineage"))
    return df.checkpoint(eager)
