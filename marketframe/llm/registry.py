"""Registration of this package's queries and of the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketframe.llm.storage import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    import importlib
    for module in ("toxicity", "decontamination", "similarity", "mixing", "secrets", "warc", "perplexity", "brown", "licenses", "wrappers", "substrings", "merkle", "collocations"):
        importlib.import_module(f"marketframe.llm.{module}")
    return dict(QUERIES), dict(ORACLES)
