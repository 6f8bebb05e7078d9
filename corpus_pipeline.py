"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, mixing to target weights.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's rows as Parquet in the shared folder and reads them again, so that a
lost executor repeats one stage at most.

Odd rows: null and empty texts are clean, unlike everything, and hold no benchmark passage or secret, so they reach the mixing
stage, which draws them like other rows of their source; null ids are kept; rows that repeat a document are copies, of which
one stays; an empty table passes through; columns beyond those of documents are kept under their names, except copy, copies and shuffle_key,
which the last stage sets.
"""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketframe.llm import decontamination, mixing, secrets, similarity, toxicity
from marketframe.llm.registry import table
from marketframe.session import shared_dir

#: near-duplicate stages take five words and a similarity of 0.8
NEAR = similarity.Rule(5, 80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7, by a model fitted on training labels."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels, train=toxicity.TRAIN))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of an overlap of 80 % or more in shingles of five words: the one with the smallest id."""
    return similarity.keep_one(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, n_chars counted again where the text changed."""
    clean = secrets.redact(docs, secrets.fit(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in global random order."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_contaminated),
          ("secrets", redact_secrets), ("mixing", mix_sources)]
#: no SQL learns a classifier; tests/llm/test_pipeline.py holds run() against plain rules
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(shared_dir(spark), f"corpus-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        out = os.path.join(folder, f"{i}-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return docs
