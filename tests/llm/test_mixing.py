"""Poisson draws against their distribution and targets, and odd rows."""
import math
from collections import Counter

from pyspark.sql import functions as F

from marketframe.llm import mixing


def test_counts_follow_the_poisson_law(spark):
    u = mixing.uniform(F.col("id").cast("string"))
    for rate in (0.3, 2.5, 40.0):
        rows = spark.range(20_000).select(mixing.drawn([F.col("id").cast("string")], F.lit(rate)).alias("n"), u.alias("u"))
        n = Counter(r.n for r in rows.collect())
        mean = sum(k * v for k, v in n.items()) / 20_000
        var = sum((k - mean) ** 2 * v for k, v in n.items()) / 20_000
        assert abs(mean - rate) < 5 * math.sqrt(rate / 20_000) and abs(var / rate - 1) < 0.06


def test_large_rates_do_not_underflow(spark):
    rows = spark.range(200).select(mixing.drawn([F.col("id").cast("string")], F.lit(2000.0)).alias("n")).collect()
    assert abs(sum(r.n for r in rows) / 200 - 2000) < 20


def test_targets_are_met(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("abcdefghij").alias("text"),
                                    F.when(F.col("id") % 10 < 7, "web").when(F.col("id") % 10 < 9, "books").alias("source"), F.lit(7).alias("copy"))
    out = mixing.mix(docs, {"web": 1.0, "books": 3.0}, budget=60_000)
    assert out.columns == ["doc_id", "text", "source", "copy", "copies", "shuffle_key"]
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"web", "books"} and abs(n["web"] - 1500) < 200 and abs(n["books"] - 4500) < 350
    again = mixing.mix(docs.repartition(3), {"web": 1.0, "books": 3.0}, budget=60_000)
    assert sorted(r.shuffle_key for r in out.collect()) == sorted(r.shuffle_key for r in again.collect())


def test_order_is_global_and_keys_differ(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(docs, budget=8000).collect()
    assert len({r.shuffle_key for r in rows}) == len(rows)
    place = [r.doc_id for r in rows]
    assert place != sorted(place)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "text", None), (3, "text", None), (3, "text", None), (4, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mix(docs, {"": 1.0}, budget=80).where("source is not null").count() == 0
    assert mixing.mix(docs).where("source = 'empty'").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs, {}).count() == 0
