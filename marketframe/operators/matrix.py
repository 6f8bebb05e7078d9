"""Pairwise statistics of many series without pairing rows.

The rows of one date become one vector; every task multiplies its dates into a partial Gram matrix and emits only that,
so what is shuffled grows with the square of the universe and not with the number of rows. Missing values are masked,
which makes every entry pairwise complete.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

PARTIAL = "asset_i string, asset_j string, n double, si double, sj double, sii double, sjj double, sij double"


def cross_products(panel: DataFrame, value: str, series: str = "asset_id", ts: str = "ts") -> DataFrame:
    """n, sums, squares and products for every pair i <= j with a common date."""
    by_date = panel.where(F.col(value).isNotNull()).groupBy(ts).agg(
        F.collect_list(series).alias("names"), F.collect_list(value).alias("xs"))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        index: dict[str, int] = {}
        sums = None
        for pdf in batches:
            for names in pdf["names"]:
                for name in names:
                    index.setdefault(name, len(index))
            k = len(index)
            x, m = np.zeros((len(pdf), k)), np.zeros((len(pdf), k))
            for row, (names, xs) in enumerate(zip(pdf["names"], pdf["xs"])):
                at = [index[n] for n in names]
                x[row, at], m[row, at] = xs, 1.0
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            if sums is None:
                sums = part
            else:
                grown = np.zeros((6, k, k))
                old = sums.shape[1]
                grown[:, :old, :old] = sums
                sums = grown + part
        if sums is None:
            return
        names = np.array(list(index))
        # one row of the matrix at a time keeps the output batches small
        for a, name in enumerate(names):
            keep = (names >= name) & (sums[0, a] > 0)
            yield pd.DataFrame({"asset_i": name, "asset_j": names[keep], **{
                c: sums[i, a, keep] for i, c in enumerate(("n", "si", "sj", "sii", "sjj", "sij"))}})

    # a window over at most a calendar's worth of vectors; partials of all tasks are added up
    partial = by_date.mapInPandas(gram, PARTIAL)
    return partial.groupBy("asset_i", "asset_j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")])


def covariance(panel: DataFrame, value: str = "ret", series: str = "asset_id", least: int = 2) -> DataFrame:
    """Sample covariance and correlation for every pair i <= j, in long form."""
    p = cross_products(panel, value, series).where(F.col("n") >= least)
    n = F.col("n")
    cov = (F.col("sij") - F.col("si") * F.col("sj") / n) / (n - 1)
    vi = (F.col("sii") - F.col("si") * F.col("si") / n) / (n - 1)
    vj = (F.col("sjj") - F.col("sj") * F.col("sj") / n) / (n - 1)
    return p.select("asset_i", "asset_j", n.cast("long").alias("n"), cov.alias("cov"),
                    (cov / F.nullif(F.sqrt(F.greatest(vi * vj, F.lit(0.0))), F.lit(0.0))).alias("corr"))


def both_triangles(pairs: DataFrame) -> DataFrame:
    mirrored = pairs.where("asset_i <> asset_j").withColumns({"asset_i": F.col("asset_j"), "asset_j": F.col("asset_i")})
    return pairs.unionByName(mirrored)


def correlated_pairs(curves: DataFrame, key: str, last: int = 60, threshold: float = 0.70, least: int = 10) -> DataFrame:
    """Pairs whose returns over the last `last` points move together (or apart) at least that strongly.

    Points are aligned from the newest backwards, as histories of the same length are.
    """
    w = Window.partitionBy(key).orderBy(F.desc("ts"))
    recent = curves.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= last)
    older = F.lead("equity").over(Window.partitionBy(key).orderBy("_back"))
    rets = recent.withColumn("ret", (F.col("equity") - older) / (older + 1e-10)).where("ret IS NOT NULL")
    pairs = covariance(rets.withColumnRenamed("_back", "pos").withColumn("ts", F.col("pos")), "ret", key)
    return pairs.where((F.col("asset_i") < F.col("asset_j")) & (F.col("n") >= least) & (F.abs("corr") >= threshold))


def shrunk(panel: DataFrame, value: str = "ret", method: str = "ledoit_wolf") -> DataFrame:
    """Covariance shrunk towards a scaled identity (Ledoit-Wolf or OAS closed form) on complete dates.

    Everything the intensity needs is an aggregate: the matrix itself and the sum of squared row norms.
    """
    full = panel.where(F.col(value).isNotNull())
    size = full.select("asset_id").distinct().agg(F.count(F.lit(1))).scalar()
    complete = full.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ts"))).where(F.col("_n") == size).drop("_n")
    mean = complete.groupBy("asset_id").agg(F.avg(value).alias("_m"))
    centred = complete.join(mean, "asset_id").withColumn("_x", F.col(value) - F.col("_m")).select("ts", "asset_id", "_x")
    rows = centred.groupBy("ts").agg(F.sum(F.col("_x") * F.col("_x")).alias("q"))
    fourth = rows.agg(F.sum(F.col("q") * F.col("q")).alias("q4"), F.count(F.lit(1)).alias("t"))
    pairs = cross_products(centred, "_x").select("asset_i", "asset_j", (F.col("sij") / F.col("n")).alias("s"))
    weight = F.when(F.col("asset_i") == F.col("asset_j"), 1).otherwise(2)
    agg = pairs.agg(F.sum(F.when(F.col("asset_i") == F.col("asset_j"), F.col("s"))).alias("tr"),
                    F.sum(weight * F.col("s") * F.col("s")).alias("fro"),
                    F.sum((F.col("asset_i") == F.col("asset_j")).cast("long")).alias("p"))
    stats = agg.withColumn("_r", fourth.select(F.struct("q4", "t")).scalar()).select("*", "_r.*")
    mu, p, t = F.col("tr") / F.col("p"), F.col("p"), F.col("t")
    d2 = (F.col("fro") - p * mu * mu) / p
    if method == "ledoit_wolf":
        b2 = F.least((F.col("q4") / t - F.col("fro")) / (p * t), d2)
        shrink = F.when(d2 == 0, 0.0).otherwise(b2 / d2)
    else:
        alpha, m2 = F.col("fro") / (p * p), mu * mu
        shrink = F.least(F.lit(1.0), (alpha + m2) / ((t + 1) * (alpha - m2 / p)))
    stats = stats.select(F.struct(mu.alias("mu"), shrink.alias("shrinkage")))
    out = pairs.withColumn("_s", stats.scalar()).select("*", "_s.*")
    cov = (1 - F.col("shrinkage")) * F.col("s") + F.when(
        F.col("asset_i") == F.col("asset_j"), F.col("shrinkage") * F.col("mu")).otherwise(0.0)
    return out.select("asset_i", "asset_j", cov.alias("cov"), "shrinkage")
