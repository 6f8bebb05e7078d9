"""Stationary block bootstrap of the Sharpe ratio."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marketframe.functions.stats import RISK_FREE, TRADING_DAYS


#: simulations that one row of work holds; they share a copy of the series and are drawn together
CHUNK = 250


def resampled_sharpes(returns: DataFrame, key: str, n_sims: int, seed: int = 7) -> DataFrame:
    """One Sharpe ratio per (key, simulation).

    A daily return series has at most one value per calendar day, so it travels as one array. Chunk numbers are dealt out and the
    series joined to them, so a series is copied once per chunk, not once per simulation. Every chunk draws from its own
    counter-based generator, which makes a result independent of partitioning and of retries.
    """
    series = returns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "ret"))).alias("_s"))
    series = series.where(F.size("_s") >= 30).select(key, F.col("_s.ret").alias("rets"))
    chunks = -(-n_sims // CHUNK)
    tasks = series.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(key, "chunk")
    rf = RISK_FREE / TRADING_DAYS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        import numpy as np
        for pdf in batches:
            for k, rets, chunk in zip(pdf[key], pdf["rets"], pdf["chunk"]):
                excess = np.asarray(rets) - rf
                n, sims = len(excess), min(CHUNK, n_sims - int(chunk) * CHUNK)
                p = 1.0 / max(1, int(np.sqrt(n)))
                rng = np.random.Generator(np.random.Philox(key=[(seed << 32) + int(chunk), zlib.crc32(str(k).encode())]))
                at, total, squares = np.full(sims, n), np.zeros(sims), np.zeros(sims)
                for _ in range(n):       # one step of all simulations: go on, or start a block; blocks end with the series
                    fresh = (rng.random(sims) < p) | (at + 1 >= n)
                    at = np.where(fresh, rng.integers(0, n, sims), at + 1)
                    x = excess[at]
                    total += x
                    squares += x * x
                mean = total / n
                spread = np.sqrt(np.maximum(squares / n - mean * mean, 0))
                yield pd.DataFrame({key: [k] * sims, "sim": int(chunk) * CHUNK + np.arange(sims, dtype=np.int32),
                                    "sharpe": mean / (spread + 1e-10) * np.sqrt(TRADING_DAYS)})

    return tasks.mapInPandas(run, f"{key} string, sim int, sharpe double")


def bootstrap_sharpe(returns: DataFrame, key: str, n_sims: int = 10_000, confidence: float = 0.95, seed: int = 7) -> DataFrame:
    """Point estimate, confidence bounds and the share of positive resamples per series."""
    a = (1 - confidence) / 2
    sims = resampled_sharpes(returns, key, n_sims, seed).groupBy(key).agg(
        F.percentile("sharpe", F.array(F.lit(a), F.lit(1 - a))).alias("_ci"),
        F.avg(F.when(F.col("sharpe") > 0, 1.0).otherwise(0.0)).alias("p_positive"), F.count(F.lit(1)).alias("n_simulations"))
    excess = F.col("ret") - RISK_FREE / TRADING_DAYS
    point = returns.groupBy(key).agg(
        (F.avg(excess) / (F.stddev_samp("ret") + 1e-10) * F.sqrt(F.lit(252.0))).alias("sharpe"))
    both = point.unionByName(sims, allowMissingColumns=True).groupBy(key).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("sharpe", "_ci", "p_positive", "n_simulations")])
    return both.where("_ci IS NOT NULL").select(key, "sharpe", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"),
                                                "p_positive", "n_simulations")
