"""GARCH(1,1) by likelihood grid on a schedule: refit every STEP bars on the last BLOCKS * STEP returns, one volatility per bar.

Returns are cut into blocks that end where a model is refitted, so a fit reads the last BLOCKS blocks and every return is stored once.
Fits do not depend on each other: assets x fits are rows, and a batch of rows runs its recursions side by side as arrays. A bar
finds its fit by number, an equi-join. Until FIRST returns exist, the fallback rule stands in.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marketframe.operators.models import ALPHAS, BETAS
from marketframe.operators.windows import by_asset, pct_change

STEP = 21
BLOCKS = 12
FIRST = 60
YEAR = 252
FITS = "asset_id string, fit long, ts date, n_obs long, alpha double, beta double, omega double, log_likelihood double, vol double, long_run_vol double"


def grid() -> np.ndarray:
    """The stationary pairs (alpha, beta), by alpha and beta."""
    return np.array([(a, b) for a in ALPHAS for b in BETAS if a + b < 1])


def numbered_returns(bars: DataFrame) -> DataFrame:
    """bars with r and n_obs, the number of returns up to the bar."""
    df = bars.withColumn("r", pct_change("close"))
    return df.withColumn("n_obs", F.count("r").over(by_asset().rowsBetween(Window.unboundedPreceding, 0)))


def likelihoods(series: list[np.ndarray], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihoods, last variances, omegas) of every series (percent returns) under every pair; the variance targets that of the series."""
    longest = max(len(s) for s in series)
    e, live = np.zeros((len(series), longest)), np.zeros((len(series), longest), dtype=bool)
    var = np.zeros((len(series), 1))
    for i, s in enumerate(series):
        own = s - s.mean()
        own = own - own.mean()
        e[i, longest - len(s):], live[i, longest - len(s):] = own, True
        var[i] = (own * own).mean()
    alpha, beta = pairs[:, 0], pairs[:, 1]
    omega = var * (1 - alpha - beta)
    h, ll = np.repeat(var, len(pairs), axis=1), np.zeros((len(series), len(pairs)))
    for t in range(longest):
        on = live[:, t:t + 1]
        square = (e[:, t] ** 2)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = np.where(on, ll - 0.5 * (np.log(h) + square / h), ll)
        h = np.where(on, omega + alpha * square + beta * h, h)
    return ll, h, omega


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = grid()
    for batch in batches:
        if not len(batch):
            continue
        series = [np.asarray(x.values.to_numpy(zero_copy_only=False)) * 100 for x in batch.column("rs")]
        ll, h, omega = likelihoods(series, pairs)
        row = np.arange(len(series))
        # the shift keeps decimal ties apart from rounding, as elsewhere; the first pair wins ties
        best = np.argmax(np.where(np.isfinite(ll), np.round(ll + 1.7e-13, 9), -np.inf), axis=1)
        a, b = pairs[best, 0], pairs[best, 1]
        scale = np.sqrt(YEAR) / 100
        yield pa.RecordBatch.from_arrays(
            [batch.column("asset_id"), batch.column("fit"), batch.column("ts"), pa.array([len(s) for s in series], pa.int64()), pa.array(a), pa.array(b),
             pa.array(omega[row, best]), pa.array(ll[row, best]), pa.array(np.clip(np.sqrt(h[row, best]) * scale, 0.01, 5.0)),
             pa.array(np.sqrt(omega[row, best] / (1 - a - b)) * scale)],
            names=["asset_id", "fit", "ts", "n_obs", "alpha", "beta", "omega", "log_likelihood", "vol", "long_run_vol"])


def fits(bars: DataFrame) -> DataFrame:
    """One row per asset and refit (FIRST returns, then every STEP): the pair of highest likelihood and its forecast."""
    rows = numbered_returns(bars).where("r IS NOT NULL").select("asset_id", "ts", "r", "n_obs", F.ceil((F.col("n_obs") - FIRST) / STEP).cast("long").alias("fit"))
    blocks = rows.groupBy("asset_id", "fit").agg(F.array_sort(F.collect_list(F.struct("n_obs", "r"))).alias("x"), F.max("n_obs").alias("last"), F.max("ts").alias("ts"))
    frame = Window.partitionBy("asset_id").orderBy("fit").rowsBetween(-(BLOCKS - 1), 0)
    windows = blocks.withColumn("rs", F.flatten(F.collect_list(F.col("x.r")).over(frame)))
    # an unfinished block has no fit yet
    due = windows.where((F.col("fit") >= 0) & (F.col("last") == FIRST + STEP * F.col("fit")))
    return due.select("asset_id", "fit", "ts", "rs").mapInArrow(_fit, FITS)


def forecasts(bars: DataFrame) -> DataFrame:
    """bars' asset_id and ts with n_obs, source (default, realized, garch) and vol: what is known of the next bar's annual volatility."""
    frame = by_asset().rowsBetween(-29, 0)
    df = numbered_returns(bars).withColumn("_sd", F.stddev_pop("r").over(frame) * F.sqrt(F.lit(float(YEAR))))
    df = df.select("asset_id", "ts", "n_obs", "_sd", F.when(F.col("n_obs") >= FIRST, F.floor((F.col("n_obs") - FIRST) / STEP)).cast("long").alias("fit"))
    model = fits(bars).select("asset_id", "fit", F.col("vol").alias("_model"))
    source = F.when(F.col("n_obs") >= FIRST, "garch").when(F.col("n_obs") > 5, "realized").otherwise("default")
    vol = F.when(F.col("n_obs") >= FIRST, F.col("_model")).when(F.col("n_obs") > 5, F.col("_sd")).otherwise(0.20)
    return df.join(model, ["asset_id", "fit"], "left").select("asset_id", "ts", "n_obs", source.alias("source"), vol.alias("vol"))
