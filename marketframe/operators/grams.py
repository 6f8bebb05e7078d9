"""Moments of trailing windows from monthly prefix sums, for matrices per rebalance date.

Every date is a vector z = (r, 1, r * r, 1) over the universe: returns (0 where missing), whether they are there, their squares, and a
constant. A task adds its dates to one matrix z z' per month; cells are summed, and running sums over the months make every window
a difference of two prefixes. A window therefore costs its cells and not its rows, and all moments up to the fourth that
covariances, correlations and shrinkage need, pairwise complete, are read from it.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


class Moments:
    """The matrix of one window, cut to the assets with at least `least` returns."""

    def __init__(self, cells: np.ndarray, assets: list[str], least: int):
        p = len(assets)
        g = cells.reshape(3 * p + 1, 3 * p + 1)
        keep = np.flatnonzero(np.diag(g)[p:2 * p] >= least - 0.5)
        self.assets = [assets[i] for i in keep]
        part = lambda a, b: g[np.ix_(a * p + keep, b * p + keep)]
        self.n, self.rr, self.r1, self.q1, self.qr, self.qq = part(1, 1), part(0, 0), part(0, 1), part(2, 1), part(2, 0), part(2, 2)
        self.dates = g[3 * p, 3 * p]
        self.mean = np.diag(self.r1) / np.diag(self.n)

    def covariance(self) -> np.ndarray:
        """Sample covariance over the common dates of each pair; 0 where there are none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = (self.rr - self.r1 * self.r1.T / self.n) / (self.n - 1)
        return np.nan_to_num(cov, posinf=0.0, neginf=0.0)

    def correlation(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            var = self.q1 - self.r1 * self.r1 / self.n              # of i over the dates that i and j share
            corr = (self.rr - self.r1 * self.r1.T / self.n) / np.sqrt(var * var.T)
        corr = np.clip(np.nan_to_num(corr), -1, 1)
        np.fill_diagonal(corr, 1.0)
        return corr

    def shrunk(self) -> tuple[np.ndarray, float]:
        """Ledoit-Wolf covariance towards the scaled identity, missing returns standing at the mean, and the intensity."""
        m, p, t = self.mean, len(self.assets), self.dates
        s = (self.rr - m[None, :] * self.r1 - m[:, None] * self.r1.T + np.outer(m, m) * self.n) / t
        # sum over dates of (x'x) ** 2 for the centred x, expanded into products of raw moments
        mi, mj = m[:, None], m[None, :]
        fourth = (self.qq - 2 * mj * self.qr - 2 * mi * self.qr.T + mj ** 2 * self.q1 + mi ** 2 * self.q1.T + 4 * mi * mj * self.rr
                  - 2 * mi * mj ** 2 * self.r1 - 2 * mj * mi ** 2 * self.r1.T + mi ** 2 * mj ** 2 * self.n).sum()
        mu, fro = np.trace(s) / p, (s * s).sum()
        away = (fro - p * mu * mu) / p
        h = min((fourth / t - fro) / (p * t), away) / away if away > 0 else 1.0
        return (1 - h) * s + h * mu * np.eye(p), h


def monthly_cells(panel: DataFrame, value: str, assets: list[str]) -> DataFrame:
    """month, pos, v: cells of the sums of z z' over the dates of each month. The universe is a list, since each window solves for all of it."""
    index, p = {a: i for i, a in enumerate(assets)}, len(assets)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for month, names, xs in zip(batch.column("month").to_pylist(), batch.column("names"), batch.column("xs")):
                z = np.zeros(3 * p + 1)
                at = np.array([index[n] for n in names.as_py()])
                x = xs.values.to_numpy(zero_copy_only=False)
                z[at], z[p + at], z[2 * p + at], z[3 * p] = x, 1.0, x * x, 1.0
                sums.setdefault(month, []).append(z)
                if len(sums[month]) >= 256:
                    sums[month] = _folded(sums[month])
        for month, rows in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([month], pa.date32()), pa.array([_folded(rows)[0].reshape(-1)], pa.list_(pa.float64()))], names=["month", "cells"])

    by_date = panel.where(F.col(value).isNotNull()).groupBy("ts").agg(F.collect_list("asset_id").alias("names"), F.collect_list(value).alias("xs"))
    parts = by_date.select(F.trunc("ts", "month").alias("month"), "names", "xs").mapInArrow(partial, "month date, cells array<double>")
    return parts.select("month", F.posexplode("cells").alias("pos", "v")).groupBy("month", "pos").agg(F.sum("v").alias("v"))


def _folded(rows: list[np.ndarray]) -> list[np.ndarray]:
    """A matrix in front of vectors, or vectors alone, as one matrix."""
    z = np.array([r for r in rows if r.ndim == 1])
    total = sum((r for r in rows if r.ndim == 2), np.zeros((z.shape[1], z.shape[1])) if len(z) else 0.0)
    return [total + z.T @ z if len(z) else total]


def windows(cells: DataFrame, months: int, size: int) -> DataFrame:
    """rebalance, cells: for every month from the first to the last, the sums of all `size` cells over the `months` months before it."""
    ends = cells.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a IS NOT NULL")
    calendar = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    # one row per month and cell, so that frames of rows are frames of months; months may be empty
    empty = calendar.select("month", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("pos"), F.lit(0.0).alias("v"))
    dense = cells.union(empty).groupBy("month", "pos").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("pos").orderBy("month")
    before = dense.withColumn("total", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = before.withColumn("v", F.col("total") - F.lag("total", months, 0.0).over(w))
    return out.groupBy(F.col("month").alias("rebalance")).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("cells"))


def per_rebalance(panel: DataFrame, value: str, months: int, least: int, solve, extra: DataFrame | None = None) -> DataFrame:
    """rebalance, asset_id, weight: solve(moments, {asset: extra}) for every rebalance with two assets of `least` returns or more.

    extra: rebalance, asset_id, x.
    """
    assets = sorted(r[0] for r in panel.select("asset_id").distinct().collect())
    if not assets:
        return panel.sparkSession.createDataFrame([], "rebalance date, asset_id string, weight double")
    rows = windows(monthly_cells(panel, value, assets), months, (3 * len(assets) + 1) ** 2)
    if extra is not None:
        named = extra.groupBy("rebalance").agg(F.map_from_entries(F.collect_list(F.struct("asset_id", "x"))).alias("extra"))
        rows = rows.join(named, "rebalance", "left")
    else:
        rows = rows.withColumn("extra", F.lit(None).cast("map<string,double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for day, cells, x in zip(batch.column("rebalance").to_pylist(), batch.column("cells"), batch.column("extra").to_pylist()):
                moments = Moments(cells.values.field("v").to_numpy(zero_copy_only=False), assets, least)
                if len(moments.assets) >= 2:
                    out = pd.DataFrame({"rebalance": day, "asset_id": moments.assets, "weight": solve(moments, dict(x or []))})
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return rows.mapInArrow(run, "rebalance date, asset_id string, weight double")
