"""Walk-forward cross-sectional rank model: ridge regressions from cumulative Gram tables.

Every row is a vector of features (ranks per date, missing ones 0) with the rank of its forward return as label. A task adds its rows
to one Gram matrix per month in which their labels became known; the partial matrices are summed by cell. Running sums over the
months make the training set of every rebalance a difference of two prefixes, so that all retrainings read the panel once,
whatever the length of the training window. Each rebalance then solves one system of the size of the feature list.

A label counts from the month after the one in which it became known, so no model sees a return that ends after its first date.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marketframe.operators.crosssection import percent_rank_avg
from marketframe.operators.windows import by_asset

#: share of the number of rows that is added to the squares of every feature but the constant
RIDGE = 0.01
#: months of labels that a model is trained on
MONTHS = 36
#: a model needs as many labelled rows
LEAST = 100


def labelled(panel: DataFrame, horizon: int = 21, least: int = 5) -> DataFrame:
    """The rows whose forward return is known, with label, its rank per date, and known, the month of the bar that ends it."""
    w = by_asset()
    df = panel.withColumns({"_fwd": F.lead("close", horizon).over(w) / F.col("close") - 1, "known": F.trunc(F.lead("ts", horizon).over(w), "month")})
    df = df.where("_fwd IS NOT NULL").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ts"))).where(F.col("_n") >= least)
    return df.withColumn("label", percent_rank_avg("_fwd", ["ts"])).drop("_fwd", "_n")


def gram_cells(rows: DataFrame, features: list[str]) -> DataFrame:
    """known, pos, v: the cells of the sums of z z' per month, z = (1, features, label), by row and column."""
    k = len(features) + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            z = np.ones((len(batch), k))
            for i, name in enumerate([*features, "label"]):
                z[:, i + 1] = batch.column(name).to_numpy(zero_copy_only=False)
            months = batch.column("known").dictionary_encode()
            code = months.indices.to_numpy(zero_copy_only=False)
            for c, month in enumerate(months.dictionary.to_pylist()):
                own = z[code == c]
                sums[month] = sums.get(month, 0.0) + own.T @ own
        # a matrix per month, whatever the rows
        for month, gram in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([month], pa.date32()), pa.array([gram.reshape(-1)], pa.list_(pa.float64()))], names=["known", "cells"])

    parts = rows.select("known", "label", *features).mapInArrow(partial, "known date, cells array<double>")
    return parts.select("known", F.posexplode("cells").alias("pos", "v")).groupBy("known", "pos").agg(F.sum("v").alias("v"))


def training_cells(cells: DataFrame, clock: DataFrame, features: list[str], months: int = MONTHS) -> DataFrame:
    """month, pos, v: the sums over the labels of the `months` months before each month of the clock, as a difference of running sums."""
    k = len(features) + 2
    empty = clock.select(F.trunc("ts", "month").alias("month")).distinct().select(
        "month", F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("pos"), F.lit(0.0).alias("v"))
    dense = empty.union(cells.select(F.col("known"), "pos", "v")).groupBy("month", "pos").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("pos").orderBy("month")
    before = dense.withColumn("total", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return before.withColumn("v", F.col("total") - F.lag("total", months, 0.0).over(w)).select("month", "pos", "v")


def models(cells: DataFrame, features: list[str], ridge: float = RIDGE, least: int = LEAST) -> DataFrame:
    """month, n, beta (constant first), importance (shares of |beta| times the deviation of the feature) of each month with enough rows."""
    k = len(features) + 2

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, beta, share = [], [], []
            for cells in batch.column("cells"):
                g = np.asarray(cells.values.field("v").to_numpy(zero_copy_only=False)).reshape(k, k)
                n, a, y = g[0, 0], g[:-1, :-1].copy(), g[:-1, -1]
                a[np.arange(1, k - 1), np.arange(1, k - 1)] += ridge * n
                b = np.linalg.solve(a, y)
                spread = np.sqrt(np.maximum(np.diag(g)[1:-1] / n - (g[0, 1:-1] / n) ** 2, 0))
                weight = np.abs(b[1:]) * spread
                count.append(int(round(n)))
                beta.append(b)
                share.append(weight / max(weight.sum(), 1e-300))
            yield pa.RecordBatch.from_arrays([batch.column("month"), pa.array(count, pa.int64()), pa.array(beta, pa.list_(pa.float64())),
                                              pa.array(share, pa.list_(pa.float64()))], names=["month", "n", "beta", "importance"])

    rows = cells.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("cells"))
    return rows.where(F.element_at("cells", 1)["v"] >= least - 0.5).mapInArrow(solve, "month date, n long, beta array<double>, importance array<double>")


def predictions(panel: DataFrame, fitted: DataFrame, features: list[str]) -> DataFrame:
    """panel with prediction, null in months without a model."""
    value = F.element_at("beta", 1)
    for i, name in enumerate(features):
        value = value + F.col(name) * F.element_at("beta", i + 2)
    return panel.withColumn("month", F.trunc("ts", "month")).join(fitted.select("month", "beta"), "month", "left").withColumn("prediction", value).drop("beta", "month")


def walk_forward(panel: DataFrame, features: list[str], months: int = MONTHS, ridge: float = RIDGE, horizon: int = 21) -> tuple[DataFrame, DataFrame]:
    """(panel with prediction, models) for a panel of asset_id, ts, close and features."""
    filled = panel.fillna(0.0, subset=features)
    cells = gram_cells(labelled(filled, horizon), features)
    fitted = models(training_cells(cells, panel, features, months), features, ridge)
    return predictions(filled, fitted, features), fitted


def importances(fitted: DataFrame, features: list[str]) -> DataFrame:
    """month, factor, importance."""
    named = F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.col("importance"))).alias("factor", "importance")
    return fitted.select("month", named)
