"""Per-series models: GARCH by likelihood grid, Kalman hedge ratios, rolling regression, factor betas, rank model."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from marketframe.operators.matrix import cross_products
from marketframe.operators.windows import by_asset, pct_change, roll

ALPHAS = (0.03, 0.05, 0.08, 0.10, 0.15, 0.20)
BETAS = (0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.94)


def garch_grid(bars: DataFrame, window: int = 252, least: int = 60) -> DataFrame:
    """GARCH(1,1) per asset on its last `window` returns: the (alpha, beta) of highest Gaussian likelihood.

    omega follows from variance targeting, pairs that are not stationary are not in the grid. The grid is an array
    generator and the variance recursion a fold over at most `window` values, so assets x grid run in parallel in the JVM.
    """
    last = Window.partitionBy("asset_id").orderBy(F.desc("ts"))
    r = bars.withColumn("r", pct_change("close") * 100).where("r IS NOT NULL")
    r = r.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= window)
    series = r.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("ts", "r"))).alias("_s"), F.avg("r").alias("mu"),
                                       F.var_pop("r").alias("var")).where(F.size("_s") >= least)
    e = F.transform(F.col("_s.r"), lambda x: x - F.col("mu"))
    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a in ALPHAS for b in BETAS if a + b < 1])
    df = series.select("asset_id", "var", e.alias("e"), F.size("_s").cast("long").alias("n_obs"), F.explode(grid).alias("g")).select("*", "g.*")
    omega = F.col("var") * (1 - F.col("alpha") - F.col("beta"))
    start = F.struct(F.col("var").alias("h"), F.lit(0.0).alias("ll"))

    def step(acc, x):
        ll = acc["ll"] - 0.5 * (F.log(acc["h"]) + x * x / acc["h"])
        return F.struct((F.col("omega") + F.col("alpha") * x * x + F.col("beta") * acc["h"]).alias("h"), ll.alias("ll"))

    fitted = df.withColumn("omega", omega).withColumn("f", F.aggregate("e", start, step))
    best = fitted.groupBy("asset_id").agg(F.max_by(F.struct("alpha", "beta", "omega", "n_obs", "f"), F.col("f.ll")).alias("b"))
    year = F.sqrt(F.lit(252.0)) / 100
    return best.select("asset_id", "b.n_obs", "b.alpha", "b.beta", "b.omega", F.col("b.f.ll").alias("log_likelihood"),
                       F.greatest(F.lit(0.01), F.least(F.lit(5.0), F.sqrt("b.f.h") * year)).alias("forecast_vol"),
                       (F.sqrt(F.col("b.omega") / (1 - F.col("b.alpha") - F.col("b.beta"))) * year).alias("long_run_vol"))


def pair_panel(bars: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Closes of both legs on their common dates, one row per (pair, ts); the list of pairs is given, never all pairs."""
    table = F.array(*[F.struct(F.lit(f"{a}/{b}").alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    tagged = bars.select("asset_id", "ts", "close", F.explode(F.filter(
        table, lambda p: (p["a"] == F.col("asset_id")) | (p["b"] == F.col("asset_id")))).alias("p"))
    leg = lambda name: F.max(F.when(F.col("asset_id") == F.col(f"p.{name}"), F.col("close")))
    return tagged.groupBy(F.col("p.pair").alias("pair"), "ts").agg(leg("a").alias("price_a"), leg("b").alias("price_b")).where(
        "price_a IS NOT NULL AND price_b IS NOT NULL")


def kalman_pairs(panel: DataFrame, q: float = 1e-4, r: float = 1e-2, window: int = 60) -> DataFrame:
    """Online hedge ratio and the z-score of the spread against its last `window` values (population deviation).

    The filter is sequential, so one pair's dates (at most one row per calendar day) are one group.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        pdf = pdf.sort_values("ts")
        beta, p = 1.0, 1.0
        betas, spreads = [], []
        for a, b in zip(pdf["price_a"], pdf["price_b"]):
            p += q
            gain = p * b / (b * b * p + r)
            beta += gain * (a - beta * b)
            p *= 1 - gain * b
            betas.append(beta)
            spreads.append(a - beta * b)
        s = pd.Series(spreads)
        sd = s.rolling(window).std(ddof=0)
        z = (s - s.rolling(window).mean()) / sd.where(sd >= 1e-8)
        return pd.DataFrame({"pair": pdf["pair"].to_numpy(), "ts": pdf["ts"].to_numpy(), "beta": betas, "spread": spreads, "z": z.to_numpy()})

    return panel.select("pair", "ts", "price_a", "price_b").groupBy("pair").applyInPandas(
        run, "pair string, ts date, beta double, spread double, z double")


def pair_zscore(panel: DataFrame, n: int = 60) -> DataFrame:
    """Rolling least-squares hedge ratio and the spread's z-score, both over the last n common dates."""
    w = Window.partitionBy("pair").orderBy("ts")
    frame = w.rowsBetween(-(n - 1), 0)
    full = F.count(F.lit(1)).over(frame) >= n
    df = panel.withColumn("beta", F.when(full, F.regr_slope("price_a", "price_b").over(frame)))
    df = df.withColumn("spread", F.col("price_a") - F.col("beta") * F.col("price_b"))
    sd = roll(F.stddev_pop, "spread", n, w)
    return df.withColumn("z", (F.col("spread") - roll(F.avg, "spread", n, w)) / F.when(sd > 1e-8, sd))


def factor_betas(curves: DataFrame, factors: DataFrame, names: list[str], alpha: float = 0.01, key: str = "portfolio_id") -> DataFrame:
    """Ridge betas of each curve's returns on factor returns and the residual volatility.

    Cross-products are aggregated in one pass per curve (k*k numbers); the k-by-k system is then solved per row.
    """
    joined = curves.join(factors, "ts").dropna(subset=["ret", *names])
    cols = ["ret", *names]
    sums = [F.count(F.lit(1)).cast("double").alias("n")] + [F.sum(c).alias(f"s_{c}") for c in cols]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]
    agg = joined.groupBy(key).agg(*sums).where("n >= 30")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                n = row["n"]
                c = np.empty((len(cols), len(cols)))
                for i, a in enumerate(cols):
                    for j in range(i, len(cols)):
                        c[i, j] = c[j, i] = row[f"p_{a}_{cols[j]}"] - row[f"s_{a}"] * row[f"s_{cols[j]}"] / n
                xx, xy = c[1:, 1:], c[1:, 0]
                b = np.linalg.solve(xx + alpha * np.eye(len(names)), xy)
                rss = c[0, 0] - 2 * b @ xy + b @ xx @ b
                vol = float(np.sqrt(max(rss, 0.0) / n * 252))
                out += [(row[key], f, float(v), vol) for f, v in zip(names, b)]
            yield pd.DataFrame(out, columns=[key, "factor", "beta", "residual_vol"])

    return agg.mapInPandas(run, f"{key} string, factor string, beta double, residual_vol double")


def rank_model(dataset: DataFrame, features: list[str], cut: str, horizon_days: int = 45, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Boosted trees on ranked features: trained on labels known before `cut`, predicting from `cut` on.

    Returns predictions (ts, asset_id, prediction, label) and importances. Rows whose label reaches past the cut are left
    out of training.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    filled = dataset.fillna(0.0, subset=features)
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(filled)
    day = F.lit(cut).cast("date")
    train = assembled.where(F.col("ts") < F.date_sub(day, horizon_days)).select("features", "label")
    model = GBTRegressor(labelCol="label", maxIter=10, maxDepth=3, seed=seed).fit(train)
    predicted = model.transform(assembled.where(F.col("ts") >= day)).select("ts", "asset_id", "prediction", "label")
    spark = dataset.sparkSession
    scores = spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())],
                                   "factor string, importance double")
    return predicted, scores
