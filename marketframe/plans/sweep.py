"""Parameter sweeps, walk-forward evaluation, stress periods: whole grids as one distributed plan.

A grid is a constant, so configurations travel as an array column: rolling means are computed once per distinct length
(one sort of the panel), every configuration becomes one array element, and rows are exploded only right before the
aggregation that shrinks them again.
"""
from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketframe.functions.stats import deflated_sharpe, expected_max_sharpe, expected_max_sharpe_of, lit, rnd
from marketframe.operators.performance import summary
from marketframe.operators.windows import ordered, running, with_means


@dataclass(frozen=True)
class SmaGrid:
    """All combinations of fast and slow lengths, numbered in product order."""
    fast: tuple[int, ...]
    slow: tuple[int, ...]

    @property
    def configs(self) -> list[tuple[int, int]]:
        return list(itertools.product(self.fast, self.slow))

    @property
    def lengths(self) -> list[int]:
        return sorted({*self.fast, *self.slow})


def grid_table(bars: DataFrame, grid: SmaGrid) -> DataFrame:
    """The panel times the grid in long form, by an array generator rather than a join."""
    configs = F.array(*[F.struct(F.lit(i).cast("long").alias("param_id"), F.lit(f).cast("long").alias("fast"),
                                 F.lit(s).cast("long").alias("slow")) for i, (f, s) in enumerate(grid.configs)])
    return bars.withColumn("_p", F.explode(configs)).select(*bars.columns, "_p.*")


def sma_sweep_returns(panel: DataFrame, grid: SmaGrid, keys: list[str], cost: float = 0.0) -> DataFrame:
    """Mean return over the assets per (keys, ts, param_id).

    keys are extra partition columns such as a walk-forward window; signals warm up inside each partition.
    """
    w = ordered(["asset_id", *keys])
    df = with_means(panel, "close", {f"_m{n}": n for n in grid.lengths}, w)
    raw = F.array(*[F.when(F.col(f"_m{f}") > F.col(f"_m{s}"), 1).otherwise(0) for f, s in grid.configs])
    df = df.withColumns({"_raw": raw, "_r": F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))})
    # a signal is delayed one bar, and executes on the bar after that
    none = F.array_repeat(F.lit(0), len(grid.configs))
    df = df.withColumns({"_held": F.coalesce(F.lag("_raw", 2).over(w), none),
                         "_before": F.coalesce(F.lag("_raw", 3).over(w), none)})
    held, before = F.col("_held"), F.col("_before")
    rets = F.array(*[held[i] * F.col("_r") - cost * F.abs(held[i] - before[i]) for i in range(len(grid.configs))])
    long = df.select(*keys, "ts", F.posexplode(rets).alias("param_id", "ret"))
    return long.groupBy(*keys, "ts", F.col("param_id").cast("long").alias("param_id")).agg(F.avg("ret").alias("ret"))


def equity_from_returns(returns: DataFrame, keys: list[str], start: float = 100_000.0) -> DataFrame:
    """Compounded index in dollars, rounded to a millionth so that a flat day is exactly flat."""
    return returns.withColumn("equity", rnd(start * F.exp(F.sum(F.log1p("ret")).over(running(ordered(keys))))))


def with_config(df: DataFrame, grid: SmaGrid) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("param_id").cast("int") + 1)
    return df.withColumns({"fast": pick([f for f, _ in grid.configs]), "slow": pick([s for _, s in grid.configs])})


def sweep(bars: DataFrame, grid: SmaGrid, cost: float = 0.002) -> DataFrame:
    """Metrics per configuration with the Sharpe ratio deflated for the number of configurations tried."""
    curves = equity_from_returns(sma_sweep_returns(bars, grid, [], cost), ["param_id"])
    scored = summary(curves, ["param_id"])
    e_max = expected_max_sharpe(len(grid.configs))
    scored = scored.withColumn("deflated_sharpe_corrected", F.expr(deflated_sharpe("sharpe_ratio", "(n_obs + 1)", lit(e_max))))
    return with_config(scored, grid).orderBy(F.desc("deflated_sharpe_corrected"), "param_id")


def walk_forward_windows(bars: DataFrame, train: int, test: int, step: int, gap: int = 0) -> DataFrame:
    """(ts, window_id, phase) for every date inside a train or test span, by index arithmetic on the date list."""
    dates = bars.select("ts").distinct()
    n = dates.agg(F.count(F.lit(1))).scalar()
    i = (F.row_number().over(Window.orderBy("ts")) - 1).cast("long")
    last = F.floor((n - (train + gap + test)) / step)

    def spans(start: int, length: int, phase: str) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col("_i") - start - length + 1) / step))
        until = F.least(F.col("_last"), F.floor((F.col("_i") - start) / step))
        ids = F.when(first <= until, F.sequence(first.cast("long"), until.cast("long")))
        return F.transform(F.coalesce(ids, F.array().cast("array<bigint>")),
                           lambda k: F.struct(k.alias("window_id"), F.lit(phase).alias("phase")))

    both = F.concat(spans(0, train, "train"), spans(train + gap, test, "test"))
    df = dates.withColumns({"_i": i, "_last": last})
    return df.select("ts", F.explode(both).alias("w")).select("ts", "w.*")


def walk_forward(bars: DataFrame, grid: SmaGrid, train: int = 756, test: int = 252, step: int = 126, gap: int = 0,
                 cost: float = 0.002) -> DataFrame:
    """Best configuration of each train span and how it did on the test span that follows.

    Windows and configurations are data: one plan evaluates windows x phases x configurations, keyed by all three.
    """
    keys = ["window_id", "phase"]
    sliced = bars.select("asset_id", "ts", "close").join(walk_forward_windows(bars, train, test, step, gap), "ts")
    curves = equity_from_returns(sma_sweep_returns(sliced, grid, keys, cost), [*keys, "param_id"])
    scored = summary(curves, [*keys, "param_id"])
    rank = F.struct(F.round("sharpe_ratio", 9), -F.col("param_id"))
    best = scored.where("phase = 'train'").groupBy("window_id").agg(
        F.max_by("param_id", rank).alias("param_id"), F.max("sharpe_ratio").alias("train_sharpe"))
    oos = scored.where("phase = 'test'").select(
        "window_id", "param_id", F.col("sharpe_ratio").alias("oos_sharpe"), F.col("total_return").alias("oos_return"),
        F.col("max_drawdown").alias("oos_max_drawdown"), F.col("calmar_ratio").alias("oos_calmar"))
    return with_config(best.join(oos, ["window_id", "param_id"]), grid)


def walk_forward_summary(results: DataFrame, n_configs: int, n_obs: Column) -> DataFrame:
    """In-sample against out-of-sample, significance for all configurations tried, and the modal configuration."""
    agg = results.groupBy().agg(
        F.avg("oos_sharpe").alias("avg_oos_sharpe"), F.avg("train_sharpe").alias("avg_is_sharpe"),
        F.count(F.lit(1)).alias("n_windows"), F.avg(F.when(F.col("oos_sharpe") > 0, 1.0).otherwise(0.0)).alias("oos_win_rate"),
        F.mode("param_id", True).alias("most_stable_param"))
    df = agg.withColumns({"sharpe_degradation": F.col("avg_is_sharpe") - F.col("avg_oos_sharpe"),
                          "total_configs": F.col("n_windows") * n_configs, "n_obs": n_obs})
    df = df.withColumn("deflated_sharpe", F.expr(deflated_sharpe(
        "avg_oos_sharpe", "n_obs", expected_max_sharpe_of("total_configs"))))
    return df.withColumn("verdict", F.when((F.col("deflated_sharpe") > 0) & (F.col("avg_oos_sharpe") > 0.3), "pass")
                         .when(F.col("sharpe_degradation") > 0.5, "overfit").otherwise("fail"))


def by_period(curves: DataFrame, periods: list[tuple[str, str, str]], least: int = 30, floor: float = -0.25) -> DataFrame:
    """Metrics of every curve inside named periods; a date may lie in several of them."""
    table = F.array(*[F.struct(F.lit(n).alias("period"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b"))
                      for n, a, b in periods])
    hits = F.filter(table, lambda p: F.col("ts").between(p["a"], p["b"]))
    df = curves.select("*", F.explode(hits).alias("_p")).withColumn("period", F.col("_p.period")).drop("_p")
    return summary(df, ["portfolio_id", "period"]).where(F.col("n_obs") + 1 >= least).withColumn(
        "passed", F.col("max_drawdown") >= floor)


def by_regime(curves: DataFrame, regimes: DataFrame, least: int = 20) -> DataFrame:
    """Metrics per regime, with returns taken between consecutive dates inside the regime."""
    labelled = curves.join(regimes.select(F.col("asset_id").alias("portfolio_id"), "ts", "regime"), ["portfolio_id", "ts"])
    return summary(labelled, ["portfolio_id", "regime"]).where(F.col("n_obs") + 1 >= least)
