"""Performance of equity curves: returns, drawdowns, summary metrics, benchmark comparison, trade statistics.

All curves are evaluated at once: a curve is a key (or several), never a loop. Curves hold one row per date.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketframe.functions.stats import RISK_FREE, TRADING_DAYS, deflated_sharpe, lit, sample_kurt, sample_skew
from marketframe.operators.windows import ordered, roll, running


def with_returns(curves: DataFrame, keys: list[str], equity: str = "equity") -> DataFrame:
    return curves.withColumn("ret", F.col(equity) / F.lag(equity).over(ordered(keys)) - 1)


def with_drawdown(curves: DataFrame, keys: list[str], equity: str = "equity") -> DataFrame:
    peak = F.max(equity).over(running(ordered(keys)))
    return curves.withColumn("peak", peak).withColumn("drawdown", (F.col(equity) - F.col("peak")) / F.col("peak"))


def root_year() -> Column:
    return F.sqrt(F.lit(float(TRADING_DAYS)))


def summary(curves: DataFrame, keys: list[str], e_max: float = 0.0, rf: float = RISK_FREE) -> DataFrame:
    """Total return, CAGR, volatility, Sharpe, Sortino, Calmar, drawdown and deflated Sharpe ratio per curve."""
    df = with_drawdown(with_returns(curves, keys), keys)
    excess = F.col("ret") - rf / TRADING_DAYS
    agg = df.groupBy(*keys).agg(
        F.min_by("equity", "ts").alias("initial_equity"), F.max_by("equity", "ts").alias("final_equity"),
        F.count("ret").alias("n_obs"), F.stddev_samp("ret").alias("_sd"), F.avg(excess).alias("_mean"),
        F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("_down"),
        F.count(F.when(F.col("ret") < 0, 1)).alias("_n_down"), F.min("drawdown").alias("max_drawdown"),
        sample_skew(F.col("ret")).alias("skew"), sample_kurt(F.col("ret")).alias("kurt")).where("n_obs > 0")
    years = F.col("n_obs") / float(TRADING_DAYS)
    growth = F.col("final_equity") / F.col("initial_equity")
    df = agg.withColumns({"n_years": years, "total_return": growth - 1,
                          "cagr": F.pow(growth, 1 / F.greatest(years, F.lit(0.01))) - 1,
                          "annual_volatility": F.col("_sd") * root_year(),
                          "sharpe_ratio": F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * root_year()).otherwise(0.0)})
    down = F.when(F.col("_n_down") > 0, F.col("_down") * root_year()).otherwise(1e-8)
    df = df.withColumns({
        "sortino_ratio": F.when(down > 0, (F.col("cagr") - rf) / down).otherwise(0.0),
        "calmar_ratio": F.when(F.abs("max_drawdown") > 1e-8, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0),
        "deflated_sharpe": F.expr(deflated_sharpe("sharpe_ratio", "n_obs", lit(e_max), "COALESCE(skew, 0)", "COALESCE(kurt, 0)"))})
    return df.drop("_sd", "_mean", "_down", "_n_down")


def monthly_returns(curves: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """Return of each calendar month against the previous one; a missing month leaves no return after it."""
    month = curves.groupBy(key, F.trunc("ts", "month").alias("month")).agg(F.max_by("equity", "ts").alias("equity"))
    w = ordered(key, "month")
    adjacent = F.months_between("month", F.lag("month").over(w)) == 1
    return month.withColumn("ret", F.when(adjacent, F.col("equity") / F.lag("equity").over(w) - 1)).where("ret IS NOT NULL")


def drawdown_episodes(curves: DataFrame, key: str = "portfolio_id", threshold: float = -1e-6) -> DataFrame:
    """Finished drawdowns: start, the recovery date that ends them, depth and days; an open one is not reported."""
    w = ordered(key)
    df = with_drawdown(curves, [key]).withColumn("_in", (F.col("drawdown") < threshold).cast("int"))
    df = df.withColumns({"_start": ((F.col("_in") == 1) & (F.coalesce(F.lag("_in").over(w), F.lit(0)) == 0)).cast("int"),
                         "_next": F.lead("ts").over(w)})
    df = df.withColumn("_episode", F.sum("_start").over(running(w))).where("_in = 1")
    out = df.groupBy(key, "_episode").agg(F.min("ts").alias("start"), F.max_by("_next", "ts").alias("end"),
                                          F.min("drawdown").alias("depth"))
    return out.where("end IS NOT NULL").withColumn("days", F.datediff("end", "start").cast("long")).drop("_episode")


def drawdown_summary(curves: DataFrame, key: str = "portfolio_id", threshold: float = -1e-6) -> DataFrame:
    """Number, mean depth and longest duration of the finished drawdowns of each curve; 0 where there is none."""
    found = drawdown_episodes(curves, key, threshold).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_episodes"), F.avg("depth").alias("mean_depth"), F.max("days").alias("max_days"))
    every = curves.select(key).distinct().join(found, key, "left")
    return every.select(key, F.coalesce("n_episodes", F.lit(0)).alias("n_episodes"), F.coalesce("mean_depth", F.lit(0.0)).alias("mean_depth"),
                        F.coalesce("max_days", F.lit(0)).alias("max_days"))


def drawdown_utilisation(curves: DataFrame, halt: float = -0.15, close: float = -0.20, key: str = "portfolio_id") -> DataFrame:
    """The latest drawdown of each curve as a share of the level that halts new positions, and the state of the breaker."""
    last = with_drawdown(curves, [key]).groupBy(key).agg(F.max_by("drawdown", "ts").alias("drawdown"))
    dd = F.round("drawdown", 9)
    state = F.when(dd <= close, "CLOSE_ALL").when(dd <= halt, "HALT_OPENS").otherwise("NORMAL")
    return last.withColumns({"utilisation": F.col("drawdown") / halt, "status": state})


def rolling_sharpe(curves: DataFrame, key: str = "portfolio_id", n: int = 252, rf: float = RISK_FREE) -> DataFrame:
    w = ordered(key)
    df = with_returns(curves, [key]).withColumn("_x", F.col("ret") - rf / TRADING_DAYS)
    value = roll(F.avg, "_x", n, w) / F.nullif(roll(F.stddev_samp, "_x", n, w), F.lit(0.0)) * root_year()
    return df.withColumn("rolling_sharpe", F.coalesce(value, F.lit(0.0))).where("ret IS NOT NULL")


def rolling_calmar(curves: DataFrame, key: str = "portfolio_id", n: int = 252) -> DataFrame:
    """Rolling CAGR over the rolling maximum drawdown; the drawdown inside a frame is a fold over the frame's values."""
    w = ordered(key)
    frame = w.rowsBetween(-(n - 1), 0)
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

    def step(acc, x):
        peak = F.greatest(acc["peak"], x)
        return F.struct(peak.alias("peak"), F.least(acc["dd"], (x - peak) / peak).alias("dd"))

    df = curves.withColumns({"_window": F.collect_list("equity").over(frame),
                             "_cagr": F.pow(F.col("equity") / F.lag("equity", n).over(w), F.lit(252.0 / n)) - 1})
    dd = F.when(F.size("_window") == n, F.aggregate("_window", start, step)["dd"])
    df = df.withColumn("_dd", dd).drop("_window")
    return df.withColumn("rolling_calmar", F.coalesce(F.col("_cagr") / F.nullif(F.abs("_dd"), F.lit(0.0)), F.lit(0.0))).drop(
        "_cagr", "_dd")


def report_rolling_sharpe(curves: DataFrame, key: str = "portfolio_id", longest: int = 252) -> DataFrame:
    """Rolling Sharpe without a risk-free rate over min(252, half the returns) bars.

    The window length differs per curve, so sums over it are differences of running sums at two row numbers, matched with
    an equi-join on the row number.
    """
    w = ordered(key)
    df = with_returns(curves, [key]).where("ret IS NOT NULL")
    df = df.withColumns({"_i": F.row_number().over(w), "_s": F.sum("ret").over(running(w)),
                         "_q": F.sum(F.col("ret") * F.col("ret")).over(running(w)),
                         "_n": F.least(F.lit(longest), F.floor(F.count(F.lit(1)).over(Window.partitionBy(key)) / 2))})
    past = df.select(key, (F.col("_i") + F.col("_n")).alias("_i"), F.col("_s").alias("_ps"), F.col("_q").alias("_pq"))
    df = df.where("_i >= _n AND _n >= 2").join(past, [key, "_i"], "left")
    n = F.col("_n")
    total = F.col("_s") - F.coalesce("_ps", F.lit(0.0))
    square = F.col("_q") - F.coalesce("_pq", F.lit(0.0))
    sd = F.sqrt(F.greatest(square - total * total / n, F.lit(0.0)) / (n - 1))
    return df.withColumn("rolling_sharpe", total / n / F.nullif(sd, F.lit(0.0)) * root_year()).select(key, "ts", "rolling_sharpe")


def aligned_returns(curves: DataFrame, benchmark: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """Returns of each curve and of the benchmark on the dates both have."""
    r = with_returns(curves, [key]).where("ret IS NOT NULL").select(key, "ts", F.col("ret").alias("strategy"))
    b = benchmark.withColumn("benchmark", F.col("equity") / F.lag("equity").over(Window.orderBy("ts")) - 1).where(
        "benchmark IS NOT NULL").select("ts", "benchmark")
    return r.join(b, "ts")


def benchmark_stats(aligned: DataFrame, key: str = "portfolio_id", least: int = 30) -> DataFrame:
    s, b = F.col("strategy"), F.col("benchmark")
    agg = aligned.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(s, b).alias("beta"), (F.regr_intercept(s, b) * 252).alias("alpha_annual"),
        F.regr_r2(s, b).alias("r_squared"), F.avg(s - b).alias("_m"), F.stddev_samp(s - b).alias("_sd"),
        (F.exp(F.sum(F.log1p(b))) - 1).alias("benchmark_return"), (F.exp(F.sum(F.log1p(s))) - 1).alias("_total"))
    return agg.where(F.col("n") >= least).withColumns({
        "information_ratio": F.when(F.col("_sd") > 0, F.col("_m") / F.col("_sd") * root_year()).otherwise(0.0),
        "excess_return": F.col("_total") - F.col("benchmark_return")}).drop("_m", "_sd", "_total")


def attribution(aligned: DataFrame, key: str = "portfolio_id", least: int = 30) -> DataFrame:
    """Market and alpha share of the annual return; alpha is tested with the standard error of the intercept."""
    s, b = F.col("strategy"), F.col("benchmark")
    agg = aligned.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.regr_slope(s, b).alias("beta"), F.regr_intercept(s, b).alias("_a"),
        F.regr_r2(s, b).alias("r_squared"), F.avg(s).alias("_ms"), F.avg(b).alias("_mb"),
        F.regr_syy(s, b).alias("_syy"), F.regr_sxx(s, b).alias("_sxx")).where(F.col("_n") >= least)
    residual = F.col("_syy") * (1 - F.col("r_squared")) / (F.col("_n") - 2)
    error = F.sqrt(residual * (1 / F.col("_n") + F.col("_mb") * F.col("_mb") / F.nullif(F.col("_sxx"), F.lit(0.0))))
    return agg.select(key, (F.col("_ms") * 252).alias("total_annual_return"),
                      (F.col("beta") * F.col("_mb") * 252).alias("market_contribution"),
                      (F.col("_a") * 252).alias("alpha_contribution"), "beta", "r_squared",
                      (F.col("_a") / (error + 1e-10)).alias("alpha_tstat"))


def trade_stats(trades: DataFrame, key: str = "strategy_id") -> DataFrame:
    """Closed trades only; a loss is a result of zero or less. Pure aggregates, combined map-side."""
    pnl = F.col("realized_pnl")
    win, loss = F.when(pnl > 0, pnl), F.when(pnl <= 0, pnl)
    agg = trades.where("realized_pnl IS NOT NULL").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_trades"), (F.count(win) / F.count(F.lit(1))).alias("win_rate"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.sum(win), F.lit(0.0)).alias("gross_profit"), F.coalesce(F.sum(loss), F.lit(0.0)).alias("gross_loss"),
        F.sum(pnl).alias("total_pnl"), F.avg("holding_bars").alias("avg_holding_bars"))
    return agg.withColumns({
        "profit_factor": F.col("gross_profit") / F.abs(F.nullif(F.col("gross_loss"), F.lit(0.0))),
        "expectancy": F.col("win_rate") * F.col("avg_win") - (1 - F.col("win_rate")) * F.abs("avg_loss"),
        "insufficient_sample": F.col("n_trades") < 30})


def verdict(metrics: DataFrame, ci_low: str | None = None) -> DataFrame:
    """Go / no-go lines from significance, Sharpe band, confidence bound and drawdown."""
    dsr, sharpe, dd = F.col("deflated_sharpe"), F.col("sharpe_ratio"), F.col("max_drawdown")
    lines = [F.when(dsr > 0, "significant").otherwise("not_significant"),
             F.when(sharpe > 0.5, "good_sharpe").when(sharpe > 0, "weak_sharpe").otherwise("negative_sharpe"),
             F.when(F.abs(dd) < 0.20, "drawdown_acceptable").otherwise("drawdown_large")]
    if ci_low:
        lines.insert(2, F.when(F.col(ci_low) > 0, "ci_positive").when(F.col(ci_low).isNotNull(), "ci_includes_zero"))
    return metrics.withColumns({"summary": F.concat_ws(" | ", F.array_compact(F.array(*lines))),
                                "proceed": (dsr > 0) & (sharpe > 0.3)})
