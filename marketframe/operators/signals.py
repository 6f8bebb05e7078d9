"""Vectorised signals: one row per (asset, bar) with a value in {-1, 0, 1}, delayed by one bar.

Each function takes a bar panel and returns it with the column `signal`; parameters stay Column literals, so a signal
composes with any other DataFrame step inside one plan.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketframe.operators.recurrence import Ewm, ewm
from marketframe.operators.windows import by_asset, pct_change, roll, shifted_signal


def _side(long_when: Column, short_when: Column | None = None) -> Column:
    side = F.when(long_when, 1)
    if short_when is not None:
        side = F.when(short_when, -1).when(long_when, 1)
    return side.otherwise(0)


def sma_crossover(bars: DataFrame, fast: int = 50, slow: int = 200, long_only: bool = True) -> DataFrame:
    f, s = roll(F.avg, "close", fast), roll(F.avg, "close", slow)
    df = bars.withColumns({"sma_fast": f, "sma_slow": s})
    up, down = F.col("sma_fast") > F.col("sma_slow"), F.col("sma_fast") < F.col("sma_slow")
    return shifted_signal(df.withColumn("raw", _side(up, None if long_only else down)))


def donchian(bars: DataFrame, period: int = 20, long_only: bool = False) -> DataFrame:
    """Close beyond the extreme of the previous `period` closes."""
    df = bars.withColumns({"upper": roll(F.max, "close", period, end=-1), "lower": roll(F.min, "close", period, end=-1)})
    down = None if long_only else F.col("close") < F.col("lower")
    return shifted_signal(df.withColumn("raw", _side(F.col("close") > F.col("upper"), down)))


def bollinger(bars: DataFrame, window: int = 20, k: float = 2.0, long_only: bool = False) -> DataFrame:
    df = bars.withColumns({"mid": roll(F.avg, "close", window), "sd": roll(F.stddev_samp, "close", window)})
    low = F.col("close") < F.col("mid") - k * F.col("sd")
    high = F.col("close") > F.col("mid") + k * F.col("sd")
    return shifted_signal(df.withColumn("raw", _side(low, None if long_only else high)))


def momentum(bars: DataFrame, lookback: int = 252, skip: int = 21, long_only: bool = True) -> DataFrame:
    """Sign of the return between lookback+skip and skip bars ago."""
    w = by_asset()
    ret = F.lag("close", skip).over(w) / F.lag("close", lookback + skip).over(w) - 1
    df = bars.withColumn("momentum", ret)
    down = None if long_only else F.col("momentum") < 0
    return shifted_signal(df.withColumn("raw", _side(F.col("momentum") > 0, down)))


def equal_weight(bars: DataFrame) -> DataFrame:
    return shifted_signal(bars.withColumn("raw", F.lit(1)))


def with_rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Wilder RSI of the vectorised form: the first bar counts as a gain of 0, a zero average loss becomes 1e-10."""
    change = F.col("close") - F.lag("close").over(by_asset())
    df = bars.withColumn("_ch", F.coalesce(change, F.lit(0.0))).withColumns({
        "_gain": F.greatest("_ch", F.lit(0.0)), "_loss": F.greatest(-F.col("_ch"), F.lit(0.0))})
    df = ewm(df, [Ewm("_gain", 1 / period, "_ag"), Ewm("_loss", 1 / period, "_al")])
    loss = F.when(F.col("_al") == 0, 1e-10).otherwise(F.col("_al"))
    return df.withColumn("rsi", 100 - 100 / (1 + F.col("_ag") / loss)).drop("_ch", "_gain", "_loss", "_ag", "_al")


def rsi(bars: DataFrame, period: int = 14, oversold: float = 30, overbought: float = 70, trend: int = 200,
        long_only: bool = True) -> DataFrame:
    df = with_rsi(bars, period).withColumn("sma_trend", roll(F.avg, "close", trend))
    low = (F.col("rsi") < oversold) & (F.col("close") > F.col("sma_trend"))
    down = None if long_only else F.col("rsi") > overbought
    return shifted_signal(df.withColumn("raw", _side(low, down)))


def macd_columns(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Full-history MACD: line, its own mean, and the histogram."""
    df = ewm(bars, [Ewm("close", 2 / (fast + 1), "_ef"), Ewm("close", 2 / (slow + 1), "_es")])
    df = df.withColumn("macd", F.col("_ef") - F.col("_es"))
    df = ewm(df, [Ewm("macd", 2 / (signal + 1), "macd_signal")])
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_ef", "_es")


def strategy_returns(signals: DataFrame, cost: float = 0.0) -> DataFrame:
    """Per asset and bar: yesterday's signal times today's return, less the cost of the change in position."""
    w = by_asset()
    held = F.coalesce(F.lag("signal").over(w), F.lit(0))
    before = F.coalesce(F.lag("signal", 2).over(w), F.lit(0))
    return signals.withColumn("ret", F.coalesce(held * pct_change("close"), F.lit(0.0)) - cost * F.abs(held - before))


def portfolio_equity(returns: DataFrame, keys: list[str], start: float = 100_000.0) -> DataFrame:
    """Equal-weight mean of asset returns per date, compounded to an equity index."""
    from marketframe.operators.windows import ordered, running
    daily = returns.groupBy(*keys, "ts").agg(F.avg("ret").alias("ret"))
    return daily.withColumn("equity", start * F.exp(F.sum(F.log1p("ret")).over(running(ordered(keys or [F.lit(1)])))))
