"""Realised and implied volatility, leverage and regimes built on them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketframe.functions.stats import rnd
from marketframe.operators.asof import asof_daily
from marketframe.operators.windows import by_asset, log_return, pct_change, roll


def with_exogenous(bars: DataFrame, series: DataFrame, series_id: str, name: str = "vix") -> DataFrame:
    """Carry a released series forward onto every bar; releases between trading dates count as well.

    The series becomes a lookup by day, so the bars are joined by date and not sorted against it.
    """
    one = series.where(F.col("series_id") == series_id).select("release_date", F.col("value").alias(name))
    return asof_daily(bars, one, [], "ts", "release_date", [name])


def realized_vol(n: int = 30, default: float = 0.20) -> Column:
    """Annualised deviation of the last n log returns from a column `lr`; a default where history is short."""
    return F.coalesce(roll(F.stddev_samp, "lr", n) * F.sqrt(F.lit(252.0)), F.lit(default))


def with_log_return(bars: DataFrame) -> DataFrame:
    return bars.withColumn("lr", log_return())


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def leverage(vol: Column, target: float = 0.10, low: float = 0.25, high: float = 2.0) -> Column:
    return clip(target / F.greatest(vol, F.lit(0.01)), low, high)


def iv_estimate(bars: DataFrame, vix: str | None = None, window: int = 30, premium: float = 1.15) -> DataFrame:
    """Implied volatility proxy: realised volatility scaled by the volatility index, or by a flat premium."""
    root = F.sqrt(F.lit(252.0))
    df = with_log_return(bars).withColumns({"_rv": roll(F.stddev_samp, "lr", window) * root,
                                            "_rv20": roll(F.stddev_samp, "lr", 20) * root})
    if vix:
        ratio = clip(F.col(vix) / 100.0 / F.greatest(F.col("_rv20"), F.lit(0.05)), 0.5, 3.0)
        iv = F.when(F.col(vix).isNotNull() & F.col("_rv20").isNotNull(), F.col("_rv") * ratio)
    else:
        iv = F.col("_rv") * premium
    return df.withColumn("iv", F.when(iv.isNotNull(), clip(iv, 0.05, 3.0))).drop("_rv", "_rv20")


def iv_rank(df: DataFrame, n: int = 252) -> DataFrame:
    """Position of today's value inside its trailing range, and the share of trailing values below it."""
    frame = by_asset().rowsBetween(-(n - 1), 0)
    low, high = F.min("iv").over(frame), F.max("iv").over(frame)
    df = df.where("iv IS NOT NULL").withColumns({"_lo": low, "_hi": high, "_all": F.collect_list("iv").over(frame)})
    below = F.size(F.filter("_all", lambda v: v < F.col("iv"))) / F.size("_all")
    flat = F.col("_hi") == F.col("_lo")
    return df.withColumns({
        "iv_rank": F.when(flat, 0.5).otherwise(clip((F.col("iv") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), 0.0, 1.0)),
        "iv_percentile": F.when(flat, 0.5).otherwise(below)}).drop("_lo", "_hi", "_all")


def vix_regime(bars: DataFrame, vix: str = "vix") -> DataFrame:
    """Bands of the 20-observation mean, the confidence multiplier, and an alert when the extreme band is entered."""
    w = by_asset()
    df = bars.where(F.col(vix).isNotNull()).withColumn("avg20", rnd(F.coalesce(roll(F.avg, vix, 20), F.col(vix)), 8))
    df = df.withColumn("regime", F.when(F.col("avg20") > 35, "HIGH_VOL_EXTREME").when(F.col("avg20") > 25, "HIGH_VOL")
                       .otherwise("LOW_VOL"))
    extreme = F.col("regime") == "HIGH_VOL_EXTREME"
    return df.withColumns({
        "multiplier": F.when(extreme, 0.0).when(F.col("regime") == "HIGH_VOL", 0.5).otherwise(1.0),
        "alert": extreme & (F.lag("regime", 1, "LOW_VOL").over(w) != "HIGH_VOL_EXTREME")})


def vol_fallback(bars: DataFrame) -> DataFrame:
    """Volatility where a model has too little history: population deviation of the last 30 returns, or a default."""
    df = bars.withColumns({"r": pct_change("close")})
    frame = by_asset().rowsBetween(-29, 0)
    seen = F.count("r").over(by_asset().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"n_obs": seen, "vol": F.when(seen > 5, F.stddev_pop("r").over(frame) * F.sqrt(F.lit(252.0)))
                           .otherwise(0.20)})


def regimes(bars: DataFrame, vix: str | None = None) -> DataFrame:
    """Bull or bear by the 200-bar mean, high or low volatility by its own 252-bar median; nulls fall to bear and low."""
    df = bars.withColumn("_r", pct_change("close"))
    if vix:
        df = df.withColumn("_v", F.col(vix))
    else:
        df = df.withColumn("_v", roll(F.stddev_samp, "_r", 30) * F.sqrt(F.lit(252.0)))
    # the frame as a sorted array: picking the middle is far cheaper than an exact percentile per frame
    df = df.withColumn("_w", F.sort_array(F.collect_list("_v").over(by_asset().rowsBetween(-251, 0))))
    median = F.when(F.size("_w") >= 252, (F.element_at("_w", 126) + F.element_at("_w", 127)) / 2)
    bull = F.coalesce(F.col("close") > roll(F.avg, "close", 200), F.lit(False))
    high = F.coalesce(F.col("_v") > median, F.lit(False))
    label = F.concat(F.when(bull, "bull").otherwise("bear"), F.when(high, "_high_vol").otherwise("_low_vol"))
    return df.withColumn("regime", label).drop("_r", "_v", "_w")
