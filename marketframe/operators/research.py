"""Signal research: information coefficients, decay, turnover, capacity."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketframe.operators.crosssection import percent_rank_avg
from marketframe.operators.windows import by_asset


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null where one side does not vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def information_coefficients(panel: DataFrame, signal: str, horizons: list[int], least: int = 5) -> DataFrame:
    """Spearman correlation per (ts, horizon) of a signal with the return that follows it."""
    w = by_asset()
    ahead = {f"_f{h}": F.lead("close", h).over(w) / F.col("close") - 1 for h in horizons}
    pairs = F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"_f{h}").alias("fwd")) for h in horizons])
    long = (panel.withColumns(ahead).where(F.col(signal).isNotNull())
            .select("ts", F.col(signal).alias("_sig"), F.explode(pairs).alias("_p")).select("ts", "_sig", "_p.*")
            .where("fwd IS NOT NULL"))
    keys = ["ts", "horizon"]
    ranked = long.withColumns({"_rs": percent_rank_avg("_sig", keys), "_rf": percent_rank_avg("fwd", keys)})
    return ranked.groupBy(*keys).agg(correlation("_rs", "_rf").alias("ic"), F.count(F.lit(1)).alias("n")).where(
        (F.col("n") >= least) & F.col("ic").isNotNull())


def factor_decay(ics: DataFrame) -> DataFrame:
    """Mean, population deviation, information ratio, t-statistic and hit rate per horizon."""
    m, s, n = F.avg("ic"), F.stddev_pop("ic"), F.count(F.lit(1))
    return ics.groupBy("horizon").agg(
        m.alias("mean_ic"), s.alias("std_ic"), (m / (s + 1e-10)).alias("ir"),
        (m / (s / F.sqrt(n.cast("double")) + 1e-10)).alias("t_stat"),
        F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("pct_positive"), n.alias("n_obs"))


def rolling_ic(ics: DataFrame, n: int = 12) -> DataFrame:
    """Mean of the last n evaluations, 0 while there are fewer than three; one row per evaluation date."""
    w = Window.orderBy("ts").rowsBetween(-(n - 1), 0)
    return ics.withColumn("rolling_ic", F.when(F.count("ic").over(w) >= 3, F.avg("ic").over(w)).otherwise(0.0))


def turnover(weights: DataFrame, rate: float = 0.001) -> DataFrame:
    """Turnover, cost drag and break-even cost of a weight panel (ts, asset_id, close, weight); one row.

    The cost scales turnover by the average price, as this measure is defined.
    """
    w = by_asset()
    df = weights.withColumns({"_d": F.coalesce(F.abs(F.col("weight") - F.lag("weight").over(w)), F.lit(0.0)),
                              "_wr": F.coalesce(F.lag("weight").over(w) * (F.col("close") / F.lag("close").over(w) - 1), F.lit(0.0))})
    assets = df.groupBy("asset_id").agg(F.avg("close").alias("p")).agg(
        F.count(F.lit(1)).alias("n_assets"), F.avg("p").alias("avg_price"))
    daily = df.groupBy("ts").agg(F.sum("_d").alias("_d"), F.sum("_wr").alias("_wr"))
    total = daily.agg(F.avg("_d").alias("_d"), F.sum(F.log1p("_wr")).alias("_g"), F.count(F.lit(1)).alias("_n"))
    df = total.withColumn("_a", assets.select(F.struct("n_assets", "avg_price")).scalar()).select("*", "_a.*")
    df = df.withColumns({"daily_turnover": F.col("_d") / F.greatest("n_assets", F.lit(1)),
                           "gross_annual_return": F.exp(F.col("_g") * 252 / F.col("_n")) - 1})
    df = df.withColumns({"annual_turnover": F.col("daily_turnover") * 252,
                         "annual_cost": F.col("daily_turnover") * F.col("avg_price") * rate * 252})
    return df.select("daily_turnover", "annual_turnover", "annual_cost", "gross_annual_return",
                     (F.col("gross_annual_return") - F.col("annual_cost")).alias("net_annual_return"),
                     (F.col("gross_annual_return") / (F.col("annual_turnover") + 1e-10) * 10_000).alias("break_even_bps"))


def capacity(trades: DataFrame, key: str, current: float, target: float, adv_fraction: float = 0.01,
             daily_shares: float = 1_000_000.0) -> DataFrame:
    """Square-root impact at today's capital and at the target capital, per key."""
    part = F.col("avg_quantity") / (daily_shares + 1)
    df = trades.groupBy(key).agg(F.avg("quantity").alias("avg_quantity")).withColumn("participation", part)
    now, then = 0.1 * F.sqrt("participation"), 0.1 * F.sqrt(F.col("participation") * (target / current))
    return df.select(key, "participation", (now * 100).alias("current_slippage_pct"), (then * 100).alias("target_slippage_pct"),
                     ((then - now) * 20_000).alias("drag_bps"),
                     (current * adv_fraction ** 2 / (F.col("participation") + 1e-10)).alias("max_capital"),
                     F.when(then - now > 0.005, "constrained").otherwise("scales").alias("recommendation"))
