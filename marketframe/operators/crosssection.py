"""Cross-sectional ranks, baskets and factor panels.

A cross-section holds one row per listed asset and date, so a window over a date is bounded by the universe.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketframe.operators.recurrence import Ewm, ewm
from marketframe.operators.windows import by_asset, first_of_month, log_return, ordered, pct_change, roll, with_deviations


def percent_rank_avg(x: str, keys: list[str]) -> Column:
    """Percentile rank with ties sharing their average rank; null stays null and does not count."""
    order = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
    ties = Window.partitionBy(*keys, x)
    group = Window.partitionBy(*keys)
    rank = F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    return F.when(F.col(x).isNotNull(), rank / F.count(x).over(group))


def _ranks_by_code(code: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Percentile ranks of the columns of x within equal codes, ties sharing their average rank; NaN stays NaN and does not count."""
    out = np.full(x.shape, np.nan)
    place = np.arange(len(code))
    for j in range(x.shape[1]):
        order = np.lexsort((x[:, j], code))                     # NaN comes last within its code
        c, v = code[order], x[order, j]
        new_code = np.append(True, c[1:] != c[:-1])
        new_tie = new_code | np.append(True, v[1:] != v[:-1])
        first = np.maximum.accumulate(np.where(new_code, place, 0))
        ties = np.flatnonzero(new_tie)
        size = np.diff(np.append(ties, len(c)))
        rank = np.repeat(ties, size) - first + 1 + np.repeat(size - 1, size) / 2.0
        valid = np.bincount(np.cumsum(new_code) - 1, weights=~np.isnan(v))
        out[order, j] = np.where(np.isnan(v), np.nan, rank / np.maximum(valid, 1)[np.cumsum(new_code) - 1])
    return out


def percent_ranks(df: DataFrame, columns: list[str], key: str = "ts") -> DataFrame:
    """df with each of the columns replaced by its percentile rank per key, as percent_rank_avg gives it, null for null.

    One shuffle by the key serves all columns. Sorted batches are ranked as arrays; a key that a batch leaves open is carried into the
    next, so memory holds one batch and one cross-section.
    """
    schema = df.schema

    def run(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            table = pa.Table.from_batches([b for b in (rest, batch) if b is not None]) if rest is not None or batch is not None else None
            if table is None or not len(table):
                continue
            table = table.combine_chunks()
            code = table.column(key).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cut = len(code) if batch is None else int(np.argmax(code == code[-1]))
            rest = table.slice(cut).combine_chunks().to_batches()[0] if cut < len(code) else None
            if cut:
                x = np.column_stack([table.column(c).to_numpy() for c in columns])[:cut].astype(float)
                ranked = _ranks_by_code(code[:cut], x)
                done = table.slice(0, cut)
                for j, c in enumerate(columns):
                    done = done.set_column(done.schema.get_field_index(c), c, pa.array(ranked[:, j], mask=np.isnan(ranked[:, j])))
                yield from done.combine_chunks().to_batches()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def ranked_baskets(df: DataFrame, score: str, n_long: int, n_short: int = 0) -> DataFrame:
    """Top n_long as LONG and bottom n_short as SHORT per date; dates with too few assets give nothing."""
    day = Window.partitionBy("ts")
    best = day.orderBy(F.desc(score), "asset_id")
    ranked = df.where(F.col(score).isNotNull()).withColumns(
        {"_r": F.row_number().over(best), "_n": F.count(F.lit(1)).over(day)})
    side = F.when(F.col("_r") <= n_long, "LONG").when(F.col("_r") > F.col("_n") - n_short, "SHORT")
    return (ranked.where(F.col("_n") >= n_long + n_short).withColumns({"side": side, "rank": F.col("_r").cast("long")})
            .where(F.col("side").isNotNull()).drop("_r", "_n"))


def month_starts(bars: DataFrame) -> DataFrame:
    """First date of each month on which anything trades: the rebalance clock of the whole universe."""
    return bars.groupBy(F.trunc("ts", "month").alias("_month")).agg(F.min("ts").alias("ts")).select("ts")


def monthly_scores(bars: DataFrame, score: Column, name: str) -> DataFrame:
    """The score of every asset as of the rebalance dates, taken from its latest bar at or before the date.

    Each bar is valid until the day before the asset's next bar, and the rebalance date of a month is looked up inside
    that interval month by month, so the match is an equi-join on the month.
    """
    w = by_asset()
    scored = bars.withColumn(name, score).withColumn(
        "_to", F.coalesce(F.date_sub(F.lead("ts").over(w), 1), F.last_day("ts")))
    months = F.sequence(F.trunc("ts", "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))
    spread = scored.where(F.col(name).isNotNull()).select(
        "asset_id", F.col("ts").alias("_from"), "_to", name, F.explode(months).alias("_month"))
    clock = month_starts(bars).withColumn("_month", F.trunc("ts", "month"))
    return (spread.join(clock, "_month").where(F.col("ts").between(F.col("_from"), F.col("_to")))
            .select("ts", "asset_id", name))


def momentum_score(lookback: int = 252, skip: int = 21) -> Column:
    w = by_asset()
    return F.lag("close", skip - 1).over(w) / F.lag("close", lookback + skip - 1).over(w) - 1


def low_vol_score(window: int = 252) -> Column:
    """Annualised deviation of log returns over up to `window` bars, once half of them exist; from a column `lr`."""
    return roll(F.stddev_samp, "lr", window, least=window // 2) * F.sqrt(F.lit(252.0))


def basket_changes(baskets: DataFrame) -> DataFrame:
    """Entries and exits between consecutive rebalances: membership present at k but not k-1, or the reverse."""
    # the clock has one row per rebalance, numbered in one small ordered window
    order = Window.orderBy("ts")
    clock = baskets.select("ts").distinct().withColumns({"_k": F.row_number().over(order), "_next": F.lead("ts").over(order)})
    asset = Window.partitionBy("asset_id").orderBy("_k")
    near = baskets.join(clock, "ts").withColumns({"_before": F.lag("_k").over(asset), "_after": F.lead("_k").over(asset)})
    enter = F.when(F.col("_before").isNull() | (F.col("_before") < F.col("_k") - 1), F.struct("ts", F.lit("ENTER").alias("change")))
    leave = F.when(F.col("_next").isNotNull() & (F.col("_after").isNull() | (F.col("_after") > F.col("_k") + 1)),
                   F.struct(F.col("_next").alias("ts"), F.lit("EXIT").alias("change")))
    return near.select("asset_id", F.explode(F.filter(F.array(enter, leave), lambda x: x.isNotNull())).alias("_c")).select("_c.ts", "asset_id", "_c.change")


def basket_exits(baskets: DataFrame) -> DataFrame:
    """Assets of the last rebalance but one that the last one no longer holds."""
    days = baskets.select("ts").distinct().orderBy(F.desc("ts")).limit(2)
    ends = days.agg(F.max("ts").alias("_now"), F.min("ts").alias("_was"), F.count("*").alias("_n")).where("_n = 2")
    last = baskets.join(days, "ts", "left_semi").groupBy("asset_id").agg(F.max("ts").alias("_at"))
    return last.join(ends, last["_at"] == ends["_was"], "left_semi").select("asset_id")


def dual_momentum(bars: DataFrame, equities: list[str], bond: str, bill: str, lookback: int = 252) -> DataFrame:
    """Best equity by trailing return if it beats the bill asset, else the bond; on the first date of each month."""
    ret = F.col("close") / F.lag("close", lookback - 1).over(by_asset()) - 1
    scores = monthly_scores(bars.where(F.col("asset_id").isin([*equities, bill])), ret, "ret")
    is_equity = F.col("asset_id").isin(equities)
    best = scores.groupBy("ts").agg(
        F.max_by(F.when(is_equity, F.col("asset_id")), F.when(is_equity, F.col("ret"))).alias("best"),
        F.max(F.when(is_equity, F.col("ret"))).alias("equity_return"),
        F.coalesce(F.max(F.when(F.col("asset_id") == bill, F.col("ret"))), F.lit(0.0)).alias("bill_return"))
    return best.where(F.col("best").isNotNull()).withColumn(
        "holding", F.when(F.col("equity_return") > F.col("bill_return"), F.col("best")).otherwise(F.lit(bond)))


def alpha_factors(bars: DataFrame, vix: str | None = None) -> DataFrame:
    """The factor panel: returns, risk-adjusted momentum, reversals, z-scores, volatilities, volume and technicals.

    vix names a column of bars with the volatility index as known at the bar; it adds its level and its 20-bar mean.
    """
    eps = 1e-8
    w = by_asset()
    root = F.sqrt(F.lit(252.0))
    df = bars.withColumns({"_r1": pct_change("close"), "_lr": log_return(), "_ch": F.col("close") - F.lag("close").over(w),
                           "_dv": F.col("volume") * F.col("close")})
    df = with_deviations(df, "_r1", {f"_sr{p}": p for p in (5, 10, 20, 60, 120, 252)})
    df = with_deviations(df, "_lr", {f"_sl{p}": p for p in (5, 10, 20, 60)})
    cols: dict[str, Column] = {}
    for p in (5, 10, 20, 60, 120, 252):
        cols[f"ret_{p}d"] = pct_change("close", p)
        cols[f"mom_adj_{p}d"] = pct_change("close", p) / (F.col(f"_sr{p}") * root + eps)
    cols["mom_12_1"] = F.lag("close", 21).over(w) / F.lag("close", 252).over(w) - 1
    for p in (1, 3, 5):
        cols[f"rev_{p}d"] = -pct_change("close", p)
    for p in (10, 20):
        cols[f"zscore_{p}d"] = (F.col("close") - roll(F.avg, "close", p)) / (roll(F.stddev_samp, "close", p) + eps)
    for p in (5, 10, 20, 60):
        cols[f"vol_{p}d"] = F.col(f"_sl{p}") * root
    cols["vol_ratio"] = F.col("volume") / (roll(F.avg, "volume", 20) + 1)
    cols["amihud_illiq"] = roll(F.avg, F.abs("_lr") / (F.col("_dv") + 1), 20)
    cols["dollar_vol_20"] = roll(F.avg, "_dv", 20)
    cols["bb_pos"] = (F.col("close") - roll(F.avg, "close", 20)) / (2 * roll(F.stddev_samp, "close", 20) + eps)
    high, low = roll(F.max, "close", 252), roll(F.min, "close", 252)
    cols["pct_from_high"] = (F.col("close") - high) / (high + eps)
    cols["pct_from_low"] = (F.col("close") - low) / (low + eps)
    if vix:
        cols["vix_level"] = F.col(vix)
        cols["vix_20ma"] = roll(F.avg, vix, 20)
    df = df.withColumns(cols).withColumns({
        "vol_ratio_5_20": F.col("vol_5d") / (F.col("vol_20d") + eps),
        "vol_ratio_20_60": F.col("vol_20d") / (F.col("vol_60d") + eps)})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def ewm_factors(bars: DataFrame) -> DataFrame:
    """The factors built on exponential means: RSI and the MACD histogram relative to price."""
    from marketframe.operators.signals import macd_columns
    ch = F.coalesce(F.col("close") - F.lag("close").over(by_asset()), F.lit(0.0))
    df = bars.withColumns({"_g": F.greatest(ch, F.lit(0.0)), "_l": F.greatest(-ch, F.lit(0.0))})
    df = ewm(df, [Ewm("_g", 1 / 14, "_ag"), Ewm("_l", 1 / 14, "_al")])
    df = df.withColumn("rsi_14", 100 - 100 / (1 + F.col("_ag") / (F.col("_al") + 1e-8)))
    df = macd_columns(df).withColumn("macd_hist", F.col("macd_hist") / (F.col("close") + 1e-8))
    return df.drop("_g", "_l", "_ag", "_al", "macd", "macd_signal")


def long_factors(panel: DataFrame, names: list[str]) -> DataFrame:
    """Wide factor columns to (ts, asset_id, factor, value)."""
    return panel.unpivot(["ts", "asset_id"], names, "factor", "value").where(F.col("value").isNotNull())


def ml_dataset(panel: DataFrame, horizon: int = 21, least: int = 5) -> DataFrame:
    """Adds `label`: the cross-sectional rank of the forward return, on dates with enough assets."""
    df = panel.withColumn("fwd", F.lead("close", horizon).over(by_asset()) / F.col("close") - 1).where("fwd IS NOT NULL")
    counted = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ts"))).where(F.col("_n") >= least)
    return counted.withColumn("label", percent_rank_avg("fwd", ["ts"])).drop("_n")
