"""Stop levels and the first bar at which a position is stopped out or reaches its target."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marketframe.operators.windows import by_asset, roll


def true_range():
    before = F.lag("close").over(by_asset())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr_stops(bars: DataFrame, period: int = 14, multiple: float = 2.0) -> DataFrame:
    """Stop prices at a multiple of the mean true range from the close, for both directions."""
    df = bars.withColumn("_tr", true_range()).withColumn("atr", roll(F.avg, "_tr", period))
    return df.withColumns({"long_stop": F.col("close") - multiple * F.col("atr"),
                           "short_stop": F.col("close") + multiple * F.col("atr")}).drop("_tr")


GROUP_ROWS = 50_000      # positions handled by one task at a time


def stop_hits(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """First bar after entry on which a position leaves, and why.

    positions: position_id, asset_id, entry_ts, entry_price, direction, stop_pct, target_pct, trail_pct and, optional,
    atr_multiple (the last three may be null). A trailing level follows the best price since entry including the current
    bar, at a share of it or, with atr_multiple, at that many mean true ranges (the column atr of bars) as they are on the bar;
    while the range is unknown or zero the last level stands. On one bar a stop counts before a target. Levels are
    compared to the bar's low and high.

    Positions of an asset are cut into groups of about GROUP_ROWS by a hash, from a count per asset, so a popular asset
    is spread over many tasks; every group sees the bars of its asset, at most one per calendar day. Inside a group all
    open positions advance together bar by bar and leave the working set when they are hit.
    """
    count = positions.groupBy("asset_id").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("_groups"))
    left = positions.join(count, "asset_id").withColumn(
        "_g", F.pmod(F.xxhash64("position_id"), F.col("_groups").cast("long")).cast("int")).drop("_groups")
    copies = count.select(F.col("asset_id").alias("_asset"), F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_copy"))
    if "atr_multiple" not in positions.columns:
        left = left.withColumn("atr_multiple", F.lit(None).cast("double"))
    atr = F.col("atr") if "atr" in bars.columns else F.lit(None).cast("double")
    right = bars.select(F.col("asset_id").alias("_asset"), "ts", "high", "low", "close", atr.alias("atr")).join(copies, "_asset")

    def run(pos, bar):
        import numpy as np
        columns = ["position_id", "asset_id", "exit_ts", "reason", "level", "exit_price"]
        if pos.empty or bar.empty:
            return pd.DataFrame(columns=columns)
        bar = bar.sort_values("ts")
        days = bar["ts"].to_numpy(dtype="datetime64[D]")
        high, low, close, width = (bar[c].to_numpy(dtype=float) for c in ("high", "low", "close", "atr"))
        at = np.searchsorted(days, pos["entry_ts"].to_numpy(dtype="datetime64[D]"), side="right")
        side = np.where(pos["direction"] == "LONG", 1.0, -1.0)
        entry, stop_pct, target_pct, trail_pct, multiple = (pos[c].to_numpy(dtype=float) for c in (
            "entry_price", "stop_pct", "target_pct", "trail_pct", "atr_multiple"))
        stop, target, best = entry * (1 - side * stop_pct), entry * (1 + side * target_pct), entry.copy()
        trailing = ~np.isnan(trail_pct)
        out_bar, reason, level = np.full(len(pos), -1), np.full(len(pos), "", dtype=object), np.full(len(pos), np.nan)
        live = np.flatnonzero(at < len(days))
        while len(live):
            i = at[live]
            s, h, lo = side[live], high[i], low[i]
            best[live] = np.where(s > 0, np.maximum(best[live], h), np.minimum(best[live], lo))
            stop[live] = np.where(trailing[live], best[live] * (1 - s * trail_pct[live]), stop[live])
            known = ~np.isnan(multiple[live]) & (np.nan_to_num(width[i]) > 0)
            stop[live] = np.where(known, best[live] - s * multiple[live] * np.nan_to_num(width[i]), stop[live])
            adverse, favour = np.where(s > 0, lo, h), np.where(s > 0, h, lo)
            stopped = (adverse - stop[live]) * s <= 0
            reached = ~stopped & ((favour - target[live]) * s >= 0)
            for mask, name, values in ((stopped, "stop_exit", stop), (reached, "target_exit", target)):
                done = live[mask]
                out_bar[done], reason[done], level[done] = at[done], name, values[done]
            live = live[~(stopped | reached)]
            at[live] += 1
            live = live[at[live] < len(days)]
        hit = out_bar >= 0
        return pd.DataFrame({"position_id": pos["position_id"][hit], "asset_id": pos["asset_id"][hit],
                             "exit_ts": bar["ts"].to_numpy()[out_bar[hit]], "reason": reason[hit], "level": level[hit],
                             "exit_price": close[out_bar[hit]]})

    return left.groupBy("asset_id", "_g").cogroup(right.groupBy("_asset", "_copy")).applyInPandas(
        run, "position_id string, asset_id string, exit_ts date, reason string, level double, exit_price double")
