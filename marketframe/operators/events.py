"""Event signals: rows only where a strategy's held direction changes.

Where an exit does not depend on how long a position is held, the state is the last non-null request, so a running
`last(ignoreNulls)` replaces the row-by-row state machine.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marketframe.operators.recurrence import Ewm, ewm, trailing_ewm
from marketframe.operators.signals import with_rsi
from marketframe.operators.windows import (by_asset, first_of_month, ordered, roll, row_index, running, state_changes)


def sma_cross_events(bars: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """LONG when the fast mean crosses above the slow one, FLAT when below; after slow + 5 bars."""
    w = by_asset()
    df = bars.withColumns({"sma_fast": roll(F.avg, "close", fast), "sma_slow": roll(F.avg, "close", slow),
                           "_n": row_index()})
    df = df.withColumns({"_pf": F.lag("sma_fast").over(w), "_ps": F.lag("sma_slow").over(w)})
    f, s, pf, ps = (F.col(c) for c in ("sma_fast", "sma_slow", "_pf", "_ps"))
    event = F.when(F.col("_n") >= slow + 5, F.when((f > s) & (pf <= ps), "LONG").when((f < s) & (pf >= ps), "FLAT"))
    return state_changes(df.withColumn("event", event)).select("asset_id", "ts", "direction", "sma_fast", "sma_slow")


def with_ema_pair(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """Means over the trailing 4*slow bars, each slice seeded at its own first bar."""
    df = ewm(bars, [Ewm("close", 2 / (fast + 1), "_ef"), Ewm("close", 2 / (slow + 1), "_es")])
    df = trailing_ewm(df, "_ef", 2 / (fast + 1), "close", 4 * slow, "ema_fast")
    return trailing_ewm(df, "_es", 2 / (slow + 1), "close", 4 * slow, "ema_slow").drop("_ef", "_es")


def ema_cross(bars: DataFrame, fast: int = 12, slow: int = 26) -> DataFrame:
    df = with_ema_pair(bars, fast, slow).withColumns({"_n": row_index()})
    up = (F.col("_n") >= 2 * slow) & (F.col("ema_fast") > F.col("ema_slow"))
    return df.withColumn("raw", F.when(up, 1).otherwise(0)).withColumn(
        "signal", F.lag("raw", 1, 0).over(by_asset()).cast("long")).drop("_n")


def adx_columns(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's directional movement, full history; 0 until the first directional move."""
    w = by_asset()
    df = bars.withColumns({"_up": F.col("high") - F.lag("high").over(w), "_dn": F.lag("low").over(w) - F.col("low"),
                           "_pc": F.lag("close").over(w)})
    df = df.withColumns({
        "_pdm": F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0),
        "_mdm": F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0),
        "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")),
                         F.abs(F.col("low") - F.col("_pc")))})
    df = ewm(df, [Ewm("tr", 1 / n, "atr"), Ewm("_pdm", 1 / n, "_sp"), Ewm("_mdm", 1 / n, "_sm")])
    pdi = 100 * F.col("_sp") / F.nullif(F.col("atr"), F.lit(0.0))
    mdi = 100 * F.col("_sm") / F.nullif(F.col("atr"), F.lit(0.0))
    df = df.withColumns({"pdi": pdi, "mdi": mdi}).withColumn(
        "_dx", 100 * F.abs(F.col("pdi") - F.col("mdi")) / F.nullif(F.col("pdi") + F.col("mdi"), F.lit(0.0)))
    df = ewm(df, [Ewm("_dx", 1 / n, "_adx")])
    return df.withColumn("adx", F.coalesce("_adx", F.lit(0.0))).drop("_up", "_dn", "_pc", "_pdm", "_mdm", "_sp", "_sm",
                                                                    "_dx", "_adx")


def adx_events(bars: DataFrame, n: int = 14, threshold: float = 25.0, fast: int = 50, slow: int = 200) -> DataFrame:
    df = adx_columns(bars, n).withColumns({"_f": roll(F.avg, "close", fast), "_s": roll(F.avg, "close", slow),
                                           "_n": row_index()})
    event = F.when(F.col("_n") >= slow + 2 * n, F.when(F.col("adx") <= threshold, "FLAT")
                   .when(F.col("_f") > F.col("_s"), "LONG").when(F.col("_f") < F.col("_s"), "FLAT"))
    return state_changes(df.withColumn("event", event)).select("asset_id", "ts", "direction", "adx")


def bollinger_events(bars: DataFrame, window: int = 20, k: float = 2.0, entry_z: float = 1.0, exit_z: float = 0.5) -> DataFrame:
    df = bars.withColumns({"_m": roll(F.avg, "close", window), "_s": roll(F.stddev_samp, "close", window),
                           "_n": row_index()})
    df = df.withColumn("z", (F.col("close") - F.col("_m")) / (k * F.nullif(F.col("_s"), F.lit(0.0))))
    event = F.when(F.col("_n") >= window + 5, F.when(F.col("z") < -entry_z, "LONG").when(F.col("z") > entry_z, "SHORT")
                   .when(F.abs("z") < exit_z, "FLAT"))
    return state_changes(df.withColumn("event", event)).select(
        "asset_id", "ts", "direction", "z", F.when(F.col("direction") == "FLAT", 1.0)
        .otherwise(F.least(F.lit(1.0), F.abs("z") / (entry_z * 2))).alias("confidence"))


def tsmom_events(bars: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Monthly time-series momentum: direction by the sign of the 12-1 return, on the first bar of a month."""
    w = by_asset()
    df = bars.withColumns({"_first": first_of_month(), "_n": row_index(),
                           "momentum": F.lag("close", skip - 1).over(w) / F.lag("close", lookback + skip - 1).over(w) - 1})
    event = F.when(F.col("_first") & F.col("momentum").isNotNull(),
                   F.when(F.col("momentum") > 0, "LONG").otherwise("SHORT"))
    return state_changes(df.withColumn("event", event)).select(
        "asset_id", "ts", "direction", "momentum", F.least(F.lit(1.0), F.abs("momentum") * 5).alias("confidence"))


def donchian_events(bars: DataFrame, entry: int = 20, exit_: int = 10, long_only: bool = False) -> DataFrame:
    """Channel breakout with a state-dependent exit.

    Entries do not depend on the state, so the rows since the last entry form one episode; the position is closed from
    the first row of the episode whose close passes the exit level of the direction held.
    """
    df = bars.withColumns({
        "_hh": roll(F.max, "high", entry - 1, end=-1), "_ll": roll(F.min, "low", entry - 1, end=-1),
        "_xh": roll(F.max, "high", exit_ - 1, end=-1), "_xl": roll(F.min, "low", exit_ - 1, end=-1), "_n": row_index()})
    short = F.lit(False) if long_only else F.col("close") < F.col("_ll")
    side = F.when(F.col("_n") >= entry + 5, F.when(F.col("close") > F.col("_hh"), "LONG").when(short, "SHORT"))
    df = df.withColumn("_entry", side).withColumn("_episode", F.count("_entry").over(running()))
    within = ordered(["asset_id", "_episode"])
    held = F.first("_entry").over(running(within))
    out = F.when(F.col("_entry").isNull(), F.when(held == "LONG", F.col("close") < F.col("_xl"))
                 .when(held == "SHORT", F.col("close") > F.col("_xh"))).otherwise(False)
    df = df.withColumns({"_held": held, "_out": F.coalesce(out, F.lit(False))})
    closed = F.max("_out").over(running(within))
    df = df.withColumn("event", F.when(F.col("_held").isNull() | closed, "FLAT").otherwise(F.col("_held")))
    return state_changes(df).select("asset_id", "ts", "direction", "close")


RSI_STATE = "struct<side:string,held:int,events:array<struct<ts:date,direction:string,reason:string>>>"


def rsi_events(bars: DataFrame, period: int = 14, oversold: float = 30, overbought: float = 70, exit_rsi: float = 50,
               trend: int = 200, max_hold: int = 10, long_only: bool = False) -> DataFrame:
    """RSI position events with an exit level and a maximum holding time.

    The holding time makes the state depend on its own past, so the bars of one asset (at most one per calendar day) are
    folded in order inside the JVM; the fold keeps only the events.
    """
    # event form: the first difference is dropped instead of counted as zero, and the window is the trailing slice
    n = trend + period + 5
    change = F.col("close") - F.lag("close").over(by_asset())
    df = bars.withColumns({"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0))})
    df = ewm(df.withColumns({"_gain": F.when(change.isNotNull(), F.col("_gain")),
                             "_loss": F.when(change.isNotNull(), F.col("_loss"))}),
             [Ewm("_gain", 1 / period, "_ag"), Ewm("_loss", 1 / period, "_al")])
    df = trailing_ewm(df, "_ag", 1 / period, "_gain", n - 1, "_ag")
    df = trailing_ewm(df, "_al", 1 / period, "_loss", n - 1, "_al")
    ratio = F.when(F.col("_al") > 0, F.col("_ag") / F.col("_al")).otherwise(100.0)
    df = df.withColumns({"rsi": 100 - 100 / (1 + ratio), "_sma": roll(F.avg, "close", trend), "_n": row_index()})
    ready = df.where(F.col("_n") >= n).select("asset_id", "ts", "close", "rsi", "_sma")
    rows = ready.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("ts", "rsi", "close", "_sma"))).alias("rows"))

    def step(acc, x):
        flat = acc["side"] == "FLAT"
        held = acc["held"] + 1
        timed = ~flat & (held >= max_hold)
        exits = ((acc["side"] == "LONG") & (x["rsi"] >= exit_rsi)) | ((acc["side"] == "SHORT") & (x["rsi"] <= exit_rsi))
        buy = flat & (x["rsi"] < oversold) & (x["close"] > x["_sma"])
        sell = flat & (x["rsi"] > overbought) & F.lit(not long_only)
        side = F.when(timed | exits, "FLAT").when(buy, "LONG").when(sell, "SHORT").otherwise(acc["side"])
        reason = F.when(timed, "rsi_time_exit").when(exits, "rsi_exit").when(buy, "rsi_oversold").otherwise("rsi_overbought")
        changed = side != acc["side"]
        event = F.struct(x["ts"].alias("ts"), side.alias("direction"), reason.alias("reason"))
        return F.struct(side.alias("side"), F.when(changed, 0).otherwise(held).cast("int").alias("held"),
                        F.when(changed, F.concat(acc["events"], F.array(event))).otherwise(acc["events"]).alias("events")
                        ).cast(RSI_STATE)

    start = F.struct(F.lit("FLAT").alias("side"), F.lit(0).alias("held"), F.array().alias("events")).cast(RSI_STATE)
    folded = rows.select("asset_id", F.aggregate("rows", start, step).alias("state"))
    return folded.select("asset_id", F.explode("state.events").alias("e")).select("asset_id", "e.*")


def macd_events(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD crosses over the trailing 4*slow bars.

    Inside one slice the line's own mean is seeded with 0 (both means start at the first bar), so it equals the mean of
    the slice-corrected line, which the fold over the slice gives exactly.
    """
    n = 4 * slow
    af, as_, ag = 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)
    frame = by_asset().rowsBetween(-(n - 1), 0)
    start = F.struct(*[F.lit(None).cast("double").alias(c) for c in ("f", "s", "g", "prev_gap")], F.lit(None).cast("double").alias("gap"))

    def step(acc, x):
        f = F.coalesce(acc["f"] + af * (x - acc["f"]), x)
        s = F.coalesce(acc["s"] + as_ * (x - acc["s"]), x)
        g = F.coalesce(acc["g"] + ag * (f - s - acc["g"]), f - s)
        return F.struct(f.alias("f"), s.alias("s"), g.alias("g"), acc["gap"].alias("prev_gap"), (f - s - g).alias("gap"))

    df = bars.withColumns({"_slice": F.collect_list("close").over(frame), "_n": row_index()})
    df = df.withColumn("_m", F.aggregate("_slice", start, step)).drop("_slice")
    up, was_up = F.col("_m.gap") > 0, F.col("_m.prev_gap") > 0
    ready = F.col("_n") >= slow + signal + 5
    df = df.withColumns({"macd": F.col("_m.f") - F.col("_m.s"), "histogram": F.col("_m.gap"),
                         "event": F.when(ready, F.when(up & ~was_up, "LONG").when(~up & was_up, "FLAT"))})
    return df.drop("_m", "_n")
