"""Risk monitors over equity curves and alerts."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marketframe.operators.performance import with_drawdown
from marketframe.operators.windows import ordered, running


def circuit_breaker(curves: DataFrame, key: str = "portfolio_id", halt: float = -0.15, close: float = -0.20) -> DataFrame:
    """Halt with hysteresis: on at the halt level, off once half of it is regained; close-all at the deeper level.

    Between the two levels the last decision stands, which is the last non-null request.
    """
    w = ordered(key)
    df = with_drawdown(curves, [key])
    request = F.when(F.col("drawdown") <= halt, F.lit(True)).when(F.col("drawdown") > halt * 0.5, F.lit(False))
    df = df.withColumn("_req", request).withColumn("halted", F.coalesce(
        F.last("_req", ignorenulls=True).over(running(w)), F.lit(False)))
    before = F.coalesce(F.lag("halted").over(w), F.lit(False))
    change = F.when(F.col("halted") & ~before, "HALT").when(~F.col("halted") & before, "RESET")
    return df.withColumns({"change": change, "close_all": F.col("drawdown") <= close}).drop("_req")


def drawdown_alerts(curves: DataFrame, key: str = "portfolio_id", warn: float = -0.10, critical: float = -0.15) -> DataFrame:
    df = with_drawdown(curves, [key])
    kind = F.when(F.col("drawdown") <= critical, "MAX_DRAWDOWN_CRITICAL").when(F.col("drawdown") <= warn, "MAX_DRAWDOWN_WARNING")
    severity = F.when(F.col("drawdown") <= critical, "CRITICAL").otherwise("WARNING")
    return df.withColumns({"risk_type": kind, "severity": severity}).where("risk_type IS NOT NULL").select(
        F.col(key).alias("entity"), "ts", "risk_type", "severity", F.col("drawdown").alias("value"))


def concentration_alerts(positions: DataFrame, limit: float) -> DataFrame:
    """Positions (entity, ts, value, equity) above one and a half times the cap."""
    weight = F.abs("value") / F.col("equity")
    return positions.where(F.col("equity") > 0).withColumn("_w", weight).where(F.col("_w") > limit * 1.5).select(
        "entity", "ts", F.lit("CONCENTRATION_BREACH").alias("risk_type"), F.lit("WARNING").alias("severity"), F.col("_w").alias("value"))


def flat_runs(signals: DataFrame, key: str = "asset_id", least: int = 63) -> DataFrame:
    """Bars on which nothing has been held for at least `least` bars in a row."""
    w = ordered(key)
    df = signals.withColumn("_held", (F.col("signal") != 0).cast("int"))
    df = df.withColumn("_run", F.sum("_held").over(running(w)))
    since = F.sum(1 - F.col("_held")).over(running(ordered([key, "_run"])))
    return df.withColumn("_bars", since).where((F.col("_held") == 0) & (F.col("_bars") >= least)).select(
        F.col(key).alias("entity"), "ts", F.lit("STALE_SIGNALS").alias("risk_type"), F.lit("WARNING").alias("severity"),
        F.col("_bars").cast("double").alias("value"))


def ic_alerts(rolling: DataFrame, least: float = 0.02) -> DataFrame:
    return rolling.where((F.col("rolling_ic") < least) & (F.col("rolling_ic") != 0)).select(
        F.lit("model").alias("entity"), "ts", F.lit("ML_IC_DECAY").alias("risk_type"), F.lit("WARNING").alias("severity"),
        F.col("rolling_ic").alias("value"))


def vol_spike_alerts(vols: DataFrame, multiple: float = 2.0, alpha: float = 0.02) -> DataFrame:
    """Bars whose volatility exceeds a multiple of a slow baseline that skips the spikes themselves.

    The skip makes the baseline depend on its own past; the bars of one asset (one per calendar day) are folded in order
    inside the JVM and only the spikes are kept.
    """
    rows = vols.where("vol IS NOT NULL").groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("ts", "vol"))).alias("rows"))
    kind = "struct<base:double,hits:array<struct<ts:date,vol:double,base:double>>>"

    def step(acc, x):
        spike = x["vol"] > acc["base"] * multiple
        base = F.when(acc["base"].isNull(), x["vol"]).when(spike, acc["base"]).otherwise(
            (1 - alpha) * acc["base"] + alpha * x["vol"])
        hit = F.array(F.struct(x["ts"].alias("ts"), x["vol"].alias("vol"), acc["base"].alias("base")))
        return F.struct(base.alias("base"), F.when(spike, F.concat(acc["hits"], hit)).otherwise(acc["hits"]).alias("hits")).cast(kind)

    start = F.struct(F.lit(None).cast("double").alias("base"), F.array().alias("hits")).cast(kind)
    hits = rows.select("asset_id", F.explode(F.aggregate("rows", start, step)["hits"]).alias("h"))
    return hits.select(F.col("asset_id").alias("entity"), F.col("h.ts").alias("ts"), F.lit("VOLATILITY_SPIKE").alias("risk_type"),
                       F.lit("WARNING").alias("severity"), (F.col("h.vol") / F.col("h.base")).alias("value"))


def cooled_down(alerts: DataFrame, keys: list[str], ts: str = "ts", seconds: int = 3600) -> DataFrame:
    """Suppress an alert within `seconds` of the last one emitted for the same key and day.

    Keys carry the date, so a group is first reduced to its distinct seconds (at most 86,400, counted map-side) and then
    folded; the fold keeps at most one entry per cooldown.
    """
    stamp = F.unix_timestamp(F.col(ts).cast("timestamp"))
    distinct = alerts.groupBy(*keys, F.col(ts).cast("date").alias("day"), stamp.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    rows = distinct.groupBy(*keys, "day").agg(F.array_sort(F.collect_list("_s")).alias("_all"), F.sum("_n").alias("n_alerts"))
    kept = F.aggregate("_all", F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out")),
                       lambda acc, s: F.when(acc["last"].isNull() | (s - acc["last"] >= seconds), F.struct(
                           s.alias("last"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc))
    return rows.select(*keys, "day", "n_alerts", F.explode(kept["out"]).alias("_s")).select(
        *keys, "day", F.timestamp_seconds("_s").alias("ts"), "n_alerts")
