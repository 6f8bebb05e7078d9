"""Streaming jobs: bars, sliding statistics, de-duplication, alerts, order matching, trailing stops, inactivity."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELAY = "10 minutes"


def ohlcv(ticks: DataFrame, length: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Tumbling bars per asset; first and last price by event time, then id."""
    order = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", delay).groupBy(F.window("ts", length), "asset_id").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("volume"))
    return bars.select("asset_id", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def sliding_stats(ticks: DataFrame, length: str = "1 day", slide: str = "1 hour", delay: str = DELAY) -> DataFrame:
    stats = ticks.withWatermark("ts", delay).groupBy(F.window("ts", length, slide), "asset_id").agg(
        F.count(F.lit(1)).alias("volume"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("vol"))
    return stats.select("asset_id", F.col("window.start").alias("start"), "volume", "mean", "vol")


def deduplicated(ticks: DataFrame, delay: str = DELAY) -> DataFrame:
    """Rows polled twice pass once; the key holds the time, so the outcome does not depend on batching."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["asset_id", "event_id", "ts"])


def cooled_alerts(alerts: DataFrame, keys: list[str], cooldown: str = "1 hour") -> DataFrame:
    """At most one alert per key and hour."""
    bucket = F.date_trunc("hour", "ts")
    return alerts.withWatermark("ts", cooldown).withColumn("hour", bucket).dropDuplicatesWithinWatermark(
        [*keys, "hour"]).select(*keys, "hour")


def order_fills(orders: DataFrame, fills: DataFrame, within: str = "interval 120 days", delay: str = "1 day") -> DataFrame:
    """Orders with the fills that arrive inside a bounded time, so state on both sides can be dropped.

    delay is the disorder that the sources promise not to exceed, over all of what they deliver: rows later than it behind the newest one
    are dropped, however the input falls into batches. Sources without an order in time need their whole span.
    """
    o = orders.withWatermark("order_ts", delay)
    f = fills.withWatermark("fill_ts", delay)
    return o.join(f, F.expr(f"order_id = fill_order_id AND fill_ts >= order_ts AND fill_ts <= order_ts + {within}"), "inner")


STOP_STATE = "best double, last long, ts array<bigint>, ids array<bigint>, prices array<double>"


def trailing_stops(ticks: DataFrame, key: str = "user_id", trail: float = 0.5, delay: str = "0 seconds", idle: str = "365 days") -> DataFrame:
    """Exit events of a long position per key that restarts after each exit, and after `idle` without a tick.

    Ticks may be out of order by up to `delay`: each waits in the state of its key until the watermark has passed it, and is then
    folded in order of time and id, so the outcome does not depend on how the input falls into batches. An event-time timer wakes a
    key whose ticks have become due; another removes the state of one that has been idle. State holds the best price and the ticks
    of the last `delay`.

    Every tick is held against the best price up to and including itself, the first one of a key too, so a price of zero exits at once.
    Ticks of one time and id are ordered by price (NaN, then null, last). A null key is a key; a null price counts as a sign of life
    only; NaN is the greatest price and exits at once, as it compares in SQL; ticks without a time are no ticks.
    """
    quiet = int(pd.Timedelta(idle).total_seconds() * 1_000_000)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, last, ts, ids, prices = state.get if state.exists else (None, None, [], [], [])
        waiting = [*zip(ts, ids, prices)]
        for pdf in batches:
            waiting += zip(pdf["t"].tolist(), pdf["event_id"].tolist(), [None if n else p for n, p in zip(pdf["none"].tolist(), pdf["price"].tolist())])
        waiting.sort(key=lambda w: (w[0], w[1], w[2] is None, w[2] != w[2], w[2]))
        watermark = state.getCurrentWatermarkMs()
        due = sum(t <= watermark * 1000 for t, _, _ in waiting)
        out = []
        for t, _, price in waiting[:due]:
            if last is not None and t - last > quiet:
                best = None
            last = t
            if price is None:
                continue
            best = price if best is None or price != price else max(best, price)
            if price != price or price <= best * (1 - trail):
                out.append((k[0], t, float(best), float(price)))
                best = None
        waiting = waiting[due:]
        if waiting:
            alarm = -(-waiting[0][0] // 1000) - 1
        elif best is not None and last + quiet > watermark * 1000:
            alarm = -(-(last + quiet) // 1000)
        else:
            state.remove()
            alarm = None
        if alarm is not None:
            state.update((best, last, [t for t, _, _ in waiting], [i for _, i, _ in waiting], [p for _, _, p in waiting]))
            state.setTimeoutTimestamp(max(alarm, watermark + 1))
        if out:
            # a key may be null, and Spark appends empty rows: nullable integers stay exact
            yield pd.DataFrame(out, columns=[key, "t", "best", "exit_price"]).astype({key: "Int64", "t": "Int64"})

    # times as microseconds, which do not depend on the zone of the session
    rows = ticks.where("ts IS NOT NULL").withWatermark("ts", delay).select(
        key, "ts", F.unix_micros("ts").alias("t"), F.coalesce("event_id", F.lit((1 << 63) - 1)).alias("event_id"), "price", F.col("price").isNull().alias("none"))
    exits = rows.groupBy(key).applyInPandasWithState(step, f"{key} bigint, t bigint, best double, exit_price double", STOP_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return exits.select(key, F.timestamp_micros("t").alias("ts"), "best", "exit_price")


def inactivity(ticks: DataFrame, key: str = "user_id", gap: str = "6 hours", delay: str = DELAY) -> DataFrame:
    """Closed activity sessions; each one ends in at least `gap` without a tick."""
    s = ticks.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stale_at"), "n")
