"""Streaming queries, run over everything available and read back from their sink."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.catalog.registry import query
from marketframe.catalog.sqltext import roll
from marketframe.functions.stats import rnd
from marketframe.operators.asof import asof_daily
from marketframe.sources.market import Market
from marketframe.streaming import jobs
from marketframe.session import durable
from marketframe.streaming.sources import replay, run_batches, run_to_parquet, run_with_history, table_stream, ticks

NTZ = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
LIMIT = "(SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE"


@query("stream_ohlcv", f"""SELECT event_type AS asset_id, DATE_TRUNC('day', ts) AS start, ARG_MIN(value, (ts, event_id)) AS open, MAX(value) AS high, MIN(value) AS low,
    ARG_MAX(value, (ts, event_id)) AS close, COUNT(*) AS volume FROM events GROUP BY 1, 2 HAVING DATE_TRUNC('day', MIN(ts)) + INTERVAL 1 DAY <= {LIMIT}""")
def stream_ohlcv(spark, d):
    return run_to_parquet(jobs.ohlcv(ticks(spark, d)), "ohlcv").select("asset_id", NTZ("start"), "open", "high", "low", "close", "volume")


@query("stream_sliding", f"""SELECT asset_id, start, COUNT(*) AS volume, R6(AVG(value)) AS mean, R6(STDDEV_SAMP(value)) AS vol FROM (
    SELECT event_type AS asset_id, value, DATE_TRUNC('hour', ts) - k * INTERVAL 1 HOUR AS start FROM events, (SELECT UNNEST(RANGE(0, 24)) AS k))
    WHERE start + INTERVAL 1 DAY <= {LIMIT} GROUP BY 1, 2""")
def stream_sliding(spark, d):
    return run_to_parquet(jobs.sliding_stats(ticks(spark, d)), "sliding").select(
        "asset_id", NTZ("start"), "volume", rnd("mean").alias("mean"), rnd("vol").alias("vol"))


@query("stream_dedup", "SELECT event_id, ts, event_type AS asset_id, value AS price FROM events")
def stream_dedup(spark, d):
    polled = ticks(spark, d).unionByName(ticks(spark, d))
    return run_to_parquet(jobs.deduplicated(polled), "dedup").select("event_id", NTZ("ts"), "asset_id", "price")


@query("stream_alerts", "SELECT DISTINCT user_id, DATE_TRUNC('hour', ts) AS hour FROM events WHERE event_type = 'error'")
def stream_alerts(spark, d):
    errors = ticks(spark, d).where("asset_id = 'error'")
    return run_to_parquet(jobs.cooled_alerts(errors, ["user_id"]), "alerts").select("user_id", NTZ("hour"))


@query("stream_order_fill", """SELECT o_orderkey AS order_id, o_orderdate AS order_ts, l_shipdate AS fill_ts, l_quantity AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 120 DAY""")
def stream_order_fill(spark, d):
    m = Market(spark, d)
    orders = m.table("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp").alias("order_ts"))
    fills = m.table("lineitem").select(F.col("l_orderkey").alias("fill_order_id"), F.col("l_shipdate").cast("timestamp").alias("fill_ts"), F.col("l_quantity").alias("quantity"))
    # the tables are stored by key; replayed year by year they need a delay of a year, and state older than that goes
    live = jobs.order_fills(replay(orders, "order_ts", "orders"), replay(fills, "fill_ts", "fills"), delay="367 days")
    return run_to_parquet(live, "order_fill").select("order_id", NTZ("order_ts"), NTZ("fill_ts"), "quantity")


DUE = "(SELECT DATE_TRUNC('milliseconds', MAX(ts)) FROM events) - INTERVAL 10 MINUTE"


@query("stream_trailing_stop", f"""WITH RECURSIVE n AS MATERIALIZED (SELECT user_id, ts, value AS px, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id, value) AS rn,
      COALESCE(ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id, value) > INTERVAL 2 DAY, TRUE) AS fresh FROM events WHERE ts <= {DUE}),
    s AS (SELECT user_id, ts, rn, px, px AS best, px <= px * 0.5 AS hit FROM n WHERE rn = 1 UNION ALL
      SELECT n.user_id, n.ts, n.rn, n.px, CASE WHEN s.hit OR n.fresh THEN n.px ELSE GREATEST(s.best, n.px) END, n.px <= CASE WHEN s.hit OR n.fresh THEN n.px ELSE GREATEST(s.best, n.px) END * 0.5 FROM s JOIN n ON n.user_id IS NOT DISTINCT FROM s.user_id AND n.rn = s.rn + 1)
    SELECT user_id, ts, best, px AS exit_price FROM s WHERE hit""")
def stream_trailing_stop(spark, d):
    stops = jobs.trailing_stops(ticks(spark, d), delay=jobs.DELAY, idle="2 days")
    return run_to_parquet(stops, "trailing").select("user_id", NTZ("ts"), "best", "exit_price")


@query("stream_warm_sma", f"""SELECT asset_id, ts, close, R6({roll('AVG', 'close', 50)}) AS sma FROM bars QUALIFY ts > DATE '1996-12-31'""")
def stream_warm_sma(spark, d):
    """Bars up to 1996 are stored history, later ones arrive as a stream, a year at a time."""
    from marketframe.operators.windows import roll as rolling
    bars = Market(spark, d).bars().select("asset_id", "ts", "close")
    old = durable(bars.where("ts <= DATE '1996-12-31'"))
    live = replay(bars.where("ts > DATE '1996-12-31'"), "ts", "bars", files=1)
    schema = spark.createDataFrame([], "asset_id string, ts date, close double, sma double").schema
    return run_with_history(live, old, "warm", 49, lambda b: b.withColumn("sma", rnd(rolling(F.avg, "close", 50))), schema)


@query("stream_stale", f"""SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 6 HOUR AS stale_at, COUNT(*) AS n FROM (
    SELECT *, SUM(b) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (
      SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events))
    GROUP BY user_id, s HAVING MAX(ts) + INTERVAL 6 HOUR <= {LIMIT}""")
def stream_stale(spark, d):
    return run_to_parquet(jobs.inactivity(ticks(spark, d)), "stale").select("user_id", NTZ("start"), NTZ("stale_at"), "n")


@query("stream_macro", """SELECT o.order_id, o.ts, o.strategy_id AS series_id, R6(value) AS value FROM orders_in AS o ASOF LEFT JOIN macro_series AS m ON o.strategy_id = m.series_id AND o.ts >= m.release_date""")
def stream_macro(spark, d):
    macro = Market(spark, d).macro_series()
    orders = table_stream(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("ts"), F.col("o_orderpriority").alias("series_id"))

    def enrich(batch):
        return asof_daily(batch, macro, ["series_id"], "ts", "release_date", ["value"]).withColumn("value", rnd("value"))

    schema = spark.createDataFrame([], "order_id bigint, ts date, series_id string, value double").schema
    return run_batches(orders, "macro", enrich, schema)
