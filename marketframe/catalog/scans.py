"""Scans, sources, sinks, filters and predicates."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketframe.catalog.registry import query
from marketframe.catalog.sqltext import W
from marketframe.functions.stats import rnd
from marketframe.operators import panel, quality, sets
from marketframe.session import shared_dir
from marketframe.sources.calendar import HOLIDAYS, trading_calendar
from marketframe.sources.market import Market
from marketframe.sources.store import BarStore

BAR_COLUMNS = ["asset_id", "ts", "open", "high", "low", "close", "volume"]


@query("bars_range", """
    SELECT asset_id, ts, open, high, low, close, volume FROM bars
    WHERE asset_id = 'Brand#23' AND ts BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""")
def bars_range(spark, d):
    return Market(spark, d).store().bars_between("Brand#23", "1996-01-01", "1997-12-31").select(*BAR_COLUMNS)


@query("bar_panel", """
    SELECT ts, MAX(CASE WHEN asset_id = 'Brand#11' THEN close END) AS "Brand#11",
           MAX(CASE WHEN asset_id = 'Brand#23' THEN close END) AS "Brand#23",
           MAX(CASE WHEN asset_id = 'Brand#55' THEN close END) AS "Brand#55"
    FROM bars WHERE asset_id IN ('Brand#11', 'Brand#23', 'Brand#55') GROUP BY ts""")
def bar_panel(spark, d):
    return panel.wide_panel(Market(spark, d).bars(), ["Brand#11", "Brand#23", "Brand#55"])


@query("ingest_bars", """
    SELECT asset_id, ts, open, high, low, close, volume, R6(adj_close / close) AS factor FROM (
      SELECT b.*, close * COALESCE(cumulative_split_factor, 1.0) AS adj_close FROM dirty_bars AS b
      LEFT JOIN adjustment_factors AS f ON f.asset_id = b.asset_id AND f.effective_date = b.ts)
    WHERE high >= low AND close BETWEEN low AND high AND open > 0 AND close > 0 AND volume >= 0""")
def ingest_bars(spark, d):
    store = new_store(spark)
    store.ingest(Market(spark, d).raw_bars(), "all")
    return store.read().select(*BAR_COLUMNS, rnd("factor").alias("factor"))


def new_store(spark):
    return BarStore(spark, f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}")


REASON = """CASE WHEN high < low THEN 'refused_high_below_low' WHEN close < low OR close > high THEN 'refused_close_outside' WHEN open <= 0 OR close <= 0 THEN 'refused_not_positive'
    WHEN volume < 0 THEN 'refused_negative_volume' ELSE 'ok' END"""


@query("ingest_counts", f"""WITH j AS MATERIALIZED (SELECT ts, {REASON} AS reason FROM dirty_bars),
    early AS (SELECT * FROM j WHERE ts < DATE '1997-01-01')
    SELECT 'first' AS batch, 'read' AS outcome, COUNT(*) AS n FROM early UNION ALL SELECT 'first', reason, COUNT(*) FROM early WHERE reason <> 'ok' GROUP BY 2
    UNION ALL SELECT 'first', 'inserted', COUNT(*) FROM early WHERE reason = 'ok' UNION ALL SELECT 'first', UNNEST(['superseded', 'updated', 'unchanged']), 0
    UNION ALL SELECT 'second', 'read', COUNT(*) FROM j UNION ALL SELECT 'second', reason, COUNT(*) FROM j WHERE reason <> 'ok' GROUP BY 2
    UNION ALL SELECT 'second', 'unchanged', COUNT(*) FROM j WHERE reason = 'ok' AND ts < DATE '1996-01-01'
    UNION ALL SELECT 'second', 'updated', COUNT(*) FROM j WHERE reason = 'ok' AND ts >= DATE '1996-01-01' AND ts < DATE '1997-01-01'
    UNION ALL SELECT 'second', 'inserted', COUNT(*) FROM j WHERE reason = 'ok' AND ts >= DATE '1997-01-01' UNION ALL SELECT 'second', 'superseded', 0""")
def ingest_counts(spark, d):
    """What two batches did: bars up to 1996, those of 1996 with provisional volumes, and then all of them as they are."""
    raw, store = Market(spark, d).raw_bars(), new_store(spark)
    last_year = (F.year("ts") == 1996) & (F.col("volume") >= 0)
    early = raw.where("ts < DATE '1997-01-01'").withColumn("volume", F.when(last_year, F.col("volume") + 1).otherwise(F.col("volume")))
    outcomes = [(batch, k, n) for batch, rows in (("first", early), ("second", raw)) for k, n in store.ingest(rows, batch).items()]
    return spark.createDataFrame(outcomes, "batch string, outcome string, n long")


@query("quarantined_bars", f"""SELECT asset_id, ts, SUBSTR({REASON}, 9) AS reason FROM dirty_bars WHERE {REASON} <> 'ok'""")
def quarantined_bars(spark, d):
    store = new_store(spark)
    store.ingest(Market(spark, d).raw_bars(), "all")
    return store.quarantine().select("asset_id", "ts", "reason")


@query("upsert_latest", """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity FROM lineitem
    QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""")
def upsert_latest(spark, d):
    lines = Market(spark, d).table("lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return sets.keep_last(lines, ["l_orderkey", "l_linenumber"],
                          ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("insert_if_absent", """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL
    SELECT o_orderkey, o_custkey FROM orders AS o WHERE o_orderdate >= DATE '1997-01-01' AND NOT EXISTS (
      SELECT 1 FROM orders AS e WHERE e.o_orderstatus = 'F' AND e.o_orderkey = o.o_orderkey)""")
def insert_if_absent(spark, d):
    orders = Market(spark, d).table("orders")
    existing = orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    incoming = orders.where("o_orderdate >= DATE '1997-01-01'").select("o_orderkey", "o_custkey")
    return sets.insert_if_absent(existing, incoming, ["o_orderkey"])


@query("event_log_json", """
    SELECT event_type, CAST(FLOOR(EPOCH(ts)) AS BIGINT) AS epoch,
           CAST(JSON_OBJECT('event_id', event_id, 'user_id', user_id, 'event_type', event_type) AS VARCHAR) AS payload
    FROM events""")
def event_log_json(spark, d):
    return sets.event_log(Market(spark, d).table("events"), "event_type", "ts", ["event_id", "user_id", "event_type"])


@query("latest_snapshot", """
    SELECT user_id, 'k' AS position, CAST(JSON_EXTRACT(props, '$.k') AS BIGINT) AS quantity FROM (
      SELECT * FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)""")
def latest_snapshot(spark, d):
    snap = sets.keep_last(Market(spark, d).table("events").select("user_id", "ts", "event_id", "props"),
                          ["user_id"], ["ts", "event_id"])
    return snap.select("user_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("position", "quantity"))


@query("equity_last_n_days", """
    SELECT portfolio_id, ts, equity FROM equity_curves
    WHERE ts >= (SELECT MAX(ts) FROM equity_curves) - 730""")
def equity_last_n_days(spark, d):
    return panel.last_n_days(Market(spark, d).equity_curves(), 730)


@query("trading_calendar", """
    SELECT CAST(day AS DATE) AS day FROM
      (SELECT UNNEST(GENERATE_SERIES(DATE_TRUNC('month', (SELECT MIN(o_orderdate) FROM orders)),
                                     (SELECT MAX(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS day)
    WHERE ISODOW(day) <= 5 AND STRFTIME(day, '%m-%d') NOT IN ('01-01', '07-04', '12-25')""")
def calendar(spark, d):
    dates = Market(spark, d).table("orders").agg(
        F.trunc(F.min(F.col("o_orderdate").cast("date")), "month").alias("first"),
        F.max(F.col("o_orderdate").cast("date")).alias("last"))
    return trading_calendar(dates, HOLIDAYS)


@query("universe_dedup", """
    SELECT asset_id, MIN(p_partkey) AS position FROM (SELECT p_brand AS asset_id, p_partkey FROM part) GROUP BY 1""")
def universe_dedup(spark, d):
    parts = Market(spark, d).table("part").select(F.col("p_brand").alias("asset_id"), F.col("p_partkey").alias("pos"))
    return sets.first_positions(parts, "asset_id", "pos").orderBy("position")


@query("trade_log", """
    SELECT strategy_id, asset_id, direction, entry_date, exit_date, R6(entry_price) AS entry_price,
           R6(exit_price) AS exit_price, quantity, R6(realized_pnl) AS realized_pnl FROM trades""")
def trade_log(spark, d):
    return Market(spark, d).trades().select(
        "strategy_id", "asset_id", "direction", "entry_date", "exit_date", rnd("entry_price").alias("entry_price"),
        rnd("exit_price").alias("exit_price"), "quantity", rnd("realized_pnl").alias("realized_pnl")
    ).orderBy("entry_date")


@query("bar_quality", """
    SELECT asset_id, ts, CASE WHEN high < low THEN 'high_below_low' WHEN close NOT BETWEEN low AND high THEN 'close_outside'
           WHEN open <= 0 OR close <= 0 THEN 'not_positive' WHEN volume < 0 THEN 'negative_volume' ELSE 'ok' END AS reason
    FROM dirty_bars""")
def bar_quality(spark, d):
    return Market(spark, d).dirty_bars().select("asset_id", "ts", quality.reject_reason().alias("reason"))


@query("adjusted_bars", """
    SELECT b.asset_id, b.ts, R6(close * COALESCE(s, 1) + COALESCE(v, 0)) AS adj_close, R6(open * COALESCE(s, 1)) AS adj_open,
           R6(high * COALESCE(s, 1)) AS adj_high, R6(low * COALESCE(s, 1)) AS adj_low
    FROM bars AS b ASOF LEFT JOIN (SELECT asset_id, effective_date, cumulative_split_factor AS s,
                                          cumulative_div_adjustment AS v FROM adjustment_factors) AS f
      ON b.asset_id = f.asset_id AND b.ts >= f.effective_date""")
def adjusted_bars(spark, d):
    m = Market(spark, d)
    adj = panel.adjusted(m.bars(), m.adjustment_factors())
    return adj.select("asset_id", "ts", *[rnd(c).alias(c) for c in ("adj_close", "adj_open", "adj_high", "adj_low")])


@query("bars_as_of", "SELECT asset_id, ts, close FROM bars WHERE ts < DATE '1997-06-30'")
def bars_as_of(spark, d):
    return panel.before(Market(spark, d).bars(), "1997-06-30").select("asset_id", "ts", "close")


@query("event_type_split", """
    SELECT CASE event_type WHEN 'purchase' THEN 'FILL' WHEN 'error' THEN 'RISK' WHEN 'signup' THEN 'ORDER'
                WHEN 'click' THEN 'SIGNAL' ELSE 'BAR' END AS route, CAST(COUNT(*) AS BIGINT) AS n, MIN(ts) AS first_ts, MAX(ts) AS last_ts
    FROM events GROUP BY 1""")
def event_type_split(spark, d):
    routed = sets.routed_events(Market(spark, d).table("events"))
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"),
                                       F.max("ts").alias("last_ts"))


@query("session_filter", """
    SELECT event_id, ts FROM events
    WHERE DAYOFWEEK(ts - INTERVAL 5 HOUR) BETWEEN 1 AND 5
      AND CAST(ts - INTERVAL 5 HOUR AS TIME) >= TIME '09:30:00' AND CAST(ts - INTERVAL 5 HOUR AS TIME) < TIME '16:00:00'""")
def session_filter(spark, d):
    events = Market(spark, d).table("events")
    return events.where(quality.in_regular_session("ts")).select("event_id", "ts")


@query("warmup_gate", f"SELECT asset_id, ts, close FROM (SELECT *, ROW_NUMBER() {W} AS n FROM bars) WHERE n > 252")
def warmup_gate(spark, d):
    return panel.warmed_up(Market(spark, d).bars(), 252).select("asset_id", "ts", "close")


@query("sample_every_n", """
    SELECT portfolio_id, ts, equity FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY portfolio_id ORDER BY ts) AS n FROM equity_curves) WHERE n % 21 = 0""")
def sample_every_n(spark, d):
    return panel.every_nth(Market(spark, d).equity_curves(), 21, "portfolio_id")


@query("latest_n_bars", """
    SELECT asset_id, ts, close FROM bars WHERE ts < DATE '1998-01-01'
    QUALIFY ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY ts DESC) <= 20""")
def latest_n_bars(spark, d):
    return panel.latest_n(panel.before(Market(spark, d).bars(), "1998-01-01"), 20).select("asset_id", "ts", "close")


@query("latest_macro", """
    SELECT series_id, ARG_MAX(value, release_date) AS value, MAX(release_date) AS release_date
    FROM macro_series WHERE release_date <= DATE '1997-06-30' GROUP BY 1""")
def latest_macro(spark, d):
    return panel.latest_released(Market(spark, d).macro_series(), "1997-06-30")


@query("recent_trades", """
    SELECT strategy_id, asset_id, exit_date, R6(realized_pnl) AS realized_pnl, quantity FROM trades WHERE exit_date IS NOT NULL
    ORDER BY exit_date DESC, R6(realized_pnl) DESC, asset_id, strategy_id, quantity LIMIT 200""")
def recent_trades(spark, d):
    t = Market(spark, d).trades().where("exit_date IS NOT NULL").select(
        "strategy_id", "asset_id", "exit_date", rnd("realized_pnl").alias("realized_pnl"), "quantity")
    return t.orderBy(F.desc("exit_date"), F.desc("realized_pnl"), "asset_id", "strategy_id", "quantity").limit(200)


@query("current_bar", """
    SELECT asset_id, MAX(ts) AS ts, ARG_MAX(close, ts) AS close, ARG_MAX(volume, ts) AS volume FROM bars
    WHERE ts <= DATE '1997-06-30' GROUP BY 1""")
def current_bar(spark, d):
    return panel.current_bar(Market(spark, d).bars(), "1997-06-30")


@query("event_timeline", """
    SELECT ts, event_id AS seq, route, CAST(CASE route WHEN 'FILL' THEN 0 WHEN 'RISK' THEN 1 WHEN 'ORDER' THEN 2
           WHEN 'SIGNAL' THEN 3 ELSE 4 END AS BIGINT) AS priority
    FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'FILL' WHEN 'error' THEN 'RISK' WHEN 'signup' THEN 'ORDER'
                WHEN 'click' THEN 'SIGNAL' ELSE 'BAR' END AS route FROM events)""")
def event_timeline(spark, d):
    return sets.timeline(sets.routed_events(Market(spark, d).table("events")), "ts", "event_id")


@query("latest_signal", """
    SELECT asset_id, strategy_id, direction, confidence, ts FROM signals
    QUALIFY ROW_NUMBER() OVER (PARTITION BY asset_id, strategy_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_signal(spark, d):
    return sets.keep_last(Market(spark, d).signals(), ["asset_id", "strategy_id"], ["ts", "event_id"]).select(
        "asset_id", "strategy_id", "direction", "confidence", "ts")


@query("universe_union", """
    SELECT DISTINCT asset_id FROM (SELECT p_brand AS asset_id FROM part WHERE p_size > 25
      UNION ALL SELECT p_brand FROM part WHERE p_retailprice > 1200)""")
def universe_union(spark, d):
    part = Market(spark, d).table("part")
    return sets.union_of_universes([part.where("p_size > 25").select(F.col("p_brand").alias("asset_id")),
                                    part.where("p_retailprice > 1200").select(F.col("p_brand").alias("asset_id"))])


@query("common_index", """
    SELECT ts, asset_id FROM bars WHERE volume > 50 INTERSECT SELECT ts, asset_id FROM dirty_bars WHERE close > 0""")
def common_index(spark, d):
    m = Market(spark, d)
    return sets.common_index(m.bars().where("volume > 50"), m.dirty_bars().where("close > 0"), ["ts", "asset_id"])


@query("merge_bars", """
    SELECT asset_id, ts, close FROM (
      SELECT asset_id, ts, close FROM bars WHERE ts <= DATE '1997-12-31' UNION
      SELECT asset_id, ts, close FROM bars WHERE ts >= DATE '1997-10-01')
    QUALIFY ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY ts DESC) <= 400""")
def merge_bars(spark, d):
    bars = Market(spark, d).bars().select("asset_id", "ts", "close")
    return sets.merge_bars(bars.where("ts <= '1997-12-31'"), bars.where("ts >= '1997-10-01'"), 400)


@query("dedup_keep_last", """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_shipdate, CAST(copies AS BIGINT) AS copies FROM (
      SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC) = 1""")
def dedup_keep_last(spark, d):
    lines = Market(spark, d).table("lineitem")
    return lines.groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(
        F.max("l_shipdate").alias("l_shipdate"), F.count(F.lit(1)).alias("copies"))


@query("bar_counts", """
    SELECT asset_id, CAST(YEAR(ts) AS BIGINT) AS year, CAST(COUNT(*) AS BIGINT) AS bars, MIN(ts) AS first_ts, MAX(ts) AS last_ts
    FROM bars GROUP BY ROLLUP (asset_id, YEAR(ts))""")
def bar_counts(spark, d):
    return (Market(spark, d).bars().withColumn("year", F.year("ts").cast("long")).rollup("asset_id", "year")
            .agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


@query("adjustment_factor", """
    SELECT b.asset_id, b.ts, R6(CASE WHEN close > 0 THEN (close * s + v) / close ELSE 1.0 END) AS factor
    FROM bars AS b JOIN (SELECT asset_id, effective_date, cumulative_split_factor AS s, cumulative_div_adjustment AS v
                         FROM adjustment_factors) AS f ON b.asset_id = f.asset_id AND b.ts = f.effective_date""")
def adjustment_factor(spark, d):
    m = Market(spark, d)
    joined = m.bars().join(m.adjustment_factors().withColumnRenamed("effective_date", "ts"), ["asset_id", "ts"])
    priced = joined.withColumn("adj_close", F.col("close") * F.col("cumulative_split_factor")
                               + F.col("cumulative_div_adjustment"))
    return panel.with_adjustment_factor(priced).select("asset_id", "ts", rnd("factor").alias("factor"))


@query("epoch_convert", """
    SELECT event_id, CAST(FLOOR(EPOCH(ts)) AS BIGINT) AS epoch, CAST(DATE_TRUNC('month', ts) AS DATE) AS month_start,
           LAST_DAY(ts) AS month_end, CAST(ts AS DATE) AS day FROM events""")
def epoch_convert(spark, d):
    ts = F.col("ts").cast("timestamp")
    back = F.timestamp_seconds(F.unix_timestamp(ts))
    return Market(spark, d).table("events").select(
        "event_id", F.unix_timestamp(ts).alias("epoch"), F.trunc(back, "month").alias("month_start"),
        F.last_day(back).alias("month_end"), back.cast("date").alias("day"))


@query("json_params", """
    SELECT event_id, CAST(JSON_EXTRACT(props, '$.k') AS BIGINT) AS k,
           CAST(JSON_OBJECT('k', CAST(JSON_EXTRACT(props, '$.k') AS BIGINT), 'kind', event_type) AS VARCHAR) AS params FROM events""")
def json_params(spark, d):
    parsed = Market(spark, d).table("events").withColumn("p", F.from_json("props", "k bigint"))
    return parsed.select("event_id", F.col("p.k").alias("k"),
                         F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("kind"))).alias("params"))


@query("ffill_panel", f"""
    SELECT c.ts, c.asset_id, LAST_VALUE(b.close IGNORE NULLS) OVER (PARTITION BY c.asset_id ORDER BY c.ts
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
    FROM (SELECT DISTINCT d.ts, a.asset_id FROM (SELECT DISTINCT ts FROM bars) AS d,
                 (SELECT asset_id, MIN(ts) AS lo FROM bars GROUP BY 1) AS a WHERE d.ts >= a.lo) AS c
    LEFT JOIN bars AS b ON b.ts = c.ts AND b.asset_id = c.asset_id""")
def ffill_panel(spark, d):
    return panel.ffill_panel(Market(spark, d).bars())


@query("first_bar_entry", """
    SELECT asset_id, MIN(ts) AS ts, 'LONG' AS direction, ARG_MIN(close, ts) AS close FROM bars GROUP BY 1""")
def first_bar_entry(spark, d):
    return panel.first_bar(Market(spark, d).bars())
