"""Risk monitors, alerts and exits."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.catalog.performance import ic_sql
from marketframe.catalog.registry import query
from marketframe.catalog.sqltext import RUN, W, over, roll
from marketframe.functions.stats import rnd
from marketframe.operators import exits, research, risk, volatility as vol
from marketframe.operators.signals import sma_crossover
from marketframe.operators.windows import pct_change
from marketframe.sources.market import Market

DD = """(SELECT *, (equity - MAX(equity) OVER w) / MAX(equity) OVER w AS dd FROM equity_curves WINDOW w AS (PARTITION BY portfolio_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
PW = "OVER (PARTITION BY portfolio_id ORDER BY ts)"


@query("circuit_breaker", f"""SELECT portfolio_id, ts, R6(dd) AS drawdown, halted, CASE WHEN halted AND NOT b THEN 'HALT' WHEN NOT halted AND b THEN 'RESET' END AS change, dd <= -0.2 AS close_all FROM (
    SELECT *, COALESCE(LAG(halted) {PW}, FALSE) AS b FROM (SELECT *, COALESCE(LAST_VALUE(CASE WHEN dd <= -0.15 THEN TRUE WHEN dd > -0.075 THEN FALSE END IGNORE NULLS)
      OVER (PARTITION BY portfolio_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS halted FROM {DD}))""")
def circuit_breaker(spark, d):
    return risk.circuit_breaker(Market(spark, d).equity_curves()).select(
        "portfolio_id", "ts", rnd("drawdown").alias("drawdown"), "halted", "change", "close_all")


STALE = f"""SELECT asset_id AS entity, ts, 'STALE_SIGNALS' AS risk_type, 'WARNING' AS severity, CAST(n AS DOUBLE) AS value FROM (
    SELECT *, SUM(1 - h) OVER (PARTITION BY asset_id, run ORDER BY ts) AS n FROM (SELECT *, SUM(h) {RUN} AS run FROM (
      SELECT asset_id, ts, CASE WHEN LAG(raw, 1, 0) {W} <> 0 THEN 1 ELSE 0 END AS h FROM (
        SELECT asset_id, ts, CASE WHEN {roll('AVG', 'close', 50)} > {roll('AVG', 'close', 200)} THEN 1 ELSE 0 END AS raw FROM bars)))) WHERE h = 0 AND n >= 63"""
CONC = """SELECT asset_id AS entity, ts, 'CONCENTRATION_BREACH' AS risk_type, 'WARNING' AS severity, R6(close / SUM(close) OVER (PARTITION BY ts)) AS value FROM bars QUALIFY close / SUM(close) OVER (PARTITION BY ts) > 0.3"""


@query("health_alerts", f"""SELECT portfolio_id AS entity, ts, CASE WHEN dd <= -0.15 THEN 'MAX_DRAWDOWN_CRITICAL' ELSE 'MAX_DRAWDOWN_WARNING' END AS risk_type, CASE WHEN dd <= -0.15 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, R6(dd) AS value
    FROM {DD} WHERE dd <= -0.10 UNION ALL {CONC} UNION ALL {STALE}""")
def health_alerts(spark, d):
    from pyspark.sql import Window
    m = Market(spark, d)
    dd = risk.drawdown_alerts(m.equity_curves())
    positions = m.bars().select(F.col("asset_id").alias("entity"), "ts", F.col("close").alias("value"),
                                F.sum("close").over(Window.partitionBy("ts")).alias("equity"))
    conc = risk.concentration_alerts(positions, 0.20)
    stale = risk.flat_runs(sma_crossover(m.bars(), 50, 200))
    return dd.unionByName(conc).unionByName(stale).withColumn("value", rnd("value"))


@query("open_alerts", """SELECT event_id AS alert_id, ts, user_id, R6(value) AS value FROM events WHERE event_type = 'error' AND value >= 50 ORDER BY ts DESC, event_id DESC LIMIT 10""")
def open_alerts(spark, d):
    e = Market(spark, d).table("events").where("event_type = 'error'").withColumn("dismissed", F.col("value") < 50)
    return e.where(~F.col("dismissed")).orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select(
        F.col("event_id").alias("alert_id"), "ts", "user_id", rnd("value").alias("value"))


@query("alert_cooldown", """WITH RECURSIVE a AS MATERIALIZED (SELECT user_id, CAST(ts AS DATE) AS day, FLOOR(EPOCH(ts)) AS s FROM events),
    e AS (SELECT user_id, day, MIN(s) AS s FROM a GROUP BY 1, 2 UNION ALL SELECT * FROM (SELECT e.user_id, e.day, MIN(a.s) AS s FROM e JOIN a ON a.user_id = e.user_id AND a.day = e.day AND a.s >= e.s + 3600 GROUP BY e.user_id, e.day))
    SELECT e.user_id, e.day, TO_TIMESTAMP(e.s) AT TIME ZONE 'UTC' AS ts, n AS n_alerts FROM e JOIN (SELECT user_id, day, COUNT(*) AS n FROM a GROUP BY 1, 2) AS c ON c.user_id = e.user_id AND c.day = e.day""")
def alert_cooldown(spark, d):
    return risk.cooled_down(Market(spark, d).table("events"), ["user_id"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


POS = """SELECT CONCAT(asset_id, '@', STRFTIME(ts, '%Y-%m-%d')) AS position_id, asset_id, ts AS entry_ts, close AS entry_price, CASE WHEN volume % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction,
    0.05::DOUBLE AS stop_pct, CASE WHEN volume % 3 > 0 THEN 0.15::DOUBLE END AS target_pct, CASE WHEN volume % 3 = 0 THEN 0.08::DOUBLE END AS trail_pct FROM bars"""


def bracket_positions(bars):
    """One position per bar: a bracket, or every third one a trailing stop without a target."""
    v = F.col("volume")
    return bars.select(
        F.concat("asset_id", F.lit("@"), F.date_format("ts", "yyyy-MM-dd")).alias("position_id"), "asset_id", F.col("ts").alias("entry_ts"),
        F.col("close").alias("entry_price"), F.when(v % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), F.lit(0.05).alias("stop_pct"),
        F.when(v % 3 > 0, 0.15).alias("target_pct"), F.when(v % 3 == 0, 0.08).alias("trail_pct"))


@query("stop_hits", f"""WITH pos AS MATERIALIZED ({POS}),
    path AS (SELECT p.*, b.ts, b.high, b.low, b.close, CASE WHEN direction = 'LONG' THEN GREATEST(entry_price, MAX(b.high) OVER w) ELSE LEAST(entry_price, MIN(b.low) OVER w) END AS best
      FROM pos AS p JOIN bars AS b ON b.asset_id = p.asset_id AND b.ts > p.entry_ts WINDOW w AS (PARTITION BY p.position_id ORDER BY b.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    lv AS (SELECT *, CASE WHEN trail_pct IS NOT NULL THEN best * (1 - CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END * trail_pct) ELSE entry_price * (1 - CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END * stop_pct) END AS stop,
      entry_price * (1 + CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END * target_pct) AS target FROM path),
    hit AS (SELECT *, CASE WHEN direction = 'LONG' AND low <= stop OR direction = 'SHORT' AND high >= stop THEN 'stop_exit'
      WHEN direction = 'LONG' AND high >= target OR direction = 'SHORT' AND low <= target THEN 'target_exit' END AS reason FROM lv)
    SELECT position_id, asset_id, ts AS exit_ts, reason, R6(CASE WHEN reason = 'stop_exit' THEN stop ELSE target END) AS level, close AS exit_price FROM hit WHERE reason IS NOT NULL
    QUALIFY ROW_NUMBER() OVER (PARTITION BY position_id ORDER BY ts) = 1""")
def stop_hits(spark, d):
    bars = Market(spark, d).bars()
    return exits.stop_hits(bracket_positions(bars), bars).withColumn("level", rnd("level"))


@query("atr_trail_hits", f"""WITH ranged AS MATERIALIZED (SELECT *, {roll('AVG', 'tr', 14)} AS atr FROM (SELECT *, GREATEST(high - low, ABS(high - LAG(close) {W}), ABS(low - LAG(close) {W})) AS tr FROM bars)),
    pos AS MATERIALIZED (SELECT CONCAT(asset_id, '@', STRFTIME(ts, '%Y-%m-%d')) AS position_id, asset_id, ts AS entry_ts, close AS entry_price, CASE WHEN volume % 2 = 0 THEN 1 ELSE -1 END AS side FROM bars),
    path AS (SELECT p.*, b.ts, b.high, b.low, b.close, b.atr, CASE WHEN side = 1 THEN GREATEST(entry_price, MAX(b.high) OVER w) ELSE LEAST(entry_price, MIN(b.low) OVER w) END AS best
      FROM pos AS p JOIN ranged AS b ON b.asset_id = p.asset_id AND b.ts > p.entry_ts WINDOW w AS (PARTITION BY p.position_id ORDER BY b.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    lv AS (SELECT *, COALESCE(LAST_VALUE(CASE WHEN atr > 0 THEN best - side * 2.5::DOUBLE * atr END IGNORE NULLS) OVER (PARTITION BY position_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), entry_price * (1 - side * 0.2::DOUBLE)) AS stop FROM path)
    SELECT position_id, asset_id, ts AS exit_ts, R6(stop) AS level, close AS exit_price FROM lv WHERE side = 1 AND low <= stop OR side = -1 AND high >= stop
    QUALIFY ROW_NUMBER() OVER (PARTITION BY position_id ORDER BY ts) = 1""")
def atr_trail_hits(spark, d):
    """One position per bar behind a stop at 2.5 mean true ranges from the best price since entry, 20 % from the entry while the range is unknown."""
    bars = Market(spark, d).bars()
    positions = bracket_positions(bars).withColumns({"stop_pct": F.lit(0.2), "target_pct": F.lit(None).cast("double"), "trail_pct": F.lit(None).cast("double"), "atr_multiple": F.lit(2.5)})
    hits = exits.stop_hits(positions, exits.atr_stops(bars, 14))
    return hits.select("position_id", "asset_id", "exit_ts", rnd("level").alias("level"), "exit_price")
