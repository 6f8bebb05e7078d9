"""Vectorised signals and event signals."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.catalog.registry import query
from marketframe.catalog.sqltext import RUN, SHIFT, W, changes, over, roll
from marketframe.functions.stats import rnd
from marketframe.operators import events, signals
from marketframe.operators.recurrence import Ewm, ewm
from marketframe.operators.windows import by_asset, log_return, pct_change
from marketframe.sources.market import Market


def bars(spark, d):
    return Market(spark, d).bars()


@query("returns", f"""
    SELECT asset_id, ts, R6(close / LAG(close, 1) {W} - 1) AS ret_1, R6(close / LAG(close, 21) {W} - 1) AS ret_21,
           R6(LN(close / LAG(close, 1) {W})) AS log_ret FROM bars""")
def returns(spark, d):
    return bars(spark, d).select("asset_id", "ts", rnd(pct_change("close")).alias("ret_1"),
                                 rnd(pct_change("close", 21)).alias("ret_21"), rnd(log_return()).alias("log_ret"))


def _signal(name, raw, inner="bars"):
    return f"SELECT asset_id, ts, {SHIFT} FROM (SELECT *, CASE {raw} ELSE 0 END AS raw FROM {inner})"


@query("sig_sma", _signal("sig_sma", f"""WHEN {roll('AVG', 'close', 50)} < {roll('AVG', 'close', 200)} THEN -1
    WHEN {roll('AVG', 'close', 50)} > {roll('AVG', 'close', 200)} THEN 1"""))
def sig_sma(spark, d):
    return signals.sma_crossover(bars(spark, d), 50, 200, long_only=False).select("asset_id", "ts", "signal")


@query("sig_donchian", _signal("sig_donchian", f"""WHEN close < {roll('MIN', 'close', 20, -1)} THEN -1
    WHEN close > {roll('MAX', 'close', 20, -1)} THEN 1"""))
def sig_donchian(spark, d):
    return signals.donchian(bars(spark, d), 20).select("asset_id", "ts", "signal")


@query("sig_bollinger", _signal("sig_bollinger", f"""
    WHEN close > {roll('AVG', 'close', 20)} + 2 * {roll('STDDEV_SAMP', 'close', 20)} THEN -1
    WHEN close < {roll('AVG', 'close', 20)} - 2 * {roll('STDDEV_SAMP', 'close', 20)} THEN 1"""))
def sig_bollinger(spark, d):
    return signals.bollinger(bars(spark, d), 20, 2.0).select("asset_id", "ts", "signal")


@query("sig_tsmom", _signal("sig_tsmom", f"""WHEN LAG(close, 21) {W} / LAG(close, 273) {W} - 1 < 0 THEN -1
    WHEN LAG(close, 21) {W} / LAG(close, 273) {W} - 1 > 0 THEN 1"""))
def sig_tsmom(spark, d):
    return signals.momentum(bars(spark, d), 252, 21, long_only=False).select("asset_id", "ts", "signal")


@query("sig_equal_weight", f"SELECT asset_id, ts, CAST(LAG(1, 1, 0) {W} AS BIGINT) AS signal FROM bars")
def sig_equal_weight(spark, d):
    return signals.equal_weight(bars(spark, d)).select("asset_id", "ts", "signal")


def ewm_sql(columns: dict[str, tuple[str, float]], source: str = "numbered") -> str:
    """Recursive CTE `folded` with one exponentially weighted mean per column, over rows numbered rn = 1.. per asset."""
    first = ", ".join(f"{x} AS {out}" for out, (x, _) in columns.items())
    step = ", ".join(f"f.{out} + {a!r}::DOUBLE * (n.{x} - f.{out})" for out, (x, a) in columns.items())
    return f"""folded AS (
        SELECT asset_id, ts, rn, {first} FROM {source} WHERE rn = 1 UNION ALL
        SELECT n.asset_id, n.ts, n.rn, {step} FROM folded AS f JOIN {source} AS n
          ON n.asset_id = f.asset_id AND n.rn = f.rn + 1)"""


GAINS = f"""numbered AS MATERIALIZED (
    SELECT asset_id, ts, close, ROW_NUMBER() {W} AS rn, GREATEST(COALESCE(close - LAG(close) {W}, 0), 0) AS g,
           GREATEST(COALESCE(LAG(close) {W} - close, 0), 0) AS l FROM bars)"""


@query("sig_rsi", f"""WITH RECURSIVE {GAINS}, {ewm_sql({'ag': ('g', 1 / 14), 'al': ('l', 1 / 14)})}
    SELECT asset_id, ts, R6(rsi) AS rsi, {SHIFT} FROM (
      SELECT *, CASE WHEN rsi > 70 THEN -1 WHEN rsi < 30 AND close > sma THEN 1 ELSE 0 END AS raw FROM (
        SELECT n.asset_id, n.ts, n.close, 100 - 100 / (1 + ag / CASE WHEN al = 0 THEN 1e-10 ELSE al END) AS rsi,
               {roll('AVG', 'n.close', 200).replace('PARTITION BY asset_id ORDER BY ts', 'PARTITION BY n.asset_id ORDER BY n.ts')} AS sma
        FROM numbered AS n JOIN folded AS f ON f.asset_id = n.asset_id AND f.rn = n.rn))""")
def sig_rsi(spark, d):
    return signals.rsi(bars(spark, d), 14, 30, 70, 200, long_only=False).select(
        "asset_id", "ts", rnd("rsi").alias("rsi"), "signal")


@query("ewm", f"""WITH RECURSIVE numbered AS MATERIALIZED (SELECT asset_id, ts, close, ROW_NUMBER() {W} AS rn FROM bars),
    {ewm_sql({'ema_12': ('close', 2 / 13), 'ema_26': ('close', 2 / 27), 'ema_slow': ('close', 0.02)})}
    SELECT asset_id, ts, R6(ema_12) AS ema_12, R6(ema_26) AS ema_26, R6(ema_slow) AS ema_slow FROM folded""")
def ewm_query(spark, d):
    df = ewm(bars(spark, d).select("asset_id", "ts", "close"), [
        Ewm("close", 2 / 13, "ema_12"), Ewm("close", 2 / 27, "ema_26"), Ewm("close", 0.02, "ema_slow")])
    return df.select("asset_id", "ts", *[rnd(c).alias(c) for c in ("ema_12", "ema_26", "ema_slow")])


def slice_fold(alpha: float, n: int) -> str:
    return f"LIST_REDUCE(LIST(close) {over(n)}, LAMBDA a, x: a + {alpha!r}::DOUBLE * (x - a))"


@query("sig_ema", f"""
    SELECT asset_id, ts, R6(ema_fast) AS ema_fast, R6(ema_slow) AS ema_slow, {SHIFT} FROM (
      SELECT *, CASE WHEN n >= 52 AND ema_fast > ema_slow THEN 1 ELSE 0 END AS raw FROM (
        SELECT asset_id, ts, ROW_NUMBER() {W} AS n, {slice_fold(2 / 13, 104)} AS ema_fast,
               {slice_fold(2 / 27, 104)} AS ema_slow FROM bars))""")
def sig_ema(spark, d):
    return events.ema_cross(bars(spark, d), 12, 26).select(
        "asset_id", "ts", rnd("ema_fast").alias("ema_fast"), rnd("ema_slow").alias("ema_slow"), "signal")


MACD_FOLD = f"""LIST_REDUCE(LIST({{'f': close, 's': close, 'g': 0.0::DOUBLE, 'pg': 0.0::DOUBLE, 'gap': 0.0::DOUBLE}}) {over(104)},
    LAMBDA a, x: {{'f': a.f + {2 / 13!r}::DOUBLE * (x.f - a.f), 's': a.s + {2 / 27!r}::DOUBLE * (x.s - a.s),
      'g': a.g + {2 / 10!r}::DOUBLE * ((a.f + {2 / 13!r}::DOUBLE * (x.f - a.f)) - (a.s + {2 / 27!r}::DOUBLE * (x.s - a.s)) - a.g),
      'pg': a.gap,
      'gap': (a.f + {2 / 13!r}::DOUBLE * (x.f - a.f)) - (a.s + {2 / 27!r}::DOUBLE * (x.s - a.s))
         - (a.g + {2 / 10!r}::DOUBLE * ((a.f + {2 / 13!r}::DOUBLE * (x.f - a.f)) - (a.s + {2 / 27!r}::DOUBLE * (x.s - a.s)) - a.g))}})"""


@query("sig_macd", changes(f"""
    SELECT asset_id, ts, m.f - m.s AS macd, m.gap AS histogram,
           CASE WHEN n >= 40 AND m.gap > 0 AND NOT m.pg > 0 THEN 'LONG'
                WHEN n >= 40 AND NOT m.gap > 0 AND m.pg > 0 THEN 'FLAT' END AS event
    FROM (SELECT asset_id, ts, ROW_NUMBER() {W} AS n, {MACD_FOLD} AS m FROM bars)""",
    "R6(macd) AS macd, R6(histogram) AS histogram"))
def sig_macd(spark, d):
    from marketframe.operators.windows import state_changes
    df = events.macd_events(bars(spark, d), 12, 26, 9)
    return state_changes(df).select("asset_id", "ts", "direction", rnd("macd").alias("macd"),
                                    rnd("histogram").alias("histogram"))


@query("events_sma_cross", changes(f"""
    SELECT asset_id, ts, f, s, CASE WHEN n >= 205 AND f > s AND pf <= ps THEN 'LONG'
                                    WHEN n >= 205 AND f < s AND pf >= ps THEN 'FLAT' END AS event
    FROM (SELECT *, LAG(f) {W} AS pf, LAG(s) {W} AS ps FROM (
      SELECT asset_id, ts, ROW_NUMBER() {W} AS n, {roll('AVG', 'close', 50)} AS f, {roll('AVG', 'close', 200)} AS s
      FROM bars))""", "R6(f) AS sma_fast, R6(s) AS sma_slow"))
def events_sma_cross(spark, d):
    return events.sma_cross_events(bars(spark, d)).select(
        "asset_id", "ts", "direction", rnd("sma_fast").alias("sma_fast"), rnd("sma_slow").alias("sma_slow"))


@query("events_bollinger", changes(f"""
    SELECT asset_id, ts, z, CASE WHEN n < 25 THEN NULL WHEN z < -1 THEN 'LONG' WHEN z > 1 THEN 'SHORT'
                                 WHEN ABS(z) < 0.5 THEN 'FLAT' END AS event
    FROM (SELECT asset_id, ts, ROW_NUMBER() {W} AS n, (close - {roll('AVG', 'close', 20)})
            / (2 * NULLIF({roll('STDDEV_SAMP', 'close', 20)}, 0)) AS z FROM bars)""",
    "R6(z) AS z, R6(CASE WHEN state = 'FLAT' THEN 1 ELSE LEAST(1, ABS(z) / 2) END) AS confidence"))
def events_bollinger(spark, d):
    return events.bollinger_events(bars(spark, d)).select(
        "asset_id", "ts", "direction", rnd("z").alias("z"), rnd("confidence").alias("confidence"))


@query("events_tsmom", changes(f"""
    SELECT asset_id, ts, m, CASE WHEN f AND m > 0 THEN 'LONG' WHEN f AND m <= 0 THEN 'SHORT' END AS event
    FROM (SELECT asset_id, ts, LAG(close, 20) {W} / LAG(close, 272) {W} - 1 AS m,
                 COALESCE(DATE_TRUNC('month', ts) <> LAG(DATE_TRUNC('month', ts)) {W}, TRUE) AS f FROM bars)""",
    "R6(m) AS momentum, R6(LEAST(1, ABS(m) * 5)) AS confidence"))
def events_tsmom(spark, d):
    return events.tsmom_events(bars(spark, d)).select(
        "asset_id", "ts", "direction", rnd("momentum").alias("momentum"), rnd("confidence").alias("confidence"))


@query("events_donchian", changes(f"""
    SELECT asset_id, ts, close, CASE WHEN held IS NULL OR closed THEN 'FLAT' ELSE held END AS event FROM (
      SELECT *, MAX(CASE WHEN entry IS NULL AND ((held = 'LONG' AND close < xl) OR (held = 'SHORT' AND close > xh))
                         THEN TRUE ELSE FALSE END)
                  OVER (PARTITION BY asset_id, episode ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS closed FROM (
        SELECT *, FIRST_VALUE(entry) OVER (PARTITION BY asset_id, episode ORDER BY ts) AS held FROM (
          SELECT *, COUNT(entry) {RUN} AS episode FROM (
            SELECT *, CASE WHEN n >= 25 AND close > hh THEN 'LONG' WHEN n >= 25 AND close < ll THEN 'SHORT' END AS entry FROM (
              SELECT asset_id, ts, close, ROW_NUMBER() {W} AS n, {roll('MAX', 'high', 19, -1)} AS hh,
                     {roll('MIN', 'low', 19, -1)} AS ll, {roll('MAX', 'high', 9, -1)} AS xh,
                     {roll('MIN', 'low', 9, -1)} AS xl FROM bars)))))""", "close"))
def events_donchian(spark, d):
    return events.donchian_events(bars(spark, d)).select("asset_id", "ts", "direction", "close")


def slice_mean(x: str) -> str:
    return f"LIST_REDUCE(LIST({x}) {over(218)}, LAMBDA a, v: a + {1 / 14!r}::DOUBLE * (v - a))"


@query("events_rsi", f"""WITH RECURSIVE g AS MATERIALIZED (
      SELECT asset_id, ts, close, ROW_NUMBER() {W} AS n, {roll('AVG', 'close', 200)} AS sma, GREATEST(close - LAG(close) {W}, 0) AS gain, GREATEST(LAG(close) {W} - close, 0) AS loss FROM bars),
    q AS MATERIALIZED (SELECT asset_id, ts, close, n, sma, {slice_mean('gain')} AS ag, {slice_mean('loss')} AS al FROM g WHERE n > 1),
    r AS MATERIALIZED (SELECT asset_id, ts, close > sma AS up, 100 - 100 / (1 + CASE WHEN al > 0 THEN ag / al ELSE 100 END) AS rsi, ROW_NUMBER() {W} AS k FROM q WHERE n >= 219),
    s AS (SELECT asset_id, k - 1 AS k, 'FLAT' AS side, 0 AS held, NULL::DATE AS ts, NULL::VARCHAR AS reason FROM r WHERE k = 1 UNION ALL
      SELECT r.asset_id, r.k, CASE WHEN s.side <> 'FLAT' AND (s.held + 1 >= 10 OR (s.side = 'LONG' AND rsi >= 50) OR (s.side = 'SHORT' AND rsi <= 50)) THEN 'FLAT'
          WHEN s.side = 'FLAT' AND rsi < 30 AND up THEN 'LONG' WHEN s.side = 'FLAT' AND rsi > 70 THEN 'SHORT' ELSE s.side END AS side2,
        CASE WHEN side2 <> s.side THEN 0 ELSE s.held + 1 END, r.ts,
        CASE WHEN side2 = s.side THEN NULL WHEN side2 = 'FLAT' AND s.held + 1 >= 10 THEN 'rsi_time_exit' WHEN side2 = 'FLAT' THEN 'rsi_exit' WHEN side2 = 'LONG' THEN 'rsi_oversold' ELSE 'rsi_overbought' END
      FROM s JOIN r ON r.asset_id = s.asset_id AND r.k = s.k + 1)
    SELECT asset_id, ts, side AS direction, reason FROM s WHERE reason IS NOT NULL""")
def events_rsi(spark, d):
    return events.rsi_events(bars(spark, d))


ADX = f"""WITH RECURSIVE moves AS MATERIALIZED (
      SELECT asset_id, ts, close, ROW_NUMBER() {W} AS rn, high - LAG(high) {W} AS up, LAG(low) {W} - low AS dn,
             GREATEST(high - low, ABS(high - LAG(close) {W}), ABS(low - LAG(close) {W})) AS tr FROM bars),
    numbered AS MATERIALIZED (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pdm,
                             CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mdm FROM moves),
    {ewm_sql({'atr': ('tr', 1 / 14), 'sp': ('pdm', 1 / 14), 'sm': ('mdm', 1 / 14)})},
    dx AS MATERIALIZED (
      SELECT asset_id, ts, x, COUNT(x) {RUN} AS rn FROM (
        SELECT asset_id, ts, 100 * ABS(sp - sm) / NULLIF(sp + sm, 0) AS x FROM folded WHERE atr <> 0)),
    {ewm_sql({'a': ('x', 1 / 14)}, 'dx').replace('folded', 'smooth')}"""


@query("adx", f"""{ADX}
    SELECT f.asset_id, f.ts, R6(f.atr) AS atr, R6(100 * sp / NULLIF(atr, 0)) AS pdi, R6(100 * sm / NULLIF(atr, 0)) AS mdi,
           R6(COALESCE(s.a, 0)) AS adx
    FROM folded AS f LEFT JOIN smooth AS s ON s.asset_id = f.asset_id AND s.ts = f.ts""")
def adx(spark, d):
    return events.adx_columns(bars(spark, d)).select(
        "asset_id", "ts", *[rnd(c).alias(c) for c in ("atr", "pdi", "mdi", "adx")])


@query("events_adx", ADX + ", body AS MATERIALIZED (" + f"""
    SELECT b.asset_id, b.ts, COALESCE(s.a, 0) AS a, CASE WHEN n < 228 THEN NULL WHEN COALESCE(s.a, 0) <= 25 THEN 'FLAT'
             WHEN f > sl THEN 'LONG' WHEN f < sl THEN 'FLAT' END AS event
    FROM (SELECT asset_id, ts, ROW_NUMBER() {W} AS n, {roll('AVG', 'close', 50)} AS f, {roll('AVG', 'close', 200)} AS sl
          FROM bars) AS b LEFT JOIN smooth AS s ON s.asset_id = b.asset_id AND s.ts = b.ts) """
       + changes("SELECT * FROM body", "R6(a) AS adx"))
def events_adx(spark, d):
    return events.adx_events(bars(spark, d)).select("asset_id", "ts", "direction", rnd("adx").alias("adx"))


@query("atr_stop", f"""
    SELECT asset_id, ts, R6(atr) AS atr, R6(close - 2 * atr) AS long_stop, R6(close + 2 * atr) AS short_stop FROM (
      SELECT asset_id, ts, close, {roll('AVG', 'tr', 14)} AS atr FROM (
        SELECT asset_id, ts, close, GREATEST(high - low, ABS(high - LAG(close) {W}), ABS(low - LAG(close) {W})) AS tr FROM bars))""")
def atr_stop(spark, d):
    from marketframe.operators.exits import atr_stops
    return atr_stops(bars(spark, d), 14, 2.0).select(
        "asset_id", "ts", *[rnd(c).alias(c) for c in ("atr", "long_stop", "short_stop")])
