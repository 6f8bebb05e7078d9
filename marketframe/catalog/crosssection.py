"""Cross-sections, factor panels and models."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from marketframe.catalog.performance import rank_sql
from marketframe.catalog.registry import query
from marketframe.catalog.signals import GAINS, ewm_sql
from marketframe.catalog.sqltext import RUN, W, over, roll
from marketframe.functions.stats import rnd
from marketframe.operators import crosssection as xs, models, weights
from marketframe.operators.performance import with_returns
from marketframe.operators.volatility import with_exogenous
from marketframe.operators.windows import by_asset, log_return, pct_change, running
from marketframe.sources.market import Market


def bars(spark, d):
    return Market(spark, d).bars()


@query("xs_rank", f"""SELECT asset_id, ts, R6({rank_sql('volume', 'ts')}) AS volume_rank, CASE WHEN m IS NOT NULL THEN R6({rank_sql('m', 'ts')}) END AS momentum_rank
    FROM (SELECT asset_id, ts, volume, close / LAG(close, 20) {W} - 1 AS m FROM bars)""")
def xs_rank(spark, d):
    df = bars(spark, d).withColumn("m", pct_change("close", 20))
    return df.select("asset_id", "ts", rnd(xs.percent_rank_avg("volume", ["ts"])).alias("volume_rank"),
                     rnd(xs.percent_rank_avg("m", ["ts"])).alias("momentum_rank"))


def monthly_sql(score: str, source: str = "bars") -> str:
    """Score of every asset at the first date of each month, from its latest bar at or before it in the month-by-month validity."""
    return f"""(SELECT c.ts, s.asset_id, s.score FROM (SELECT MIN(ts) AS ts FROM bars GROUP BY DATE_TRUNC('month', ts)) AS c
      JOIN (SELECT asset_id, ts AS a, COALESCE(LEAD(ts) {W} - 1, LAST_DAY(ts)) AS b, {score} AS score FROM {source}) AS s ON c.ts BETWEEN s.a AND s.b
      WHERE s.score IS NOT NULL)"""


MOM = f"LAG(close, 20) {W} / LAG(close, 272) {W} - 1"
XSMOM = f"""SELECT ts, asset_id, CASE WHEN r <= 5 THEN 'LONG' WHEN r > n - 5 THEN 'SHORT' END AS side, r AS rank, R6(score) AS score FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY ts ORDER BY score DESC, asset_id) AS r, COUNT(*) OVER (PARTITION BY ts) AS n FROM {{source}}) WHERE n >= 10 AND (r <= 5 OR r > n - 5)"""
CLOCKED = XSMOM.format(source=monthly_sql(f'R9({MOM})').replace('c.ts,', "c.ts,"))


def momentum_baskets(m_bars):
    # months without a bar of the asset's own reach back to the bar still standing: same validity as the clock uses
    score = rnd(xs.momentum_score(), 9)
    df = xs.monthly_scores(m_bars, score, "score")
    clock = xs.month_starts(m_bars)
    return xs.ranked_baskets(df.join(clock, "ts", "left_semi"), "score", 5, 5)


@query("xs_momentum", CLOCKED)
def xs_momentum(spark, d):
    return momentum_baskets(bars(spark, d)).select("ts", "asset_id", "side", "rank", rnd("score").alias("score"))


@query("basket_changes", f"""WITH b AS MATERIALIZED (SELECT ts, asset_id FROM ({CLOCKED}) WHERE side = 'LONG'),
    k AS MATERIALIZED (SELECT ts, ROW_NUMBER() OVER (ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM b)), n AS MATERIALIZED (SELECT b.asset_id, k.k, k.ts FROM b JOIN k ON k.ts = b.ts)
    SELECT ts, asset_id, 'ENTER' AS change FROM n WHERE NOT EXISTS (SELECT 1 FROM n AS p WHERE p.asset_id = n.asset_id AND p.k = n.k - 1) UNION ALL
    SELECT k.ts, n.asset_id, 'EXIT' FROM n JOIN k ON k.k = n.k + 1 WHERE NOT EXISTS (SELECT 1 FROM n AS p WHERE p.asset_id = n.asset_id AND p.k = n.k + 1)""")
def basket_changes(spark, d):
    return xs.basket_changes(momentum_baskets(bars(spark, d)).where("side = 'LONG'").select("ts", "asset_id"))


@query("basket_exits", f"""WITH b AS MATERIALIZED (SELECT ts, asset_id FROM ({CLOCKED}) WHERE side = 'LONG'), k AS MATERIALIZED (SELECT ts, ROW_NUMBER() OVER (ORDER BY ts DESC) AS k FROM (SELECT DISTINCT ts FROM b))
    SELECT asset_id FROM b JOIN k USING (ts) WHERE k = 2 EXCEPT SELECT asset_id FROM b JOIN k USING (ts) WHERE k = 1""")
def basket_exits(spark, d):
    baskets = momentum_baskets(bars(spark, d)).where("side = 'LONG'").select("ts", "asset_id")
    return xs.basket_exits(baskets)


LOWVOL = f"R9({roll('STDDEV_SAMP', 'lr', 252, least=126)} * SQRT(252))"


@query("low_vol_basket", f"""SELECT ts, asset_id, r AS rank, R6(score) AS vol FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ts ORDER BY score, asset_id) AS r, COUNT(*) OVER (PARTITION BY ts) AS n
    FROM {monthly_sql(LOWVOL, f'(SELECT *, LN(close / LAG(close) {W}) AS lr FROM bars)')}) WHERE n >= 5 AND r <= 5""")
def low_vol_basket(spark, d):
    df = bars(spark, d).withColumn("lr", log_return())
    scores = xs.monthly_scores(df, -rnd(xs.low_vol_score(), 9), "score")
    return xs.ranked_baskets(scores, "score", 5).select("ts", "asset_id", "rank", rnd(-F.col("score")).alias("vol"))


@query("dual_momentum", f"""SELECT ts, holding, R6(eq) AS equity_return, R6(bill) AS bill_return FROM (
    SELECT ts, eq, bill, CASE WHEN eq > bill THEN best ELSE 'Brand#33' END AS holding FROM (
      SELECT ts, ARG_MAX(CASE WHEN asset_id <> 'Brand#55' THEN asset_id END, CASE WHEN asset_id <> 'Brand#55' THEN score END) AS best,
             MAX(CASE WHEN asset_id <> 'Brand#55' THEN score END) AS eq, COALESCE(MAX(CASE WHEN asset_id = 'Brand#55' THEN score END), 0) AS bill
      FROM (SELECT c.ts, s.asset_id, s.score FROM (SELECT MIN(ts) AS ts FROM u GROUP BY DATE_TRUNC('month', ts)) AS c
        JOIN (SELECT asset_id, ts AS a, COALESCE(LEAD(ts) {W} - 1, LAST_DAY(ts)) AS b, close / LAG(close, 251) {W} - 1 AS score FROM u) AS s ON c.ts BETWEEN s.a AND s.b WHERE s.score IS NOT NULL) GROUP BY 1)
    WHERE best IS NOT NULL)""".replace("SELECT ts, holding", "WITH u AS MATERIALIZED (SELECT * FROM bars WHERE asset_id IN ('Brand#11', 'Brand#23', 'Brand#55')) SELECT ts, holding", 1))
def dual_momentum(spark, d):
    df = xs.dual_momentum(bars(spark, d), ["Brand#11", "Brand#23"], "Brand#33", "Brand#55")
    return df.select("ts", "holding", rnd("equity_return").alias("equity_return"), rnd("bill_return").alias("bill_return"))


EPS = "1e-8::DOUBLE"
FACTOR_SQL: dict[str, str] = {}
for p in (5, 10, 20, 60, 120, 252):
    FACTOR_SQL[f"ret_{p}d"] = f"close / LAG(close, {p}) {W} - 1"
    FACTOR_SQL[f"mom_adj_{p}d"] = f"(close / LAG(close, {p}) {W} - 1) / ({roll('STDDEV_SAMP', 'r1', p)} * SQRT(252) + {EPS})"
FACTOR_SQL["mom_12_1"] = f"LAG(close, 21) {W} / LAG(close, 252) {W} - 1"
for p in (1, 3, 5):
    FACTOR_SQL[f"rev_{p}d"] = f"-(close / LAG(close, {p}) {W} - 1)"
for p in (10, 20):
    FACTOR_SQL[f"zscore_{p}d"] = f"(close - {roll('AVG', 'close', p)}) / ({roll('STDDEV_SAMP', 'close', p)} + {EPS})"
for p in (5, 10, 20, 60):
    FACTOR_SQL[f"vol_{p}d"] = f"{roll('STDDEV_SAMP', 'lr', p)} * SQRT(252)"
FACTOR_SQL["vol_ratio_5_20"] = f"({FACTOR_SQL['vol_5d']}) / ({FACTOR_SQL['vol_20d']} + {EPS})"
FACTOR_SQL["vol_ratio_20_60"] = f"({FACTOR_SQL['vol_20d']}) / ({FACTOR_SQL['vol_60d']} + {EPS})"
FACTOR_SQL["vol_ratio"] = f"volume / ({roll('AVG', 'volume', 20)} + 1)"
FACTOR_SQL["amihud_illiq"] = f"1000000 * {roll('AVG', 'il', 20)}"
FACTOR_SQL["dollar_vol_20"] = roll('AVG', 'dv', 20)
FACTOR_SQL["bb_pos"] = f"(close - {roll('AVG', 'close', 20)}) / (2 * {roll('STDDEV_SAMP', 'close', 20)} + {EPS})"
FACTOR_SQL["pct_from_high"] = f"(close - {roll('MAX', 'close', 252)}) / ({roll('MAX', 'close', 252)} + {EPS})"
FACTOR_SQL["pct_from_low"] = f"(close - {roll('MIN', 'close', 252)}) / ({roll('MIN', 'close', 252)} + {EPS})"
FACTOR_SQL["vix_level"] = "vix"
FACTOR_SQL["vix_20ma"] = roll('AVG', 'vix', 20)
FACTORS = list(FACTOR_SQL)
VIX_BARS = """(SELECT b.*, m.value AS vix FROM (SELECT *, '1-URGENT' AS series_id FROM bars) AS b
    ASOF LEFT JOIN macro_series AS m ON b.series_id = m.series_id AND b.ts >= m.release_date)"""


def factor_panel(spark, d):
    m = Market(spark, d)
    return xs.alpha_factors(with_exogenous(m.bars(), m.macro_series(), "1-URGENT"), "vix")


@query("alpha_factors", f"""SELECT asset_id, ts, {', '.join(f'R4({x}) AS {n}' for n, x in FACTOR_SQL.items())} FROM (
    SELECT *, volume * close AS dv, ABS(lr) / (volume * close + 1) AS il FROM (SELECT *, close / LAG(close) {W} - 1 AS r1, LN(close / LAG(close) {W}) AS lr FROM {VIX_BARS}))""")
def alpha_factors(spark, d):
    df = factor_panel(spark, d).withColumn("amihud_illiq", F.col("amihud_illiq") * 1_000_000)
    return df.select("asset_id", "ts", *[rnd(n, 4).alias(n) for n in FACTORS])


@query("ewm_factors", f"""WITH RECURSIVE {GAINS}, {ewm_sql({'ag': ('g', 1 / 14), 'al': ('l', 1 / 14), 'ef': ('close', 2 / 13), 'es': ('close', 2 / 27)})},
    line AS MATERIALIZED (SELECT asset_id, ts, rn, ef - es AS m, ag, al FROM folded), {ewm_sql({'s': ('m', 0.2)}, 'line').replace('folded', 'smooth')}
    SELECT l.asset_id, l.ts, R4(100 - 100 / (1 + ag / (al + {EPS}))) AS rsi_14, R6((m - s) / (n.close + {EPS})) AS macd_hist
    FROM line AS l JOIN smooth AS k ON k.asset_id = l.asset_id AND k.rn = l.rn JOIN numbered AS n ON n.asset_id = l.asset_id AND n.rn = l.rn""")
def ewm_factors(spark, d):
    return xs.ewm_factors(bars(spark, d)).select("asset_id", "ts", rnd("rsi_14", 4).alias("rsi_14"), rnd("macd_hist").alias("macd_hist"))


# values are compared to nine significant places below one, four above, so that equal ones tie in every engine
COARSE = ("dollar_vol_20",)
RANKED = ", ".join(f"{'R4' if n in COARSE else 'R9'}({x}) AS {n}" for n, x in FACTOR_SQL.items())


@query("factor_ranks", f"""WITH f AS MATERIALIZED (SELECT asset_id, ts, {RANKED} FROM (
      SELECT *, volume * close AS dv, ABS(lr) / (volume * close + 1) AS il FROM (SELECT *, close / LAG(close) {W} - 1 AS r1, LN(close / LAG(close) {W}) AS lr FROM {VIX_BARS})))
    SELECT asset_id, ts, factor, R6({rank_sql('value', 'ts, factor')} - 0.5) AS value FROM (UNPIVOT f ON {', '.join(FACTORS)} INTO NAME factor VALUE value) WHERE value IS NOT NULL""")
def factor_ranks(spark, d):
    panel = factor_panel(spark, d).withColumn("amihud_illiq", F.col("amihud_illiq") * 1_000_000)
    panel = panel.select("ts", "asset_id", *[rnd(n, 4 if n in COARSE else 9).alias(n) for n in FACTORS])
    ranked = xs.long_factors(panel, FACTORS).withColumn("value", rnd(xs.percent_rank_avg("value", ["ts", "factor"]) - 0.5))
    return ranked.select("asset_id", "ts", "factor", "value")


@query("ml_dataset", f"""SELECT asset_id, ts, R6({rank_sql('fwd', 'ts')}) AS label, R6(ret_20d) AS ret_20d FROM (
    SELECT *, COUNT(*) OVER (PARTITION BY ts) AS n FROM (SELECT asset_id, ts, LEAD(close, 21) {W} / close - 1 AS fwd, close / LAG(close, 20) {W} - 1 AS ret_20d FROM bars) WHERE fwd IS NOT NULL) WHERE n >= 5""")
def ml_dataset(spark, d):
    df = xs.ml_dataset(bars(spark, d).withColumn("ret_20d", pct_change("close", 20)))
    return df.select("asset_id", "ts", rnd("label").alias("label"), rnd("ret_20d").alias("ret_20d"))


@query("rank_signals", f"""SELECT ts, asset_id, CAST(CASE WHEN r <= 5 THEN 1 WHEN r > n - 5 THEN -1 ELSE 0 END AS BIGINT) AS signal FROM (
    SELECT ts, asset_id, ROW_NUMBER() OVER (PARTITION BY ts ORDER BY score DESC, asset_id) AS r, COUNT(*) OVER (PARTITION BY ts) AS n
    FROM (SELECT ts, asset_id, close / LAG(close, 20) {W} - 1 AS score FROM bars) WHERE score IS NOT NULL)""")
def rank_signals(spark, d):
    df = bars(spark, d).withColumn("score", pct_change("close", 20)).where("score IS NOT NULL")
    day = Window.partitionBy("ts")
    df = df.withColumns({"_r": F.row_number().over(day.orderBy(F.desc("score"), "asset_id")), "_n": F.count(F.lit(1)).over(day)})
    side = F.when(F.col("_r") <= 5, 1).when(F.col("_r") > F.col("_n") - 5, -1).otherwise(0)
    return df.select("ts", "asset_id", side.cast("long").alias("signal"))


@query("turbulence_regime", f"""WITH t AS MATERIALIZED (SELECT ts, R6(CASE WHEN STDDEV_SAMP(ret) > 1e-6 THEN ABS(AVG(ret)) / STDDEV_SAMP(ret) END) AS turbulence FROM (SELECT ts, close / LAG(close) {W} - 1 AS ret FROM bars) WHERE ret IS NOT NULL GROUP BY 1)
    SELECT ts, turbulence, CAST(turbulence <= (SELECT QUANTILE_CONT(turbulence, 0.9) FROM t) AS BIGINT) AS normal FROM t WHERE turbulence IS NOT NULL""")
def turbulence_regime(spark, d):
    """The threshold rule on a scalar stress index (the matrix index itself is the query `turbulence`)."""
    r = bars(spark, d).withColumn("ret", pct_change("close")).where("ret IS NOT NULL")
    t = r.groupBy("ts").agg(rnd(F.abs(F.avg("ret")) / F.when(F.stddev_samp("ret") > 1e-6, F.stddev_samp("ret"))).alias("turbulence")).where("turbulence IS NOT NULL")
    return t.withColumn("normal", (F.col("turbulence") <= t.agg(F.percentile("turbulence", F.lit(0.9))).scalar()).cast("long"))


PAIRS = [("Brand#11", "Brand#12"), ("Brand#23", "Brand#24"), ("Brand#45", "Brand#55")]


@query("pair_zscore", f"""SELECT pair, ts, R6(beta) AS beta, R4((spread - m) / CASE WHEN sd > 1e-8 THEN sd END) AS z FROM (
    SELECT *, CASE WHEN COUNT(spread) {over(60, keys='pair')} >= 60 THEN AVG(spread) {over(60, keys='pair')} END AS m, CASE WHEN COUNT(spread) {over(60, keys='pair')} >= 60 THEN STDDEV_POP(spread) {over(60, keys='pair')} END AS sd FROM (
      SELECT *, pa - beta * pb AS spread FROM (SELECT *, CASE WHEN COUNT(*) {over(60, keys='pair')} >= 60 THEN REGR_SLOPE(pa, pb) {over(60, keys='pair')} END AS beta FROM (
        SELECT CONCAT(p.a, '/', p.b) AS pair, x.ts, x.close AS pa, y.close AS pb FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in PAIRS)}) AS p(a, b)
        JOIN bars AS x ON x.asset_id = p.a JOIN bars AS y ON y.asset_id = p.b AND y.ts = x.ts))))""")
def pair_zscore(spark, d):
    df = models.pair_zscore(models.pair_panel(bars(spark, d), PAIRS))
    return df.select("pair", "ts", rnd("beta").alias("beta"), rnd("z", 4).alias("z"))


PAIR_ROWS = f"""(SELECT CONCAT(p.a, '/', p.b) AS pair, x.ts, x.close AS pa, y.close AS pb, ROW_NUMBER() OVER (PARTITION BY p.a, p.b ORDER BY x.ts) AS rn
    FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in PAIRS)}) AS p(a, b) JOIN bars AS x ON x.asset_id = p.a JOIN bars AS y ON y.asset_id = p.b AND y.ts = x.ts)"""


def kalman_step(beta: str, p: str, source: str) -> str:
    gain = f"(({p} + 1e-4::DOUBLE) * pb / (pb * pb * ({p} + 1e-4::DOUBLE) + 1e-2::DOUBLE))"
    return f"{beta} + {gain} * (pa - {beta} * pb) AS beta, ({p} + 1e-4::DOUBLE) * (1 - {gain} * pb) AS p"


@query("kalman_pairs", f"""WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM {PAIR_ROWS}),
    k AS (SELECT pair, ts, rn, pa, pb, {kalman_step('1.0::DOUBLE', '1.0::DOUBLE', 'n')} FROM n WHERE rn = 1 UNION ALL
      SELECT n.pair, n.ts, n.rn, n.pa, n.pb, {kalman_step('k.beta', 'k.p', 'n').replace('pa ', 'n.pa ').replace('pb', 'n.pb')} FROM k JOIN n ON n.pair = k.pair AND n.rn = k.rn + 1)
    SELECT pair, ts, R6(beta) AS beta, R6(spread) AS spread, R6(CASE WHEN COUNT(*) {over(60, keys='pair')} >= 60 THEN (spread - AVG(spread) {over(60, keys='pair')}) / CASE WHEN STDDEV_POP(spread) {over(60, keys='pair')} >= 1e-8 THEN STDDEV_POP(spread) {over(60, keys='pair')} END END) AS z
    FROM (SELECT *, pa - beta * pb AS spread FROM k)""")
def kalman_pairs(spark, d):
    df = models.kalman_pairs(models.pair_panel(bars(spark, d), PAIRS))
    return df.select("pair", "ts", rnd("beta").alias("beta"), rnd("spread").alias("spread"), rnd(F.when(~F.isnan("z"), F.col("z"))).alias("z"))


@query("garch_grid", f"""WITH s AS MATERIALIZED (SELECT asset_id, r - AVG(r) OVER (PARTITION BY asset_id) AS e, ts FROM (
      SELECT asset_id, ts, 100 * (close / LAG(close) {W} - 1) AS r FROM bars) WHERE r IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY ts DESC) <= 252),
    t AS MATERIALIZED (SELECT asset_id, ts, e - AVG(e) OVER (PARTITION BY asset_id) AS e FROM s),
    l AS MATERIALIZED (SELECT asset_id, LIST(e ORDER BY ts) AS es, VAR_POP(e) AS v, COUNT(*) AS n_obs FROM t GROUP BY 1 HAVING COUNT(*) >= 60),
    g AS MATERIALIZED (SELECT l.*, a, b, v * (1 - a - b) AS w FROM l, (VALUES {', '.join(f'({a}::DOUBLE)' for a in models.ALPHAS)}) AS x(a), (VALUES {', '.join(f'({b}::DOUBLE)' for b in models.BETAS)}) AS y(b) WHERE a + b < 1),
    f AS MATERIALIZED (SELECT *, LIST_REDUCE(LIST_TRANSFORM(es, LAMBDA x: {{'h': x, 'll': 0.0::DOUBLE}}), LAMBDA acc, x: {{'h': w + a * x.h * x.h + b * acc.h, 'll': acc.ll - 0.5 * (LN(acc.h) + x.h * x.h / acc.h)}}, {{'h': v, 'll': 0.0::DOUBLE}}) AS r FROM g)
    SELECT asset_id, n_obs, a AS alpha, b AS beta, R6(w) AS omega, R4(r.ll) AS log_likelihood, R6(GREATEST(0.01, LEAST(5.0, SQRT(r.h) * SQRT(252) / 100))) AS forecast_vol, R6(SQRT(w / (1 - a - b)) * SQRT(252) / 100) AS long_run_vol
    FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY r.ll DESC) = 1""")
def garch_grid(spark, d):
    df = models.garch_grid(bars(spark, d))
    return df.select("asset_id", "n_obs", "alpha", "beta", rnd("omega").alias("omega"), rnd("log_likelihood", 4).alias("log_likelihood"),
                     rnd("forecast_vol").alias("forecast_vol"), rnd("long_run_vol").alias("long_run_vol"))


@query("factor_betas", f"""WITH r AS MATERIALIZED (SELECT *, volume >= AVG(volume) OVER (PARTITION BY ts) AS big FROM (SELECT asset_id, ts, volume, close / LAG(close) {W} - 1 AS ret FROM bars) WHERE ret IS NOT NULL),
    f AS MATERIALIZED (SELECT ts, AVG(ret) AS m, AVG(CASE WHEN big THEN ret END) - AVG(CASE WHEN NOT big THEN ret END) AS s FROM r WHERE ret IS NOT NULL GROUP BY 1),
    c AS MATERIALIZED (SELECT asset_id, COUNT(*) AS n, VAR_POP(m) * COUNT(*) + 0.01 AS mm, VAR_POP(s) * COUNT(*) + 0.01 AS ss, COVAR_POP(m, s) * COUNT(*) AS ms, COVAR_POP(m, ret) * COUNT(*) AS my, COVAR_POP(s, ret) * COUNT(*) AS sy, VAR_POP(ret) * COUNT(*) AS yy
      FROM r JOIN f ON f.ts = r.ts WHERE ret IS NOT NULL AND s IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 30),
    b AS MATERIALIZED (SELECT *, (my * ss - sy * ms) / (mm * ss - ms * ms) AS bm, (sy * mm - my * ms) / (mm * ss - ms * ms) AS bs FROM c),
    v AS MATERIALIZED (SELECT *, SQRT(GREATEST(yy - 2 * (bm * my + bs * sy) + bm * bm * (mm - 0.01) + bs * bs * (ss - 0.01) + 2 * bm * bs * ms, 0) / n * 252) AS vol FROM b)
    SELECT asset_id AS portfolio_id, 'market' AS factor, R6(bm) AS beta, R6(vol) AS residual_vol FROM v UNION ALL SELECT asset_id, 'size', R6(bs), R6(vol) FROM v""")
def factor_betas(spark, d):
    b = bars(spark, d).withColumn("ret", pct_change("close"))
    day = Window.partitionBy("ts")
    big = F.col("volume") >= F.avg("volume").over(day)
    factors = b.where("ret IS NOT NULL").withColumn("_big", big).groupBy("ts").agg(
        F.avg("ret").alias("market"), (F.avg(F.when(F.col("_big"), F.col("ret"))) - F.avg(F.when(~F.col("_big"), F.col("ret")))).alias("size"))
    curves = b.where("ret IS NOT NULL").select(F.col("asset_id").alias("portfolio_id"), "ts", "ret")
    df = models.factor_betas(curves, factors, ["market", "size"])
    return df.select("portfolio_id", "factor", rnd("beta").alias("beta"), rnd("residual_vol").alias("residual_vol"))
