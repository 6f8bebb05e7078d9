"""Performance, research and reports."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from marketframe.catalog.registry import query
from marketframe.catalog.sqltext import W, over, roll
from marketframe.functions.stats import (deflated_sharpe, expected_max_sharpe, expected_max_sharpe_of, lit, rnd,
                                         sample_kurt, sample_skew)
from marketframe.operators import performance as perf, research
from marketframe.operators.signals import portfolio_equity, sma_crossover, strategy_returns
from marketframe.operators.volatility import regimes
from marketframe.operators.windows import by_asset, ordered, pct_change
from marketframe.plans import sweep as plans
from marketframe.plans.bootstrap import bootstrap_sharpe
from marketframe.sources.market import Market

P = "portfolio_id"


def rounded(df, keep, values, digits=6):
    return df.select(*keep, *[rnd(v, digits).alias(v) for v in values])


def summary_sql(source: str, keys: str, e_max: float = 0.0) -> str:
    """The metric block of operators.performance.summary over a table with keys, ts, equity."""
    dsr = deflated_sharpe("sharpe_ratio", "n_obs", lit(e_max), "COALESCE(skew, 0)", "COALESCE(kurt, 0)")
    return f"""SELECT *, {dsr} AS deflated_sharpe FROM (
      SELECT *, CASE WHEN dv > 0 THEN (cagr - 0.05) / dv ELSE 0 END AS sortino_ratio,
             CASE WHEN ABS(max_drawdown) > 1e-8 THEN cagr / ABS(max_drawdown) ELSE 0 END AS calmar_ratio FROM (
        SELECT *, final_equity / initial_equity - 1 AS total_return, n_obs / 252.0::DOUBLE AS n_years,
               POW(final_equity / initial_equity, 1 / GREATEST(n_obs / 252.0::DOUBLE, 0.01)) - 1 AS cagr,
               sd * SQRT(252) AS annual_volatility, CASE WHEN sd > 0 THEN mu / sd * SQRT(252) ELSE 0 END AS sharpe_ratio,
               CASE WHEN n_down > 0 THEN down * SQRT(252) ELSE 1e-8 END AS dv FROM (
          SELECT {keys}, ARG_MIN(equity, ts) AS initial_equity, ARG_MAX(equity, ts) AS final_equity, COUNT(ret) AS n_obs,
                 STDDEV_SAMP(ret) AS sd, AVG(ret - 0.05::DOUBLE / 252) AS mu, STDDEV_SAMP(CASE WHEN ret < 0 THEN ret END) AS down,
                 COUNT(CASE WHEN ret < 0 THEN 1 END) AS n_down, MIN(dd) AS max_drawdown, SKEWNESS(ret) AS skew, KURTOSIS(ret) AS kurt
          FROM (SELECT *, equity / LAG(equity) OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS ret,
                       (equity - MAX(equity) OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
                        / MAX(equity) OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dd
                FROM {source}) GROUP BY {keys} HAVING COUNT(ret) > 0)))"""


METRICS = ["total_return", "cagr", "annual_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio"]


def r(names, digits=6):
    return ", ".join(f"R{digits}({n}) AS {n}" for n in names)


@query("perf_summary", f"SELECT portfolio_id, n_obs, {r(METRICS)} FROM ({summary_sql('equity_curves', P)})")
def perf_summary(spark, d):
    return rounded(perf.summary(Market(spark, d).equity_curves(), [P]), [P, "n_obs"], METRICS)


@query("deflated_sharpe", f"""SELECT portfolio_id, R6(sharpe_ratio) AS sharpe_ratio, R6(skew) AS skew, R6(kurt) AS kurt,
    R4(deflated_sharpe) AS deflated_sharpe FROM ({summary_sql('equity_curves', P, expected_max_sharpe(20))})""")
def deflated(spark, d):
    df = perf.summary(Market(spark, d).equity_curves(), [P], expected_max_sharpe(20))
    return df.select(P, rnd("sharpe_ratio").alias("sharpe_ratio"), rnd("skew").alias("skew"), rnd("kurt").alias("kurt"),
                     rnd("deflated_sharpe", 4).alias("deflated_sharpe"))


@query("sample_moments", f"""SELECT asset_id, R6(SKEWNESS(x)) AS skew, R6(KURTOSIS(x)) AS kurt, COUNT(x) AS n
    FROM (SELECT asset_id, close / LAG(close) {W} - 1 AS x FROM bars) GROUP BY 1""")
def sample_moments(spark, d):
    df = Market(spark, d).bars().withColumn("x", pct_change("close"))
    return df.groupBy("asset_id").agg(rnd(sample_skew(F.col("x"))).alias("skew"), rnd(sample_kurt(F.col("x"))).alias("kurt"),
                                      F.count("x").alias("n"))


@query("drawdown_series", """
    SELECT portfolio_id, ts, R6(peak) AS peak, R6((equity - peak) / peak) AS drawdown FROM (
      SELECT *, MAX(equity) OVER (PARTITION BY portfolio_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak
      FROM equity_curves)""")
def drawdown_series(spark, d):
    return rounded(perf.with_drawdown(Market(spark, d).equity_curves(), [P]), [P, "ts"], ["peak", "drawdown"])


MONTHLY = """SELECT portfolio_id, month, equity / prev - 1 AS ret FROM (
      SELECT *, LAG(equity) OVER (PARTITION BY portfolio_id ORDER BY month) AS prev, LAG(month) OVER (PARTITION BY portfolio_id ORDER BY month) AS pm
      FROM (SELECT portfolio_id, CAST(DATE_TRUNC('month', ts) AS DATE) AS month, ARG_MAX(equity, ts) AS equity FROM equity_curves GROUP BY 1, 2))
    WHERE pm = month - INTERVAL 1 MONTH"""


@query("monthly_returns", f"SELECT portfolio_id, month, R6(ret) AS ret FROM ({MONTHLY})")
def monthly_returns(spark, d):
    return rounded(perf.monthly_returns(Market(spark, d).equity_curves()), [P, "month"], ["ret"])


@query("best_worst_month", f"SELECT portfolio_id, R6(MAX(ret)) AS best_month, R6(MIN(ret)) AS worst_month, COUNT(*) AS n_months FROM ({MONTHLY}) GROUP BY 1")
def best_worst_month(spark, d):
    return perf.monthly_returns(Market(spark, d).equity_curves()).groupBy(P).agg(
        rnd(F.max("ret")).alias("best_month"), rnd(F.min("ret")).alias("worst_month"), F.count(F.lit(1)).alias("n_months"))


@query("monthly_heatmap", f"""SELECT portfolio_id, CAST(YEAR(month) AS BIGINT) AS year,
    {', '.join(f'R6(MAX(CASE WHEN MONTH(month) = {m} THEN ret END)) AS m{m:02d}' for m in range(1, 13))} FROM ({MONTHLY}) GROUP BY 1, 2""")
def monthly_heatmap(spark, d):
    df = perf.monthly_returns(Market(spark, d).equity_curves()).withColumns(
        {"year": F.year("month").cast("long"), "m": F.month("month")})
    wide = df.groupBy(P, "year").pivot("m", list(range(1, 13))).agg(F.first("ret"))
    return wide.select(P, "year", *[rnd(F.col(str(m))).alias(f"m{m:02d}") for m in range(1, 13)])


@query("drawdown_episodes", """
    SELECT portfolio_id, MIN(ts) AS start, ARG_MAX(nxt, ts) AS "end", R6(MIN(dd)) AS depth, ARG_MAX(nxt, ts) - MIN(ts) AS days FROM (
      SELECT *, SUM(s) OVER (PARTITION BY portfolio_id ORDER BY ts) AS ep FROM (
        SELECT *, CASE WHEN i AND NOT COALESCE(LAG(i) OVER w, FALSE) THEN 1 ELSE 0 END AS s, LEAD(ts) OVER w AS nxt FROM (
          SELECT *, dd < -1e-6 AS i FROM (
            SELECT *, (equity - MAX(equity) OVER (PARTITION BY portfolio_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
                     / MAX(equity) OVER (PARTITION BY portfolio_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dd
            FROM equity_curves)) WINDOW w AS (PARTITION BY portfolio_id ORDER BY ts))) WHERE i
    GROUP BY portfolio_id, ep HAVING MAX(ts) < ARG_MAX(nxt, ts) AND BOOL_AND(nxt IS NOT NULL)""")
def drawdown_episodes(spark, d):
    return rounded(perf.drawdown_episodes(Market(spark, d).equity_curves()), [P, "start", "end", "days"], ["depth"])


EPISODES = """
    SELECT portfolio_id, MIN(ts) AS start, ARG_MAX(nxt, ts) AS "end", MIN(dd) AS depth, ARG_MAX(nxt, ts) - MIN(ts) AS days FROM (
      SELECT *, SUM(s) OVER (PARTITION BY portfolio_id ORDER BY ts) AS ep FROM (
        SELECT *, CASE WHEN i AND NOT COALESCE(LAG(i) OVER w, FALSE) THEN 1 ELSE 0 END AS s, LEAD(ts) OVER w AS nxt FROM (
          SELECT *, dd < -1e-6 AS i FROM (SELECT *, equity / MAX(equity) OVER r - 1 AS dd FROM equity_curves
            WINDOW r AS (PARTITION BY portfolio_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
        WINDOW w AS (PARTITION BY portfolio_id ORDER BY ts))) WHERE i
    GROUP BY portfolio_id, ep HAVING BOOL_AND(nxt IS NOT NULL)"""


@query("drawdown_summary", f"""SELECT c.portfolio_id, COALESCE(n, 0) AS n_episodes, R6(COALESCE(d, 0)) AS mean_depth, COALESCE(m, 0) AS max_days FROM (SELECT DISTINCT portfolio_id FROM equity_curves) AS c
    LEFT JOIN (SELECT portfolio_id, COUNT(*) AS n, AVG(depth) AS d, MAX(days) AS m FROM ({EPISODES}) GROUP BY 1) AS e ON e.portfolio_id = c.portfolio_id""")
def drawdown_summary(spark, d):
    return rounded(perf.drawdown_summary(Market(spark, d).equity_curves()), [P, "n_episodes", "max_days"], ["mean_depth"])


@query("drawdown_utilisation", """SELECT portfolio_id, R6(dd) AS drawdown, R6(dd / -0.15) AS utilisation,
      CASE WHEN ROUND(dd, 9) <= -0.2 THEN 'CLOSE_ALL' WHEN ROUND(dd, 9) <= -0.15 THEN 'HALT_OPENS' ELSE 'NORMAL' END AS status
    FROM (SELECT portfolio_id, ARG_MAX(equity, ts) / MAX(equity) - 1 AS dd FROM equity_curves GROUP BY 1)""")
def drawdown_utilisation(spark, d):
    return rounded(perf.drawdown_utilisation(Market(spark, d).equity_curves()), [P, "status"], ["drawdown", "utilisation"])


@query("rolling_sharpe", f"""SELECT portfolio_id, ts, R6(COALESCE({roll('AVG', 'x', 252, keys=P)} / {roll('STDDEV_SAMP', 'x', 252, keys=P)} * SQRT(252), 0)) AS rolling_sharpe
    FROM (SELECT *, equity / LAG(equity) OVER (PARTITION BY portfolio_id ORDER BY ts) - 1 - 0.05::DOUBLE / 252 AS x FROM equity_curves)
    QUALIFY x IS NOT NULL""")
def rolling_sharpe(spark, d):
    return rounded(perf.rolling_sharpe(Market(spark, d).equity_curves()), [P, "ts"], ["rolling_sharpe"])


@query("rolling_calmar", f"""SELECT portfolio_id, ts, R6(COALESCE((POW(equity / LAG(equity, 252) OVER (PARTITION BY portfolio_id ORDER BY ts), 1.0::DOUBLE) - 1)
      / NULLIF(ABS(CASE WHEN n >= 252 THEN f.dd END), 0), 0)) AS rolling_calmar FROM (
    SELECT *, COUNT(equity) {over(252, keys=P)} AS n,
           LIST_REDUCE(LIST({{'p': equity, 'dd': 0.0::DOUBLE}}) {over(252, keys=P)},
             LAMBDA a, x: {{'p': GREATEST(a.p, x.p), 'dd': LEAST(a.dd, (x.p - GREATEST(a.p, x.p)) / GREATEST(a.p, x.p))}}) AS f
    FROM equity_curves)""")
def rolling_calmar(spark, d):
    return rounded(perf.rolling_calmar(Market(spark, d).equity_curves()), [P, "ts"], ["rolling_calmar"])


@query("report_rolling_sharpe", """
    WITH r AS MATERIALIZED (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY portfolio_id ORDER BY ts) AS i, LEAST(252, COUNT(*) OVER (PARTITION BY portfolio_id) // 2) AS n
      FROM (SELECT portfolio_id, ts, equity / LAG(equity) OVER (PARTITION BY portfolio_id ORDER BY ts) - 1 AS ret FROM equity_curves) WHERE ret IS NOT NULL)
    SELECT a.portfolio_id, a.ts, R4(AVG(b.ret) / STDDEV_SAMP(b.ret) * SQRT(252)) AS rolling_sharpe
    FROM r AS a JOIN r AS b ON a.portfolio_id = b.portfolio_id AND b.i > a.i - a.n AND b.i <= a.i
    WHERE a.i >= a.n AND a.n >= 2 GROUP BY 1, 2""")
def report_rolling_sharpe(spark, d):
    return rounded(perf.report_rolling_sharpe(Market(spark, d).equity_curves()), [P, "ts"], ["rolling_sharpe"], 4)


ALIGNED = """SELECT c.portfolio_id, c.ts, c.r AS s, b.r AS b
    FROM (SELECT *, equity / LAG(equity) OVER (PARTITION BY portfolio_id ORDER BY ts) - 1 AS r FROM equity_curves) AS c
    JOIN (SELECT *, equity / LAG(equity) OVER (ORDER BY ts) - 1 AS r FROM benchmark_curve) AS b ON b.ts = c.ts
    WHERE c.r IS NOT NULL AND b.r IS NOT NULL"""


@query("benchmark_stats", f"""
    SELECT portfolio_id, COUNT(*) AS n, R6(REGR_SLOPE(s, b)) AS beta, R6(REGR_INTERCEPT(s, b) * 252) AS alpha_annual, R6(REGR_R2(s, b)) AS r_squared,
           R6(AVG(s - b) / STDDEV_SAMP(s - b) * SQRT(252)) AS information_ratio, R6(EXP(SUM(LN(1 + b))) - 1) AS benchmark_return,
           R6(EXP(SUM(LN(1 + s))) - EXP(SUM(LN(1 + b)))) AS excess_return
    FROM ({ALIGNED}) GROUP BY 1 HAVING COUNT(*) >= 30""")
def benchmark_stats(spark, d):
    m = Market(spark, d)
    return rounded(perf.benchmark_stats(perf.aligned_returns(m.equity_curves(), m.benchmark_curve())), [P, "n"],
                   ["beta", "alpha_annual", "r_squared", "information_ratio", "benchmark_return", "excess_return"])


@query("attribution", f"""
    SELECT portfolio_id, R6(ms * 252) AS total_annual_return, R6(beta * mb * 252) AS market_contribution, R6(a * 252) AS alpha_contribution,
           R6(beta) AS beta, R6(r2) AS r_squared, R6(a / (SQRT(syy * (1 - r2) / (n - 2) * (1.0::DOUBLE / n + mb * mb / sxx)) + 1e-10)) AS alpha_tstat
    FROM (SELECT portfolio_id, COUNT(*) AS n, REGR_SLOPE(s, b) AS beta, REGR_INTERCEPT(s, b) AS a, REGR_R2(s, b) AS r2, AVG(s) AS ms, AVG(b) AS mb,
                 REGR_SYY(s, b) AS syy, REGR_SXX(s, b) AS sxx FROM ({ALIGNED}) GROUP BY 1 HAVING COUNT(*) >= 30)""")
def attribution(spark, d):
    m = Market(spark, d)
    return rounded(perf.attribution(perf.aligned_returns(m.equity_curves(), m.benchmark_curve())), [P], [
        "total_annual_return", "market_contribution", "alpha_contribution", "beta", "r_squared", "alpha_tstat"])


TRADE_COLUMNS = ["win_rate", "avg_win", "avg_loss", "gross_profit", "gross_loss", "total_pnl", "avg_holding_bars", "profit_factor", "expectancy"]


@query("trade_stats", f"""SELECT strategy_id, n_trades, {r(TRADE_COLUMNS, 4)}, n_trades < 30 AS insufficient_sample FROM (
    SELECT *, gross_profit / ABS(NULLIF(gross_loss, 0)) AS profit_factor, win_rate * avg_win - (1 - win_rate) * ABS(avg_loss) AS expectancy FROM (
      SELECT strategy_id, COUNT(*) AS n_trades, COUNT(CASE WHEN p > 0 THEN 1 END) / COUNT(*) AS win_rate, AVG(CASE WHEN p > 0 THEN p END) AS avg_win,
             AVG(CASE WHEN p <= 0 THEN p END) AS avg_loss, SUM(CASE WHEN p > 0 THEN p END) AS gross_profit, SUM(CASE WHEN p <= 0 THEN p END) AS gross_loss,
             SUM(p) AS total_pnl, AVG(holding_bars) AS avg_holding_bars
      FROM (SELECT *, realized_pnl AS p FROM trades WHERE realized_pnl IS NOT NULL) GROUP BY 1))""")
def trade_stats(spark, d):
    return rounded(perf.trade_stats(Market(spark, d).trades()), ["strategy_id", "n_trades", "insufficient_sample"], TRADE_COLUMNS, 4)


@query("strategy_pnl", "SELECT strategy_id, R4(SUM(realized_pnl)) AS total_pnl, COUNT(realized_pnl) AS n FROM trades GROUP BY 1")
def strategy_pnl(spark, d):
    return Market(spark, d).trades().groupBy("strategy_id").agg(
        rnd(F.sum("realized_pnl"), 4).alias("total_pnl"), F.count("realized_pnl").alias("n")).orderBy("total_pnl")


@query("annual_turnover", """
    SELECT t.asset_id, R6(traded / avg_equity / GREATEST(n / 252.0::DOUBLE, 1)) AS annual_turnover
    FROM (SELECT asset_id, SUM(ABS(quantity * entry_price)) AS traded FROM trades GROUP BY 1) AS t
    JOIN (SELECT portfolio_id, AVG(equity) AS avg_equity, COUNT(*) - 1 AS n FROM equity_curves GROUP BY 1) AS e ON e.portfolio_id = t.asset_id""")
def annual_turnover(spark, d):
    m = Market(spark, d)
    traded = m.trades().groupBy("asset_id").agg(F.sum(F.abs(F.col("quantity") * F.col("entry_price"))).alias("traded"))
    equity = m.equity_curves().groupBy(F.col(P).alias("asset_id")).agg(F.avg("equity").alias("e"), (F.count(F.lit(1)) - 1).alias("n"))
    return traded.join(equity, "asset_id").select("asset_id", rnd(
        F.col("traded") / F.col("e") / F.greatest(F.col("n") / 252.0, F.lit(1.0))).alias("annual_turnover"))


@query("today_ytd", """
    SELECT portfolio_id, R4(MAX(CASE WHEN k = 1 THEN equity END) - MAX(CASE WHEN k = 2 THEN equity END)) AS today_pnl,
           R6(CASE WHEN COUNT(CASE WHEN y = my THEN 1 END) >= 2 THEN ARG_MAX(CASE WHEN y = my THEN equity END, ts) / ARG_MIN(equity, CASE WHEN y = my THEN ts END) - 1 ELSE 0 END) AS ytd_return
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY portfolio_id ORDER BY ts DESC) AS k, YEAR(ts) AS y, YEAR(MAX(ts) OVER (PARTITION BY portfolio_id)) AS my FROM equity_curves)
    GROUP BY 1""")
def today_ytd(spark, d):
    c = Market(spark, d).equity_curves()
    w = ordered(P)
    df = c.withColumns({"_prev": F.lag("equity").over(w), "_year": F.year("ts")})
    by_year = df.groupBy(P, "_year").agg(F.max_by("equity", "ts").alias("last"), F.min_by("equity", "ts").alias("first"),
                                         F.count(F.lit(1)).alias("n"), F.max_by(F.col("equity") - F.col("_prev"), "ts").alias("today"))
    out = by_year.groupBy(P).agg(F.max_by(F.struct("last", "first", "n", "today"), "_year").alias("y"))
    ytd = F.when(F.col("y.n") >= 2, F.col("y.last") / F.col("y.first") - 1).otherwise(0.0)
    return out.select(P, rnd("y.today", 4).alias("today_pnl"), rnd(ytd).alias("ytd_return"))


@query("rebased_benchmark", """
    SELECT portfolio_id, ts, R4(b * FIRST_VALUE(equity) OVER w / FIRST_VALUE(b) OVER w) AS benchmark FROM (
      SELECT c.portfolio_id, c.ts, c.equity, b.equity AS b FROM equity_curves AS c JOIN benchmark_curve AS b ON b.ts = c.ts)
    WINDOW w AS (PARTITION BY portfolio_id ORDER BY ts)""")
def rebased_benchmark(spark, d):
    m = Market(spark, d)
    df = m.equity_curves().join(m.benchmark_curve().withColumnRenamed("equity", "b"), "ts")
    w = ordered(P)
    return df.select(P, "ts", rnd(F.col("b") * F.first("equity").over(w) / F.first("b").over(w), 4).alias("benchmark"))


@query("verdict", f"""SELECT portfolio_id, CONCAT_WS(' | ', CASE WHEN deflated_sharpe > 0 THEN 'significant' ELSE 'not_significant' END,
      CASE WHEN sharpe_ratio > 0.5 THEN 'good_sharpe' WHEN sharpe_ratio > 0 THEN 'weak_sharpe' ELSE 'negative_sharpe' END,
      CASE WHEN ABS(max_drawdown) < 0.2 THEN 'drawdown_acceptable' ELSE 'drawdown_large' END) AS summary,
      deflated_sharpe > 0 AND sharpe_ratio > 0.3 AS proceed FROM ({summary_sql('equity_curves', P)})""")
def verdict(spark, d):
    return perf.verdict(perf.summary(Market(spark, d).equity_curves(), [P])).select(P, "summary", "proceed")


GRID = plans.SmaGrid((5, 10, 20, 30, 50), (60, 100, 150, 200))
WFO_GRID = plans.SmaGrid((10, 20, 50), (100, 200))
PERIODS = [("spring_1996", "1996-02-01", "1996-07-31"), ("year_1997", "1997-01-01", "1997-12-31"), ("rate_scare", "1998-04-01", "1998-08-15")]


def sweep_curve_sql(grid, source: str, keys: str = "") -> str:
    """Equity per (keys, param_id, ts) of the crossover grid over a bar table."""
    k = f"{keys}, " if keys else ""
    part = f"asset_id, {keys}" if keys else "asset_id"
    means = ", ".join(f"{roll('AVG', 'close', n, keys=part)} AS m{n}" for n in grid.lengths)
    params = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS param_id, {f} AS fast, {s} AS slow" for i, (f, s) in enumerate(grid.configs))
    raw = " ".join(f"WHEN param_id = {i} THEN CASE WHEN m{f} > m{s} THEN 1 ELSE 0 END" for i, (f, s) in enumerate(grid.configs))
    w = f"OVER (PARTITION BY {part}, param_id ORDER BY ts)"
    return f"""SELECT {k}param_id, ts, R6(100000 * EXP(SUM(LN(1 + ret)) OVER (PARTITION BY {k}param_id ORDER BY ts))) AS equity FROM (
        SELECT {k}param_id, ts, AVG(ret) AS ret FROM (
          SELECT {k}param_id, ts, COALESCE(LAG(raw, 2) {w}, 0) * COALESCE(close / LAG(close) {w} - 1, 0)
                 - 0.002 * ABS(COALESCE(LAG(raw, 2) {w}, 0) - COALESCE(LAG(raw, 3) {w}, 0)) AS ret
          FROM (SELECT *, CASE {raw} END AS raw FROM (SELECT *, {means} FROM {source}), ({params})))
        GROUP BY {k}param_id, ts)"""


@query("param_grid", "SELECT asset_id, ts, close, p.* FROM bars, (VALUES (0::BIGINT, 10::BIGINT, 100::BIGINT), (1, 10, 200), (2, 20, 100), (3, 20, 200), (4, 50, 100), (5, 50, 200)) AS p(param_id, fast, slow)")
def param_grid(spark, d):
    return plans.grid_table(Market(spark, d).bars().select("asset_id", "ts", "close"), WFO_GRID)


@query("sweep_scores", f"""
    SELECT param_id, f.fast, f.slow, {r(METRICS)}, R4({deflated_sharpe('sharpe_ratio', '(n_obs + 1)', lit(expected_max_sharpe(20)))}) AS deflated_sharpe_corrected
    FROM ({summary_sql('(' + sweep_curve_sql(GRID, 'bars') + ')', 'param_id')}) JOIN (
      {' UNION ALL '.join(f'SELECT CAST({i} AS BIGINT) AS param_id, CAST({f} AS BIGINT) AS fast, CAST({s} AS BIGINT) AS slow' for i, (f, s) in enumerate(GRID.configs))}) AS f USING (param_id)""")
def sweep_scores(spark, d):
    df = plans.sweep(Market(spark, d).bars(), GRID)
    return df.select("param_id", "fast", "slow", *[rnd(m).alias(m) for m in METRICS],
                     rnd("deflated_sharpe_corrected", 4).alias("deflated_sharpe_corrected"))


SPANS = """SELECT ts, window_id, phase FROM (SELECT ts, ROW_NUMBER() OVER (ORDER BY ts) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars)),
    (SELECT UNNEST(RANGE(0, 200)) AS window_id), (VALUES ('train', 0, 756), ('test', 756, 252)) AS p(phase, a, len)
    WHERE window_id * 126 + 1008 <= n AND i >= window_id * 126 + a AND i < window_id * 126 + a + len"""


@query("wfo_windows", f"""SELECT window_id, phase, MIN(ts) AS start, MAX(ts) AS "end", COUNT(*) AS n FROM ({SPANS}) GROUP BY 1, 2""")
def wfo_windows(spark, d):
    return plans.walk_forward_windows(Market(spark, d).bars(), 756, 252, 126).groupBy("window_id", "phase").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))


WFO = f"""WITH spans AS MATERIALIZED ({SPANS}),
    curves AS MATERIALIZED ({sweep_curve_sql(WFO_GRID, '(SELECT asset_id, b.ts, close, window_id, phase FROM bars AS b JOIN spans AS s ON s.ts = b.ts)', 'window_id, phase')}),
    scored AS MATERIALIZED ({summary_sql('curves', 'window_id, phase, param_id')}),
    best AS MATERIALIZED (SELECT window_id, param_id, sharpe_ratio AS train_sharpe FROM scored WHERE phase = 'train'
      QUALIFY ROW_NUMBER() OVER (PARTITION BY window_id ORDER BY ROUND(sharpe_ratio, 9) DESC, param_id) = 1),
    wfo AS MATERIALIZED (SELECT b.window_id, b.param_id, train_sharpe, sharpe_ratio AS oos_sharpe, total_return AS oos_return, max_drawdown AS oos_max_drawdown,
      calmar_ratio AS oos_calmar FROM best AS b JOIN scored AS s ON s.window_id = b.window_id AND s.param_id = b.param_id AND s.phase = 'test')"""
WFO_VALUES = ["train_sharpe", "oos_sharpe", "oos_return", "oos_max_drawdown", "oos_calmar"]


@query("walk_forward", f"""{WFO} SELECT window_id, param_id, {r(WFO_VALUES)} FROM wfo""")
def walk_forward(spark, d):
    return rounded(plans.walk_forward(Market(spark, d).bars(), WFO_GRID), ["window_id", "param_id"], WFO_VALUES)


WFO_SUMMARY = ["avg_oos_sharpe", "avg_is_sharpe", "sharpe_degradation", "oos_win_rate"]


@query("wfo_summary", f"""{WFO} SELECT n_windows, total_configs, most_stable_param, {r(WFO_SUMMARY)}, R4(dsr) AS deflated_sharpe,
      CASE WHEN dsr > 0 AND avg_oos_sharpe > 0.3 THEN 'pass' WHEN sharpe_degradation > 0.5 THEN 'overfit' ELSE 'fail' END AS verdict FROM (
    SELECT *, {deflated_sharpe('avg_oos_sharpe', 'n_obs', expected_max_sharpe_of('total_configs'))} AS dsr FROM (
      SELECT *, avg_is_sharpe - avg_oos_sharpe AS sharpe_degradation, n_windows * 6 AS total_configs, (SELECT COUNT(DISTINCT ts) FROM bars) AS n_obs FROM (
        SELECT AVG(oos_sharpe) AS avg_oos_sharpe, AVG(train_sharpe) AS avg_is_sharpe, COUNT(*) AS n_windows, AVG(CASE WHEN oos_sharpe > 0 THEN 1.0 ELSE 0.0 END) AS oos_win_rate,
               (SELECT param_id FROM wfo GROUP BY 1 ORDER BY COUNT(*) DESC, param_id LIMIT 1) AS most_stable_param FROM wfo)))""")
def wfo_summary(spark, d):
    bars = Market(spark, d).bars()
    n = bars.agg(F.countDistinct("ts")).scalar()
    df = plans.walk_forward_summary(plans.walk_forward(bars, WFO_GRID), len(WFO_GRID.configs), n)
    return df.select("n_windows", "total_configs", "most_stable_param", *[rnd(c).alias(c) for c in WFO_SUMMARY],
                     rnd("deflated_sharpe", 4).alias("deflated_sharpe"), "verdict")


@query("stress_periods", f"""SELECT portfolio_id, period, n_obs, {r(METRICS)}, max_drawdown >= -0.25 AS passed FROM ({summary_sql('''(
      SELECT c.*, period FROM equity_curves AS c JOIN (VALUES ''' + ', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS)
      + ''') AS p(period, a, b) ON c.ts BETWEEN p.a AND p.b)''', 'portfolio_id, period')}) WHERE n_obs + 1 >= 30""")
def stress_periods(spark, d):
    return rounded(plans.by_period(Market(spark, d).equity_curves(), PERIODS), [P, "period", "n_obs", "passed"], METRICS)


REGIMES = f"""SELECT asset_id, ts, CONCAT(CASE WHEN close > {roll('AVG', 'close', 200)} THEN 'bull' ELSE 'bear' END,
      CASE WHEN v > {roll('MEDIAN', 'v', 252)} THEN '_high_vol' ELSE '_low_vol' END) AS regime FROM (
    SELECT *, {roll('STDDEV_SAMP', 'x', 30)} * SQRT(252) AS v FROM (SELECT *, close / LAG(close) {W} - 1 AS x FROM bars))"""


@query("regimes", REGIMES)
def regimes_query(spark, d):
    return regimes(Market(spark, d).bars()).select("asset_id", "ts", "regime")


@query("regime_counts", f"SELECT asset_id, regime, COUNT(*) AS n, R6(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY asset_id)) AS share FROM ({REGIMES}) GROUP BY 1, 2")
def regime_counts(spark, d):
    n = regimes(Market(spark, d).bars()).groupBy("asset_id", "regime").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("asset_id"))
    return n.select("asset_id", "regime", "n", rnd(share).alias("share"))


@query("regime_metrics", f"""SELECT portfolio_id, regime, n_obs, R6(sharpe_ratio) AS sharpe_ratio, R6(cagr) AS cagr, R6(max_drawdown) AS max_drawdown, R6(calmar_ratio) AS calmar_ratio
    FROM ({summary_sql(f'(SELECT c.*, regime FROM equity_curves AS c JOIN ({REGIMES}) AS g ON g.asset_id = c.portfolio_id AND g.ts = c.ts)', 'portfolio_id, regime')}) WHERE n_obs + 1 >= 20""")
def regime_metrics(spark, d):
    bars = Market(spark, d).bars()
    curves = bars.select(F.col("asset_id").alias(P), "ts", (1000 * F.col("close")).alias("equity"))
    return rounded(plans.by_regime(curves, regimes(bars)), [P, "regime", "n_obs"], ["sharpe_ratio", "cagr", "max_drawdown", "calmar_ratio"])


def rank_sql(x: str, keys: str) -> str:
    return (f"(RANK() OVER (PARTITION BY {keys} ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE) "
            f"/ COUNT({x}) OVER (PARTITION BY {keys})")


HORIZONS = [1, 5, 10, 21, 42, 63]


def ic_sql(horizons):
    fwd = " UNION ALL ".join(f"SELECT ts, sig, CAST({h} AS BIGINT) AS horizon, f{h} AS fwd FROM base" for h in horizons)
    leads = ", ".join(f"LEAD(close, {h}) {W} / close - 1 AS f{h}" for h in horizons)
    return f"""WITH base AS MATERIALIZED (SELECT ts, close / LAG(close, 20) {W} - 1 AS sig, {leads} FROM bars),
      ics AS MATERIALIZED (SELECT ts, horizon, CORR(a, b) AS ic, COUNT(*) AS n FROM (
        SELECT ts, horizon, {rank_sql('sig', 'ts, horizon')} AS a, {rank_sql('fwd', 'ts, horizon')} AS b
        FROM ({fwd}) WHERE sig IS NOT NULL AND fwd IS NOT NULL) GROUP BY 1, 2 HAVING COUNT(*) >= 5)"""


@query("factor_decay", f"""{ic_sql(HORIZONS)} SELECT horizon, R6(AVG(ic)) AS mean_ic, R6(STDDEV_POP(ic)) AS std_ic, R6(AVG(ic) / (STDDEV_POP(ic) + 1e-10)) AS ir,
      R6(AVG(ic) / (STDDEV_POP(ic) / SQRT(COUNT(*)) + 1e-10)) AS t_stat, R6(AVG(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END)) AS pct_positive, COUNT(*) AS n_obs
    FROM ics WHERE ic IS NOT NULL AND NOT ISNAN(ic) GROUP BY 1""")
def factor_decay(spark, d):
    panel = Market(spark, d).bars().withColumn("sig", pct_change("close", 20))
    ics = research.information_coefficients(panel, "sig", HORIZONS)
    ics = ics.withColumn("ic", F.when(F.abs("ic") < 1e-12, 0.0).otherwise(F.col("ic")))
    return rounded(research.factor_decay(ics), ["horizon", "n_obs"], ["mean_ic", "std_ic", "ir", "t_stat", "pct_positive"])


TURNOVER = ["daily_turnover", "annual_turnover", "annual_cost", "gross_annual_return", "net_annual_return", "break_even_bps"]


@query("turnover_cost", f"""WITH s AS MATERIALIZED (
      SELECT asset_id, ts, close, LAG(raw, 1, 0) {W} / 25.0::DOUBLE AS weight FROM (
        SELECT *, CASE WHEN {roll('AVG', 'close', 20)} > {roll('AVG', 'close', 50)} THEN 1 ELSE 0 END AS raw FROM bars)),
    x AS MATERIALIZED (SELECT *, COALESCE(ABS(weight - LAG(weight) {W}), 0) AS d, COALESCE(LAG(weight) {W} * (close / LAG(close) {W} - 1), 0) AS wr FROM s)
    SELECT R6(dt) AS daily_turnover, R6(dt * 252) AS annual_turnover, R6(dt * p * 0.001 * 252) AS annual_cost, R6(g) AS gross_annual_return,
           R6(g - dt * p * 0.001 * 252) AS net_annual_return, R4(g / (dt * 252 + 1e-10) * 10000) AS break_even_bps
    FROM (SELECT AVG(d) / (SELECT COUNT(DISTINCT asset_id) FROM x) AS dt, EXP(SUM(LN(1 + wr)) * 252 / COUNT(*)) - 1 AS g,
                 (SELECT AVG(p) FROM (SELECT AVG(close) AS p FROM x GROUP BY asset_id)) AS p
          FROM (SELECT ts, SUM(d) AS d, SUM(wr) AS wr FROM x GROUP BY 1))""")
def turnover_cost(spark, d):
    signals = sma_crossover(Market(spark, d).bars(), 20, 50).select("asset_id", "ts", "close", (F.col("signal") / 25.0).alias("weight"))
    df = research.turnover(signals)
    return df.select(*[rnd(c, 4 if c == "break_even_bps" else 6).alias(c) for c in TURNOVER])


@query("capacity", """SELECT strategy_id, R8(p) AS participation, R6(10 * SQRT(p)) AS current_slippage_pct, R6(10 * SQRT(p * 100)) AS target_slippage_pct,
      R4((0.1 * SQRT(p * 100) - 0.1 * SQRT(p)) * 20000) AS drag_bps, R4(100000 * 0.0001::DOUBLE / (p + 1e-10)) AS max_capital,
      CASE WHEN 0.1 * SQRT(p * 100) - 0.1 * SQRT(p) > 0.005 THEN 'constrained' ELSE 'scales' END AS recommendation
    FROM (SELECT strategy_id, AVG(quantity) / 1000001.0::DOUBLE AS p FROM trades GROUP BY 1)""")
def capacity(spark, d):
    df = research.capacity(Market(spark, d).trades(), "strategy_id", 100_000.0, 10_000_000.0)
    return df.select("strategy_id", rnd("participation", 8).alias("participation"), rnd("current_slippage_pct").alias("current_slippage_pct"),
                     rnd("target_slippage_pct").alias("target_slippage_pct"), rnd("drag_bps", 4).alias("drag_bps"),
                     rnd("max_capital", 4).alias("max_capital"), "recommendation")


@query("bootstrap_sharpe")
def bootstrap(spark, d):
    m = Market(spark, d)
    curves = m.equity_curves().unionByName(m.benchmark_curve().withColumn(P, F.lit("benchmark")))
    rets = perf.with_returns(curves, [P]).where("ret IS NOT NULL").select(P, "ts", "ret")
    return bootstrap_sharpe(rets, P, 10_000)


@query("strategy_equity", f"""
    SELECT ts, R6(ret) AS ret, R4(100000 * EXP(SUM(LN(1 + ret)) OVER (ORDER BY ts))) AS equity FROM (
      SELECT ts, AVG(COALESCE(COALESCE(h, 0) * r, 0) - 0.002 * ABS(COALESCE(h, 0) - COALESCE(b, 0))) AS ret FROM (
        SELECT asset_id, ts, LAG(signal) {W} AS h, LAG(signal, 2) {W} AS b, close / LAG(close) {W} - 1 AS r FROM (
          SELECT *, LAG(raw, 1, 0) {W} AS signal FROM (
            SELECT *, CASE WHEN {roll('AVG', 'close', 50)} > {roll('AVG', 'close', 200)} THEN 1 ELSE 0 END AS raw FROM bars))) GROUP BY ts)""")
def strategy_equity(spark, d):
    returns = strategy_returns(sma_crossover(Market(spark, d).bars(), 50, 200), 0.002)
    df = portfolio_equity(returns.withColumn("strategy", F.lit("sma")), ["strategy"])
    return df.select("ts", rnd("ret").alias("ret"), rnd("equity", 4).alias("equity"))
