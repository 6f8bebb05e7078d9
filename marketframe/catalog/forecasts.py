"""Model forecasts and what reads them: walk-forward rank model, its coefficients of information, GARCH schedule."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.catalog.crosssection import COARSE, FACTORS, RANKED, VIX_BARS, factor_panel
from marketframe.catalog.performance import rank_sql
from marketframe.catalog.registry import query
from marketframe.catalog.sqltext import W, over
from marketframe.catalog.weights import WITH_CAND, candidates
from marketframe.functions.stats import rnd
from marketframe.operators import crosssection as xs, garch, rankmodel, research, risk, weights
from marketframe.operators.models import ALPHAS, BETAS
from marketframe.session import durable
from marketframe.sources.market import Market

K = len(FACTORS)
MONTH = "CAST(DATE_TRUNC('month', {}) AS DATE)"


def ranked_features(panel):
    """The factors as centred ranks per date: ties share theirs, missing ones stay null."""
    kept = panel.select("asset_id", "ts", "close", *[rnd(n, 4 if n in COARSE else 9).alias(n) for n in FACTORS])
    return xs.percent_ranks(kept, FACTORS).withColumns({n: F.col(n) - 0.5 for n in FACTORS})


def model(spark, d):
    """(rows with prediction, models) of the walk-forward ridge on all factors."""
    panel = factor_panel(spark, d).withColumn("amihud_illiq", F.col("amihud_illiq") * 1_000_000)
    # training and prediction both read the panel, whose windows are the costly part
    rows, fitted = rankmodel.walk_forward(durable(ranked_features(panel)), FACTORS)
    return rows.withColumn("prediction", rnd("prediction", 9)), fitted


# the same fit in SQL: Gram cells per month, frames over months, elimination over the system's cells
MODEL = f"""f AS MATERIALIZED (SELECT asset_id, ts, {RANKED} FROM (
      SELECT *, volume * close AS dv, ABS(lr) / (volume * close + 1) AS il FROM (SELECT *, close / LAG(close) {W} - 1 AS r1, LN(close / LAG(close) {W}) AS lr FROM {VIX_BARS}))),
    x AS MATERIALIZED (SELECT asset_id, ts, i, {rank_sql('value', 'ts, factor')} - 0.5 AS x FROM (UNPIVOT f ON {', '.join(FACTORS)} INTO NAME factor VALUE value)
      JOIN (SELECT UNNEST([{', '.join(f"'{n}'" for n in FACTORS)}]) AS name, UNNEST(RANGE(1, {K + 1})) AS i) ON name = factor WHERE value IS NOT NULL),
    ahead AS MATERIALIZED (SELECT asset_id, ts, LEAD(close, 21) {W} / close - 1 AS fwd, {MONTH.format(f"LEAD(ts, 21) {W}")} AS known FROM bars),
    lab AS MATERIALIZED (SELECT asset_id, ts, known, {rank_sql('fwd', 'ts')} AS y FROM (SELECT *, COUNT(*) OVER (PARTITION BY ts) AS n FROM ahead WHERE fwd IS NOT NULL) WHERE n >= 5),
    z AS MATERIALIZED (SELECT asset_id, ts, known, 0 AS i, 1.0::DOUBLE AS x FROM lab UNION ALL SELECT asset_id, ts, known, i, x FROM lab JOIN x USING (asset_id, ts)
      UNION ALL SELECT asset_id, ts, known, {K + 1}, y FROM lab),
    g AS MATERIALIZED (SELECT a.known AS month, a.i, b.i AS j, SUM(a.x * b.x) AS v FROM z AS a JOIN z AS b ON a.asset_id = b.asset_id AND a.ts = b.ts WHERE a.i <= {K} GROUP BY ALL),
    cells AS MATERIALIZED (SELECT month, i, j, SUM(v) OVER (PARTITION BY i, j ORDER BY month ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING) AS v FROM (
      SELECT c.month, p.i, q.j, COALESCE(g.v, 0) AS v FROM (SELECT DISTINCT {MONTH.format('ts')} AS month FROM bars) AS c CROSS JOIN (SELECT UNNEST(RANGE({K + 1})) AS i) AS p
      CROSS JOIN (SELECT UNNEST(RANGE({K + 2})) AS j) AS q LEFT JOIN g ON g.month = c.month AND g.i = p.i AND g.j = q.j)),
    enough AS MATERIALIZED (SELECT month, v AS n FROM cells WHERE i = 0 AND j = 0 AND v >= 99.5),
    gj AS (SELECT month, i, j, v + CASE WHEN i = j AND i > 0 THEN 0.01::DOUBLE * n ELSE 0 END AS v, 0 AS k FROM cells JOIN enough USING (month)
      UNION ALL SELECT month, i, j, CASE WHEN i = k THEN v / pv ELSE v - vi * vj / pv END, k + 1 FROM (
        SELECT *, MAX(CASE WHEN j = k THEN v END) OVER (PARTITION BY month, i) AS vi, MAX(CASE WHEN i = k THEN v END) OVER (PARTITION BY month, j) AS vj,
               MAX(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY month) AS pv FROM gj) WHERE k <= {K}),
    beta AS MATERIALIZED (SELECT month, i, v AS b FROM gj WHERE k = {K + 1} AND j = {K + 1}),
    pred AS MATERIALIZED (SELECT b.asset_id, b.ts, R9(c.b + COALESCE(s.v, 0)) AS p FROM bars AS b JOIN beta AS c ON c.i = 0 AND c.month = {MONTH.format('b.ts')}
      LEFT JOIN (SELECT asset_id, ts, SUM(x.x * beta.b) AS v FROM x JOIN beta ON beta.i = x.i AND beta.month = {MONTH.format('x.ts')} GROUP BY 1, 2) AS s ON s.asset_id = b.asset_id AND s.ts = b.ts),
    ics AS MATERIALIZED (SELECT ts, CORR(a, b) AS ic, COUNT(*) AS n FROM (SELECT ts, {rank_sql('p', 'ts')} AS a, {rank_sql('fwd', 'ts')} AS b FROM pred JOIN ahead USING (asset_id, ts) WHERE fwd IS NOT NULL)
      WHERE ts IN (SELECT MIN(ts) FROM bars GROUP BY DATE_TRUNC('month', ts)) GROUP BY 1 HAVING COUNT(*) >= 5)"""


@query("ml_rank_model", f"WITH RECURSIVE {MODEL} SELECT ts, asset_id, R6(p) AS prediction, R6({rank_sql('p', 'ts')}) AS rank FROM pred")
def ml_rank_model(spark, d):
    rows = model(spark, d)[0].where("prediction IS NOT NULL")
    return rows.select("ts", "asset_id", rnd("prediction").alias("prediction"), rnd(xs.percent_rank_avg("prediction", ["ts"])).alias("rank"))


@query("ml_importances", f"""WITH RECURSIVE {MODEL},
    w AS (SELECT b.month, b.i, ABS(b.b) * SQRT(GREATEST(d.v / n - (m.v / n) * (m.v / n), 0)) AS w FROM beta AS b JOIN enough AS e ON e.month = b.month
      JOIN cells AS d ON d.month = b.month AND d.i = b.i AND d.j = b.i JOIN cells AS m ON m.month = b.month AND m.i = 0 AND m.j = b.i WHERE b.i > 0)
    SELECT month, [{', '.join(f"'{n}'" for n in FACTORS)}][i] AS factor, R6(w / SUM(w) OVER (PARTITION BY month)) AS importance FROM w""")
def ml_importances(spark, d):
    return rankmodel.importances(model(spark, d)[1], FACTORS).withColumn("importance", rnd("importance"))


def monthly_ics(spark, d):
    rows, _ = model(spark, d)
    ics = research.information_coefficients(rows, "prediction", [21])
    return ics.join(xs.month_starts(Market(spark, d).bars()), "ts", "left_semi")


ROLL = "CASE WHEN COUNT(ic) OVER w >= 3 THEN AVG(ic) OVER w ELSE 0 END"
KNOWN = "FROM ics WHERE ic IS NOT NULL AND NOT ISNAN(ic) WINDOW w AS (ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


@query("rolling_ic", f"WITH RECURSIVE {MODEL} SELECT ts, R6(ic) AS ic, n, R6({ROLL}) AS rolling_ic {KNOWN}")
def rolling_ic(spark, d):
    return research.rolling_ic(monthly_ics(spark, d)).select("ts", "n", rnd("ic").alias("ic"), rnd("rolling_ic").alias("rolling_ic"))


@query("ic_alerts", f"""WITH RECURSIVE {MODEL} SELECT 'model' AS entity, ts, 'ML_IC_DECAY' AS risk_type, 'WARNING' AS severity, R6(v) AS value
    FROM (SELECT ts, {ROLL} AS v {KNOWN}) WHERE v < 0.02 AND v <> 0""")
def ic_alerts(spark, d):
    return risk.ic_alerts(research.rolling_ic(monthly_ics(spark, d))).withColumn("value", rnd("value"))


GARCH = f"""obs AS MATERIALIZED (SELECT asset_id, ts, x, COUNT(x) {W} AS n FROM (SELECT asset_id, ts, close / LAG(close) {W} - 1 AS x FROM bars)),
    win AS MATERIALIZED (SELECT d.asset_id, d.fit, d.ts, o.ts AS t, 100 * o.x AS r FROM (SELECT asset_id, ts, n, (n - 60) // 21 AS fit FROM obs WHERE x IS NOT NULL AND n >= 60 AND (n - 60) % 21 = 0) AS d
      JOIN obs AS o ON o.asset_id = d.asset_id AND o.x IS NOT NULL AND o.n > d.n - 252 AND o.n <= d.n),
    ser AS MATERIALIZED (SELECT asset_id, fit, ts, LIST(e ORDER BY t) AS es, VAR_POP(e) AS v, COUNT(*) AS n_obs FROM (SELECT *, r - AVG(r) OVER (PARTITION BY asset_id, fit) AS e FROM win) GROUP BY 1, 2, 3),
    grid AS MATERIALIZED (SELECT s.*, a, b, v * (1 - a - b) AS w FROM ser AS s, (VALUES {', '.join(f'({a}::DOUBLE)' for a in ALPHAS)}) AS p(a), (VALUES {', '.join(f'({b}::DOUBLE)' for b in BETAS)}) AS q(b) WHERE a + b < 1),
    run AS MATERIALIZED (SELECT asset_id, fit, ts, n_obs, a, b, w, LIST_REDUCE(LIST_TRANSFORM(es, LAMBDA x: {{'h': x, 'll': 0.0::DOUBLE}}), LAMBDA acc, x: {{'h': w + a * x.h * x.h + b * acc.h, 'll': acc.ll - 0.5 * (LN(acc.h) + x.h * x.h / acc.h)}}, {{'h': v, 'll': 0.0::DOUBLE}}) AS r FROM grid),
    best AS MATERIALIZED (SELECT *, GREATEST(0.01, LEAST(5.0, SQRT(r.h) * SQRT(252) / 100)) AS vol FROM run QUALIFY ROW_NUMBER() OVER (PARTITION BY asset_id, fit ORDER BY R9(r.ll) DESC, a, b) = 1),
    fc AS MATERIALIZED (SELECT o.asset_id, o.ts, o.n AS n_obs, CASE WHEN n >= 60 THEN 'garch' WHEN n > 5 THEN 'realized' ELSE 'default' END AS source,
      CASE WHEN n >= 60 THEN g.vol WHEN n > 5 THEN sd * SQRT(252) ELSE 0.2 END AS vol
      FROM (SELECT *, STDDEV_POP(x) {over(30)} AS sd FROM obs) AS o LEFT JOIN best AS g ON g.asset_id = o.asset_id AND o.n >= 60 AND g.fit = (o.n - 60) // 21)"""


@query("garch_fits", f"""WITH {GARCH} SELECT asset_id, ts, n_obs, a AS alpha, b AS beta, R6(w) AS omega, R4(r.ll) AS log_likelihood, R6(vol) AS vol, R6(SQRT(w / (1 - a - b)) * SQRT(252) / 100) AS long_run_vol FROM best""")
def garch_fits(spark, d):
    return garch.fits(Market(spark, d).bars()).select("asset_id", "ts", "n_obs", "alpha", "beta", rnd("omega").alias("omega"), rnd("log_likelihood", 4).alias("log_likelihood"),
                                                      rnd("vol").alias("vol"), rnd("long_run_vol").alias("long_run_vol"))


@query("vol_fallback", f"WITH {GARCH} SELECT asset_id, ts, n_obs, source, R6(vol) AS vol FROM fc")
def vol_fallback(spark, d):
    return garch.forecasts(Market(spark, d).bars()).withColumn("vol", rnd("vol"))


@query("naive_portfolio_vol", f"""{WITH_CAND}, {GARCH} SELECT portfolio_id, R6(SQRT(SUM(weight * weight * v * v))) AS vol FROM cand
    JOIN (SELECT asset_id, ARG_MAX(vol, ts) AS v FROM fc GROUP BY 1) USING (asset_id) GROUP BY 1""")
def naive_portfolio_vol(spark, d):
    m = Market(spark, d)
    vols = garch.forecasts(m.bars()).groupBy("asset_id").agg(F.max_by("vol", "ts").alias("vol"))
    return weights.naive_vol(candidates(m), vols).select("portfolio_id", rnd("vol").alias("vol"))


@query("vol_spike_alerts", f"""WITH RECURSIVE {GARCH}, v AS MATERIALIZED (SELECT asset_id, ts, vol, ROW_NUMBER() {W} AS rn FROM fc),
    s AS (SELECT asset_id, ts, rn, vol, NULL::DOUBLE AS prev, vol AS base FROM v WHERE rn = 1 UNION ALL
      SELECT v.asset_id, v.ts, v.rn, v.vol, s.base, CASE WHEN v.vol > s.base * 2 THEN s.base ELSE 0.98::DOUBLE * s.base + 0.02::DOUBLE * v.vol END FROM s JOIN v ON v.asset_id = s.asset_id AND v.rn = s.rn + 1)
    SELECT asset_id AS entity, ts, 'VOLATILITY_SPIKE' AS risk_type, 'WARNING' AS severity, R6(vol / prev) AS value FROM s WHERE vol > prev * 2""")
def vol_spike_alerts(spark, d):
    vols = garch.forecasts(Market(spark, d).bars()).select("asset_id", "ts", "vol")
    return risk.vol_spike_alerts(vols).withColumn("value", rnd("value"))
