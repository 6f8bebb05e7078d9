"""Ensembles, pairwise matrices and weights."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.catalog.registry import query
from marketframe.catalog.sqltext import W, over, roll
from marketframe.functions.stats import rnd
from marketframe.operators import ensemble, matrix, volatility as vol, weights
from marketframe.operators.windows import log_return, pct_change
from marketframe.sources.market import Market

VOTES = """(SELECT *, CAST(ts AS DATE) AS day FROM signals QUALIFY ROW_NUMBER() OVER (PARTITION BY asset_id, CAST(ts AS DATE), strategy_id ORDER BY ts DESC, event_id DESC) = 1)"""
NUM = "CASE direction WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN -1 ELSE 0 END"


def votes(spark, d):
    return ensemble.latest_per_day(Market(spark, d).signals())


@query("vote_majority", f"""SELECT asset_id, day, n, CASE WHEN l >= s AND l >= f THEN 'LONG' WHEN s >= f THEN 'SHORT' ELSE 'FLAT' END AS direction,
      R6(GREATEST(l, s, f) / n) AS confidence, R6((l - s) / n) AS net_score FROM (
    SELECT asset_id, day, COUNT(*) AS n, COUNT(CASE WHEN direction = 'LONG' THEN 1 END) AS l, COUNT(CASE WHEN direction = 'SHORT' THEN 1 END) AS s,
           COUNT(CASE WHEN direction = 'FLAT' THEN 1 END) AS f FROM {VOTES} GROUP BY 1, 2)""")
def vote_majority(spark, d):
    return ensemble.majority(votes(spark, d)).select("asset_id", "day", "n", "direction", rnd("confidence").alias("confidence"), rnd("net_score").alias("net_score"))


def weighted_sql(source):
    return f"""SELECT asset_id, day, n, CASE WHEN R9(s) > 0.25 THEN 'LONG' WHEN R9(s) < -0.25 THEN 'SHORT' ELSE 'FLAT' END AS direction, R6(LEAST(1, ABS(s))) AS confidence, R6(s) AS net_score FROM (
      SELECT asset_id, day, COUNT(*) AS n, SUM(confidence * {NUM}) / CASE WHEN SUM(confidence) = 0 THEN COUNT(*) ELSE SUM(confidence) END AS s FROM {source} GROUP BY 1, 2)"""


@query("vote_weighted", weighted_sql(VOTES))
def vote_weighted(spark, d):
    return ensemble.weighted(votes(spark, d)).select("asset_id", "day", "n", "direction", rnd("confidence").alias("confidence"), rnd("net_score").alias("net_score"))


@query("vote_orthogonal", weighted_sql(f"(SELECT asset_id, day, signal_type, direction, AVG(confidence) AS confidence FROM {VOTES} GROUP BY 1, 2, 3, 4)"))
def vote_orthogonal(spark, d):
    return ensemble.orthogonal(votes(spark, d)).select("asset_id", "day", "n", "direction", rnd("confidence").alias("confidence"), rnd("net_score").alias("net_score"))


@query("vote_breakdown", f"""SELECT asset_id, day, STRING_AGG(strategy_id, ',' ORDER BY strategy_id) AS contributors,
    STRING_AGG(CONCAT(strategy_id, '=', direction), ',' ORDER BY strategy_id) AS votes FROM {VOTES} GROUP BY 1, 2 HAVING COUNT(*) >= 2""")
def vote_breakdown(spark, d):
    df = ensemble.breakdown(votes(spark, d))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("votes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return df.select("asset_id", "day", "contributors", flat.alias("votes"))


RETS = f"(SELECT asset_id, ts, close / LAG(close) {W} - 1 AS ret FROM bars)"
COV = f"""(SELECT a.asset_id AS asset_i, b.asset_id AS asset_j, COUNT(*) AS n, COVAR_SAMP(a.ret, b.ret) AS cov, CORR(a.ret, b.ret) AS corr
    FROM {RETS} AS a JOIN {RETS} AS b ON a.ts = b.ts AND a.asset_id <= b.asset_id WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 2)"""
FULL = f"(SELECT asset_i, asset_j, cov FROM {COV} UNION ALL SELECT asset_j, asset_i, cov FROM {COV} WHERE asset_i <> asset_j)"


def rets(m):
    return m.bars().select("asset_id", "ts", pct_change("close").alias("ret"))


@query("cov_matrix", f"SELECT asset_i, asset_j, n, R8(cov) AS cov, R6(corr) AS corr FROM {COV}")
def cov_matrix(spark, d):
    return matrix.covariance(rets(Market(spark, d))).select("asset_i", "asset_j", "n", rnd("cov", 8).alias("cov"), rnd("corr").alias("corr"))


@query("correlated_pairs", """WITH r AS MATERIALIZED (SELECT * FROM (
      SELECT portfolio_id, k, (equity - LEAD(equity) OVER w) / (LEAD(equity) OVER w + 1e-10) AS ret FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY portfolio_id ORDER BY ts DESC) AS k FROM equity_curves) WHERE k <= 60 WINDOW w AS (PARTITION BY portfolio_id ORDER BY k)) WHERE ret IS NOT NULL)
    SELECT a.portfolio_id AS strategy_a, b.portfolio_id AS strategy_b, R6(CORR(a.ret, b.ret)) AS corr FROM r AS a JOIN r AS b ON a.k = b.k AND a.portfolio_id < b.portfolio_id
    GROUP BY 1, 2 HAVING COUNT(*) >= 10 AND ABS(CORR(a.ret, b.ret)) >= 0.25""")
def correlated_pairs(spark, d):
    return matrix.correlated_pairs(Market(spark, d).equity_curves(), "portfolio_id", 60, 0.25).select(
        F.col("asset_i").alias("strategy_a"), F.col("asset_j").alias("strategy_b"), rnd("corr").alias("corr"))


def _universe(m):
    return m.bars().select("asset_id").distinct()


CAND = """(SELECT CAST(p.k AS BIGINT) AS portfolio_id, a.asset_id, v / SUM(v) OVER (PARTITION BY p.k) AS weight
    FROM (SELECT UNNEST(RANGE(0, 40)) AS k) AS p, (SELECT DISTINCT asset_id FROM bars) AS a, LATERAL (SELECT 1 + (k * 7 + CAST(SUBSTR(a.asset_id, 7) AS BIGINT) * 13) % 17 + CASE WHEN CAST(SUBSTR(a.asset_id, 7) AS BIGINT) % 5 = k % 5 THEN 20 ELSE 0 END AS v))"""


def candidates(m):
    """Forty deterministic long-only weight vectors over the universe."""
    from pyspark.sql import Window
    df = _universe(m).withColumn("portfolio_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))))
    num, k = F.substring("asset_id", 7, 10).cast("long"), F.col("portfolio_id")
    v = 1 + (k * 7 + num * 13) % 17 + F.when(num % 5 == k % 5, 20).otherwise(0)
    return df.withColumn("_v", v).withColumn("weight", F.col("_v") / F.sum("_v").over(Window.partitionBy("portfolio_id"))).drop("_v")


PAIRS = f"(SELECT wi.portfolio_id, wi.asset_id, wi.weight * wj.weight * cov AS rc FROM cand AS wi JOIN {FULL} AS c ON c.asset_i = wi.asset_id JOIN cand AS wj ON wj.asset_id = c.asset_j AND wj.portfolio_id = wi.portfolio_id)"
WITH_CAND = f"WITH cand AS MATERIALIZED (SELECT * FROM {CAND})"


@query("weight_hhi_vol", f"""{WITH_CAND} SELECT h.portfolio_id, R6(hhi) AS hhi, R6(SQRT(v * 252)) AS vol FROM (SELECT portfolio_id, SUM(weight * weight) AS hhi FROM cand GROUP BY 1) AS h
    JOIN (SELECT portfolio_id, SUM(rc) AS v FROM {PAIRS} GROUP BY 1) AS p ON p.portfolio_id = h.portfolio_id""")
def weight_hhi_vol(spark, d):
    m = Market(spark, d)
    df = weights.concentration_and_vol(candidates(m), matrix.covariance(rets(m)))
    return df.select("portfolio_id", rnd("hhi").alias("hhi"), rnd("vol").alias("vol"))


@query("risk_contribution", f"""{WITH_CAND} SELECT portfolio_id, asset_id, R6(rc / SUM(rc) OVER (PARTITION BY portfolio_id)) AS contribution
    FROM (SELECT portfolio_id, asset_id, SUM(rc) AS rc FROM {PAIRS} GROUP BY 1, 2)""")
def risk_contribution(spark, d):
    m = Market(spark, d)
    df = weights.risk_contribution(candidates(m), matrix.covariance(rets(m)))
    return df.select("portfolio_id", "asset_id", rnd("contribution").alias("contribution"))


@query("frontier_candidates", f"""{WITH_CAND} SELECT CAST(bucket AS BIGINT) AS bucket, portfolio_id, R6(ret) AS ret, R6(vol) AS vol, R6((ret - 0.05) / vol) AS sharpe FROM (
      SELECT r.portfolio_id, ret, SQRT(v * 252) AS vol, FLOOR(ret / 0.01) AS bucket FROM (
        SELECT portfolio_id, SUM(weight * mu) * 252 AS ret FROM cand JOIN (SELECT asset_id, AVG(ret) AS mu FROM {RETS} GROUP BY 1) AS m USING (asset_id) GROUP BY 1) AS r
      JOIN (SELECT portfolio_id, SUM(rc) AS v FROM {PAIRS} GROUP BY 1) AS p ON p.portfolio_id = r.portfolio_id)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY bucket ORDER BY ROUND(vol, 9), portfolio_id) = 1""")
def frontier_candidates(spark, d):
    m = Market(spark, d)
    r = rets(m)
    df = weights.frontier(candidates(m), r.groupBy("asset_id").agg(F.avg("ret").alias("mean")), matrix.covariance(r), 0.01)
    return df.select("bucket", "portfolio_id", *[rnd(c).alias(c) for c in ("ret", "vol", "sharpe")])


@query("top_allocations", f"""{WITH_CAND} SELECT portfolio_id, asset_id, R6(weight) AS weight, k AS rank FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY portfolio_id ORDER BY ROUND(weight, 9) DESC, asset_id) AS k FROM cand) WHERE k <= 3""")
def top_allocations(spark, d):
    return weights.top_allocations(candidates(Market(spark, d)), "portfolio_id").select(
        "portfolio_id", "asset_id", rnd("weight").alias("weight"), F.col("rank").cast("long").alias("rank"))


@query("target_quantities", f"""{WITH_CAND} SELECT portfolio_id, asset_id, CAST(GREATEST(1, FLOOR(100000 * weight / px)) AS BIGINT) AS quantity FROM cand
    JOIN (SELECT asset_id, ARG_MAX(close, ts) AS px FROM bars GROUP BY 1) USING (asset_id)""")
def target_quantities(spark, d):
    m = Market(spark, d)
    last = m.bars().groupBy("asset_id").agg(F.max_by("close", "ts").alias("price"))
    return weights.target_quantities(candidates(m).join(last, "asset_id"), 100_000.0).select("portfolio_id", "asset_id", "quantity")


@query("inverse_variance_weights", f"""SELECT CAST(year AS BIGINT) AS year, asset_id, R6(iv / SUM(iv) OVER (PARTITION BY year)) AS weight FROM (
    SELECT YEAR(ts) AS year, asset_id, 1 / (VAR_SAMP(ret) + 1e-10) AS iv FROM {RETS} GROUP BY 1, 2 HAVING VAR_SAMP(ret) IS NOT NULL)""")
def inverse_variance_weights(spark, d):
    r = rets(Market(spark, d)).withColumn("year", F.year("ts").cast("long"))
    return weights.inverse_variance(r, ["year"]).select("year", "asset_id", rnd("weight").alias("weight"))


@query("equal_weights", "SELECT ts, asset_id, R9(1.0::DOUBLE / COUNT(*) OVER (PARTITION BY ts)) AS weight FROM bars")
def equal_weights(spark, d):
    return weights.equal_weights(Market(spark, d).bars(), ["ts"]).select("ts", "asset_id", rnd("weight", 9).alias("weight"))


def shrunk_sql(method: str) -> str:
    lw = "LEAST((q4 / t - fro) / (p * t), (fro - p * mu * mu) / p) / ((fro - p * mu * mu) / p)"
    oas = "LEAST(1.0, (fro / (p * p) + mu * mu) / ((t + 1) * (fro / (p * p) - mu * mu / p)))"
    return f"""WITH r AS MATERIALIZED (SELECT asset_id, DATE_TRUNC('month', ts) AS ts, SUM(ret) AS ret FROM {RETS} WHERE ret IS NOT NULL GROUP BY 1, 2),
      c AS MATERIALIZED (SELECT asset_id, ts, ret - AVG(ret) OVER (PARTITION BY asset_id) AS x FROM (
        SELECT *, COUNT(*) OVER (PARTITION BY ts) AS k FROM r) WHERE k = (SELECT COUNT(DISTINCT asset_id) FROM r)),
      s AS MATERIALIZED (SELECT a.asset_id AS asset_i, b.asset_id AS asset_j, AVG(a.x * b.x) AS s FROM c AS a JOIN c AS b ON a.ts = b.ts GROUP BY 1, 2),
      g AS MATERIALIZED (SELECT *, tr / p AS mu FROM (SELECT SUM(CASE WHEN asset_i = asset_j THEN s END) AS tr, SUM(s * s) AS fro, COUNT(DISTINCT asset_i)::DOUBLE AS p FROM s),
        (SELECT SUM(q * q) AS q4, COUNT(*)::DOUBLE AS t FROM (SELECT ts, SUM(x * x) AS q FROM c GROUP BY 1)))
      SELECT '{method}' AS method, asset_i, asset_j, R6(h) AS shrinkage, R8((1 - h) * s + CASE WHEN asset_i = asset_j THEN h * mu ELSE 0 END) AS cov
      FROM s, (SELECT mu, {lw if method == 'ledoit_wolf' else oas} AS h FROM g) WHERE asset_i <= asset_j"""


def _monthly(m):
    return rets(m).where("ret IS NOT NULL").groupBy("asset_id", F.trunc("ts", "month").alias("ts")).agg(F.sum("ret").alias("ret"))


@query("cov_shrunk", shrunk_sql("ledoit_wolf"))
def cov_shrunk(spark, d):
    return matrix.shrunk(_monthly(Market(spark, d))).select(
        F.lit("ledoit_wolf").alias("method"), "asset_i", "asset_j", rnd("shrinkage").alias("shrinkage"), rnd("cov", 8).alias("cov"))


@query("cov_shrunk_oas", shrunk_sql("oas"))
def cov_shrunk_oas(spark, d):
    return matrix.shrunk(_monthly(Market(spark, d)), method="oas").select(
        F.lit("oas").alias("method"), "asset_i", "asset_j", rnd("shrinkage").alias("shrinkage"), rnd("cov", 8).alias("cov"))


SIZERS = ("fixed_fraction", "vol_target", "half_kelly", "equal_weight")


@query("position_sizes", f"""SELECT asset_id, ts, CAST(GREATEST(1, FLOOR(LEAST(100000 * c * 0.02, 10000) / close)) AS BIGINT) AS fixed_fraction,
      CAST(CASE WHEN v > 0 THEN GREATEST(1, FLOOR(LEAST(0.01 / v * 100000 * c, 15000) / close)) ELSE 0 END AS BIGINT) AS vol_target,
      CAST(GREATEST(1, FLOOR(LEAST(100000 * c * 0.125::DOUBLE, 20000) / close)) AS BIGINT) AS half_kelly,
      CAST(GREATEST(1, FLOOR(LEAST(100000 * c / 20, 10000) / close)) AS BIGINT) AS equal_weight
    FROM (SELECT asset_id, ts, close, (volume % 100) / 100.0::DOUBLE + 0.003::DOUBLE AS c, COALESCE({roll('STDDEV_SAMP', 'lr', 30)} * SQRT(252), 0.2) AS v FROM (SELECT *, LN(close / LAG(close) {W}) AS lr FROM bars))""")
def position_sizes(spark, d):
    df = vol.with_log_return(Market(spark, d).bars()).withColumns({"v": vol.realized_vol(), "c": (F.col("volume") % 100) / 100.0 + 0.003})
    return df.select("asset_id", "ts", *[weights.position_size(s, F.lit(100_000.0), F.col("c"), F.col("close"), F.col("v")).cast("long").alias(s) for s in SIZERS])


@query("hrp_weights")
def hrp_weights(spark, d):
    return weights.hrp_weights(rets(Market(spark, d)))


VIEWS = [({"Brand#11": 1.0, "Brand#23": -1.0}, 0.05 / 252, 0.7), ({"Brand#45": 1.0}, 0.10 / 252, 0.5)]
LEGS = ", ".join(f"({k}, '{a}', {w}::DOUBLE)" for k, (legs, _, _) in enumerate(VIEWS) for a, w in legs.items())


@query("black_litterman_weights", f"""WITH RECURSIVE r AS MATERIALIZED (SELECT asset_id, ts, close / LAG(close) {W} - 1 AS ret, close * volume AS dv FROM bars),
    win AS MATERIALIZED (SELECT * FROM (SELECT asset_id, ts, ret, dv, CAST(DATE_TRUNC('month', ts) + k * INTERVAL 1 MONTH AS DATE) AS reb FROM r, (SELECT UNNEST(RANGE(1, 13)) AS k))
      WHERE reb <= (SELECT DATE_TRUNC('month', MAX(ts)) FROM r WHERE ret IS NOT NULL)),
    ok AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY reb ORDER BY asset_id) - 1 AS i, COUNT(*) OVER (PARTITION BY reb) AS p, dv / SUM(dv) OVER (PARTITION BY reb) AS w
      FROM (SELECT reb, asset_id, AVG(ret) AS m, SUM(dv) AS dv FROM win GROUP BY 1, 2 HAVING COUNT(ret) >= 20) QUALIFY p >= 2),
    x AS MATERIALIZED (SELECT reb, ts, asset_id, ret - m AS x FROM win JOIN ok USING (reb, asset_id) WHERE ret IS NOT NULL),
    days AS (SELECT reb, COUNT(DISTINCT ts)::DOUBLE AS t FROM win WHERE ret IS NOT NULL GROUP BY 1),
    s AS MATERIALIZED (SELECT a.reb, a.asset_id AS ai, b.asset_id AS aj, a.i, b.i AS j, a.p, COALESCE(q.v, 0) / t AS s FROM ok AS a JOIN ok AS b ON b.reb = a.reb JOIN days ON days.reb = a.reb
      LEFT JOIN (SELECT y.reb, y.asset_id AS ai, z.asset_id AS aj, SUM(y.x * z.x) AS v FROM x AS y JOIN x AS z ON z.reb = y.reb AND z.ts = y.ts GROUP BY 1, 2, 3) AS q ON q.reb = a.reb AND q.ai = a.asset_id AND q.aj = b.asset_id),
    sh AS (SELECT reb, mu, LEAST((q4 / t - fro) / (p * t), (fro - p * mu * mu) / p) / ((fro - p * mu * mu) / p) AS h FROM (SELECT reb, SUM(CASE WHEN i = j THEN s END) / MAX(p) AS mu, SUM(s * s) AS fro, MAX(p)::DOUBLE AS p FROM s GROUP BY 1)
      JOIN (SELECT reb, SUM(q * q) AS q4 FROM (SELECT reb, ts, SUM(x * x) AS q FROM x GROUP BY 1, 2) GROUP BY 1) USING (reb) JOIN days USING (reb)),
    cv AS MATERIALIZED (SELECT s.reb, ai, aj, i, j, p, (1 - h) * s + CASE WHEN i = j THEN h * mu ELSE 0 END AS c FROM s JOIN sh USING (reb)),
    lg AS MATERIALIZED (SELECT reb, k, asset_id, l.w / SUM(ABS(l.w)) OVER (PARTITION BY reb, k) AS l FROM (VALUES {LEGS}) AS l(k, asset_id, w) JOIN ok USING (asset_id)),
    ld AS MATERIALIZED (SELECT cv.reb, k, ai, 0.025::DOUBLE * SUM(c * l) AS v FROM cv JOIN lg ON lg.reb = cv.reb AND lg.asset_id = cv.aj GROUP BY 1, 2, 3),
    sp AS MATERIALIZED (SELECT lg.reb, lg.k, ld.k AS m, SUM(l * v) AS v FROM lg JOIN ld ON ld.reb = lg.reb AND ld.ai = lg.asset_id GROUP BY 1, 2, 3),
    eq AS MATERIALIZED (SELECT cv.reb, ai, 2.5::DOUBLE * SUM(c * w) AS e FROM cv JOIN ok ON ok.reb = cv.reb AND ok.asset_id = cv.aj GROUP BY 1, 2),
    rs AS (SELECT lg.reb, k, CASE k WHEN 0 THEN {VIEWS[0][1]!r}::DOUBLE ELSE {VIEWS[1][1]!r}::DOUBLE END - SUM(l * e) AS v FROM lg JOIN eq ON eq.reb = lg.reb AND eq.ai = lg.asset_id GROUP BY 1, 2),
    vw AS MATERIALIZED (SELECT o.reb, COALESCE(MAX(CASE WHEN k = 0 AND m = 0 THEN v * {2 - VIEWS[0][2]!r}::DOUBLE END), 1) AS a, COALESCE(MAX(CASE WHEN k = 1 AND m = 1 THEN v * {2 - VIEWS[1][2]!r}::DOUBLE END), 1) AS d, COALESCE(MAX(CASE WHEN k = 0 AND m = 1 THEN v END), 0) AS b
      FROM (SELECT DISTINCT reb FROM ok) AS o LEFT JOIN sp ON sp.reb = o.reb GROUP BY 1),
    rv AS (SELECT o.reb, COALESCE(MAX(CASE WHEN k = 0 THEN v END), 0) AS r0, COALESCE(MAX(CASE WHEN k = 1 THEN v END), 0) AS r1 FROM (SELECT DISTINCT reb FROM ok) AS o LEFT JOIN rs ON rs.reb = o.reb GROUP BY 1),
    lv AS MATERIALIZED (SELECT ok.reb, ok.asset_id, i, p, COALESCE(MAX(CASE WHEN k = 0 THEN v END), 0) AS x, COALESCE(MAX(CASE WHEN k = 1 THEN v END), 0) AS y FROM ok LEFT JOIN ld ON ld.reb = ok.reb AND ld.ai = ok.asset_id GROUP BY 1, 2, 3, 4),
    sys AS (SELECT cv.reb, cv.i, cv.j, cv.p, 1.025::DOUBLE * c - (d * f.x * g.x - b * (f.x * g.y + f.y * g.x) + a * f.y * g.y) / (a * d - b * b) AS v FROM cv JOIN vw USING (reb) JOIN lv AS f ON f.reb = cv.reb AND f.i = cv.i JOIN lv AS g ON g.reb = cv.reb AND g.i = cv.j
      UNION ALL SELECT lv.reb, lv.i, lv.p, lv.p, e + x * (d * r0 - b * r1) / (a * d - b * b) + y * (a * r1 - b * r0) / (a * d - b * b) FROM lv JOIN eq ON eq.reb = lv.reb AND eq.ai = lv.asset_id JOIN vw ON vw.reb = lv.reb JOIN rv ON rv.reb = lv.reb),
    gj AS (SELECT reb, i, j, p, v, 0 AS k FROM sys UNION ALL SELECT reb, i, j, p, CASE WHEN i = k THEN v / pv ELSE v - vi * vj / pv END, k + 1 FROM (
        SELECT *, MAX(CASE WHEN j = k THEN v END) OVER (PARTITION BY reb, i) AS vi, MAX(CASE WHEN i = k THEN v END) OVER (PARTITION BY reb, j) AS vj, MAX(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY reb) AS pv FROM gj) WHERE k < p),
    best AS (SELECT reb, i, LEAST(GREATEST(v / 2.5, 0), 0.30) AS v FROM gj WHERE k = p AND j = p)
    SELECT reb AS rebalance, asset_id, R6(CASE WHEN SUM(v) OVER (PARTITION BY reb) > 0 THEN v / SUM(v) OVER (PARTITION BY reb) ELSE 1.0 / p END) AS weight FROM best JOIN ok USING (reb, i)""")
def black_litterman_weights(spark, d):
    m = Market(spark, d)
    panel = m.bars().select("asset_id", "ts", pct_change("close").alias("ret"), (F.col("close") * F.col("volume")).alias("dv"))
    return weights.black_litterman_weights(panel, VIEWS, size="dv").withColumn("weight", rnd("weight"))


@query("turbulence")
def turbulence(spark, d):
    return weights.turbulence(rets(Market(spark, d)))
