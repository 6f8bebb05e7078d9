"""Volatility, option chains and screens."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.catalog.registry import query
from marketframe.catalog.sqltext import W, over, roll
from marketframe.functions import options as opt
from marketframe.functions.stats import norm_cdf, norm_ppf, rnd
from marketframe.operators import chains, holdings, volatility as vol
from marketframe.operators.windows import pct_change
from marketframe.sources.market import Market

LR = f"SELECT *, LN(close / LAG(close) {W}) AS lr FROM bars"
MONTHLY_BARS = "(SELECT * FROM bars QUALIFY ROW_NUMBER() OVER (PARTITION BY asset_id, DATE_TRUNC('month', ts) ORDER BY ts) = 1)"


@query("realized_vol", f"SELECT asset_id, ts, R6(COALESCE({roll('STDDEV_SAMP', 'lr', 30)} * SQRT(252), 0.2)) AS vol FROM ({LR})")
def realized_vol(spark, d):
    return vol.with_log_return(Market(spark, d).bars()).select("asset_id", "ts", rnd(vol.realized_vol()).alias("vol"))


@query("vol_target_leverage", f"""SELECT asset_id, ts, R6(GREATEST(0.25, LEAST(2.0, 0.10 / GREATEST(v, 0.01)))) AS leverage
    FROM (SELECT asset_id, ts, COALESCE({roll('STDDEV_SAMP', 'lr', 30)} * SQRT(252), 0.2) AS v FROM ({LR}))""")
def vol_target_leverage(spark, d):
    df = vol.with_log_return(Market(spark, d).bars()).withColumn("vol", vol.realized_vol())
    return df.select("asset_id", "ts", rnd(vol.leverage(F.col("vol"))).alias("leverage"))


VIX = f"""(SELECT b.*, m.value AS vix, LN(close / LAG(close) {W.replace('asset_id', 'b.asset_id').replace('ts', 'b.ts')}) AS lr
    FROM (SELECT *, '1-URGENT' AS series_id FROM bars) AS b ASOF LEFT JOIN macro_series AS m ON b.series_id = m.series_id AND b.ts >= m.release_date)"""


@query("iv_estimate", f"""SELECT asset_id, ts, R6(CASE WHEN flat IS NOT NULL THEN GREATEST(0.05, LEAST(3.0, flat * 1.15)) END) AS iv_flat,
      R6(CASE WHEN flat * q IS NOT NULL AND vix IS NOT NULL THEN GREATEST(0.05, LEAST(3.0, flat * q)) END) AS iv_vix FROM (
    SELECT *, rv AS flat, GREATEST(0.5, LEAST(3.0, vix / 100.0 / GREATEST(rv20, 0.05))) AS q FROM (
      SELECT *, {roll('STDDEV_SAMP', 'lr', 30)} * SQRT(252) AS rv, {roll('STDDEV_SAMP', 'lr', 20)} * SQRT(252) AS rv20 FROM {VIX}))""")
def iv_estimate(spark, d):
    m = Market(spark, d)
    df = vol.with_exogenous(m.bars(), m.macro_series(), "1-URGENT")
    df = vol.iv_estimate(df).withColumnRenamed("iv", "iv_flat").drop("lr")
    df = vol.iv_estimate(df, "vix").withColumnRenamed("iv", "iv_vix")
    return df.select("asset_id", "ts", rnd("iv_flat").alias("iv_flat"), rnd("iv_vix").alias("iv_vix"))


IV = f"SELECT asset_id, ts, close, GREATEST(0.05, LEAST(3.0, {roll('STDDEV_SAMP', 'lr', 30)} * SQRT(252) * 1.15)) AS iv FROM ({LR})"
IV_RANK = f"""SELECT asset_id, ts, close, iv, CASE WHEN hi = lo THEN 0.5 ELSE GREATEST(0, LEAST(1, (iv - lo) / (hi - lo))) END AS iv_rank,
      CASE WHEN hi = lo THEN 0.5 ELSE LEN(LIST_FILTER(xs, LAMBDA x: x < iv)) / LEN(xs) END AS iv_percentile FROM (
    SELECT *, MIN(iv) {over(252)} AS lo, MAX(iv) {over(252)} AS hi, LIST(iv) {over(252)} AS xs
    FROM (SELECT *, iv AS raw_iv FROM (SELECT asset_id, ts, close, R9(GREATEST(0.05, LEAST(3.0, iv))) AS iv FROM (
      SELECT asset_id, ts, close, {roll('STDDEV_SAMP', 'lr', 30)} * SQRT(252) * 1.15 AS iv FROM ({LR})) WHERE iv IS NOT NULL)))"""


def iv_table(m):
    df = vol.iv_estimate(m.bars())
    return df.withColumn("iv", rnd("iv", 9)).select("asset_id", "ts", "close", "iv")


@query("iv_rank", f"SELECT asset_id, ts, R6(iv_rank) AS iv_rank, R6(iv_percentile) AS iv_percentile FROM ({IV_RANK})")
def iv_rank(spark, d):
    return vol.iv_rank(iv_table(Market(spark, d))).select(
        "asset_id", "ts", rnd("iv_rank").alias("iv_rank"), rnd("iv_percentile").alias("iv_percentile"))


@query("vix_regime", f"""SELECT asset_id, ts, R6(a) AS avg20, regime, CASE regime WHEN 'HIGH_VOL_EXTREME' THEN 0.0 WHEN 'HIGH_VOL' THEN 0.5 ELSE 1.0 END::DOUBLE AS multiplier,
      regime = 'HIGH_VOL_EXTREME' AND LAG(regime, 1, 'LOW_VOL') {W} <> 'HIGH_VOL_EXTREME' AS alert FROM (
    SELECT *, CASE WHEN a > 35 THEN 'HIGH_VOL_EXTREME' WHEN a > 25 THEN 'HIGH_VOL' ELSE 'LOW_VOL' END AS regime FROM (
      SELECT asset_id, ts, R8(COALESCE({roll('AVG', 'vix', 20)}, vix)) AS a FROM {VIX} WHERE vix IS NOT NULL))""")
def vix_regime(spark, d):
    m = Market(spark, d)
    df = vol.vix_regime(vol.with_exogenous(m.bars(), m.macro_series(), "1-URGENT"))
    return df.select("asset_id", "ts", rnd("avg20").alias("avg20"), "regime", "multiplier", "alert")


@query("norm_cdf", f"""SELECT asset_id, ts, R9({norm_cdf('x')}) AS cdf, R6({norm_ppf('p')}) AS ppf FROM (
    SELECT asset_id, ts, (close - open) / 2 AS x, R8(0.0001 + 0.9998 * (volume % 1000) / 1000) AS p FROM bars)""")
def norm_cdf_query(spark, d):
    df = Market(spark, d).bars().select("asset_id", "ts", ((F.col("close") - F.col("open")) / 2).alias("x"),
                                        rnd(0.0001 + 0.9998 * (F.col("volume") % 1000) / 1000, 8).alias("p"))
    return df.select("asset_id", "ts", rnd(F.expr(norm_cdf("x")), 9).alias("cdf"), rnd(F.expr(norm_ppf("p"))).alias("ppf"))


def priced_sql(source: str) -> str:
    cols = opt.cdf_columns("s", "strike", "t", "rate", "iv")
    g = ", ".join(f"{text} AS {name}" for name, text in opt.greeks("s", "strike", "t", "rate", "iv", "\"right\" = 'C'").items())
    return f"""SELECT *, {opt.price('s', 'strike', 't', 'rate', 'iv', "\"right\" = 'C'")} AS price, {g} FROM (
        SELECT *, {opt.cdf_values()['n1']} AS n1, {opt.cdf_values()['n2']} AS n2 FROM (
          SELECT *, {cols['d2']} AS d2 FROM (SELECT *, {cols['d1']} AS d1 FROM ({source}))))"""


QUOTES = """SELECT asset_id, ts, close AS s, R4(close * (0.8 + 0.4 * (volume % 21) / 20)) AS strike, (1 + volume % 90) / 365.0::DOUBLE AS t, 0.05::DOUBLE AS rate,
    0.1::DOUBLE + (volume % 37) / 100.0::DOUBLE AS iv, CASE WHEN volume % 2 = 0 THEN 'C' ELSE 'P' END AS "right" FROM bars"""
GREEKS = ["delta", "gamma", "theta", "vega", "rho"]


def quotes(m):
    v = F.col("volume")
    return m.bars().select(
        "asset_id", "ts", F.col("close").alias("s"), rnd(F.col("close") * (0.8 + 0.4 * (v % 21) / 20), 4).alias("strike"),
        ((1 + v % 90) / 365.0).alias("t"), F.lit(0.05).alias("rate"), (0.1 + (v % 37) / 100.0).alias("iv"),
        F.when(v % 2 == 0, "C").otherwise("P").alias("right"))


@query("bsm_price", f'SELECT asset_id, ts, "right", strike, R6(price) AS price FROM ({priced_sql(QUOTES)})')
def bsm_price(spark, d):
    return chains.priced(quotes(Market(spark, d))).select("asset_id", "ts", "right", "strike", rnd("price").alias("price"))


@query("bsm_greeks", f'SELECT asset_id, ts, "right", {", ".join(f"R6({g}) AS {g}" for g in GREEKS)} FROM ({priced_sql(QUOTES)})')
def bsm_greeks(spark, d):
    return chains.priced(quotes(Market(spark, d))).select("asset_id", "ts", "right", *[rnd(g).alias(g) for g in GREEKS])


CHAIN_ROWS = f"""SELECT r.*, dte, ROUND(s * (1 + (i - 10) * 0.2::DOUBLE / 10) + 1.7e-6, 2) AS strike, "right", dte / 365.0::DOUBLE AS t, r.ts + CAST(dte AS INTEGER) AS expiration
    FROM under AS r, (VALUES (21::BIGINT), (30), (45), (60), (90)) AS e(dte), (SELECT UNNEST(RANGE(0, 21)) AS i), (VALUES ('C'), ('P')) AS k("right")"""
CHAIN = f"""WITH under AS MATERIALIZED (
      SELECT asset_id, ts, close AS s, CASE WHEN value IS NULL THEN 0.05 ELSE value / 100 END::DOUBLE AS rate, iv FROM (
        SELECT v.*, m.value FROM (SELECT *, '2-HIGH' AS series_id FROM (
            SELECT asset_id, ts, close, CASE WHEN iv IS NULL THEN 0.2 ELSE R9(GREATEST(0.05, LEAST(3.0, iv))) END AS iv FROM (
              SELECT asset_id, ts, close, {roll('STDDEV_SAMP', 'lr', 30)} * SQRT(252) * 1.15 AS iv FROM ({LR})))) AS v
        ASOF LEFT JOIN macro_series AS m ON m.series_id = v.series_id AND v.ts >= m.release_date)),
    chain AS MATERIALIZED (
      SELECT *, ROUND(GREATEST(0.01, price - spread / 2) + 1.7e-6, 2) AS bid, ROUND(price + spread / 2 + 1.7e-6, 2) AS ask,
             CAST(GREATEST(10, FLOOR(1000 * ABS(delta) * (1 - mny))) AS BIGINT) AS open_interest, CAST(GREATEST(1, FLOOR(100 * ABS(delta))) AS BIGINT) AS volume FROM (
        SELECT *, ABS(LN(s / strike)) AS mny, price * GREATEST(0.05, LEAST(iv * 0.10 + ABS(LN(s / strike)) * 0.5, 0.5)) AS spread
        FROM ({priced_sql(CHAIN_ROWS)})) WHERE price >= 0.01)"""


def full_chain(m):
    """Chains on every bar with the short rate known at that date (5 % before the first release); volatility 0.20 while history is short."""
    rates = vol.with_exogenous(iv_table(m).withColumn("iv", F.coalesce("iv", F.lit(0.2))), m.macro_series(), "2-HIGH", "rate_pct")
    rate = F.coalesce(F.col("rate_pct") / 100, F.lit(0.05))
    return chains.generate_chain(rates.select("asset_id", "ts", F.col("close").alias("s"), rate.alias("rate"), "iv"))


# quoted interest and volume of the generated chain stay below 1,000 and 100; a depth by strike lets some contracts exceed the limits
DEPTH = "(1 + CAST(FLOOR(strike) AS BIGINT) % 5)"


def deep(chain):
    depth = 1 + F.floor("strike") % 5
    return chain.withColumns({"open_interest": F.col("open_interest") * depth, "volume": F.col("volume") * depth})


@query("option_chain", f"""{CHAIN} SELECT asset_id, ts, dte, expiration, "right", strike, bid, ask, open_interest, volume, R6(price) AS price, {', '.join(f'R6({g}) AS {g}' for g in GREEKS)} FROM chain""")
def option_chain(spark, d):
    return full_chain(Market(spark, d)).select(
        "asset_id", "ts", "dte", "expiration", "right", "strike", "bid", "ask", "open_interest", "volume",
        rnd("price").alias("price"), *[rnd(g).alias(g) for g in GREEKS])


SPREAD = "(CASE WHEN bid + ask = 0 THEN 1.0 ELSE (ask - bid) / ((bid + ask) / 2) END)"


@query("option_mid_spread", f'{CHAIN} SELECT asset_id, ts, dte, "right", strike, R6((bid + ask) / 2) AS mid, R6({SPREAD}) AS spread_pct FROM chain')
def option_mid_spread(spark, d):
    return full_chain(Market(spark, d)).select("asset_id", "ts", "dte", "right", "strike", rnd(chains.mid()).alias("mid"),
                                                  rnd(chains.spread_pct()).alias("spread_pct"))


@query("liquid_options", f"""{CHAIN} SELECT asset_id, ts, dte, "right", strike, bid, ask, open_interest * {DEPTH} AS open_interest FROM chain
    WHERE open_interest * {DEPTH} > 1000 AND volume * {DEPTH} > 100 AND R9({SPREAD}) < 0.15""")
def liquid_options(spark, d):
    chain = deep(full_chain(Market(spark, d))).withColumn("_s", rnd(chains.spread_pct(), 9))
    return chain.where("open_interest > 1000 AND volume > 100 AND _s < 0.15").select(
        "asset_id", "ts", "dte", "right", "strike", "bid", "ask", "open_interest")


@query("occ_symbol", f"""{CHAIN} SELECT CONCAT(UPPER(REPLACE(asset_id, 'Brand#', 'B')), STRFTIME(expiration, '%y%m%d'), "right", LPAD(CAST(CAST(FLOOR(strike * 1000 + 1e-6) AS BIGINT) AS VARCHAR), 8, '0')) AS symbol, ts FROM chain""")
def occ_symbol(spark, d):
    root = F.upper(F.regexp_replace("asset_id", "Brand#", "B"))
    return full_chain(Market(spark, d)).select(chains.occ_symbol(root).alias("symbol"), "ts")


def nearest_sql(target: float, right: str) -> str:
    return f"""(SELECT * FROM chain WHERE "right" = '{right}' QUALIFY ROW_NUMBER() OVER (PARTITION BY asset_id, ts ORDER BY ROUND(ABS(delta - ({target})), 9), dte, strike) = 1)"""


@query("option_by_delta", f"""{CHAIN} SELECT asset_id, ts, "right", dte, strike, bid, R6(delta) AS delta FROM (SELECT * FROM {nearest_sql(0.3, 'C')} UNION ALL SELECT * FROM {nearest_sql(-0.3, 'P')})""")
def option_by_delta(spark, d):
    cols = ["right", "dte", "strike", "bid", "delta"]
    both = chains.nearest_each(full_chain(Market(spark, d)), {"c": (0.3, "C"), "p": (-0.3, "P")}, cols)
    return both.select("asset_id", "ts", F.explode(F.filter(F.array("c", "p"), lambda x: x.isNotNull())).alias("_x")).select("asset_id", "ts", "_x.*").withColumn("delta", rnd("delta"))


@query("expected_move", f"""{CHAIN} SELECT c.asset_id, c.ts, R6((c.bid + c.ask + p.bid + p.ask) / 2) AS expected_move, R6(c.ask + p.ask) AS entry_cost
    FROM {nearest_sql(0.5, 'C')} AS c JOIN {nearest_sql(-0.5, 'P')} AS p ON p.asset_id = c.asset_id AND p.ts = c.ts""")
def expected_move(spark, d):
    df = chains.expected_move(full_chain(Market(spark, d)))
    return df.select("asset_id", "ts", rnd("expected_move").alias("expected_move"), rnd("entry_cost").alias("entry_cost"))


RANKS = f", ranks AS MATERIALIZED ({IV_RANK})"


@query("screen_covered_call", f"""{CHAIN}{RANKS} SELECT c.asset_id, c.ts, strike, dte, bid, R6(delta) AS delta, R6(iv_rank) AS iv_rank
    FROM {nearest_sql(0.3, 'C')} AS c JOIN ranks AS r ON r.asset_id = c.asset_id AND r.ts = c.ts
    WHERE iv_rank >= 0.3 AND open_interest * {DEPTH} > 1000 AND volume * {DEPTH} > 100 AND R9({SPREAD}) < 0.15 AND bid > 0.10""")
def screen_covered_call(spark, d):
    m = Market(spark, d)
    ranks = vol.iv_rank(iv_table(m).where("iv IS NOT NULL"))
    liquid = (F.col("open_interest") > 1000) & (F.col("volume") > 100) & (rnd(chains.spread_pct(), 9) < 0.15)
    return chains.covered_calls(deep(full_chain(m)), ranks, 0.3, 0.3, liquid).select(
        "asset_id", "ts", "strike", "dte", "bid", rnd("delta").alias("delta"), rnd("iv_rank").alias("iv_rank"))


CONDOR = f"""SELECT s.asset_id, s.ts, sc AS short_call, sp AS short_put, lc AS long_call, lp AS long_put, scd AS dte, scb + spb - lca - lpa AS net_credit,
      LEAST(ABS(lc - sc), ABS(sp - lp)) - (scb + spb - lca - lpa) AS max_loss FROM (
    SELECT s.*, MIN(CASE WHEN cw THEN c.strike END) AS lc, ARG_MIN(CASE WHEN cw THEN c.ask END, CASE WHEN cw THEN c.strike END) AS lca,
           MAX(CASE WHEN pw THEN c.strike END) AS lp, ARG_MAX(CASE WHEN pw THEN c.ask END, CASE WHEN pw THEN c.strike END) AS lpa
    FROM (SELECT c.asset_id, c.ts, c.strike AS sc, c.dte AS scd, c.bid AS scb, p.strike AS sp, p.dte AS spd, p.bid AS spb
          FROM {nearest_sql(0.16, 'C')} AS c JOIN {nearest_sql(-0.16, 'P')} AS p ON p.asset_id = c.asset_id AND p.ts = c.ts
          JOIN ranks AS r ON r.asset_id = c.asset_id AND r.ts = c.ts WHERE iv_rank >= 0.5) AS s
    JOIN (SELECT * FROM chain) AS c ON c.asset_id = s.asset_id AND c.ts = s.ts,
    LATERAL (SELECT c."right" = 'C' AND c.dte = scd AND c.strike >= sc * 1.03 AS cw, c."right" = 'P' AND c.dte = spd AND c.strike <= sp * 0.97 AS pw)
    GROUP BY ALL) AS s WHERE lc IS NOT NULL AND lp IS NOT NULL AND scb + spb - lca - lpa > 0.10"""


@query("screen_iron_condor", f"""{CHAIN}{RANKS} SELECT asset_id, ts, short_call, short_put, long_call, long_put, dte, R6(net_credit) AS net_credit, R6(max_loss) AS max_loss
    FROM ({CONDOR})""".replace("SELECT s.*, MIN", "SELECT s.asset_id, s.ts, sc, scd, scb, sp, spd, spb, MIN").replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"))
def screen_iron_condor(spark, d):
    m = Market(spark, d)
    ranks = vol.iv_rank(iv_table(m).where("iv IS NOT NULL"))
    return chains.iron_condors(full_chain(m), ranks).select(
        "asset_id", "ts", "short_call", "short_put", "long_call", "long_put", "dte", rnd("net_credit").alias("net_credit"),
        rnd("max_loss").alias("max_loss"))


@query("screen_straddle", f"""{CHAIN} SELECT c.asset_id, c.ts, R6((c.bid + c.ask + p.bid + p.ask) / 2) AS expected_move, R6(c.ask + p.ask) AS entry_cost
    FROM {nearest_sql(0.5, 'C')} AS c JOIN {nearest_sql(-0.5, 'P')} AS p ON p.asset_id = c.asset_id AND p.ts = c.ts
    JOIN (SELECT asset_id, ts, vix FROM {VIX}) AS v ON v.asset_id = c.asset_id AND v.ts = c.ts WHERE v.vix > 25""")
def screen_straddle(spark, d):
    m = Market(spark, d)
    nervous = vol.with_exogenous(m.bars(), m.macro_series(), "1-URGENT").where("vix > 25").select("asset_id", "ts")
    df = chains.expected_move(full_chain(m)).join(nervous, ["asset_id", "ts"], "left_semi")
    return df.select("asset_id", "ts", rnd("expected_move").alias("expected_move"), rnd("entry_cost").alias("entry_cost"))


# a short call opened on every bar, followed to its expiration; the first bar on which an exit band is reached
SOLD = """SELECT o.asset_id, o.ts AS entry_ts, o.strike, o.expiration, o.bid AS entry_credit, o.iv, o.rate"""


@query("structure_exits", f"""{CHAIN}, sold AS MATERIALIZED ({SOLD} FROM {nearest_sql(0.3, 'C')} AS o WHERE o.bid > 0.10),
    live AS MATERIALIZED (SELECT s.*, b.ts, b.close AS s, s.expiration - b.ts AS dte, (s.expiration - b.ts) / 365.0::DOUBLE AS t, 'C' AS "right"
      FROM sold AS s JOIN bars AS b ON b.asset_id = s.asset_id AND b.ts > s.entry_ts AND b.ts <= s.expiration)
    SELECT asset_id, entry_ts, ts, dte, R6(entry_credit) AS entry_credit, R6(price) AS current_value, R6(p) AS profit_pct, exit FROM (
      SELECT *, CASE WHEN R9(p) >= 0.5 THEN 'profit_target' WHEN dte <= 21 THEN 'time' WHEN R9(p) <= -2 THEN 'stop_loss' ELSE 'hold' END AS exit
      FROM (SELECT *, (entry_credit - price) / entry_credit AS p FROM ({priced_sql('SELECT * FROM live')})))
    WHERE exit <> 'hold' QUALIFY ROW_NUMBER() OVER (PARTITION BY asset_id, entry_ts ORDER BY ts) = 1""")
def structure_exits(spark, d):
    m = Market(spark, d)
    sold = chains.nearest(full_chain(m), 0.3, "C", ["strike", "expiration", "bid", "iv", "rate"]).where("bid > 0.10")
    out = chains.first_exits(sold.withColumnsRenamed({"ts": "entry_ts", "bid": "entry_credit"}),
                             m.bars().select("asset_id", "ts", F.col("close").alias("s")))
    return out.select("asset_id", "entry_ts", "ts", "dte", rnd("entry_credit").alias("entry_credit"),
                      rnd("current_value").alias("current_value"), rnd("profit_pct").alias("profit_pct"), "exit")


# one option and one share position per open trade group
POSITIONS = """SELECT t.strategy_id AS portfolio_id, t.asset_id, CASE WHEN q % 2 = 0 THEN 'OPTION' ELSE 'EQUITY' END AS asset_type, q AS quantity, cost AS average_cost,
      px AS current_price, DATE '1998-01-01' + CAST(q % 300 AS INTEGER) AS expiration, ROUND(px + 1.7e-6, 0) AS strike, CASE WHEN q % 4 < 2 THEN 'C' ELSE 'P' END AS "right",
      (q % 100) / 100.0::DOUBLE AS delta, 0.01::DOUBLE * (q % 7) AS gamma, -0.02::DOUBLE * (q % 5) AS theta, 0.1::DOUBLE * (q % 3) AS vega, CONCAT(t.asset_id, '-', q % 2) AS symbol
    FROM (SELECT strategy_id, asset_id, CAST(SUM(quantity) AS BIGINT) AS q, R6(AVG(entry_price)) AS cost FROM trades WHERE exit_date IS NULL GROUP BY 1, 2) AS t
    JOIN (SELECT asset_id, ARG_MAX(close, ts) AS px FROM bars GROUP BY 1) AS p ON p.asset_id = t.asset_id"""


def positions(m):
    q = F.col("quantity")
    open_trades = m.trades().where("exit_date IS NULL").groupBy("strategy_id", "asset_id").agg(
        F.sum("quantity").cast("long").alias("quantity"), rnd(F.avg("entry_price")).alias("average_cost"))
    last = m.bars().groupBy("asset_id").agg(F.max_by("close", "ts").alias("current_price"))
    return open_trades.join(last, "asset_id").select(
        F.col("strategy_id").alias("portfolio_id"), "asset_id", F.when(q % 2 == 0, "OPTION").otherwise("EQUITY").alias("asset_type"),
        "quantity", "average_cost", "current_price", F.date_add(F.lit("1998-01-01").cast("date"), (q % 300).cast("int")).alias("expiration"),
        F.round(F.col("current_price") + 1.7e-6, 0).alias("strike"), F.when(q % 4 < 2, "C").otherwise("P").alias("right"),
        ((q % 100) / 100.0).alias("delta"), (0.01 * (q % 7)).alias("gamma"), (-0.02 * (q % 5)).alias("theta"),
        (0.1 * (q % 3)).alias("vega"), F.concat("asset_id", F.lit("-"), q % 2).alias("symbol"))


@query("expired_options", f"""SELECT portfolio_id, asset_id, expiration, expiration - DATE '1998-06-30' AS dte, R6(v) AS settlement, R4(quantity * 100 * (v - average_cost)) AS realized_pnl
    FROM (SELECT *, GREATEST(CASE WHEN "right" = 'C' THEN current_price - strike ELSE strike - current_price END, 0) AS v FROM ({POSITIONS}))
    WHERE asset_type = 'OPTION' AND expiration <= DATE '1998-06-30'""")
def expired_options(spark, d):
    df = holdings.expired(positions(Market(spark, d)).withColumn("underlying_price", F.col("current_price")), "1998-06-30")
    return df.select("portfolio_id", "asset_id", "expiration", "dte", rnd("settlement").alias("settlement"),
                     rnd("realized_pnl", 4).alias("realized_pnl"))


PG = ["delta", "gamma", "theta", "vega"]
PORTFOLIO_GREEKS = f"""SELECT portfolio_id, SUM(CASE WHEN asset_type = 'OPTION' THEN delta * quantity * 100 ELSE quantity END) AS delta,
    {', '.join(f"SUM(CASE WHEN asset_type = 'OPTION' THEN {g} * quantity * 100 ELSE 0 END) AS {g}" for g in PG[1:])} FROM ({POSITIONS}) GROUP BY 1"""


@query("portfolio_greeks", f"SELECT portfolio_id, {', '.join(f'R4({g}) AS {g}' for g in PG)} FROM ({PORTFOLIO_GREEKS})")
def portfolio_greeks(spark, d):
    df = holdings.greeks_by_portfolio(positions(Market(spark, d)))
    return df.select("portfolio_id", *[rnd(g, 4).alias(g) for g in PG])


@query("limit_utilisation", f"""SELECT portfolio_id, greek, R4(value) AS value, limit_value, R6(u) AS utilisation,
      CASE WHEN u > 1 THEN 'BREACHED' WHEN u > 0.8 THEN 'RED' WHEN u > 0.5 THEN 'YELLOW' ELSE 'OK' END AS status FROM (
    SELECT *, ABS(value) / limit_value AS u FROM (
      SELECT portfolio_id, 'delta' AS greek, delta AS value, 500000.0::DOUBLE AS limit_value FROM ({PORTFOLIO_GREEKS}) UNION ALL
      SELECT portfolio_id, 'vega', vega, 200000.0 FROM ({PORTFOLIO_GREEKS}) UNION ALL SELECT portfolio_id, 'gamma', gamma, 50000.0 FROM ({PORTFOLIO_GREEKS})))""")
def limit_utilisation(spark, d):
    df = holdings.greeks_by_portfolio(positions(Market(spark, d)))
    out = holdings.limit_utilisation(df, {"delta": 500_000.0, "vega": 200_000.0, "gamma": 50_000.0})
    return out.select("portfolio_id", "greek", rnd("value", 4).alias("value"), "limit_value", rnd("utilisation").alias("utilisation"), "status")


@query("book_value", f"""SELECT portfolio_id, R4(mv) AS market_value, R4(pnl) AS unrealized_pnl, R4(1000000 + mv) AS equity, R6(CASE WHEN 1000000 + mv > 0 THEN big / (1000000 + mv) ELSE 0 END) AS max_weight, n AS n_positions
    FROM (SELECT portfolio_id, SUM(quantity * current_price * m) AS mv, SUM(quantity * (current_price - average_cost) * m) AS pnl, MAX(ABS(quantity * current_price * m)) AS big, COUNT(*) AS n
          FROM (SELECT *, CASE WHEN asset_type = 'OPTION' THEN 100 ELSE 1 END AS m FROM ({POSITIONS})) GROUP BY 1)""")
def book_value(spark, d):
    df = holdings.book(positions(Market(spark, d)), 1_000_000.0)
    return df.select("portfolio_id", *[rnd(c, 4).alias(c) for c in ("market_value", "unrealized_pnl", "equity")],
                     rnd("max_weight").alias("max_weight"), "n_positions")


@query("positions_with_greeks", f"""SELECT p.portfolio_id, p.symbol, R6(COALESCE(q.delta, p.delta)) AS delta, R6(COALESCE(q.gamma, p.gamma)) AS gamma, R6(COALESCE(q.theta, p.theta)) AS theta, R6(COALESCE(q.vega, p.vega)) AS vega
    FROM ({POSITIONS}) AS p LEFT JOIN (SELECT CONCAT(asset_id, '-0') AS symbol, * FROM ({priced_sql(QUOTES)}) QUALIFY ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY ts DESC) = 1) AS q ON q.symbol = p.symbol""")
def positions_with_greeks(spark, d):
    m = Market(spark, d)
    latest = quotes(m).groupBy("asset_id").agg(F.max_by(F.struct("s", "strike", "t", "rate", "iv", "right"), "ts").alias("q"))
    q = chains.priced(latest.select("asset_id", "q.*")).withColumn("symbol", F.concat("asset_id", F.lit("-0")))
    df = holdings.with_quote_greeks(positions(m), q)
    return df.select("portfolio_id", "symbol", *[rnd(g).alias(g) for g in PG])
