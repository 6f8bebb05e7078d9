"""Joins and the fills, costs and holdings built on them."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.catalog.registry import query
from marketframe.catalog.sqltext import W, over, roll
from marketframe.functions.stats import rnd
from marketframe.operators import blotter, holdings, panel
from marketframe.operators.asof import asof_daily, asof_join
from marketframe.operators.windows import by_asset
from marketframe.sources.market import Market


@query("asof_adjustment", """
    SELECT b.asset_id, b.ts, close, R6(COALESCE(cumulative_split_factor, 1.0)) AS split, R6(COALESCE(cumulative_div_adjustment, 0.0)) AS div
    FROM bars AS b ASOF LEFT JOIN adjustment_factors AS f ON b.asset_id = f.asset_id AND b.ts >= f.effective_date""")
def asof_adjustment(spark, d):
    m = Market(spark, d)
    out = asof_join(m.bars().select("asset_id", "ts", "close"), m.adjustment_factors(), ["asset_id"], "ts",
                    "effective_date", ["cumulative_split_factor", "cumulative_div_adjustment"])
    return out.select("asset_id", "ts", "close", rnd(F.coalesce("cumulative_split_factor", F.lit(1.0))).alias("split"),
                      rnd(F.coalesce("cumulative_div_adjustment", F.lit(0.0))).alias("div"))


@query("macro_point_in_time", """
    SELECT o.order_id, o.ts, o.strategy_id AS series_id, R6(value) AS value, release_date
    FROM orders_in AS o ASOF LEFT JOIN macro_series AS m ON o.strategy_id = m.series_id AND o.ts >= m.release_date""")
def macro_point_in_time(spark, d):
    m = Market(spark, d)
    left = m.orders_in().select("order_id", "ts", F.col("strategy_id").alias("series_id"))
    out = asof_daily(left, m.macro_series(), ["series_id"], "ts", "release_date", ["value", "release_date"])
    return out.select("order_id", "ts", "series_id", rnd("value").alias("value"), "release_date")


@query("ffill_align", """
    SELECT b.asset_id, b.ts, close, R6(value) AS vix
    FROM (SELECT *, '1-URGENT' AS series_id FROM bars) AS b ASOF LEFT JOIN macro_series AS m
      ON b.series_id = m.series_id AND b.ts >= m.release_date""")
def ffill_align(spark, d):
    from marketframe.operators.volatility import with_exogenous
    m = Market(spark, d)
    return with_exogenous(m.bars(), m.macro_series(), "1-URGENT").select(
        "asset_id", "ts", "close", rnd("vix").alias("vix"))


@query("benchmark_align", """
    SELECT c.portfolio_id, c.ts, R6(c.r) AS strategy, R6(b.r) AS benchmark
    FROM (SELECT *, equity / LAG(equity) OVER (PARTITION BY portfolio_id ORDER BY ts) - 1 AS r FROM equity_curves) AS c
    JOIN (SELECT *, equity / LAG(equity) OVER (ORDER BY ts) - 1 AS r FROM benchmark_curve) AS b ON b.ts = c.ts
    WHERE c.r IS NOT NULL AND b.r IS NOT NULL""")
def benchmark_align(spark, d):
    from marketframe.operators.performance import aligned_returns
    m = Market(spark, d)
    return aligned_returns(m.equity_curves(), m.benchmark_curve()).select(
        "portfolio_id", "ts", rnd("strategy").alias("strategy"), rnd("benchmark").alias("benchmark"))


# what each order's portfolio holds of its strategy from fills of earlier days
HELD_AT = """(SELECT o.order_id, SUM(CASE WHEN f.side = 'BUY' THEN f.quantity ELSE -f.quantity END) AS held FROM orders_in AS o
    JOIN fills AS f ON f.portfolio_id = o.portfolio_id AND f.strategy_id = o.strategy_id AND f.ts < o.ts GROUP BY 1)"""


@query("signal_holdings", f"""
    SELECT o.portfolio_id, o.strategy_id, o.order_id, o.side, COALESCE(h.held, 0) AS held,
           CASE WHEN o.side = 'SELL' AND COALESCE(held, 0) > 0 THEN 'close_long' WHEN o.side = 'BUY' AND COALESCE(held, 0) < 0 THEN 'close_short' ELSE 'open' END AS action
    FROM orders_in AS o LEFT JOIN {HELD_AT} AS h ON h.order_id = o.order_id""")
def signal_holdings(spark, d):
    m = Market(spark, d)
    action = (F.when((F.col("side") == "SELL") & (F.col("held") > 0), "close_long")
              .when((F.col("side") == "BUY") & (F.col("held") < 0), "close_short").otherwise("open"))
    return holdings.with_holdings_as_of(m.orders_in(), m.fills(), ["portfolio_id", "strategy_id"]).select(
        "portfolio_id", "strategy_id", "order_id", "side", "held", action.alias("action"))


@query("order_screen", f"""
    SELECT o.order_id, o.portfolio_id, o.side, CASE WHEN side = 'SELL' THEN 'closing' WHEN cur / NULLIF(eq, 0) >= 0.1 THEN 'position_limit'
             WHEN nth > 20 THEN 'strategy_full' WHEN v < 1000 THEN 'below_minimum' WHEN eq > 0 AND (cur + v) / NULLIF(eq, 0) > 0.1 THEN 'concentration'
             ELSE 'approved' END AS status, R4((cur + v) / NULLIF(eq, 0)) AS projected_weight,
           R4(CASE WHEN v > cash * 0.95 THEN GREATEST(cash * 0.95, 0) ELSE v END) AS approved_value
    FROM (SELECT o.*, ABS(COALESCE(h.held * p.px, 0)) AS cur, GREATEST(COALESCE(c.cash, 0), 0) + COALESCE(c.book_value, 0) AS eq, c.cash,
                 f.nth, CASE WHEN COALESCE(o.limit_value, 0) = 0 THEN (GREATEST(COALESCE(c.cash, 0), 0) + COALESCE(c.book_value, 0)) * 0.02 ELSE o.limit_value END AS v
          FROM orders_in AS o LEFT JOIN {HELD_AT} AS h ON h.order_id = o.order_id
          ASOF LEFT JOIN (SELECT strategy_id, ts, R8(SUM(quantity * fill_price) / SUM(quantity)) AS px FROM fills GROUP BY 1, 2) AS p
            ON p.strategy_id = o.strategy_id AND p.ts < o.ts
          LEFT JOIN (SELECT c_custkey AS portfolio_id, c_acctbal * 1000 AS cash, 500000.0::DOUBLE AS book_value FROM customer) AS c ON c.portfolio_id = o.portfolio_id
          LEFT JOIN (SELECT portfolio_id, asset_id, ROW_NUMBER() OVER (PARTITION BY portfolio_id ORDER BY ts, order_id) AS nth FROM (
                       SELECT portfolio_id, strategy_id AS asset_id, ts, order_id FROM orders_in WHERE side = 'BUY'
                       QUALIFY ROW_NUMBER() OVER (PARTITION BY portfolio_id, strategy_id ORDER BY ts, order_id) = 1)) AS f
            ON f.portfolio_id = o.portfolio_id AND f.asset_id = o.strategy_id) AS o""")
def order_screen(spark, d):
    m = Market(spark, d)
    orders = holdings.with_holdings_as_of(m.orders_in(), m.fills(), ["portfolio_id", "strategy_id"])
    orders = holdings.with_last_price(orders, m.fills(), "strategy_id")
    # in these tables a strategy stands for the asset, and a portfolio for the strategy that opens assets
    orders = orders.withColumn("asset_id", F.col("strategy_id")).withColumn("strategy_id", F.col("portfolio_id"))
    cash = m.table("customer").select(F.col("c_custkey").alias("portfolio_id"), (F.col("c_acctbal") * 1000).alias("cash"),
                                      F.lit(500000.0).alias("book_value"))
    return holdings.screened_orders(orders, cash, 0.1, 20, 1000.0).select(
        "order_id", "portfolio_id", "side", "status", rnd("projected_weight", 4).alias("projected_weight"),
        rnd("approved_value", 4).alias("approved_value"))


@query("round_trips", """
    SELECT portfolio_id, entry_id, order_id AS exit_id, entry_ts, ts AS exit_ts, R6(entry_price) AS entry_price, R6(fill_price) AS exit_price,
           entry_qty AS quantity, R4(entry_qty * (fill_price - entry_price) - commission) AS realized_pnl, ts - entry_ts AS holding_days
    FROM (SELECT *, LAG(side) OVER lv AS entry_side, LAG(ts) OVER lv AS entry_ts, LAG(order_id) OVER lv AS entry_id,
                 LAG(fill_price) OVER lv AS entry_price, LAG(quantity) OVER lv AS entry_qty
          FROM (SELECT *, s - LEAST(0, MIN(s) OVER (PARTITION BY portfolio_id ORDER BY ts, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
                            + CASE WHEN side = 'BUY' THEN 0 ELSE 1 END AS lvl
                FROM (SELECT *, SUM(CASE WHEN side = 'BUY' THEN 1 ELSE -1 END)
                        OVER (PARTITION BY portfolio_id ORDER BY ts, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM fills))
          WINDOW lv AS (PARTITION BY portfolio_id, lvl ORDER BY ts, order_id))
    WHERE side = 'SELL' AND entry_side = 'BUY'""")
def round_trips(spark, d):
    out = blotter.round_trips(Market(spark, d).fills())
    return out.select("portfolio_id", "entry_id", "exit_id", "entry_ts", "exit_ts", rnd("entry_price").alias("entry_price"),
                      rnd("exit_price").alias("exit_price"), "quantity", rnd("realized_pnl", 4).alias("realized_pnl"),
                      "holding_days")


@query("fill_ledger", """
    SELECT order_id, portfolio_id, ts, q AS signed_qty, R4(c) AS cash_effect,
           R4(SUM(c) OVER w) AS cash, SUM(q) OVER w AS position
    FROM (SELECT *, -q * fill_price - commission AS c FROM (
            SELECT *, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS q FROM fills))
    WINDOW w AS (PARTITION BY portfolio_id ORDER BY ts, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill_ledger(spark, d):
    return blotter.ledger(Market(spark, d).fills()).select(
        "order_id", "portfolio_id", "ts", "signed_qty", rnd("cash_effect", 4).alias("cash_effect"),
        rnd("cash", 4).alias("cash"), "position")


@query("order_fill_match", """
    SELECT o.order_id, o.ts, f.ts AS fill_ts, o.side, f.quantity, R6(f.fill_price) AS fill_price, R6(f.commission) AS commission
    FROM orders_in AS o JOIN fills AS f ON f.order_id = o.order_id""")
def order_fill_match(spark, d):
    m = Market(spark, d)
    return holdings.order_fill_match(m.orders_in(), m.fills()).select(
        "order_id", "ts", "fill_ts", "side", "quantity", rnd("fill_price").alias("fill_price"),
        rnd("commission").alias("commission"))


@query("next_bar_fill", f"""
    SELECT asset_id, ts, LEAD(ts) {W} AS fill_ts, LEAD(open) {W} AS next_open, R6(LEAD((open + high + low + close) / 4) {W}) AS vwap FROM bars
    QUALIFY LEAD(ts) {W} IS NOT NULL""")
def next_bar_fill(spark, d):
    df = blotter.with_next_bar(Market(spark, d).bars()).where("next_bar IS NOT NULL")
    return df.select("asset_id", "ts", F.col("next_bar.ts").alias("fill_ts"), blotter.fill_price("next_open").alias("next_open"),
                     rnd(blotter.fill_price("vwap")).alias("vwap"))


@query("fill_price", f"""
    SELECT asset_id, ts, side, R6(lim) AS limit_price, CASE WHEN side = 'BUY' AND nl <= lim THEN R6(LEAST(no, lim))
             WHEN side = 'SELL' AND nh >= lim THEN R6(GREATEST(no, lim)) END AS fill
    FROM (SELECT asset_id, ts, CASE WHEN volume % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
                 CASE WHEN volume % 2 = 0 THEN close * 0.99 ELSE close * 1.01 END AS lim,
                 LEAD(open) {W} AS no, LEAD(high) {W} AS nh, LEAD(low) {W} AS nl FROM bars)
    WHERE no IS NOT NULL""")
def fill_price(spark, d):
    df = blotter.with_next_bar(Market(spark, d).bars()).where("next_bar IS NOT NULL").withColumn(
        "side", F.when(F.col("volume") % 2 == 0, "BUY").otherwise("SELL"))
    df = df.withColumn("lim", F.col("close") * F.when(F.col("side") == "BUY", 0.99).otherwise(1.01))
    fill = blotter.limit_fill(blotter.fill_price("next_open"), F.col("side"), F.col("lim"))
    return df.select("asset_id", "ts", "side", rnd("lim").alias("limit_price"), rnd(fill).alias("fill"))


@query("adv20", f"SELECT asset_id, ts, R6({roll('AVG', 'volume', 20, -1)}) AS adv20 FROM bars")
def adv20(spark, d):
    return Market(spark, d).bars().select("asset_id", "ts", rnd(blotter.adv20()).alias("adv20"))


@query("slippage_models", f"""
    SELECT asset_id, ts, 0.0::DOUBLE AS "none", R6(close * CASE WHEN adv > 1000000 THEN 5.0 ELSE 20.0 END / 10000) AS fixed_spread,
           R6(close * 0.1 * SQRT(100 / CASE WHEN adv <= 0 THEN GREATEST(volume, 1) ELSE adv END)) AS volume,
           R6(close * CASE WHEN adv > 100 AND volume > 10 THEN 0.02 ELSE 0.2 END / 2) AS option_spread
    FROM (SELECT *, COALESCE({roll('AVG', 'volume', 20, -1)}, 0) AS adv FROM bars)""")
def slippage_models(spark, d):
    df = Market(spark, d).bars().withColumn("adv", F.coalesce(blotter.adv20(), F.lit(0.0)))
    return df.select("asset_id", "ts", *[
        (rnd(blotter.slippage(m, F.col("close"), F.lit(100.0), F.col("volume"), F.col("adv"))) if m != "none"
         else F.lit(0.0)).alias(m) for m in blotter.SLIPPAGE_MODELS])


@query("commission_models", """
    SELECT l_orderkey, l_linenumber, l_quantity, 0.0::DOUBLE AS zero, R6(GREATEST(1.0, l_quantity * CASE WHEN opt THEN 0.65 ELSE 0.005 END)) AS per_share,
           R6(CASE WHEN opt THEN GREATEST(1.0, l_quantity * 0.65) ELSE 0 END) AS per_contract
    FROM (SELECT *, l_returnflag = 'R' AS opt FROM lineitem)""")
def commission_models(spark, d):
    q, opt = F.col("l_quantity"), F.col("l_returnflag") == "R"
    return Market(spark, d).table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", blotter.commission("zero", q, opt).alias("zero"),
        rnd(blotter.commission("per_share", q, opt)).alias("per_share"),
        rnd(blotter.commission("per_contract", q, opt)).alias("per_contract"))


@query("strategy_daily_flow", """
    SELECT strategy_id, ts, R4(SUM(CASE WHEN side = 'BUY' THEN quantity * fill_price ELSE -quantity * fill_price END)) AS signed_value,
           R4(SUM(commission)) AS commission, COUNT(DISTINCT portfolio_id) AS n_positions, COUNT(*) AS n_fills FROM fills GROUP BY 1, 2""")
def strategy_daily_flow(spark, d):
    return blotter.daily_flow(Market(spark, d).fills()).select(
        "strategy_id", "ts", rnd("signed_value", 4).alias("signed_value"), rnd("commission", 4).alias("commission"),
        "n_positions", "n_fills")


@query("mark_to_market", """
    SELECT t.strategy_id, t.asset_id, quantity, R6(COALESCE(p.px, 0)) AS current_price, R4(quantity * COALESCE(p.px, 0)) AS market_value
    FROM (SELECT strategy_id, asset_id, SUM(quantity) AS quantity FROM trades WHERE exit_date IS NULL GROUP BY 1, 2) AS t
    LEFT JOIN (SELECT asset_id, ARG_MAX(close, ts) AS px FROM bars WHERE ts <= DATE '1998-06-30' GROUP BY 1) AS p ON p.asset_id = t.asset_id""")
def mark_to_market(spark, d):
    m = Market(spark, d)
    positions = m.trades().where("exit_date IS NULL").groupBy("strategy_id", "asset_id").agg(
        F.sum("quantity").alias("quantity")).withColumn("current_price", F.lit(None).cast("double"))
    return holdings.mark_to_market(positions, m.bars(), "1998-06-30").select(
        "strategy_id", "asset_id", "quantity", rnd("current_price").alias("current_price"),
        rnd("market_value", 4).alias("market_value"))


@query("positions_avg_cost", """WITH RECURSIVE n AS MATERIALIZED (
      SELECT *, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS q, ROW_NUMBER() OVER (PARTITION BY portfolio_id ORDER BY ts, order_id) AS rn FROM fills),
    f AS (SELECT portfolio_id, order_id, rn, q AS pos, fill_price AS cost, 0.0::DOUBLE AS pnl FROM n WHERE rn = 1 UNION ALL
      SELECT n.portfolio_id, n.order_id, n.rn, f.pos + q,
        CASE WHEN f.pos + q = 0 THEN 0 WHEN f.pos = 0 OR f.pos * (f.pos + q) < 0 THEN fill_price WHEN f.pos * q > 0 THEN (f.cost * ABS(f.pos) + fill_price * ABS(q)) / ABS(f.pos + q) ELSE f.cost END,
        CASE WHEN f.pos * q < 0 THEN LEAST(ABS(f.pos), ABS(q)) * (fill_price - f.cost) * SIGN(f.pos) ELSE 0 END
      FROM f JOIN n ON n.portfolio_id = f.portfolio_id AND n.rn = f.rn + 1)
    SELECT portfolio_id, order_id, pos AS position, R4(cost) AS average_cost, R4(pnl) AS realized_pnl FROM f""")
def positions_avg_cost(spark, d):
    return blotter.average_cost(Market(spark, d).fills()).select(
        "portfolio_id", "order_id", "position", rnd("average_cost", 4).alias("average_cost"), rnd("realized_pnl", 4).alias("realized_pnl"))
