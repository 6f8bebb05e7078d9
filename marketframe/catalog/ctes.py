"""Input tables of FIXTURES.md as SQL over the driver's tables (the Spark side is sources/market.py)."""

CTES = {
    "bars": """
        SELECT asset_id, ts, open, R4(GREATEST(open, close) * (1 + tx / 10)) AS high,
               R4(LEAST(open, close) * (1 - tx / 10)) AS low, close, volume
        FROM (SELECT *, COALESCE(LAG(close) OVER (PARTITION BY asset_id ORDER BY ts), 100.0) AS open
              FROM (SELECT *, R4(100 * EXP(R8(SUM(r) OVER (PARTITION BY asset_id ORDER BY ts)))) AS close
                    FROM (SELECT p_brand AS asset_id, CAST(l_shipdate AS DATE) AS ts, R8(AVG(l_discount) - 0.05) AS r,
                                 R8(AVG(l_tax)) AS tx, CAST(SUM(l_quantity) AS BIGINT) AS volume
                          FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)))""",
    "adjustment_factors": """
        SELECT p_brand AS asset_id, CAST(DATE_TRUNC('quarter', l_shipdate) AS DATE) AS effective_date,
               R8(1 + AVG(l_tax)) AS cumulative_split_factor, R8(AVG(l_discount)) AS cumulative_div_adjustment
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
    "macro_series": """
        SELECT o_orderpriority AS series_id, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS reference_period,
               CAST(DATE_TRUNC('month', o_orderdate) AS DATE) + 45 AS release_date,
               R8(AVG(CAST(CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END AS DOUBLE))) AS value
        FROM orders GROUP BY 1, 2, 3""",
    "signals": """
        SELECT event_id, ts, CONCAT('S', user_id % 5) AS strategy_id, CONCAT('A', user_id % 7) AS asset_id,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'LONG' WHEN event_type = 'error' THEN 'SHORT'
                    ELSE 'FLAT' END AS direction,
               LEAST(1.0, value / 100) AS confidence,
               CASE WHEN user_id % 2 = 0 THEN 'trend' ELSE 'mean_reversion' END AS signal_type, props
        FROM events""",
    "trades": """
        SELECT o_orderpriority AS strategy_id, p_brand AS asset_id, 'LONG' AS direction,
               CAST(l_shipdate AS DATE) - 5 * l_linenumber AS entry_date,
               CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS exit_date,
               l_extendedprice / l_quantity AS entry_price,
               CASE WHEN l_linestatus = 'F' THEN l_extendedprice / l_quantity * (1 + l_discount - 0.05) END AS exit_price,
               l_quantity AS quantity, l_tax AS commission,
               CASE WHEN l_linestatus = 'F' THEN R8(l_extendedprice * (l_discount - 0.05)) END AS realized_pnl,
               CASE WHEN l_linestatus = 'F' THEN 5 * l_linenumber END AS holding_bars
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""",
    "orders_in": """
        SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS ts, o_orderpriority AS strategy_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, o_totalprice AS limit_value,
               o_custkey AS portfolio_id
        FROM orders""",
    "fills": """
        SELECT o.order_id, o.ts + 1 AS ts, o.strategy_id, o.portfolio_id, o.side, SUM(l.l_quantity) AS quantity,
               R8(SUM(l.l_extendedprice) / SUM(l.l_quantity)) AS fill_price, R8(SUM(l.l_tax)) AS commission
        FROM orders_in AS o JOIN lineitem AS l ON l.l_orderkey = o.order_id GROUP BY 1, 2, 3, 4, 5""",
    "equity_curves": "SELECT asset_id AS portfolio_id, ts, 1000 * close AS equity FROM bars",
    "benchmark_curve": """
        SELECT ts, R4(1000 * EXP(R8(SUM(r) OVER (ORDER BY ts)))) AS equity
        FROM (SELECT ts, R8(AVG(LN(close / open))) AS r FROM bars GROUP BY ts)""",
    "dirty_bars": """
        SELECT asset_id, ts, open, CASE WHEN volume % 11 = 0 THEN low * 0.9 ELSE high END AS high, low,
               CASE WHEN volume % 13 = 0 THEN -close ELSE close END AS close,
               CASE WHEN volume % 17 = 0 THEN -volume ELSE volume END AS volume FROM bars""",
}
