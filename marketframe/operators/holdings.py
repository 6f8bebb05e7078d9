"""Orders and signals against current holdings: lookups, marks, screens and expiry."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketframe.functions.stats import rnd
from marketframe.operators.asof import asof_join


def signed(side: str = "side", quantity: str = "quantity") -> Column:
    return F.when(F.col(side) == "BUY", F.col(quantity)).otherwise(-F.col(quantity))


def holdings(fills: DataFrame, keys: list[str]) -> DataFrame:
    """Net quantity and signed cash value per key; pre-aggregated map-side."""
    return fills.groupBy(*keys).agg(F.sum(signed()).alias("held"),
                                    F.sum(signed() * F.col("fill_price")).alias("held_value"))


def with_holdings(orders: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    joined = orders.join(held, keys, "full_outer")
    return joined.withColumns({"held": F.coalesce("held", F.lit(0.0)), "held_value": F.coalesce("held_value", F.lit(0.0))})


def with_holdings_as_of(orders: DataFrame, fills: DataFrame, keys: list[str], block: str = "month") -> DataFrame:
    """Each order with the net quantity its key held from fills strictly before the order's date; 0 without any.

    Fills become one row per key and day, so running totals are windows bounded by the calendar; orders are matched in blocks
    of time, so a key with a third of all orders is spread over its blocks.
    """
    daily = fills.groupBy(*keys, "ts").agg(F.sum(signed()).alias("_q"))
    days = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    totals = daily.select(*keys, "ts", F.sum("_q").over(days).alias("held"))
    found = asof_join(orders, totals, keys, "ts", "ts", ["held"], inclusive=False, block=block)
    return found.withColumn("held", F.coalesce("held", F.lit(0.0)))


def with_last_price(orders: DataFrame, fills: DataFrame, key: str, block: str = "month") -> DataFrame:
    """Each order with the volume-weighted fill price of its asset on the last day before it, as `last_price`."""
    cost = F.sum(F.col("quantity") * F.col("fill_price"))
    daily = fills.groupBy(key, "ts").agg(rnd(cost / F.sum("quantity"), 8).alias("last_price"))
    return asof_join(orders, daily, [key], "ts", "ts", ["last_price"], inclusive=False, block=block)


def screened_orders(orders: DataFrame, cash: DataFrame, max_weight: float = 0.10, max_assets: int = 20, min_value: float = 100.0) -> DataFrame:
    """Pre-trade screens in the order they are taken; only the first reason is reported. Orders carry held and last_price.

    Selling is never screened. A position weighs its held quantity at the last price before the order. The number of assets a
    strategy already opened counts the assets whose first opening order came earlier, a rank over one row per (strategy, asset).
    """
    opened = orders.where("side = 'BUY'").groupBy("strategy_id", "asset_id").agg(
        F.min(F.struct("ts", "order_id")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("strategy_id").orderBy("_first"))
    opened = opened.withColumn("_nth", rank).drop("_first")
    df = orders.join(cash, "portfolio_id", "left").join(opened, ["strategy_id", "asset_id"], "left")
    current = F.abs(F.coalesce(F.col("held") * F.col("last_price"), F.lit(0.0)))
    equity = F.greatest(F.coalesce("cash", F.lit(0.0)), F.lit(0.0)) + F.coalesce("book_value", F.lit(0.0))
    df = df.withColumns({"_current": current, "_equity": equity})
    value = F.when(F.coalesce("limit_value", F.lit(0.0)) == 0, F.col("_equity") * 0.02).otherwise(F.col("limit_value"))
    df = df.withColumns({"weight": F.col("_current") / F.nullif(F.col("_equity"), F.lit(0.0)), "order_value": value})
    df = df.withColumn("projected_weight", (F.col("_current") + F.col("order_value")) / F.nullif(F.col("_equity"), F.lit(0.0)))
    status = (F.when(F.col("side") == "SELL", "closing").when(F.col("weight") >= max_weight, "position_limit")
              .when(F.col("_nth") > max_assets, "strategy_full").when(F.col("order_value") < min_value, "below_minimum")
              .when((F.col("_equity") > 0) & (F.col("projected_weight") > max_weight), "concentration").otherwise("approved"))
    scaled = F.when(F.col("order_value") > F.col("cash") * 0.95, F.greatest(F.col("cash") * 0.95, F.lit(0.0)))
    return df.withColumns({"status": status, "approved_value": F.coalesce(scaled, F.col("order_value"))}).drop(
        "_current", "_equity", "_nth")


def order_fill_match(orders: DataFrame, fills: DataFrame) -> DataFrame:
    got = fills.select("order_id", F.col("ts").alias("fill_ts"), "quantity", "fill_price", "commission")
    return orders.join(got, "order_id")


def mark_to_market(positions: DataFrame, bars: DataFrame, as_of: str) -> DataFrame:
    """Latest close at or before the date, else the position's last price, else 0."""
    last = bars.where(F.col("ts") <= F.lit(as_of).cast("date")).groupBy("asset_id").agg(F.max_by("close", "ts").alias("_px"))
    df = positions.join(last, "asset_id", "left")
    price = F.coalesce(F.col("_px"), F.col("current_price"), F.lit(0.0))
    return df.withColumn("current_price", price).drop("_px").withColumn(
        "market_value", F.col("quantity") * F.col("current_price"))


def with_quote_greeks(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Take the greeks of the matching contract; positions without a quote keep theirs."""
    names = ["delta", "gamma", "theta", "vega"]
    q = quotes.select("symbol", *[F.col(n).alias(f"_{n}") for n in names])
    df = positions.join(q, "symbol", "left")
    return df.withColumns({n: F.coalesce(f"_{n}", n) for n in names}).drop(*[f"_{n}" for n in names])


def expired(positions: DataFrame, as_of: str) -> DataFrame:
    """Option positions at or past expiration, settled at intrinsic value of the underlying."""
    day = F.lit(as_of).cast("date")
    intrinsic = F.greatest(F.when(F.col("right") == "C", F.col("underlying_price") - F.col("strike"))
                           .otherwise(F.col("strike") - F.col("underlying_price")), F.lit(0.0))
    return positions.where((F.col("asset_type") == "OPTION") & (F.col("expiration") <= day)).withColumns({
        "dte": F.datediff("expiration", day).cast("long"), "settlement": intrinsic,
        "realized_pnl": F.col("quantity") * 100 * (intrinsic - F.col("average_cost"))})


def greeks_by_portfolio(positions: DataFrame) -> DataFrame:
    option = F.col("asset_type") == "OPTION"
    scale = F.col("quantity") * 100
    return positions.groupBy("portfolio_id").agg(
        F.sum(F.when(option, F.col("delta") * scale).otherwise(F.col("quantity"))).alias("delta"),
        *[F.sum(F.when(option, F.col(g) * scale).otherwise(0.0)).alias(g) for g in ("gamma", "theta", "vega")])


def book(positions: DataFrame, cash: float) -> DataFrame:
    """Market value, unrealised profit, equity and the largest position weight per portfolio."""
    mult = F.when(F.col("asset_type") == "OPTION", 100).otherwise(1)
    value = F.col("quantity") * F.col("current_price") * mult
    rows = positions.groupBy("portfolio_id").agg(
        F.sum(value).alias("market_value"),
        F.sum(F.col("quantity") * (F.col("current_price") - F.col("average_cost")) * mult).alias("unrealized_pnl"),
        F.max(F.abs(value)).alias("_largest"), F.count(F.lit(1)).alias("n_positions"))
    return rows.withColumn("equity", F.lit(cash) + F.col("market_value")).withColumn(
        "max_weight", F.when(F.col("equity") > 0, F.col("_largest") / F.col("equity")).otherwise(0.0)).drop("_largest")


def limit_utilisation(greeks: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Share of each limit in use, one row per portfolio and greek, with a status band."""
    rows = greeks.unpivot(["portfolio_id"], list(limits), "greek", "value")
    limit = F.lit(None).cast("double")
    for name, bound in limits.items():
        limit = F.when(F.col("greek") == name, float(bound)).otherwise(limit)
    used = F.abs("value") / F.col("limit_value")
    band = F.when(used > 1, "BREACHED").when(used > 0.8, "RED").when(used > 0.5, "YELLOW").otherwise("OK")
    return rows.withColumn("limit_value", limit).withColumns({"utilisation": used, "status": band})
