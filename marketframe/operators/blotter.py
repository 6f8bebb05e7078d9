"""Fills: ledger, round trips, average cost, slippage, commission and fill prices."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketframe.operators.asof import asof_join
from marketframe.operators.holdings import signed
from marketframe.operators.prefix import id_block, prefix_totals
from marketframe.operators.windows import by_asset, roll


def ledger(fills: DataFrame, start_cash: float = 0.0) -> DataFrame:
    """Signed quantity, cash effect, and running position and cash per portfolio in (ts, order_id) order."""
    qty = signed()
    df = fills.withColumns({"signed_qty": qty, "cash_effect": -qty * F.col("fill_price") - F.col("commission"),
                            "_range": id_block("order_id")})
    df = prefix_totals(df, ["portfolio_id"], ["ts", "_range", "order_id"], {"cash_effect": "cash", "signed_qty": "position"})
    return df.withColumn("cash", F.col("cash") + start_cash).drop("_range")


def round_trips(fills: DataFrame) -> DataFrame:
    """Pair each sell with the latest buy still open (last in, first out); sells without an open buy are dropped.

    The number of open buys is a balance that never falls below zero, so it is the running sum of +1/-1 less its running
    minimum. A sell that lowers the balance to d-1 closes the buy that last raised it to d, and those two are neighbours
    among the rows of level d: every nested trip is found with sorted neighbours, none with a stack.
    """
    df = fills.withColumns({"_step": F.when(F.col("side") == "BUY", 1).otherwise(-1), "_range": id_block("order_id")})
    df = prefix_totals(df, ["portfolio_id"], ["ts", "_range", "order_id"], {"_step": "_sum"}, lowest="_lowest")
    open_now = F.col("_sum") - F.least(F.lit(0), F.col("_lowest"))
    df = df.withColumn("_level", F.when(F.col("side") == "BUY", open_now).otherwise(open_now + 1))
    # the neighbour before a sell on its level, searched by week so that a busy level is split over many tasks
    level = df.select("portfolio_id", "_level", "ts", "order_id", "side", "fill_price", "quantity", "commission")
    before = level.select("portfolio_id", "_level", "ts", "order_id", F.struct("side", "ts", "order_id", "fill_price", "quantity").alias("entry"))
    sells = asof_join(level.where("side = 'SELL'"), before, ["portfolio_id", "_level"], "ts", "ts", ["entry"], inclusive=False,
                      block="week", seq="order_id").where("entry.side = 'BUY'")
    pnl = F.col("entry.quantity") * (F.col("fill_price") - F.col("entry.fill_price")) - F.col("commission")
    return sells.select("portfolio_id", F.col("entry.order_id").alias("entry_id"), F.col("order_id").alias("exit_id"),
                        F.col("entry.ts").alias("entry_ts"), F.col("ts").alias("exit_ts"),
                        F.col("entry.fill_price").alias("entry_price"), F.col("fill_price").alias("exit_price"),
                        F.col("entry.quantity").alias("quantity"), pnl.alias("realized_pnl"),
                        F.datediff("ts", "entry.ts").cast("long").alias("holding_days"))


SLIPPAGE_MODELS = ("none", "fixed_spread", "volume", "option_spread")


def slippage(model: str, price: Column, quantity: Column, volume: Column, adv: Column) -> Column:
    """Dollars per share, never negative."""
    if model == "none":
        return F.lit(0.0)
    if model == "fixed_spread":
        return price * F.when(adv > 1_000_000, 5.0).otherwise(20.0) / 10_000
    if model == "volume":
        base = F.when(adv <= 0, F.greatest(volume, F.lit(1))).otherwise(adv)
        return price * 0.1 * F.sqrt(quantity / base)
    if model == "option_spread":
        return price * F.when((adv > 100) & (volume > 10), 0.02).otherwise(0.20) / 2
    raise ValueError(f"unknown slippage model {model}")


def commission(model: str, quantity: Column, is_option: Column) -> Column:
    if model == "zero":
        return F.lit(0.0)
    if model == "per_share":
        return F.greatest(F.lit(1.0), quantity * F.when(is_option, 0.65).otherwise(0.005))
    if model == "per_contract":
        return F.when(is_option, F.greatest(F.lit(1.0), quantity * 0.65)).otherwise(0.0)
    raise ValueError(f"unknown commission model {model}")


def with_next_bar(bars: DataFrame) -> DataFrame:
    """The strictly later bar of the same asset as a struct; null on the last bar."""
    return bars.withColumn("next_bar", F.lead(F.struct("ts", "open", "high", "low", "close")).over(by_asset()))


def fill_price(mode: str, bar: str = "next_bar") -> Column:
    if mode == "close":
        return F.col("close")
    if mode == "next_open":
        return F.col(f"{bar}.open")
    if mode == "vwap":
        return (F.col(f"{bar}.open") + F.col(f"{bar}.high") + F.col(f"{bar}.low") + F.col(f"{bar}.close")) / 4
    raise ValueError(f"unknown fill mode {mode}")


def limit_fill(price: Column, side: Column, limit: Column, bar: str = "next_bar") -> Column:
    """Null when the bar never reaches the limit, else the better of limit and price."""
    buy = F.when(F.col(f"{bar}.low") <= limit, F.least(price, limit))
    sell = F.when(F.col(f"{bar}.high") >= limit, F.greatest(price, limit))
    return F.when(limit.isNull(), price).when(side == "BUY", buy).otherwise(sell)


def adv20() -> Column:
    """Mean volume of the 20 bars before this one."""
    return roll(F.avg, "volume", 20, end=-1)


def daily_flow(fills: DataFrame) -> DataFrame:
    return fills.groupBy("strategy_id", "ts").agg(
        F.sum(signed() * F.col("fill_price")).alias("signed_value"), F.sum("commission").alias("commission"),
        F.countDistinct("portfolio_id").alias("n_positions"), F.count(F.lit(1)).alias("n_fills"))


def average_cost(fills: DataFrame) -> DataFrame:
    """Position, average cost and realised profit after every fill, per portfolio in (ts, order_id) order.

    Adding to a position averages the cost, reducing it leaves the cost alone, opening or flipping it restarts at the
    fill price. Given the position (a running sum) the cost is a linear recurrence, so both scale past one task.
    """
    from marketframe.operators.affine import affine_scan
    from marketframe.session import durable
    levels = ["ts", "_range", "order_id"]
    df = fills.withColumns({"_q": signed(), "_range": id_block("order_id")})
    df = prefix_totals(df, ["portfolio_id"], levels, {"_q": "position"})
    old, new, q = F.col("_old"), F.col("position"), F.col("_q")
    df = durable(df.withColumn("_old", F.col("position") - F.col("_q")))
    opens = (old == 0) | (old * new < 0)
    adds = old * q > 0
    df = df.withColumns({"_mul": F.when(opens, 0.0).when(adds, F.abs(old) / F.abs(new)).otherwise(1.0),
                         "_add": F.when(opens, F.col("fill_price")).when(adds, F.col("fill_price") * F.abs(q) / F.abs(new)).otherwise(0.0)})
    df = affine_scan(df, ["portfolio_id"], levels, "_mul", "_add", "_before", "average_cost")
    closed = F.when(old * q < 0, F.least(F.abs(old), F.abs(q))).otherwise(0.0)
    return df.withColumns({
        "realized_pnl": closed * (F.col("fill_price") - F.col("_before")) * F.signum(old),
        "average_cost": F.when(new == 0, 0.0).otherwise(F.col("average_cost"))}).drop("_q", "_range", "_old", "_mul", "_add", "_before")
