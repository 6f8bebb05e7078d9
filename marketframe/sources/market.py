"""Market tables derived from the driver's tables (FIXTURES.md, part B).

`bars` is keyed by (asset_id, ts DATE): the raw lines are pre-aggregated map-side, so a symbol that holds a third of all
lines still becomes at most one row per calendar day. Every per-asset window downstream relies on that bound.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketframe.functions.stats import rnd
from marketframe.operators.windows import by_asset, running
from marketframe.session import settled, shared_dir
from marketframe.sources.store import BarStore

_STORES: dict[tuple[str, str], BarStore] = {}

class Market:
    """Lazily built inputs over one data directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = settled(spark), path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def _lines_with_asset(self, *columns: str) -> DataFrame:
        part = self.table("part").select("p_partkey", F.col("p_brand").alias("asset_id"))
        lines = self.table("lineitem").select("l_partkey", *columns)
        return lines.join(part, lines.l_partkey == part.p_partkey)

    def bars(self) -> DataFrame:
        daily = (self._lines_with_asset("l_shipdate", "l_discount", "l_tax", "l_quantity")
                 .groupBy("asset_id", F.col("l_shipdate").cast("date").alias("ts"))
                 .agg(rnd(F.avg("l_discount") - F.lit(0.05), 8).alias("r"), rnd(F.avg("l_tax"), 8).alias("tx"),
                      F.sum("l_quantity").cast("long").alias("volume")))
        priced = daily.withColumn("close", rnd(100 * F.exp(rnd(F.sum("r").over(
            by_asset().rowsBetween(Window.unboundedPreceding, 0)), 8)), 4))
        opened = priced.withColumn("open", F.coalesce(F.lag("close").over(by_asset()), F.lit(100.0)))
        return opened.select(
            "asset_id", "ts", "open",
            rnd(F.greatest("open", "close") * (1 + F.col("tx") / 10), 4).alias("high"),
            rnd(F.least("open", "close") * (1 - F.col("tx") / 10), 4).alias("low"), "close", "volume")

    def raw_bars(self) -> DataFrame:
        """Bars as they come in, faulty ones included, with the factor of the day."""
        factors = self.adjustment_factors().withColumnRenamed("effective_date", "ts")
        split = F.coalesce("cumulative_split_factor", F.lit(1.0))
        return self.dirty_bars().join(factors, ["asset_id", "ts"], "left").withColumn("adj_close", F.col("close") * split).select(
            "asset_id", "ts", "open", "high", "low", "close", "volume", F.when(F.col("close") > 0, F.col("adj_close") / F.col("close")).otherwise(1.0).alias("factor"))

    def store(self) -> BarStore:
        """The bar store of this directory's clean bars, filled once per application."""
        key = (self.spark.sparkContext.applicationId, self.path)
        if key not in _STORES:
            store = BarStore(self.spark, f"{shared_dir(self.spark)}/bars-{uuid.uuid4().hex}")
            store.ingest(self.bars().withColumn("factor", F.lit(1.0)), "all")
            _STORES[key] = store
        return _STORES[key]

    def adjustment_factors(self) -> DataFrame:
        return (self._lines_with_asset("l_shipdate", "l_tax", "l_discount")
                .groupBy("asset_id", F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp")).cast("date")
                         .alias("effective_date"))
                .agg(rnd(1 + F.avg("l_tax"), 8).alias("cumulative_split_factor"),
                     rnd(F.avg("l_discount"), 8).alias("cumulative_div_adjustment")))

    def macro_series(self) -> DataFrame:
        month = F.trunc(F.col("o_orderdate").cast("date"), "month")
        return (self.table("orders")
                .groupBy(F.col("o_orderpriority").alias("series_id"), month.alias("reference_period"))
                .agg(rnd(F.avg(F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(0.0)), 8).alias("value"))
                .select("series_id", "reference_period", F.date_add("reference_period", 45).alias("release_date"),
                        "value"))

    def signals(self) -> DataFrame:
        user = F.col("user_id")
        return self.table("events").select(
            "event_id", "ts", F.concat(F.lit("S"), user % 5).alias("strategy_id"),
            F.concat(F.lit("A"), user % 7).alias("asset_id"),
            F.when(F.col("event_type").isin("purchase", "signup"), "LONG")
             .when(F.col("event_type") == "error", "SHORT").otherwise("FLAT").alias("direction"),
            F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
            F.when(user % 2 == 0, "trend").otherwise("mean_reversion").alias("signal_type"), "props")

    def trades(self) -> DataFrame:
        lines = self._lines_with_asset("l_orderkey", "l_shipdate", "l_linenumber", "l_linestatus", "l_extendedprice",
                                       "l_quantity", "l_discount", "l_tax")
        orders = self.table("orders").select("o_orderkey", F.col("o_orderpriority").alias("strategy_id"))
        closed = F.col("l_linestatus") == "F"
        ship = F.col("l_shipdate").cast("date")
        price = F.col("l_extendedprice") / F.col("l_quantity")
        edge = F.col("l_discount") - 0.05
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            "strategy_id", "asset_id", F.lit("LONG").alias("direction"),
            F.date_sub(ship, 5 * F.col("l_linenumber")).alias("entry_date"),
            F.when(closed, ship).alias("exit_date"), price.alias("entry_price"),
            F.when(closed, price * (1 + F.col("l_discount") - 0.05)).alias("exit_price"),
            F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("commission"),
            F.when(closed, rnd(F.col("l_extendedprice") * edge, 8)).alias("realized_pnl"),
            F.when(closed, 5 * F.col("l_linenumber")).alias("holding_bars"))

    def orders_in(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("ts"),
            F.col("o_orderpriority").alias("strategy_id"),
            F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
            F.col("o_totalprice").alias("limit_value"), F.col("o_custkey").alias("portfolio_id"))

    def fills(self) -> DataFrame:
        lines = (self.table("lineitem").groupBy(F.col("l_orderkey").alias("order_id"))
                 .agg(F.sum("l_quantity").alias("quantity"),
                      rnd(F.sum("l_extendedprice") / F.sum("l_quantity"), 8).alias("fill_price"),
                      rnd(F.sum("l_tax"), 8).alias("commission")))
        return self.orders_in().join(lines, "order_id").select(
            "order_id", F.date_add("ts", 1).alias("ts"), "strategy_id", "portfolio_id", "side", "quantity",
            "fill_price", "commission")

    def equity_curves(self) -> DataFrame:
        return self.bars().select(F.col("asset_id").alias("portfolio_id"), "ts", (1000 * F.col("close")).alias("equity"))

    def benchmark_curve(self) -> DataFrame:
        """Equal-weight index; one row per date, so the single ordered window holds at most the calendar."""
        daily = self.bars().groupBy("ts").agg(rnd(F.avg(F.ln(F.col("close") / F.col("open"))), 8).alias("r"))
        running = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return daily.select("ts", rnd(1000 * F.exp(rnd(F.sum("r").over(running), 8)), 4).alias("equity"))

    def dirty_bars(self) -> DataFrame:
        v = F.col("volume")
        return self.bars().select(
            "asset_id", "ts", "open", F.when(v % 11 == 0, F.col("low") * 0.9).otherwise(F.col("high")).alias("high"),
            "low", F.when(v % 13 == 0, -F.col("close")).otherwise(F.col("close")).alias("close"),
            F.when(v % 17 == 0, -v).otherwise(v).alias("volume"))
