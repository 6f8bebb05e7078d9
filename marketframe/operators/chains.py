"""Option chains: generation, selection, screens and exits.

A chain is generated from one underlying row by nested array generators; nothing is joined and nothing is shuffled until
a contract is selected per (underlying, date).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketframe.functions import options as opt

EXPIRATIONS = (21, 30, 45, 60, 90)
TOLERANCE = 9        # digits to which distances are compared, so that equal ones resolve by strike in every engine


def priced(df: DataFrame, s="s", k="strike", t="t", r="rate", v="iv", call="right = 'C'") -> DataFrame:
    """Add price and greeks to rows holding spot, strike, years, rate, volatility and right."""
    for step in (opt.cdf_columns(s, k, t, r, v), opt.cdf_values()):
        for name, text in step.items():
            df = df.withColumn(name, F.expr(text))
    # emitted by a generator: a filter on the price then stays above it instead of repeating the whole formula below
    values = {"price": opt.price(s, k, t, r, v, call), **opt.greeks(s, k, t, r, v, call)}
    block = F.array(F.struct(*[F.expr(text).cast("double").alias(name) for name, text in values.items()]))
    return df.select("*", F.inline(block)).drop("d1", "d2", "n1", "n2")


def generate_chain(underlyings: DataFrame, dtes=EXPIRATIONS, width: float = 0.20, steps: int = 10) -> DataFrame:
    """Quotes for (asset_id, ts, s, rate, iv) rows: every expiration, 2*steps+1 strikes, calls and puts."""
    ladder = F.transform(F.sequence(F.lit(0), F.lit(2 * steps)),
                         lambda i: F.round(F.col("s") * (1 + (i - steps) * width / steps) + 1.7e-6, 2))
    # one row becomes hundreds: spread the small input first, by the key that selections group on later
    parts = int(underlyings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = (underlyings.repartition(parts, "asset_id", "ts").withColumn("dte", F.explode(F.array(*[F.lit(x).cast("long") for x in dtes])))
          .withColumn("strike", F.explode(ladder))
          .withColumn("right", F.explode(F.array(F.lit("C"), F.lit("P"))))
          .withColumns({"t": F.col("dte") / 365.0, "expiration": F.date_add("ts", F.col("dte").cast("int"))}))
    df = priced(df).where("price >= 0.01")
    moneyness = F.abs(F.ln(F.col("s") / F.col("strike")))
    spread = F.col("price") * F.greatest(F.lit(0.05), F.least(F.col("iv") * 0.10 + moneyness * 0.5, F.lit(0.50)))
    cents = lambda c: F.round(c + 1.7e-6, 2)
    return df.withColumns({
        "bid": cents(F.greatest(F.lit(0.01), F.col("price") - spread / 2)), "ask": cents(F.col("price") + spread / 2),
        "open_interest": F.greatest(F.lit(10), F.floor(1000 * F.abs("delta") * (1 - moneyness))),
        "volume": F.greatest(F.lit(1), F.floor(100 * F.abs("delta")))})


def mid() -> Column:
    return (F.col("bid") + F.col("ask")) / 2


def spread_pct() -> Column:
    return F.when(mid() == 0, 1.0).otherwise((F.col("ask") - F.col("bid")) / mid())


def is_liquid(min_interest: int = 1000, min_volume: int = 100, max_spread: float = 0.15) -> Column:
    return (F.col("open_interest") > min_interest) & (F.col("volume") > min_volume) & (spread_pct() < max_spread)


def occ_symbol(root: Column) -> Column:
    """Root, yyMMdd, right and the strike in thousandths padded to eight digits."""
    return F.concat(root, F.date_format("expiration", "yyMMdd"), F.col("right"),
                    F.lpad(F.floor(F.col("strike") * 1000 + 1e-6).cast("string"), 8, "0"))


def nearest(chain: DataFrame, target: float, right: str, columns: list[str], prefix: str = "") -> DataFrame:
    """Contract closest to a target delta per (asset_id, ts); ties go to the shorter expiration, then the lower strike."""
    rank = F.struct(F.round(F.abs(F.col("delta") - target), TOLERANCE), "dte", "strike")
    picked = chain.where(F.col("right") == right).groupBy("asset_id", "ts").agg(
        F.min_by(F.struct(*columns), rank).alias("_c"))
    return picked.select("asset_id", "ts", *[F.col(f"_c.{c}").alias(prefix + c) for c in columns])


def nearest_each(chain: DataFrame, targets: dict[str, tuple[float, str]], columns: list[str]) -> DataFrame:
    """nearest() for several named (delta, right) targets in one aggregation: one struct column each, null where the right is absent."""
    aggs = []
    for name, (target, right) in targets.items():
        mine = F.col("right") == right
        rank = F.struct(F.round(F.abs(F.col("delta") - target), TOLERANCE), "dte", "strike")
        aggs.append(F.min_by(F.when(mine, F.struct(*columns)), F.when(mine, rank)).alias(name))
    return chain.groupBy("asset_id", "ts").agg(*aggs)


def expected_move(chain: DataFrame) -> DataFrame:
    both = nearest_each(chain, {"c": (0.5, "C"), "p": (-0.5, "P")}, ["bid", "ask"]).where("c IS NOT NULL AND p IS NOT NULL")
    move = (F.col("c.bid") + F.col("c.ask") + F.col("p.bid") + F.col("p.ask")) / 2
    return both.select("asset_id", "ts", move.alias("expected_move"), (F.col("c.ask") + F.col("p.ask")).alias("entry_cost"))


def covered_calls(chain: DataFrame, ranks: DataFrame, delta: float = 0.30, least_rank: float = 0.30, liquid: Column | None = None) -> DataFrame:
    """Dates on which a short call may be opened: rich volatility, a liquid contract and a bid above ten cents."""
    pick = nearest(chain.withColumn("liquid", is_liquid() if liquid is None else liquid), delta, "C",
                   ["strike", "dte", "bid", "ask", "delta", "liquid"])
    ready = ranks.where(F.col("iv_rank") >= least_rank).select("asset_id", "ts", "iv_rank")
    return pick.where("liquid AND bid > 0.10").join(ready, ["asset_id", "ts"])


def iron_condors(chain: DataFrame, ranks: DataFrame, delta: float = 0.16, wing: float = 0.03, least_rank: float = 0.50) -> DataFrame:
    """Four legs per (asset_id, ts): short strikes by delta, wings the nearest strikes beyond; credit above ten cents.

    Wings belong to the expiration of the leg they protect.
    """
    keys = ["asset_id", "ts"]
    ready = chain.join(ranks.where(F.col("iv_rank") >= least_rank).select(*keys), keys, "left_semi")
    # a chain has a fixed number of contracts: they meet once, in one array, and all legs are picked from it
    def short(right: str, target: float) -> Column:
        mine = F.col("right") == right
        rank = F.struct(F.round(F.abs(F.col("delta") - target), TOLERANCE), "dte", "strike")
        return F.min_by(F.when(mine, F.struct("strike", "dte", "bid")), F.when(mine, rank))
    picked = ready.groupBy(*keys).agg(F.collect_list(F.struct("right", "dte", "strike", "ask")).alias("_legs"), short("C", delta).alias("sc"),
                                      short("P", -delta).alias("sp")).where("sc IS NOT NULL AND sp IS NOT NULL")
    leg = lambda x: F.struct(x["strike"].alias("strike"), x["ask"].alias("ask"))
    calls = F.filter("_legs", lambda x: (x["right"] == "C") & (x["dte"] == F.col("sc.dte")) & (x["strike"] >= F.col("sc.strike") * (1 + wing)))
    puts = F.filter("_legs", lambda x: (x["right"] == "P") & (x["dte"] == F.col("sp.dte")) & (x["strike"] <= F.col("sp.strike") * (1 - wing)))
    df = (picked.withColumns({"lc": F.array_min(F.transform(calls, leg)), "lp": F.array_max(F.transform(puts, leg))})
          .where("lc IS NOT NULL AND lp IS NOT NULL")
          .select(*keys, "lc", "lp", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("sc", "sp") for c in ("strike", "dte", "bid")]))
    credit = F.col("sc_bid") + F.col("sp_bid") - F.col("lc.ask") - F.col("lp.ask")
    width = F.least(F.abs(F.col("lc.strike") - F.col("sc_strike")), F.abs(F.col("sp_strike") - F.col("lp.strike")))
    return df.select(*keys, F.col("sc_strike").alias("short_call"), F.col("sp_strike").alias("short_put"),
                     F.col("lc.strike").alias("long_call"), F.col("lp.strike").alias("long_put"), F.col("sc_dte").alias("dte"),
                     credit.alias("net_credit"), (width - credit).alias("max_loss")).where("net_credit > 0.10")


def exits(structures: DataFrame, profit: float = 0.50, dte: int = 21, loss: float = -2.0) -> DataFrame:
    """Which exit band a re-priced short structure (entry_credit, current_value, dte) falls into."""
    pct = (F.col("entry_credit") - F.col("current_value")) / F.col("entry_credit")
    level = F.round(pct, TOLERANCE)
    reason = F.when(level >= profit, "profit_target").when(F.col("dte") <= dte, "time").when(level <= loss, "stop_loss").otherwise("hold")
    return structures.where("entry_credit > 0").withColumns({"profit_pct": pct, "exit": reason})


def first_exits(sold: DataFrame, bars: DataFrame) -> DataFrame:
    """The first bar on which each short call (asset_id, entry_ts, strike, expiration, entry_credit, iv, rate) reaches an exit band.

    A position meets the bars (asset_id, ts, s) of the months it lives in: an equi-join on asset and month, whatever the time to expiration.
    """
    months = F.sequence(F.trunc("entry_ts", "month"), F.trunc("expiration", "month"), F.expr("interval 1 month"))
    live = (sold.withColumn("_m", F.explode(months))
            .join(bars.withColumn("_m", F.trunc("ts", "month")), ["asset_id", "_m"]).where("ts > entry_ts AND ts <= expiration"))
    live = live.withColumns({"dte": F.datediff("expiration", "ts").cast("long"), "right": F.lit("C")})
    value = priced(live.withColumn("t", F.col("dte") / 365.0)).withColumn("current_value", F.col("price"))
    done = exits(value).where("exit <> 'hold'")
    columns = ["dte", "entry_credit", "current_value", "profit_pct", "exit"]
    return (done.groupBy("asset_id", "entry_ts").agg(F.min_by(F.struct("ts", *columns), "ts").alias("_e"))
            .select("asset_id", "entry_ts", "_e.*"))
