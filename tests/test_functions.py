import math
from statistics import NormalDist

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.functions import options as opt
from marketframe.functions.stats import (deflated_sharpe, expected_max_sharpe, expected_max_sharpe_of, lit, norm_cdf, norm_ppf, rnd,
                                         sample_kurt, sample_skew)
from marketframe.operators.blotter import commission, slippage
from marketframe.operators.chains import priced


def values(spark, xs, expr):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    return [r[0] for r in df.select(F.expr(expr)).collect()]


def test_normal_distribution_matches_erf(spark):
    xs = [-40, -8, -7.1, -3, -1, -0.1, 0, 0.1, 0.5, 1, 2.5, 7.2, 9]
    for x, got in zip(xs, values(spark, xs, norm_cdf("x"))):
        assert got == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1e-14)


def test_inverse_normal(spark):
    ps = [0.001, 0.02, 0.1, 0.5, 0.77, 0.98, 0.9999]
    for p, got in zip(ps, values(spark, ps, norm_ppf("x"))):
        assert got == pytest.approx(NormalDist().inv_cdf(p), rel=2e-9, abs=1e-9)


def test_expected_maximum_grows_with_trials(spark):
    assert expected_max_sharpe(1) == 0
    for n, got in zip([1, 2, 20, 500], values(spark, [1, 2, 20, 500], expected_max_sharpe_of("x"))):
        assert got == pytest.approx(expected_max_sharpe(n), abs=1e-8)


def test_deflated_sharpe_falls_with_trials_and_saturates(spark):
    few, many = (values(spark, [1.0], deflated_sharpe("x", "20", lit(expected_max_sharpe(n))))[0] for n in (2, 100))
    assert many < few
    assert values(spark, [5.0], deflated_sharpe("x", "1000", lit(0.0)))[0] == 3.0
    assert values(spark, [1.0], deflated_sharpe("x", "4", lit(0.0)))[0] == -1.0


def test_sample_moments_match_pandas(spark, prices):
    s = prices["ASSET_0"].pct_change().dropna()
    df = spark.createDataFrame([(float(v),) for v in s], "x double")
    skew, kurt = df.agg(sample_skew(F.col("x")), sample_kurt(F.col("x"))).first()
    assert skew == pytest.approx(s.skew(), abs=1e-10) and kurt == pytest.approx(s.kurt(), abs=1e-9)


def test_rounding_leaves_no_negative_zero(spark):
    got = spark.sql("SELECT CAST(-1e-9 AS DOUBLE) AS x").select(rnd("x")).first()[0]
    assert math.copysign(1, got) == 1


def bsm(s, k, t, r, v, call):
    cdf = NormalDist().cdf
    d1 = (math.log(s / k) + (r + v * v / 2) * t) / (v * math.sqrt(t))
    d2 = d1 - v * math.sqrt(t)
    sign = 1 if call else -1
    return sign * (s * cdf(sign * d1) - k * math.exp(-r * t) * cdf(sign * d2))


def test_option_prices_greeks_and_parity(spark):
    rows = [(100.0, k, t, 0.05, 0.25, right) for k in (80.0, 100.0, 125.0) for t in (0.1, 1.0) for right in "CP"]
    got = priced(spark.createDataFrame(rows, "s double, strike double, t double, rate double, iv double, right string")).toPandas()
    for _, x in got.iterrows():
        call = x.right == "C"
        assert x.price == pytest.approx(bsm(x.s, x.strike, x.t, x.rate, x.iv, call), abs=1e-9)
        h = 1e-4
        up, down = (bsm(x.s + e, x.strike, x.t, x.rate, x.iv, call) for e in (h, -h))
        assert x.delta == pytest.approx((up - down) / (2 * h), abs=1e-6)
        assert x.vega == pytest.approx((bsm(x.s, x.strike, x.t, x.rate, x.iv + h, call) - bsm(x.s, x.strike, x.t, x.rate, x.iv - h, call)) / (2 * h) / 100, abs=1e-6)
        assert x.theta == pytest.approx(-(bsm(x.s, x.strike, x.t + h, x.rate, x.iv, call) - bsm(x.s, x.strike, x.t - h, x.rate, x.iv, call)) / (2 * h) / 365, abs=1e-6)
        assert x.rho == pytest.approx((bsm(x.s, x.strike, x.t, x.rate + h, x.iv, call) - bsm(x.s, x.strike, x.t, x.rate - h, x.iv, call)) / (2 * h) / 100, abs=1e-6)


def test_expired_option_is_worth_its_intrinsic_value(spark):
    df = spark.createDataFrame([(110.0, 100.0, 0.0, 0.05, 0.2, "C"), (110.0, 100.0, 0.0, 0.05, 0.2, "P")],
                               "s double, strike double, t double, rate double, iv double, right string")
    assert [tuple(r) for r in priced(df).select("price", "delta", "gamma").collect()] == [(10.0, 1.0, 0.0), (0.0, 0.0, 0.0)]


def test_cost_models(spark):
    df = spark.sql("SELECT 100.0D AS p, 100.0D AS q, 5000.0D AS v, 1000000.5D AS big, 40000.0D AS adv")
    cols = [slippage("fixed_spread", F.col("p"), F.col("q"), F.col("v"), F.col("big")), slippage("fixed_spread", F.col("p"), F.col("q"), F.col("v"), F.col("adv")),
            slippage("volume", F.col("p"), F.col("q"), F.col("v"), F.col("adv")), commission("per_share", F.col("q"), F.lit(False)),
            commission("per_share", F.col("q") * 10, F.lit(False)), commission("per_contract", F.col("q"), F.lit(True))]
    assert df.select(*cols).first() == pytest.approx([0.05, 0.2, 0.5, 1.0, 5.0, 65.0])
