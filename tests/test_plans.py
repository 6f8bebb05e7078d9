import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators.performance import summary
from marketframe.plans import sweep as plans
from marketframe.plans.bootstrap import bootstrap_sharpe, resampled_sharpes


def returns(spark, n, mean=0.0005, vol=0.01, seed=1, key="p"):
    r = np.random.default_rng(seed).normal(mean, vol, n)
    return spark.createDataFrame(pd.DataFrame({"k": key, "ts": pd.bdate_range("2015-01-01", periods=n).date, "ret": r}))


def test_bootstrap_brackets_the_estimate_and_narrows(spark):
    short, long = (bootstrap_sharpe(returns(spark, n), "k", 300).first() for n in (100, 1500))
    for r in (short, long):
        assert r.ci_low < r.sharpe < r.ci_high and 0 <= r.p_positive <= 1 and r.n_simulations == 300
    assert long.ci_high - long.ci_low < short.ci_high - short.ci_low


def test_bootstrap_does_not_depend_on_partitioning(spark):
    r = returns(spark, 200)
    a = resampled_sharpes(r, "k", 50).orderBy("sim").toPandas()
    b = resampled_sharpes(r.repartition(5), "k", 50).orderBy("sim").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert a.sharpe.nunique() == 50


def test_too_short_a_series_is_left_out(spark):
    assert bootstrap_sharpe(returns(spark, 20), "k", 10).count() == 0


def test_windows_follow_index_arithmetic(bars, prices):
    got = plans.walk_forward_windows(bars, 100, 40, 30).groupBy("window_id", "phase").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).toPandas()
    days, start, want = prices.index.date, 0, {}
    while start + 140 <= len(days):
        k = len(want) // 2
        want[(k, "train")], want[(k, "test")] = (days[start], days[start + 99]), (days[start + 100], days[start + 139])
        start += 30
    assert {(r.window_id, r.phase): (r.a, r.b) for r in got.itertuples()} == want


def test_sweep_is_sorted_and_matches_single_runs(bars, prices):
    grid = plans.SmaGrid((5, 10), (20, 40))
    got = plans.sweep(bars, grid, cost=0.001).toPandas()
    assert got.deflated_sharpe_corrected.is_monotonic_decreasing and len(got) == 4
    for r in got.itertuples():
        held = (prices.rolling(r.fast).mean() > prices.rolling(r.slow).mean()).astype(int).shift(2).fillna(0)
        daily = (held * prices.pct_change().fillna(0) - 0.001 * held.diff().fillna(held).abs()).mean(axis=1)
        equity = (1 + daily).cumprod()
        assert r.total_return == pytest.approx(equity.iloc[-1] / equity.iloc[0] - 1, abs=1e-9)


def test_walk_forward_uses_the_best_train_configuration(bars):
    grid = plans.SmaGrid((5, 10), (20,))
    got = plans.walk_forward(bars, grid, 120, 60, 60).toPandas()
    keys = ["window_id", "phase", "param_id"]
    sliced = bars.join(plans.walk_forward_windows(bars, 120, 60, 60), "ts")
    scored = summary(plans.equity_from_returns(plans.sma_sweep_returns(sliced, grid, keys[:2], 0.002), keys), keys).toPandas()
    for r in got.itertuples():
        train = scored[(scored.window_id == r.window_id) & (scored.phase == "train")]
        assert r.train_sharpe == pytest.approx(train.sharpe_ratio.max())
    one = plans.walk_forward_summary(plans.walk_forward(bars, grid, 120, 60, 60), 2, F.lit(300)).first()
    assert one.n_windows == len(got) and one.sharpe_degradation == pytest.approx(one.avg_is_sharpe - one.avg_oos_sharpe)
