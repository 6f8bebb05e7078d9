"""Every registered query with SQL is compared value by value on the small tables; the others have to give rows."""
import pytest

from check import compare, connect
from marketframe.catalog import load

QUERIES, ORACLES = load()
# needs more history than the small tables have
MAY_BE_EMPTY = {"warmup_gate", "xs_momentum", "basket_changes", "basket_exits", "dual_momentum", "ml_rank_model", "rolling_ic", "factor_decay",
                "regime_metrics", "events_tsmom", "events_adx", "events_rsi",
                "events_sma_cross", "low_vol_basket", "pair_zscore", "vol_spike_alerts", "ic_alerts", "walk_forward", "rank_signals",
                "turbulence", "cov_shrunk", "cov_shrunk_oas", "health_alerts", "stress_periods", "expired_options"}


@pytest.fixture(scope="module")
def duck(path):
    return connect(path)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, path, name):
    problem, rows, _ = compare(spark, duck, QUERIES[name], ORACLES.get(name), path)
    assert problem is None, problem
    assert rows > 0 or name in MAY_BE_EMPTY


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
