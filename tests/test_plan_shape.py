"""The physical plans must stay what the operators are designed for."""
import pytest

from marketframe.catalog import load

QUERIES, _ = load()
# these run jobs while they are built (streams, written block tables, model training)
EAGER = {n for n in QUERIES if n.startswith("stream_")} | {"round_trips", "fill_ledger", "positions_avg_cost", "ml_rank_model", "ml_importances", "rolling_ic", "ic_alerts"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_nested_loops(spark, path, name):
    text = plan(QUERIES[name](spark, path))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text          # no row-at-a-time Python


def test_scans_are_pruned_and_filters_pushed(spark, path):
    text = plan(QUERIES["open_alerts"](spark, path))
    assert "PushedFilters: [IsNotNull(event_type), " in text and "EqualTo(event_type,error)" in text and "TakeOrderedAndProject" in text
    text = plan(QUERIES["trade_stats"](spark, path))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint" in text and "l_suppkey" not in text


def test_top_k_is_limited_before_the_shuffle(spark, path):
    for name in ("upsert_latest", "latest_signal", "latest_n_bars"):
        assert "WindowGroupLimit" in plan(QUERIES[name](spark, path)), name
