import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from marketframe.session import local_session
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def path():
    return SMALL


def walk(n, seed, start=100.0, drift=0.0003, vol=0.015):
    rng = np.random.default_rng(seed)
    return start * np.exp(np.cumsum(rng.normal(drift, vol, n)))


@pytest.fixture(scope="session")
def prices():
    """Five seeded random walks over 300 business days, as a wide frame."""
    days = pd.bdate_range("2020-01-02", periods=300)
    return pd.DataFrame({f"ASSET_{i}": walk(300, 42 + i) for i in range(5)}, index=days)


@pytest.fixture(scope="session")
def bars(spark, prices):
    long = prices.rename_axis("ts").reset_index().melt("ts", var_name="asset_id", value_name="close")
    long["ts"] = long["ts"].dt.date
    long["open"], long["high"], long["low"] = long.close * 0.999, long.close * 1.005, long.close * 0.995
    long["volume"] = 1_000_000
    df = spark.createDataFrame(long[["asset_id", "ts", "open", "high", "low", "close", "volume"]])
    return df.cache()
