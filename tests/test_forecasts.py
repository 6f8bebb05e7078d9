"""Walk-forward rank model and GARCH schedule against plain loops."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators import garch, rankmodel

FEATURES = ["f1", "f2", "f3"]


def panel_frame(seed=3, days=260, assets=7):
    rng = np.random.default_rng(seed)
    dates = pd.bdate_range("2020-01-02", periods=days).date
    rows = []
    for a in range(assets):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, days)))
        for i, day in enumerate(dates):
            if rng.random() < 0.9:
                f = rng.normal(size=3)
                rows.append((f"A{a}", day, float(close[i]), float(f[0]), float(f[1]) if rng.random() < 0.8 else None, float(f[2])))
    return pd.DataFrame(rows, columns=["asset_id", "ts", "close", *FEATURES])


def frame(spark, pdf):
    out = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)],
                                "asset_id string, ts date, close double, f1 double, f2 double, f3 double")
    return out.repartition(5)


def plain_models(pdf, months, horizon, least):
    """{month: coefficients} of a ridge fitted afresh on the labels known in the months before."""
    df = pdf.sort_values(["asset_id", "ts"]).fillna({c: 0.0 for c in FEATURES})
    df["fwd"] = df.groupby("asset_id")["close"].shift(-horizon) / df["close"] - 1
    df["known"] = df.groupby("asset_id")["ts"].shift(-horizon)
    lab = df[df.fwd.notna()].copy()
    lab = lab[lab.groupby("ts")["fwd"].transform("size") >= 5]
    lab["y"] = lab.groupby("ts")["fwd"].rank(pct=True)
    lab["m"] = [d.year * 12 + d.month for d in lab["known"]]
    clock = sorted({d.year * 12 + d.month for d in df["ts"]})
    out = {}
    for i, m in enumerate(clock):
        train = lab[lab["m"].isin(clock[max(0, i - months):i])]
        if len(train) >= least:
            x = np.column_stack([np.ones(len(train)), train[FEATURES]])
            a = x.T @ x + np.diag([0.0, *[rankmodel.RIDGE * len(train)] * 3])
            out[m] = np.linalg.solve(a, x.T @ train["y"].to_numpy())
    return df, out


@pytest.mark.parametrize("months, horizon", [(36, 21), (3, 5), (1, 1)])
def test_prefix_differences_train_like_fresh_fits(spark, months, horizon):
    pdf = panel_frame()
    df, want = plain_models(pdf, months, horizon, rankmodel.LEAST)
    rows, fitted = rankmodel.walk_forward(frame(spark, pdf), FEATURES, months, horizon=horizon)
    got = {r.month.year * 12 + r.month.month: np.array(r.beta) for r in fitted.collect()}
    assert set(got) == set(want) and len(got) > 5
    for m in want:
        np.testing.assert_allclose(got[m], want[m], atol=1e-9)
    shown = {(r.asset_id, r.ts): r.prediction for r in rows.collect()}
    assert len(shown) == len(pdf)
    for r in df.itertuples():
        beta = want.get(r.ts.year * 12 + r.ts.month)
        p = shown[(r.asset_id, r.ts)]
        assert p is None if beta is None else abs(p - (beta[0] + r.f1 * beta[1] + r.f2 * beta[2] + r.f3 * beta[3])) < 1e-9


def test_no_model_sees_the_future(spark):
    pdf = panel_frame(5)
    cut = pd.Timestamp("2020-09-01").date()
    changed = pdf.copy()
    later = pd.Series([d >= cut for d in pdf["ts"]])
    changed.loc[later, "close"] *= np.random.default_rng(1).uniform(0.5, 2, later.sum())

    def before(p):
        rows, _ = rankmodel.walk_forward(frame(spark, p), FEATURES, 12)
        return sorted((r.asset_id, r.ts, r.prediction) for r in rows.where(F.col("ts") < cut).where("prediction IS NOT NULL").collect())
    a, b = before(pdf), before(changed)
    assert len(a) > 100 and [x[:2] for x in a] == [x[:2] for x in b]
    np.testing.assert_allclose([x[2] for x in a], [x[2] for x in b], atol=1e-12)


def test_a_feature_that_leads_returns_is_found(spark):
    pdf = panel_frame(8, days=300, assets=12).sort_values(["asset_id", "ts"])
    pdf["f1"] = pdf.groupby("asset_id")["close"].shift(-21) / pdf["close"] - 1      # the answer itself
    pdf["f1"] = pdf.groupby("ts")["f1"].rank(pct=True) - 0.5
    _, fitted = rankmodel.walk_forward(frame(spark, pdf), FEATURES, 36)
    last = rankmodel.importances(fitted, FEATURES).orderBy(F.desc("month"), F.desc("importance")).first()
    assert last.factor == "f1" and last.importance > 0.7


def test_too_few_rows_and_no_rows(spark):
    pdf = panel_frame(2, days=30, assets=5)
    rows, fitted = rankmodel.walk_forward(frame(spark, pdf), FEATURES, 36)
    assert fitted.count() == 0 and rows.where("prediction IS NULL").count() == len(pdf)
    rows, fitted = rankmodel.walk_forward(frame(spark, pdf).limit(0), FEATURES, 36)
    assert fitted.count() == 0 and rows.count() == 0


def price_rows(n, seed, asset="A"):
    rng = np.random.default_rng(seed)
    vol = 0.01 + 0.01 * (np.sin(np.arange(n) / 15) > 0)
    return pd.DataFrame({"asset_id": asset, "ts": pd.bdate_range("2021-01-04", periods=n).date, "close": 100 * np.exp(np.cumsum(rng.normal(0, 1, n) * vol))})


def plain_fit(r):
    """(likelihood, alpha, beta, next volatility) by loops over the grid."""
    e = (r - r.mean()) * 100
    var, found = e.var(), []
    for a, b in garch.grid():
        h, ll = var, 0.0
        for x in e:
            ll -= 0.5 * (np.log(h) + x * x / h)
            h = var * (1 - a - b) + a * x * x + b * h
        found.append((ll, a, b, min(max(np.sqrt(h) * np.sqrt(252) / 100, 0.01), 5.0)))
    return max(found, key=lambda x: x[0])


def test_schedule_and_forecasts_equal_loops(spark):
    pdf = pd.concat([price_rows(400, 1, "A"), price_rows(70, 2, "B"), price_rows(3, 3, "C"), price_rows(61, 4, "D")])
    bars = spark.createDataFrame(pdf).repartition(4)
    got = {(r.asset_id, r.ts): r for r in garch.forecasts(bars).collect()}
    assert len(got) == len(pdf)
    fitted = {(r.asset_id, r.ts): r for r in garch.fits(bars).collect()}
    for asset, own in pdf.groupby("asset_id"):
        r, ts, model = own["close"].pct_change().to_numpy()[1:], own["ts"].tolist(), None
        assert got[(asset, ts[0])].vol == 0.20
        for n in range(1, len(r) + 1):
            row = got[(asset, ts[n])]
            if n >= 60 and (n - 60) % 21 == 0:
                model = plain_fit(r[max(0, n - 252):n])
                fit = fitted.pop((asset, ts[n]))
                assert (fit.n_obs, fit.alpha, fit.beta) == (min(n, 252), model[1], model[2]) and abs(fit.log_likelihood - model[0]) < 1e-8
            want = model[3] if n >= 60 else r[max(0, n - 30):n].std() * np.sqrt(252) if n > 5 else 0.20
            assert abs(row.vol - want) < 1e-9 and row.n_obs == n
            assert row.source == ("garch" if n >= 60 else "realized" if n > 5 else "default")
    assert not fitted


def test_history_grows_without_changing_old_forecasts(spark):
    pdf = price_rows(200, 9)
    early = {r.ts: r.vol for r in garch.forecasts(spark.createDataFrame(pdf[:150])).collect()}
    late = {r.ts: r.vol for r in garch.forecasts(spark.createDataFrame(pdf)).collect()}
    assert all(abs(late[k] - v) < 1e-12 for k, v in early.items())


def test_flat_prices_and_no_bars(spark):
    pdf = price_rows(100, 1)
    pdf["close"] = 50.0
    vols = [r.vol for r in garch.forecasts(spark.createDataFrame(pdf)).collect()]
    assert all(v is None or np.isnan(v) or 0 <= v <= 0.2 for v in vols)
    assert garch.forecasts(spark.createDataFrame(pdf).limit(0)).count() == 0


def test_ranks_of_many_columns_equal_pandas(spark):
    from marketframe.operators.crosssection import percent_ranks
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"asset_id": [f"A{i}" for i in range(3000)], "ts": rng.integers(0, 40, 3000), "a": rng.integers(0, 9, 3000).astype(float), "b": rng.normal(size=3000)})
    pdf.loc[rng.random(3000) < 0.2, "a"] = np.nan
    pdf.loc[pdf.ts == 7, "b"] = np.nan
    frame = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.astype({"ts": object}).itertuples(index=False)],
                                  "asset_id string, ts long, a double, b double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")        # dates that span batches
    try:
        got = percent_ranks(frame, ["a", "b"]).toPandas().sort_values("asset_id").reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = pdf.sort_values("asset_id").reset_index(drop=True)
    want[["a", "b"]] = want.groupby("ts")[["a", "b"]].rank(pct=True)
    pd.testing.assert_frame_equal(got[["asset_id", "a", "b"]], want[["asset_id", "a", "b"]])
    assert percent_ranks(frame.limit(0), ["a"]).count() == 0


def test_scratch_folder_without_the_setting():
    """A plain local session has no shared folder and cannot set one while it runs."""
    from marketframe import session

    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master}

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            raise AssertionError("the setting is fixed while a session runs")

    class Spark:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(master), type("C", (), {"applicationId": f"test-{master}"})()
    first = session.shared_dir(Spark("local[2]"))
    assert first.startswith("/tmp/") and session.shared_dir(Spark("local[2]")) == first
    for master in ("spark://host:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_dir(Spark(master))
