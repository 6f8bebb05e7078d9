import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.sources import sinks
from marketframe.streaming import jobs
from marketframe.streaming.sources import replay, run_to_parquet, run_with_history, table_stream


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def split_table(spark, folder, pdf, name, parts):
    """One file per part, written in order, so that each becomes a micro-batch of its own."""
    import os
    import time
    os.makedirs(f"{folder}/{name}.parquet")
    for i, part in enumerate(parts):
        part.to_parquet(f"{folder}/{name}.parquet/{i}.parquet", coerce_timestamps="us", index=False)
        os.utime(f"{folder}/{name}.parquet/{i}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))
    return table_stream(spark, folder, name, 1).withColumn("ts", F.col("ts").cast("timestamp"))


def ticks(n=600):
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(range(n), "min") * 7
    return pd.DataFrame({"event_id": range(n), "ts": ts, "user_id": [i % 3 for i in range(n)], "asset_id": [f"a{i % 2}" for i in range(n)],
                         "price": [100 + (i * 37) % 91 for i in range(n)]}).astype({"price": float})


def test_bars_over_several_batches_equal_one_pass(spark, folder):
    pdf = ticks()
    stream = split_table(spark, folder, pdf, "t", [pdf[i * 100:(i + 1) * 100] for i in range(6)])
    got = run_to_parquet(jobs.ohlcv(stream), "t").toPandas()
    pdf["start"] = pdf.ts.dt.floor("D")
    closed = pdf[pdf.start + pd.Timedelta("1D") <= pdf.ts.max() - pd.Timedelta("10min")]
    want = closed.groupby(["asset_id", "start"]).price.agg(["first", "max", "min", "last", "size"])
    got = got.set_index(["asset_id", "start"]).sort_index()
    assert got[["open", "high", "low", "close", "volume"]].to_numpy().tolist() == want.sort_index().to_numpy().tolist()


def test_repolled_rows_pass_once_and_late_rows_are_dropped(spark, folder):
    pdf = ticks(200)
    late = pdf[:5].assign(event_id=lambda x: x.event_id + 10_000)
    stream = split_table(spark, folder, pdf, "t", [pdf[:100], pdf[90:150], pdf[150:], late])
    got = run_to_parquet(jobs.deduplicated(stream), "t").toPandas()
    assert sorted(got.event_id) == list(range(200))


def test_trailing_stop_state_survives_batches(spark, folder):
    pdf = ticks(300)
    stream = split_table(spark, folder, pdf, "t", [pdf[:100], pdf[100:200], pdf[200:]])
    got = run_to_parquet(jobs.trailing_stops(stream, trail=0.3), "t").toPandas()
    want = []
    for user, g in pdf.groupby("user_id"):
        best = None
        for r in g.itertuples():
            best = r.price if best is None else max(best, r.price)
            if r.price <= best * 0.7:
                want.append((user, best, r.price))
                best = None
    assert sorted(zip(got.user_id, got.best, got.exit_price)) == sorted(want) and want


def test_alerts_once_per_key_and_hour(spark, folder):
    pdf = ticks(120)
    stream = split_table(spark, folder, pdf, "t", [pdf[:60], pdf[60:]])
    got = run_to_parquet(jobs.cooled_alerts(stream, ["user_id"]), "t")
    assert got.count() == got.distinct().count() == pdf.assign(h=pdf.ts.dt.floor("h")).groupby(["user_id", "h"]).ngroups


def test_append_run_is_idempotent_and_upsert_keeps_other_partitions(spark, folder):
    a = spark.createDataFrame([(1, "x", 2020), (2, "y", 2021)], "id int, v string, year int")
    for _ in range(2):
        sinks.append_run(a, f"{folder}/runs", "2024-01-01")
    sinks.append_run(a, f"{folder}/runs", "2024-01-02")
    assert spark.read.parquet(f"{folder}/runs").count() == 4
    a.write.partitionBy("year").parquet(f"{folder}/store")
    incoming = spark.createDataFrame([(2, "new", 2021), (3, "z", 2021)], "id int, v string, year int")
    sinks.upsert(a, incoming, ["id"], "year", f"{folder}/store")
    got = {r.id: r.v for r in spark.read.parquet(f"{folder}/store").collect()}
    assert got == {1: "x", 2: "new", 3: "z"}


def test_bar_store_prunes_partitions(spark, folder, bars):
    sinks.write_bars(bars, f"{folder}/bars")
    plan = spark.read.parquet(f"{folder}/bars").where("year = 2020 AND asset_id = 'ASSET_1'").select("close")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in text and "EqualTo(asset_id,ASSET_1)" in text and "ReadSchema: struct<asset_id:string,close:double>" in text


def test_json_export(spark, folder):
    sinks.export_json(spark.range(3), f"{folder}/j")
    assert spark.read.json(f"{folder}/j").count() == 3


def test_order_fills_do_not_depend_on_batches(spark, folder):
    days = pd.Timestamp("2024-01-01") + pd.to_timedelta([(i * 53) % 400 for i in range(200)], "D")
    orders = pd.DataFrame({"order_id": range(200), "ts": days})
    fills = pd.DataFrame({"fill_order_id": [i % 200 for i in range(500)], "ts": [days[i % 200] + pd.Timedelta(days=(i * 7) % 150) for i in range(500)]})
    want = sum(0 <= ((i * 7) % 150) <= 120 for i in range(500))
    for parts in (1, 5):
        o = split_table(spark, folder, orders, f"o{parts}", [orders[i::parts] for i in range(parts)]).withColumnRenamed("ts", "order_ts")
        f = split_table(spark, folder, fills, f"f{parts}", [fills[i::parts] for i in range(parts)]).withColumnRenamed("ts", "fill_ts")
        assert run_to_parquet(jobs.order_fills(o, f, delay="600 days"), f"of{parts}").count() == want


def plain_stops(pdf, trail, idle):
    want = []
    for user, g in pdf.sort_values(["ts", "event_id"]).groupby("user_id"):
        best = last = None
        for r in g.itertuples():
            if last is not None and r.ts - last > idle:
                best = None
            best, last = r.price if best is None else max(best, r.price), r.ts
            if r.price <= best * (1 - trail):
                want.append((user, r.ts, best, r.price))
                best = None
    return sorted(want)


@pytest.mark.parametrize("parts", [1, 10])
@pytest.mark.parametrize("shuffled", [False, True])
def test_trailing_stops_do_not_depend_on_batches_or_order(spark, folder, parts, shuffled):
    pdf = ticks(400)
    pdf["user_id"] = [(i * 7) % 5 for i in range(400)]
    pdf.loc[(pdf.user_id == 2) & (pdf.event_id < 300), "user_id"] = 3          # a key with a long gap
    fed = pdf.copy()
    if shuffled:                                                                # each row up to an hour late
        fed["k"] = [i + (i * 13) % 8 for i in range(400)]
        fed = fed.sort_values("k", kind="stable").drop(columns="k")
    size = -(-400 // parts)
    stream = split_table(spark, folder, fed, "t", [fed[i * size:(i + 1) * size] for i in range(parts)])
    got = run_to_parquet(jobs.trailing_stops(stream, trail=0.2, delay="2 hours", idle="10 hours"), "t").toPandas()
    due = pdf[pdf.ts <= pdf.ts.max() - pd.Timedelta("2h")]
    want = plain_stops(due, 0.2, pd.Timedelta("10h"))
    assert sorted(zip(got.user_id, got.ts, got.best, got.exit_price)) == want and len(want) > 10


def test_trailing_stop_query_equals_its_sql_on_odd_ticks(spark, folder):
    """First prices of zero, null keys, prices and times, NaN, ties in time and id."""
    import duckdb
    import check
    from marketframe.catalog import load
    queries, oracles = load()
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + i * INTERVAL 11 MINUTE AS ts, i % 7 AS user_id, 'view' AS event_type,
        CASE WHEN i < 3 THEN 0.0 ELSE 100 + (i * 37) % 171 END::DOUBLE AS value, '{}' AS props FROM RANGE(900) t(i)""")
    con.execute("UPDATE events SET user_id = NULL WHERE user_id = 6")
    con.execute("UPDATE events SET value = NULL WHERE event_id % 50 = 7")
    con.execute("UPDATE events SET value = 'NaN' WHERE event_id IN (5, 300, 301)")
    con.execute("UPDATE events SET ts = NULL WHERE event_id % 90 = 11")
    con.execute("INSERT INTO events SELECT event_id, ts, user_id, event_type, value / 2.5, props FROM events WHERE event_id % 10 = 3")
    con.execute("INSERT INTO events VALUES (NULL, TIMESTAMP '2024-01-02', 9007199254740993, 'view', 50, '{}'), (NULL, TIMESTAMP '2024-01-02 00:01', 9007199254740993, 'view', 1, '{}')")
    con.execute(f"COPY events TO '{folder}/events.parquet'")
    problem, n, _ = check.compare(spark, con, queries["stream_trailing_stop"], oracles["stream_trailing_stop"], folder)
    assert problem is None and n > 50


def test_state_of_idle_keys_goes(spark, folder):
    pdf = ticks(300)
    pdf["user_id"] = [i if i < 100 else 1000 for i in range(300)]              # a hundred keys with one tick each
    stream = split_table(spark, folder, pdf, "t", [pdf[i * 50:(i + 1) * 50] for i in range(6)])
    out = jobs.trailing_stops(stream, trail=0.2, delay="1 hour", idle="3 hours")
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) > 50 and held[-1] <= 2


def test_replayed_tables_keep_little_state(spark, folder):
    days = pd.Timestamp("2015-01-01") + pd.to_timedelta([(i * 53) % 2500 for i in range(1000)], "D")
    orders = spark.createDataFrame(pd.DataFrame({"order_id": range(1000), "order_ts": days}))
    fills = spark.createDataFrame(pd.DataFrame({"fill_order_id": [i % 1000 for i in range(2000)], "fill_ts": [days[i % 1000] + pd.Timedelta(days=(i * 7) % 150) for i in range(2000)]}))
    want = sum(((i * 7) % 150) <= 120 for i in range(2000))
    live = jobs.order_fills(replay(orders, "order_ts", "o"), replay(fills, "fill_ts", "f"), delay="367 days")
    query = live.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(f"{folder}/out").count() == want
    assert max(held) < 2200 and held[-1] < 1300                                # of 3,000 rows


def test_warm_start_has_full_windows(spark, folder):
    from marketframe.operators.windows import roll
    pdf = pd.DataFrame({"asset_id": [f"a{i % 3}" for i in range(600)], "ts": [(pd.Timestamp("2020-01-01") + pd.Timedelta(days=i // 3)).date() for i in range(600)],
                        "close": [100.0 + (i * 31) % 17 for i in range(600)]})
    history, live = spark.createDataFrame(pdf[:300]), spark.createDataFrame(pdf[300:])
    schema = spark.createDataFrame([], "asset_id string, ts date, close double, sma double").schema
    out = run_with_history(replay(live, "ts", "b", unit="week", files=1), history, "warm", 19, lambda b: b.withColumn("sma", roll(F.avg, "close", 20)), schema).toPandas()
    pdf["sma"] = pdf.groupby("asset_id").close.transform(lambda x: x.rolling(20).mean())
    want = {(r.asset_id, r.ts): r.sma for r in pdf[300:].itertuples()}
    assert len(out) == 300 and all(abs(want[(r.asset_id, r.ts)] - r.sma) < 1e-9 for r in out.itertuples())
