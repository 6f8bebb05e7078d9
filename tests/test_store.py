"""The bar store: merges, quarantine, versions, conflicts and pruned reads."""
import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from marketframe.sources.store import BarStore, Conflict

SCHEMA = "asset_id string, ts date, open double, high double, low double, close double, volume long, factor double, seq long"
COLUMNS = ["asset_id", "ts", "open", "high", "low", "close", "volume", "factor"]


@pytest.fixture()
def store(spark):
    return BarStore(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/bars")


def bar(asset, day, close=10.0, volume=5, seq=0, **other):
    row = {"open": close, "high": close + 1, "low": close - 1, "close": close, "volume": volume} | other
    return (asset, dt.date.fromisoformat(day), *[row[c] for c in ("open", "high", "low", "close", "volume")], 1.0, seq)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def content(df):
    return sorted((r.asset_id, str(r.ts), r.close) for r in df.collect())


def test_merge_counts_and_quarantine(spark, store):
    first = [bar("A", "2020-01-02"), bar("A", "2020-01-03", 11.0), bar("B", "2021-05-03"), bar("B", "2021-05-04", volume=-1), bar("B", "2021-05-05", high=1.0), bar("B", "2021-05-06", close=0.0, low=-1.0),
             bar("A", "2020-01-02", 12.0, seq=1), bar("C", "2021-01-04", open=None)]
    got = store.ingest(frame(spark, first), "one", order="seq")
    assert got == {"read": 8, "refused_high_below_low": 1, "refused_missing_value": 1, "refused_negative_volume": 1, "refused_not_positive": 1,
                   "superseded": 1, "inserted": 3, "updated": 0, "unchanged": 0}
    assert content(store.read()) == [("A", "2020-01-02", 12.0), ("A", "2020-01-03", 11.0), ("B", "2021-05-03", 10.0)]
    got = store.ingest(frame(spark, [bar("B", "2021-05-03", 20.0), bar("B", "2021-05-04", 21.0), bar("D", "2022-02-01"), bar("A", "2020-01-03", 11.0)]), "two", order="seq")
    assert (got["inserted"], got["updated"], got["unchanged"]) == (2, 1, 1)
    assert content(store.read()) == [("A", "2020-01-02", 12.0), ("A", "2020-01-03", 11.0), ("B", "2021-05-03", 20.0), ("B", "2021-05-04", 21.0), ("D", "2022-02-01", 10.0)]
    assert {(r.batch, r.reason) for r in store.quarantine().collect()} == {("one", x) for x in ("high_below_low", "missing_value", "negative_volume", "not_positive")}
    assert content(store.read(version=1)) == [("A", "2020-01-02", 12.0), ("A", "2020-01-03", 11.0), ("B", "2021-05-03", 10.0)]


def test_running_again_leaves_the_store_unchanged(spark, store):
    rows = frame(spark, [bar("A", f"20{y}-03-0{d}", 10.0 + d) for y in (19, 20, 21) for d in range(1, 8)] + [bar("A", "2019-05-01", volume=-2)])
    store.ingest(rows, "one", order="seq")
    version, parts = store.manifest()
    again = store.ingest(rows, "one", order="seq")
    assert store.manifest() == (version, parts) and again["unchanged"] == 21 and again["inserted"] == again["updated"] == 0
    assert store.quarantine().count() == 1
    # one changed row rewrites its own year only
    store.ingest(frame(spark, [bar("A", "2020-03-01", 99.0)]), "two", order="seq")
    now = {p.year: p.folder for p in store.manifest()[1]}
    assert {p.year for p in parts if now[p.year] != p.folder} == {2020}
    assert store.vacuum() == 1 and store.versions() == [2] and store.read().count() == 21


def test_reads_are_pruned(spark, store):
    rows = [bar(f"A{i:03d}", f"{y}-{m:02d}-03", 10.0 + i) for i in range(60) for y in (2018, 2019, 2020, 2021) for m in range(1, 13)]
    store.ingest(frame(spark, rows), "one", order="seq")
    df = store.bars_between("A007", "2019-02-01", "2020-03-31").select("ts", "close")
    assert all("year=2019" in f or "year=2020" in f for f in df.inputFiles()) and len({f.split("year=")[1][:4] for f in df.inputFiles()}) == 2
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    text = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(year" in text and "EqualTo(asset_id,A007)" in text and "GreaterThanOrEqual(ts,2019-02-01)" in text
    assert [str(r.ts) for r in df.collect()] == [f"2019-{m:02d}-03" for m in range(2, 13)] + [f"2020-{m:02d}-03" for m in range(1, 4)]
    assert store.read("2030-01-01").count() == 0


def test_two_writers_cannot_commit_one_version(spark, store):
    store.ingest(frame(spark, [bar("A", "2020-01-02")]), "one", order="seq")
    version, parts = store.manifest()
    store.ingest(frame(spark, [bar("A", "2020-01-03")]), "two", order="seq")
    with pytest.raises(Conflict):
        store._commit(version + 1, parts)
    assert store.read().count() == 2 and store.versions() == [1, 2]


def test_empty_batch_and_new_store(spark, store):
    assert store.read().count() == 0 and store.versions() == []
    got = store.ingest(frame(spark, [bar("A", "2020-01-02")]).limit(0), "none", order="seq")
    assert got == {"read": 0, "superseded": 0, "inserted": 0, "updated": 0, "unchanged": 0} and store.versions() == []
    got = store.ingest(frame(spark, [bar("A", "2020-01-02", volume=-1)]), "bad", order="seq")
    assert got["refused_negative_volume"] == 1 and store.read().count() == 0


def test_rows_keep_all_columns(spark, store):
    store.ingest(frame(spark, [bar("A", "2020-01-02")]), "one", order="seq")
    assert set(store.read().columns) == set(COLUMNS)
    assert store.read().select(F.sum("factor")).first()[0] == 1.0
