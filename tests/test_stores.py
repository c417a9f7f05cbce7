"""Stored tables: what a merge keeps, what a scan reads, what a join shuffles."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewright.sources import tables as ST
from tapewright.sources.optiontables import OptionStore

T0 = dt.datetime(2026, 1, 5, 10, 0)
BAR = "contract string, underlying string, ts timestamp_ntz, open double, high double, low double, close double, volume long, pos long"


def option_rows(spark, rows):
    data = [(c, u, T0 + dt.timedelta(days=d, minutes=m), p, p, p, p, 1, pos) for c, u, d, m, p, pos in rows]
    return spark.createDataFrame(data, BAR)


@pytest.fixture
def store(spark, tmp_path):
    s = OptionStore(str(tmp_path / "options"), buckets=4)
    s.save_bars(option_rows(spark, [(f"{u}{k}", u, d, m, 1.0, 0) for u in "XYZ" for k in range(6) for d in range(3) for m in range(4)]), "base")
    terms = [(f"{u}{k}", u, dt.date(2026, 2, 1), "P", float(k), dt.date(2026, 1, 1), 9.0) for u in "XYZ" for k in range(6)]
    s.save_contracts(spark.createDataFrame(terms, "contract string, underlying string, expiry date, cp string, strike double, period_start date, stock_close double"))
    return s


def plan_of(df):
    df.collect()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_merge_keeps_the_last_row_of_the_last_load(spark, store):
    store.save_bars(option_rows(spark, [("X1", "X", 0, 0, 7.0, 2), ("X1", "X", 0, 0, 99.0, 1), ("X1", "X", 9, 0, 5.0, 1)]), "fresh", ["pos"])
    got = {(r.contract, r.ts): (r.close, r.source) for r in store.bars(spark).collect()}
    assert len(got) == store.bars(spark).count() == 3 * 6 * 3 * 4 + 1
    assert got["X1", T0] == (7.0, "fresh") and got["X2", T0] == (1.0, "base") and got["X1", T0 + dt.timedelta(days=9)] == (5.0, "fresh")


def test_merge_rewrites_touched_days_only(spark, store):
    folder = lambda: {r.f for r in store.bars(spark).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    before = folder()
    store.save_bars(option_rows(spark, [("X1", "X", 1, 0, 7.0, 1)]), "fresh")
    gone = before - folder()
    assert gone and all("underlying=X/day=2026-01-06" in f for f in gone)


def test_scans_are_pruned(spark, store):
    one = store.bars(spark, ["X"], "2026-01-06", "2026-01-06", ["X1"])
    assert one.count() == 4
    plan = plan_of(one)
    assert "PartitionFilters: [isnotnull(underlying" in plan and "day=2026-01-06]" in plan and "EqualTo(contract,X1)" in plan
    assert one.select("_metadata.file_path").distinct().count() == 1


def test_days_of_another_table_prune_at_run_time(spark, store):
    days = spark.createDataFrame([("X", dt.date(2026, 1, 6), 1), ("Y", dt.date(2026, 1, 7), 2)], "underlying string, day date, n int")
    path = store.path + "-days"
    days.write.parquet(path)
    out = store.bars_of_days(spark.read.parquet(path).filter("n = 1"))
    plan = plan_of(out)
    assert out.count() == 24 and "dynamicpruning" in plan


def test_no_shuffle_by_contract(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined, counted = plan_of(store.bars_with_contracts(spark)), plan_of(store.traded_days(spark))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in joined and "Exchange" not in joined and "Exchange" not in counted
    assert store.traded_days(spark).filter("n_bars = 4").count() == 54


def test_another_session_finds_the_tables(spark, store):
    fresh = spark.newSession()
    spark.sql(f"DROP TABLE {store._table(spark, 'bars')}")
    assert store.bars(fresh).count() == 216 and store.contracts(fresh).count() == 18


def test_underlyings_come_from_folder_names(spark, store):
    store.save_bars(option_rows(spark, [("BRK/B 1", "BRK/B", 4, 0, 1.0, 0)]))
    got = {r.underlying: (r.n_days, r.first_day, r.last_day) for r in store.underlyings(spark).collect()}
    assert got == {**{u: (3, dt.date(2026, 1, 5), dt.date(2026, 1, 7)) for u in "XYZ"}, "BRK/B": (1, dt.date(2026, 1, 9), dt.date(2026, 1, 9))}


def test_empty_load(spark, store):
    store.save_bars(option_rows(spark, []).limit(0))
    assert store.bars(spark).count() == 216


def test_order_in_one_load_of_bars(spark, tmp_path):
    rows = [("A", T0, 1.0, 9.0, 1.0, 9.0, 1, 1), ("A", T0, 1.0, 2.0, 1.0, 2.0, 1, 2)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long, line long")
    ST.save_bars(df, str(tmp_path / "t"), "us", order=["line"])
    assert [r.close for r in ST.read_table(spark, str(tmp_path / "t")).collect()] == [2.0]


def test_five_minutes_follow_corrections(spark, tmp_path):
    minutes, fives = str(tmp_path / "m"), str(tmp_path / "f")
    make = lambda rows: spark.createDataFrame([("A", T0 + dt.timedelta(minutes=m), p, p, p, p, 1) for m, p in rows], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")
    for load in (make([(0, 1.0), (4, 2.0), (5, 3.0)]), make([(2, 9.0), (4, 1.5)])):
        ST.save_bars(load, minutes, "us")
        ST.save_resampled(load, minutes, fives, "us")
    got = [(r.ts.minute, r.open, r.high, r.close, r.volume) for r in ST.read_table(spark, fives).orderBy("ts").collect()]
    assert got == [(0, 1.0, 9.0, 1.5, 3), (5, 3.0, 3.0, 3.0, 1)]


def test_unreadable_contract_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"symbol": "A", "period_start": "2026-01-05", "filtered_symbols": ["A1", "A2"]}')
    assert ST.read_contract_cache(spark, str(tmp_path)).count() == 2
    (tmp_path / "b.json").write_text('{"symbol": "B", "period')
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ_FILE"):
        ST.read_contract_cache(spark, str(tmp_path)).collect()
    bad = ST.unreadable_contract_documents(spark, str(tmp_path)).collect()
    assert len(bad) == 1 and bad[0].file_path.endswith("b.json") and bad[0].document.startswith('{"symbol": "B"')


def test_counts_and_bounds_come_from_footers(spark, tmp_path):
    """Bounds, counts and sizes of a stored table equal those of its rows, and no row is read for them."""
    t = dt.datetime(2024, 12, 30, 10, 0)
    rows = [(f"s{i % 3}", t + dt.timedelta(days=i // 3), "us", None if i % 5 else float(i)) for i in range(30)]
    path = str(tmp_path / "t")
    ST.write_table(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, market string, pf_x double"), path)
    stored = ST.read_table(spark, path)
    want = stored.groupBy("market", "symbol", "year").agg(F.min(F.to_date("ts")), F.max(F.to_date("ts")), F.count("*")).collect()
    bounds = ST.partition_bounds(spark, path)
    assert sorted(map(tuple, bounds.collect())) == sorted(map(tuple, want)) and len(want) == 6
    plan = bounds._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(date), MAX(date), COUNT(*)]" in plan
    assert [r.first_date for r in ST.date_range(spark, path, ["market"]).collect()] == [t.date()]
    size = ST.table_size(spark, path).first()
    assert (size.n_rows, size.n_features) == (30, 1)
    assert size.n_files == len(stored.inputFiles()) and size.n_bytes == sum(f.stat().st_size for f in (tmp_path / "t").rglob("*.parquet"))
    # Other reads go on as before.
    assert "BatchScan" not in ST.read_table(spark, path)._jdf.queryExecution().executedPlan().toString()
