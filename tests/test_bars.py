from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewright.operators import bars as B
from tapewright.sources import tables as ST

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def _bars(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _minutes(start, n):
    return [start + dt.timedelta(minutes=i) for i in range(n)]


def test_five_minutes_become_one(spark):
    t = _minutes(dt.datetime(2025, 1, 2, 9, 0), 5)
    high, low = [105, 110, 108, 107, 106], [95, 96, 97, 98, 99]
    rows = [("A", t[i], 100.0 + i, float(high[i]), float(low[i]), 101.0 + i, 10 * (i + 1)) for i in range(5)]
    got = B.resample(_bars(spark, rows)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.ts, r.open, r.high, r.low, r.close, r.volume) == (t[0], 100.0, 110.0, 95.0, 105.0, 150)


def test_gaps_and_days_do_not_mix(spark):
    times = [dt.datetime(2025, 1, 2, 9, 4), dt.datetime(2025, 1, 2, 9, 11), dt.datetime(2025, 1, 3, 9, 4)]
    rows = [("A", t, 1.0, 1.0, 1.0, 1.0, 1) for t in times]
    got = sorted(r.ts for r in B.resample(_bars(spark, rows)).collect())
    assert got == [dt.datetime(2025, 1, 2, 9, 0), dt.datetime(2025, 1, 2, 9, 10), dt.datetime(2025, 1, 3, 9, 0)]


def test_first_source_marks_all_bars(spark):
    t = _minutes(dt.datetime(2025, 1, 2, 9, 0), 10)
    rows = [("A", x, 1.0, 1.0, 1.0, 1.0, 1) for x in t]
    df = _bars(spark, rows).withColumn("source", F.when(F.minute("ts") == 0, "first").otherwise("later"))
    assert {r.source for r in B.resample(df).collect()} == {"first"}


def test_ticks_at_the_same_instant_follow_their_number(spark):
    t = dt.datetime(2025, 1, 2, 9, 0, 1)
    df = spark.createDataFrame([("A", t, float(p), 1, i) for i, p in enumerate([5, 9, 2, 7])], "symbol string, ts timestamp_ntz, price double, volume long, id long")
    r = B.bars_from_ticks(df, order=("ts", "id")).first()
    assert (r.open, r.high, r.low, r.close, r.volume) == (5.0, 9.0, 2.0, 7.0, 4)


@pytest.mark.parametrize("market, first, last", [("kr", dt.time(9, 0), dt.time(15, 29)), ("us", dt.time(9, 30), dt.time(15, 59))])
def test_session_edges(spark, market, first, last):
    rows = [("A", t, 1.0, 1.0, 1.0, 1.0, 1) for t in _minutes(dt.datetime(2025, 1, 2, 8, 30), 480)]
    got = B.session_bars(_bars(spark, rows), market).orderBy("ts").collect()
    assert len(got) == 390 and (got[0].ts.time(), got[-1].ts.time()) == (first, last)
    assert [r.minutes_from_open for r in got] == list(range(390))


def test_normalise(spark):
    df = _bars(spark, [("A", dt.datetime(2025, 1, 2), 1.0, 1.0, 1.0, 1.0, None)]).withColumn("source", F.lit("old"))
    assert B.normalise(df).first().source == "old" and B.normalise(df, "new").first().source == "new"
    assert B.normalise(df.drop("source")).first().source == "" and B.normalise(df).first().volume == 0
    with pytest.raises(ValueError, match="close"):
        B.normalise(df.drop("close"))


def test_vendor_names(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 2), 1.0, 2.0, 0.5, 1.5, 7)], "`날짜` timestamp, `시가` double, `고가` double, `저가` double, `종가` double, `거래량` long")
    got = B.normalise(B.rename_vendor(df), "x", keys=()).first()
    assert (got.open, got.high, got.low, got.close, got.volume) == (1.0, 2.0, 0.5, 1.5, 7)


def test_venue_order_decides_open_and_close(spark):
    t = dt.datetime(2025, 1, 2, 9, 0)
    rows = [
        ("A", "ARCX.PILLAR", t, 3.0, 3.5, 2.0, 3.3, 5), ("A", "XNAS.ITCH", t + dt.timedelta(seconds=40), 1.0, 1.5, 0.9, 1.1, 5),
        ("A", "XNYS.PILLAR", t, 2.0, 9.0, 1.0, 2.2, 5), ("A", "XNAS.ITCH", t, 0.1, 99.0, 0.1, 0.1, 0), ("A", "XNYS.PILLAR", t, None, 99.0, 0.0, 1.0, 5),
    ]
    r = B.merge_venues(spark.createDataFrame(rows, SCHEMA.replace("symbol string", "symbol string, venue string"))).first()
    assert (r.ts, r.open, r.high, r.low, r.close, r.volume) == (t, 1.0, 9.0, 0.9, 3.3, 15)


def test_validation_flags(spark):
    t = dt.datetime(2025, 1, 2)
    good, bad = ("A", t, 1.0, 1.0, 1.0, 1.0, 0), ("B", t, 1.0, 1.0, -1.0, 1.0, 5)
    got = {r.symbol: r for r in B.validate_bars(_bars(spark, [good, bad, bad])).collect()}
    assert got["A"].valid and got["A"].zero_volume_share == 1.0
    assert not got["B"].valid and (got["B"].negative_prices, got["B"].duplicate_ts) == (2, 1)


def test_gaps(spark):
    t = [dt.datetime(2025, 1, 2, 9, m) for m in (0, 1, 2, 3, 10)]
    got = B.gaps(_bars(spark, [("A", x, 1.0, 1.0, 1.0, 1.0, 1) for x in t])).collect()
    assert [(r.gap_start, r.gap_seconds) for r in got] == [(dt.datetime(2025, 1, 2, 9, 4), 360.0)]


def test_saved_bars_merge_and_split_by_year(spark, tmp_path):
    path = str(tmp_path / "bars")
    days = [dt.datetime(2024, 12, 31, 10, i) for i in range(3)] + [dt.datetime(2025, 1, 2, 10, i) for i in range(3)]
    ST.save_bars(_bars(spark, [("A", t, 1.0, 1.0, 1.0, 1.0, 1) for t in days]), path, "us", "one")
    ST.save_bars(_bars(spark, [("A", days[-1], 1.0, 1.0, 1.0, 5.0, 1), ("A", days[-1] + dt.timedelta(minutes=1), 1.0, 1.0, 1.0, 6.0, 1)]), path, "us", "two")
    df = ST.read_table(spark, path, "us", ["A"], schema=ST.BAR_SCHEMA)
    got = {(r.ts, r.close, r.source) for r in df.collect()}
    assert len(got) == 7 and (days[-1], 5.0, "two") in got and (days[0], 1.0, "one") in got
    assert {r.year: r.n_rows for r in ST.partition_counts(spark, path).collect()} == {2024: 3, 2025: 4}
    assert ST.read_table(spark, path, "us", ["A"], "2025-01-01", schema=ST.BAR_SCHEMA).count() == 4
    plan = ST.read_table(spark, path, "us", ["A"], "2025-01-01", schema=ST.BAR_SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(market" in plan and "PushedFilters: [IsNotNull(ts)" in plan


def test_codes_are_padded_on_save(spark, tmp_path):
    path = str(tmp_path / "kr")
    ST.save_bars(_bars(spark, [("5930", dt.datetime(2025, 1, 2, 9), 1.0, 1.0, 1.0, 1.0, 1)]), path, "kr", pad=True)
    assert [r.symbol for r in ST.read_table(spark, path, schema=ST.BAR_SCHEMA).collect()] == ["005930"]


def test_weekly_cache_documents(spark, tmp_path):
    (tmp_path / "symbols_1.json").write_text(
        '{\n "symbol": "AAPL", "period_start": "2026-01-05", "period_end": "2026-01-12",\n "stock_close": 260.5, "filtered_symbols": ["AAPL  260109P00270000", "AAPL  260109P00265000"]}'
    )
    (tmp_path / "symbols_2.json").write_text("{ broken")
    got = ST.read_contract_cache(spark, str(tmp_path), skip_unreadable=True).collect()
    assert sorted(r.contract for r in got) == ["AAPL  260109P00265000", "AAPL  260109P00270000"]
    assert {(r.period_start, r.stock_close) for r in got} == {(dt.date(2026, 1, 5), 260.5)}


def test_history_and_replay_dates(spark):
    days = [dt.datetime(2025, 1, d, 10) for d in (2, 3, 6, 7, 8, 9, 10)]
    df = B.session_bars(_bars(spark, [("A", t, 1.0, 1.0, 1.0, 1.0, 1) for t in days]), "us")
    assert sorted(r.date.day for r in B.replay_dates(df).collect()) == [9, 10]
    recent = B.recent_dates(df, target="2025-01-09").collect()
    assert sorted((r.date.day, r.is_target) for r in recent) == [(2, False), (3, False), (6, False), (7, False), (8, False), (9, True)]


def test_last_row_of_a_load_wins(spark):
    new = spark.createDataFrame([("A", 1, 10.0, 1), ("A", 1, 7.0, 3), ("A", 1, 9.0, 2), ("B", 1, 1.0, 0)], "symbol string, ts int, close double, seq int")
    old = spark.createDataFrame([("A", 1, 99.0, 9), ("C", 1, 5.0, 0)], "symbol string, ts int, close double, seq int")
    for parts in (1, 4):
        got = {r.symbol: r.close for r in B.merge_loads(old, new.repartition(parts), order=["seq"]).collect()}
        assert got == {"A": 7.0, "B": 1.0, "C": 5.0}
        # Without an order the rows' values decide, whichever comes first.
        assert {r.close for r in B.merge_loads(old, new.drop("seq").repartition(parts)).filter("symbol = 'A'").collect()} == {10.0}
