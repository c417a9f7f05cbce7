from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tapewright.functions import contracts as C
from tapewright.functions import pricing as P
from tapewright.functions.columns import between_dates, clip, finite_or_zero, floor_to, pad_code, ratio, share
from tapewright.params import label_variant, model_variant, session_of


def test_contract_symbols(spark):
    rows = [("AAPL  260109P00270000",), ("TSLA  260320C00350500",), (" F     260320P00012500 ",), ("AAPL",), ("AAPL260109P00270000",), ("",)]
    got = C.with_contract(spark.createDataFrame(rows, "raw string"), "raw").collect()
    assert [(r.underlying, r.expiry, r.cp, r.strike) for r in got] == [
        ("AAPL", dt.date(2026, 1, 9), "P", 270.0),
        ("TSLA", dt.date(2026, 3, 20), "C", 350.5),
        ("F", dt.date(2026, 3, 20), "P", 12.5),
    ]


def test_next_week_friday(spark):
    # Monday 2026-03-09 to the Monday after, with the distance in days.
    days = [(dt.date(2026, 3, 9) + dt.timedelta(i), d) for i, d in enumerate([11, 10, 9, 8, 7, 13, 12, 11])]
    df = spark.createDataFrame(days, "d date, ahead int").select("d", "ahead", C.next_week_friday(F.col("d")).alias("f"))
    for r in df.collect():
        assert r.f.weekday() == 4 and (r.f - r.d).days == r.ahead


def test_friday_after(spark):
    df = spark.createDataFrame([(dt.date(2026, 3, 9) + dt.timedelta(i),) for i in range(8)], "d date")
    for r in df.select("d", C.friday_after(F.col("d"), 7).alias("f")).collect():
        assert r.f.weekday() == 4 and 7 <= (r.f - r.d).days <= 13


def test_weekly_periods(spark):
    df = spark.createDataFrame([("A", dt.date(2026, 3, 4), dt.date(2026, 3, 18))], "symbol string, start date, end date")
    got = sorted((r.period_start, r.period_end) for r in C.weekly_periods(df).collect())
    d = dt.date
    assert got == [(d(2026, 3, 2), d(2026, 3, 9)), (d(2026, 3, 9), d(2026, 3, 16)), (d(2026, 3, 16), d(2026, 3, 18))]


def test_file_end_date(spark):
    df = spark.createDataFrame([("TSLA_XNAS.ITCH_ohlcv-1m_20200101_20260224.dbn.zst",), ("other.csv",)], "f string")
    assert [r[0] for r in df.select(C.file_end_date(F.col("f"))).collect()] == [dt.date(2026, 2, 24), None]


def test_put_value_against_erf(spark):
    def put(s, k, days, vol=0.25, r=0.035):
        if days <= 0:
            return max(k - s, 0.0)
        t = days / 365
        d1 = (math.log(s / k) + (r + vol * vol / 2) * t) / (vol * math.sqrt(t))
        d2 = d1 - vol * math.sqrt(t)
        phi = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
        return max(k * math.exp(-r * t) * phi(-d2) - s * phi(-d1), 0.0)

    cases = [(s, k, d) for s in (20.0, 80.0, 100.0, 130.0, 500.0) for k in (60.0, 100.0, 140.0) for d in (0.0, 0.5, 7.0, 30.0, 365.0)]
    df = spark.createDataFrame(cases, "s double, k double, d double")
    for r in df.select("s", "k", "d", P.put_value(F.col("s"), F.col("k"), F.col("d")).alias("v")).collect():
        assert r.v == pytest.approx(put(r.s, r.k, r.d), abs=1e-9)


def test_strike_ladder(spark):
    def ladder(spot):
        tick = next((t for p, t in P.STRIKE_TICKS if spot >= p), 1)
        money = round(spot / tick) * tick
        out = {round(money * (1 + p) / tick) * tick for p in P.LADDER}
        return sorted(float(s) for s in out if s > 0)

    spots = [0.2, 12.5, 57.0, 102.5, 340.0, 1234.0, 49999.0, 62000.0, 123456.0]
    df = spark.createDataFrame([(s,) for s in spots], "s double")
    for r in df.select("s", P.strike_ladder(F.col("s")).alias("l")).collect():
        assert r.l == ladder(r.s)


def test_fills_and_quotes(spark):
    df = spark.createDataFrame([(5.0, 5.4, 4.8), (5.0, 5.0, 5.0)], "c double, h double, l double")
    cols = (F.col("c"), F.col("h"), F.col("l"))
    got = df.select(P.buy_fill(*cols), P.sell_fill(*cols), P.sell_fill(*cols, floor=4.9)).collect()
    assert got[0][0] == pytest.approx(5.3 * 1.005) and got[0][1] == pytest.approx(4.7 * 0.995)
    assert got[0][2] == pytest.approx(4.9 * 0.995) and got[1][0] == pytest.approx(5.01 * 1.005)
    q = spark.createDataFrame([(500.0,), (0.5,)], "v double").select(P.model_quote(F.col("v")).alias("q")).collect()
    assert (q[0].q.bid, q[0].q.ask) == (495.0, 505.0) and (q[1].q.bid, q[1].q.ask) == (0.0, 1.5)


def test_column_helpers(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double")
    got = df.select(ratio(F.col("a"), F.col("b")), ratio(F.col("a"), F.col("b"), 7), share(F.col("a"), F.col("b"), 0.5)).collect()
    assert [tuple(r) for r in got] == [(math.inf, 7, 0.5), (-math.inf, 7, 0.5), (None, 7, 0.5), (1.5, 1.5, 1.5)]
    odd = spark.createDataFrame([(math.inf,), (math.nan,), (None,), (2.0,)], "x double")
    assert [r[0] for r in odd.select(finite_or_zero(F.col("x"))).collect()] == [0.0, 0.0, 0.0, 2.0]
    assert [r[0] for r in odd.select(clip(F.col("x"), -1, 1)).limit(1).collect()] == [1.0]
    codes = spark.createDataFrame([("5930",), (" 005930",), ("TSLA",)], "c string")
    assert [r[0] for r in codes.select(pad_code(F.col("c"))).collect()] == ["005930", "005930", "TSLA"]


def test_floor_keeps_zone_less_time_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        # 02:30 does not exist in New York on that day; zone-less time must not care.
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:33:41.25' AS ts")
        assert df.select(floor_to(F.col("ts"), 5)).first()[0] == dt.datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("closed, n", [("day", 3), ("midnight", 2), ("open", 1), ("next_midnight", 4)])
def test_date_dialects(spark, closed, n):
    times = ["2024-01-01 10:00:00", "2024-01-02 00:00:00", "2024-01-02 10:00:00", "2024-01-03 00:00:00", "2024-01-03 01:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    assert df.filter(between_dates(F.col("ts"), "2024-01-01", "2024-01-02", closed)).count() == n


def test_variants():
    assert label_variant("L3").shift == 0 and label_variant("L1", "5m").prominence == 0.004
    assert model_variant("M1").fill == "drop" and model_variant("M4", "5m").sequence_lookback == 6
    for bad in (lambda: label_variant("L1", "2m"), lambda: model_variant("M9"), lambda: session_of("jp")):
        with pytest.raises(ValueError):
            bad()


def test_long_roots_keep_their_own_contracts(spark):
    rows = [(r, dt.date(2026, 1, 16), "P", 270.5) for r in ("AAPL", "purchase", "purchaser")]
    df = spark.createDataFrame(rows, "u string, e date, cp string, k double")
    made = df.withColumn("symbol", C.make_symbol(F.col("u"), F.col("e"), F.col("cp"), F.col("k")))
    got = {r.u: r for r in C.with_contract(made).collect()}
    assert got["AAPL"].symbol == "AAPL   260116P00270500" and len({r.symbol for r in got.values()}) == 3
    for u, r in got.items():
        assert (r.underlying, r.expiry, r.strike) == (u.upper(), dt.date(2026, 1, 16), 270.5)


def test_texts_that_are_no_contract(spark):
    texts = ["", "AAPL", "260116P00270000", "AAPL260116P00270000", "A B  260116P00270000", "AAPL 260116X00270000", "AAPL 26011xP00270000", None]
    assert C.with_contract(spark.createDataFrame([(t,) for t in texts], "symbol string")).count() == 0
