from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.operators import features as X
from tapewright.operators.bars import session_bars


def _expected(one: pd.DataFrame) -> pd.DataFrame:
    """Features of one symbol's bars of one year, written with pandas."""
    o, h, lo, c, v = (one[k].astype(float) for k in ("open", "high", "low", "close", "volume"))
    day = one["ts"].dt.date
    first = o.groupby(day).transform("first")
    out = pd.DataFrame({"symbol": one["symbol"], "ts": one["ts"]})
    for k in (1, 2, 3, 5, 10):
        out[f"pf_return_{k}m"] = c.pct_change(k)
    direction = np.sign(c - o)
    run = (direction != direction.shift()).cumsum()
    out["pf_consec_direction"] = (direction.groupby(run).cumcount() + 1) * direction
    out["pf_momentum_10"] = c / c.rolling(10).mean() - 1
    out["pf_acceleration"] = c.pct_change().diff()
    top, bottom = h.groupby(day).cummax(), lo.groupby(day).cummin()
    out["pf_range_position"] = np.where(top > bottom, (c - bottom) / (top - bottom), 0.5)
    out["vf_vol_ma20_ratio"] = np.where(v.rolling(20, min_periods=1).mean() > 0, v / v.rolling(20, min_periods=1).mean(), 1.0)
    out["vf_vol_change"] = v.pct_change().fillna(0).clip(-10, 10)
    signed = v * np.sign(c.diff().fillna(0))
    out["vf_obv"] = signed.groupby(day).cumsum()
    out["vf_cum_vol_share"] = v.groupby(day).cumsum() / v.groupby(day).transform("sum")

    def rsi(n):
        d = c.diff()
        gain, loss = d.clip(lower=0).ewm(span=n, adjust=False).mean(), (-d).clip(lower=0).ewm(span=n, adjust=False).mean()
        return 1 - 1 / (1 + np.where(loss > 0, gain / loss, 100))

    out["tf_rsi7"], out["tf_rsi14"] = rsi(7), rsi(14)
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    out["tf_macd"], out["tf_macd_signal"] = macd / first, macd.ewm(span=9, adjust=False).mean() / first
    sd = c.rolling(20, min_periods=1).std().fillna(0)
    out["tf_bb_width"] = 4 * sd / first
    return out




def test_features_agree_with_pandas(spark, bars):
    df, pdf = bars
    got = X.build_features(session_bars(df, "us")).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    groups = [g.reset_index(drop=True) for _, g in pdf.groupby([pdf["symbol"], pdf["ts"].dt.year])]
    # 780 bars in one series: the smoothing carries over a block boundary.
    assert max(len(g) for g in groups) > X.BLOCK
    want = pd.concat([_expected(g) for g in groups]).sort_values(["symbol", "ts"], ignore_index=True)
    assert len([c for c in got.columns if c.startswith(("pf_", "vf_", "tf_", "tmf_"))]) == 51
    for name in want.columns[2:]:
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), rtol=1e-9, atol=1e-10, err_msg=name, equal_nan=True)


def test_first_bar_defaults(spark, bars):
    got = X.build_features(session_bars(bars[0], "us")).filter("symbol = 'BBB' AND minutes_from_open = 0").first()
    assert got.pf_return_1m is None and got.pf_acceleration is None and got.pf_momentum_5 is None
    assert got.tf_rsi7 == pytest.approx(1 - 1 / 101) and got.tf_bb_width == 0 and got.tf_bb_position == 0.5
    assert got.vf_vol_change == 0 and got.tmf_session_phase == 0 and got.tmf_is_first_hour == 1


def test_flat_prices(spark, bars):
    flat = bars[0].select("symbol", "ts", *[F.lit(50.0).alias(c) for c in ("open", "high", "low", "close")], F.lit(10).cast("long").alias("volume"))
    got = X.build_features(session_bars(flat, "us")).agg(
        *[F.min(c).alias(f"a_{c}") for c in ("pf_range_position", "pf_body_ratio", "tf_stoch", "vf_vol_spike")],
        F.max("tf_rsi14").alias("rsi"), F.max("pf_consec_direction").alias("run"),
    ).first()
    assert (got.a_pf_range_position, got.a_pf_body_ratio, got.a_tf_stoch, got.a_vf_vol_spike) == (0.5, 0.0, 0.5, 1.0)
    assert got.rsi == pytest.approx(1 - 1 / 101) and got.run == 0


def test_empty_input(spark, bars):
    out = X.clean_features(X.add_lags(X.build_features(session_bars(bars[0].limit(0), "us")), 2))
    assert out.count() == 0 and len(X.feature_columns(out)) == 51 * 3


def test_lags_and_cleaning(spark, bars):
    base = X.build_features(session_bars(bars[0], "us"))
    assert X.feature_columns(base)[0] == "pf_acceleration"
    filled, dropped = X.add_lags(base, 5), X.add_lags(base, 5, "drop")
    # Two bars have no acceleration, so five lags lose seven bars of each of the three series.
    assert filled.count() - dropped.count() == 7 * 3
    assert X.add_lags(base, 0) is base
    clean = X.clean_features(filled)
    bad = clean.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in X.feature_columns(clean)]).first()
    assert sum(bad) == 0


def test_gaps_take_the_days_last_value(spark):
    rows = [("A", f"2025-01-0{d} 10:0{i}:00", x) for d, xs in ((2, [None, 1.0, None, float("inf")]), (3, [None, 2.0])) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, t string, pf_x double").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    assert [r.pf_x for r in X.clean_features(df).orderBy("ts").collect()] == [0.0, 1.0, 1.0, 1.0, 0.0, 2.0]


def test_one_exchange_serves_all_windows(spark, bars):
    stored = session_bars(bars[0], "us")
    plan = X.build_features(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_sequences(spark, bars):
    s = session_bars(bars[0], "us")
    dropped, padded = X.sequences(s, 5, "drop", ["close"]), X.sequences(s, 5, "0fill", ["close"])
    assert s.count() - dropped.count() == 4 * 4 and padded.count() == s.count()
    first = padded.filter("symbol = 'BBB' AND minutes_from_open = 1").first()
    assert [round(x[0], 2) for x in first.seq[:3]] == [0.0, 0.0, 0.0] and first.seq[4][0] == pytest.approx(first.close, rel=1e-6)


def test_index_tolerance(spark):
    bars = spark.sql("SELECT 'm' AS market, 'A' AS symbol, explode(array(TIMESTAMP_NTZ '2025-01-02 10:01:00', TIMESTAMP_NTZ '2025-01-02 10:05:00')) AS ts")
    index = spark.sql("SELECT 'm' AS market, explode(array(TIMESTAMP_NTZ '2025-01-02 09:59:00', TIMESTAMP_NTZ '2025-01-02 10:00:00')) AS ts, 10.0D AS close")
    got = [r.mf_idx_return_1m for r in X.add_index_features(bars, index).orderBy("ts").collect()]
    assert got == [0.0, None]


def test_smoothed_means_of_any_span(spark):
    rng = np.random.default_rng(5)
    x = 100 + rng.normal(size=4000).cumsum()
    pdf = pd.DataFrame({"symbol": "A", "year": 2024, "_rn": np.arange(1, 4001), "x": x})
    pdf["ts"] = pd.Timestamp("2024-01-02") + pd.to_timedelta(pdf["_rn"], unit="min")
    df = spark.createDataFrame(pdf).withColumn("date", F.to_date("ts"))
    spans = (1, 2, 5, 26, 60, 200, 1000)
    got = X.smoothed(df, {f"s{k}": (F.col("x"), k, 1) for k in spans}).toPandas().sort_values("_rn")
    for k in spans:
        want = pd.Series(x).ewm(span=k, adjust=False).mean()
        np.testing.assert_allclose(got[f"s{k}"], want, rtol=1e-10, err_msg=str(k))
