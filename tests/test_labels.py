from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.operators import labels as L
from tapewright.params import LabelVariant


def _peaks(x, least, distance, width):
    """Brute force: local maxima, distance, prominence, width at half prominence."""
    n, found, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < n and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(found, key=lambda k: (-x[k], -k)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = {}
    for p in sorted(kept):
        a = next((k for k in range(p, -1, -1) if x[k] > x[p]), -1)
        b = next((k for k in range(p, n) if x[k] > x[p]), n)
        prom = x[p] - max(min(x[a + 1 : p + 1]), min(x[p:b]))
        level = x[p] - prom / 2
        i = next(k for k in range(p, -1, -1) if x[k] <= level)
        j = next(k for k in range(p, n) if x[k] <= level)
        left = i + (level - x[i]) / (x[i + 1] - x[i])
        right = j - (level - x[j]) / (x[j - 1] - x[j])
        if prom >= least and right - left >= width:
            out[p] = (prom, right - left)
    return out


def _days(spark, series):
    rows = []
    for d, x in enumerate(series):
        start = dt.datetime(2025, 1, 2, 9, 30) + dt.timedelta(days=d)
        rows += [("A", start.date(), start + dt.timedelta(minutes=i), float(x[0]), float(c)) for i, c in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, date date, ts timestamp_ntz, open double, close double")


@pytest.mark.parametrize("v", [LabelVariant(0.003, 3, 5, 1), LabelVariant(0.002, 1, 5, 0), LabelVariant(0.0, 1, 1, 2), LabelVariant(0.01, 2, 10, 1)])
def test_against_brute_force(spark, v):
    rng = np.random.default_rng(7)
    # Coarse rounding makes plateaus and equal heights frequent.
    series = [np.round(100 + np.cumsum(rng.normal(0, 0.4, n)), 1) for n in (10, 60, 200, 390)] + [np.round(100 + rng.integers(0, 3, 120), 1)]
    df = _days(spark, series)
    got = L.turning_points(df, v).toPandas()
    labels = L.label_bars(df, v).toPandas().sort_values(["date", "ts"])
    for d, x in enumerate(series):
        day = dt.date(2025, 1, 2) + dt.timedelta(days=d)
        want = np.zeros(len(x), int)
        for kind, sign in ((1, 1), (2, -1)):
            exp = _peaks(list(sign * x), x[0] * v.prominence, v.distance, v.width)
            mine = got[(got["date"] == day) & (got["kind"] == kind)].sort_values("bar")
            assert list(mine["bar"]) == sorted(exp)
            np.testing.assert_allclose(mine["prominence"], [exp[k][0] for k in sorted(exp)], atol=1e-9)
            np.testing.assert_allclose(mine["width"], [exp[k][1] for k in sorted(exp)], atol=1e-9)
            for k in exp:
                if k + v.shift < len(x):
                    want[k + v.shift] = kind
        assert list(labels[labels["date"] == day]["label"]) == list(want)


def test_sine_has_its_extremes(spark):
    x = np.round(50000 + 250 * np.sin(np.linspace(0, 4 * np.pi, 60)), 3)
    v = LabelVariant(0.003, 1, 5, 1)
    got = L.turning_points(_days(spark, [x]), v).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {1: 2, 2: 2}


def test_flat_and_short_days(spark):
    v = LabelVariant(0.002, 1, 5, 1)
    df = _days(spark, [np.full(30, 100.0), np.arange(9.0), np.arange(20.0)])
    got = L.label_bars(df, v)
    assert got.count() == 50 and got.filter("label <> 0").count() == 0


def test_grid_counts(spark):
    x = np.round(100 + np.cumsum(np.random.default_rng(3).normal(0, 0.5, 120)), 2)
    got = L.parameter_grid(_days(spark, [x])).toPandas()
    assert len(got) == 6 * 4 * 4
    for r in got.sample(12, random_state=1).itertuples():
        least = x[0] * r.prominence_pct
        assert r.n_peaks == len(_peaks(list(x), least, r.distance, r.width))
        assert r.n_troughs == len(_peaks(list(-x), least, r.distance, r.width))
        assert r.label_ratio == pytest.approx((r.n_peaks + r.n_troughs) / 120)


def test_overrides(spark):
    t = dt.datetime(2025, 1, 2)
    auto = spark.createDataFrame([("A", t, 1), ("B", t, 0)], "symbol string, ts timestamp_ntz, label int")
    manual = spark.createDataFrame([("A", t, 2)], auto.schema)
    assert {(r.symbol, r.label) for r in L.apply_overrides(auto, manual).collect()} == {("A", 2), ("B", 0)}
    edits = spark.createDataFrame([("A", t, 0, 1), ("B", t, 1, 2)], "symbol string, ts timestamp_ntz, label int, seq long")
    assert [(r.symbol, r.label) for r in L.edit_overrides(manual, edits).collect()] == [("B", 1)]
