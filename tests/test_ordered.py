from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.operators import ordered as O


def _ts(n, rng, days=5):
    return pd.Timestamp("2025-01-01") + pd.to_timedelta(np.sort(rng.choice(days * 86400, n, replace=False)), unit="s")


def _df(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.mark.parametrize("tolerance", [None, "2 minutes", "2 days"])
def test_asof_join(spark, tolerance):
    rng = np.random.default_rng(1)
    # One key holds most rows, one has quotes on the first day only, one has none.
    left = pd.concat([pd.DataFrame({"k": k, "ts": _ts(n, rng), "id": np.arange(n)}) for k, n in (("hot", 400), ("cold", 50), ("none", 5))])
    right = pd.concat([pd.DataFrame({"k": "hot", "ts": _ts(300, rng), "v": rng.random(300)}), pd.DataFrame({"k": "cold", "ts": _ts(3, rng, 1), "v": [1.0, 2.0, 3.0]})])
    got = O.asof_join(_df(spark, left), _df(spark, right), ["k"], ["v"], tolerance=tolerance).toPandas()
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="k", tolerance=pd.Timedelta(tolerance) if tolerance else None)
    got, want = (d.sort_values(["k", "id"], ignore_index=True) for d in (got, want))
    assert len(got) == len(want)
    np.testing.assert_allclose(got["v"].astype(float), want["v"].astype(float), equal_nan=True)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    data = {"skew": rng.exponential(1, 3001) ** 4, "few": rng.integers(0, 4, 500).astype(float), "one": np.array([7.0]), "normal": rng.normal(0, 1, 777)}
    pdf = pd.concat([pd.DataFrame({"k": k, "x": x}) for k, x in data.items()])
    points = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    got = O.quantiles(spark.createDataFrame(pdf), ["k"], "x", points).collect()
    assert len(got) == len(data) * len(points)
    for r in got:
        assert r["quantile"] == pytest.approx(np.quantile(data[r.k], r.q), rel=1e-12, abs=1e-12)


def test_bins_follow_the_values(spark, monkeypatch):
    """Nearly all values in a sliver of the range, negative ones, zeros of both signs, infinities and one far outlier."""
    rng = np.random.default_rng(5)
    x = np.unique(np.concatenate([rng.random(5000) / 4096, -rng.random(500) * 1e9, [0.0, np.inf, -np.inf, 1e300, 5e-324]]))
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x}))
    got = O.value_bins(df, ["k"], "x", most=40).toPandas().sort_values("x", ignore_index=True)
    assert list(got["x"]) == list(x) and got["_bin"].is_monotonic_increasing
    assert got.groupby("_bin").size().max() <= 40
    monkeypatch.setattr(O.value_bins, "__defaults__", (16,))
    data = {"equal": np.concatenate([np.full(9900, 0.5), rng.random(100)]), "near": 0.5 + rng.random(3000) * 1e-12, "signs": np.array([-0.0, 0.0, -1.0, 1.0])}
    pdf = pd.concat([pd.DataFrame({"k": k, "x": v}) for k, v in data.items()])
    for r in O.quantiles(spark.createDataFrame(pdf), ["k"], "x", (0.0, 0.25, 0.5, 0.99, 1.0)).collect():
        assert r["quantile"] == pytest.approx(np.quantile(data[r.k], r.q), rel=1e-14, abs=0), (r.k, r.q)


def test_shared_times_give_the_same(spark):
    rng = np.random.default_rng(7)
    times = _ts(60, rng)
    left = pd.concat([pd.DataFrame({"m": m, "symbol": s, "ts": times, "v": i}) for i, (m, s) in enumerate([("us", "A"), ("us", "B"), ("kr", "C"), (None, "D")])])
    right = pd.DataFrame({"m": rng.choice(["us", "kr"], 40), "ts": _ts(40, rng), "x": rng.random(40)})
    both = [
        sorted(map(str, O.asof_join(_df(spark, left), _df(spark, right), ["m"], ["x"], tolerance=t, matched="at", shared_times=shared).collect()))
        for t in (None, "30 minutes") for shared in (False, True)
    ]
    assert both[0] == both[1] and both[2] == both[3] and len(both[0]) == len(left)


def test_running_totals(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 500), "x": rng.permutation(500), "n": rng.integers(0, 9, 500)})
    df = spark.createDataFrame(pdf).withColumn("bin", F.floor(F.col("x") / 37))
    for down in (False, True):
        order = F.desc("x") if down else F.asc("x")
        got = O.running_totals(df, ["k"], "bin", [order], ["n"], descending=down).toPandas().sort_values("x")
        want = pdf.sort_values("x", ascending=not down)
        want["c"] = want.groupby("k")["n"].cumsum()
        assert list(got["cum_n"]) == list(want.sort_values("x")["c"])
