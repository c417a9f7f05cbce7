from __future__ import annotations

import datetime as dt
import math
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.operators import metrics as M
from tapewright.operators import models as ML
from tapewright.operators import ordered as O
from tapewright.operators import splits as S
from tapewright.operators import summaries as U
from tapewright.plans import models as P


def _ap(y, s):
    total, hit, seen, out = y.sum(), 0, 0, 0.0
    for v in sorted(set(s), reverse=True):
        m = s == v
        hit, seen = hit + y[m].sum(), seen + m.sum()
        out += y[m].sum() / total * hit / seen if total else 0
    return out


def test_average_precision(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 800), "s": np.round(rng.random(800), 2), "y": rng.random(800) < 0.2})
    pdf = pd.concat([pdf, pd.DataFrame({"g": "none", "s": [0.1, 0.2], "y": [False, False]}), pd.DataFrame({"g": "all", "s": [0.9, 0.1], "y": [True, False]})])
    got = {r.g: r.pr_auc for r in M.average_precision(spark.createDataFrame(pdf), ["g"], "s", "y").collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(_ap(part["y"].to_numpy(), part["s"].to_numpy()))
    assert got["all"] == 1.0 and got["none"] == 0.0


def test_thresholds(spark):
    df = spark.createDataFrame([("g", 0.9, True), ("g", 0.6, False), ("g", 0.35, True), ("g", 0.1, False)], "g string, s double, y boolean")
    got = {r.threshold: r for r in M.threshold_table(df, ["g"], "s", "y").collect()}
    assert (got[0.3].precision, got[0.3].recall, got[0.3].predicted_positives) == (0.6667, 1.0, 3)
    assert (got[0.7].precision, got[0.7].recall, got[0.7].f1) == (1.0, 0.5, 0.6667)


def _bars(spark, rows):
    base = dt.datetime(2025, 1, 2, 9, 30)
    full = [(s, base + dt.timedelta(minutes=i), *r) for s, part in rows.items() for i, r in enumerate(part)]
    return spark.createDataFrame(full, "symbol string, ts timestamp_ntz, close double, label int, p double, t double")


def test_nearest_prediction_prefers_the_earlier(spark):
    hits = {2: 0.9, 6: 0.9}
    df = _bars(spark, {"A": [(1.0, 1 if i in (4, 8, 0) else 0, hits.get(i, 0.0), 0.0) for i in range(10)]})
    got = M.nearest_event(df, F.col("label") == 1, F.col("p") >= 0.5).orderBy("ts").collect()
    assert [r.error_bars for r in got] == [2, -2, -2]
    te = M.time_error(df, "p", 1, tolerance=2).first()
    assert (te.total_actual, te.total_predicted, te.matched) == (3, 2, 3)
    assert te.mae_bars == 2 and te.on_time_pct == 1.0 and te.within_1 == 0.0 and te.std_error_bars == pytest.approx(np.std([2, -2, -2]))


def _walk(close, p, t, slip=0.001):
    pos, entry, out = 0, 0.0, []
    for i in range(1, len(close)):
        if pos == 0 and t[i]:
            pos, entry = 1, close[i] * (1 + slip)
        elif pos == 1 and p[i]:
            out.append((close[i] * (1 - slip) - entry) / entry)
            pos = 0
    return out


def test_signal_pairs_against_a_walk(spark):
    rng = np.random.default_rng(5)
    rows = {s: [(float(c), 0, float(a), float(b)) for c, a, b in zip(100 + rng.random(200), rng.random(200) < 0.25, rng.random(200) < 0.25)] for s in ("A", "B")}
    rows["C"] = [(1.0, 0, 0.0, 1.0)] * 5
    df = _bars(spark, rows)
    pairs = M.signal_pairs(df, "p", "t")
    got = pairs.toPandas()
    for s, part in rows.items():
        want = _walk([r[0] for r in part], [r[2] for r in part], [r[3] for r in part])
        np.testing.assert_allclose(got[got["symbol"] == s].sort_values("exit_ts")["pnl_pct"], want)
    out = {r.symbol: r for r in M.pairing_summary(df, pairs).collect()}
    want = _walk(*[[r[k] for r in rows["A"]] for k in (0, 2, 3)])
    assert out["A"].n_trades == len(want) and out["A"].total_return == pytest.approx(np.prod(1 + np.array(want)) - 1)
    assert (out["C"].n_trades, out["C"].total_return, out["C"].win_rate) == (0, 0.0, 0.0)


BUY, SELL, NONE = (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)
AT_ZERO = {
    "gain": ((0.0, NONE), (0.0, BUY), (2.0, SELL)),
    "none": ((1.0, NONE), (0.0, BUY), (0.0, SELL)),
    "ruin": ((1.0, NONE), (1.0, BUY), (0.0, SELL), (0.0, BUY), (3.0, SELL)),
    "flat": ((0.0, NONE), (0.0, NONE)),
    "plain": ((1.0, NONE), (1.0, BUY), (2.0, SELL)),
}


def _at_zero(spark):
    return _bars(spark, {s: [(close, 0, *signal) for close, signal in bars] for s, bars in AT_ZERO.items()})


def test_pairs_bought_at_a_price_of_zero(spark):
    """Gains are infinite, or NaN where the sale is at 0 too; other pairs stay as they are."""
    pairs = M.signal_pairs(_at_zero(spark), "p", "t").orderBy("exit_ts").collect()
    got = {s: [r.pnl_pct for r in pairs if r.symbol == s] for s in AT_ZERO}
    assert got["gain"] == [math.inf] and np.isnan(got["none"]).tolist() == [True] and got["ruin"] == [-1.0, math.inf]
    assert got["flat"] == [] and got["plain"] == [pytest.approx(1.998 / 1.001 - 1)]


def test_pairing_summary_of_prices_of_zero(spark):
    df = _at_zero(spark)
    out = {r.symbol: r for r in M.pairing_summary(df, M.signal_pairs(df, "p", "t")).collect()}
    assert out["gain"].total_return == math.inf and out["gain"].buy_hold_return == math.inf
    assert math.isnan(out["none"].total_return) and out["none"].buy_hold_return == -1.0
    assert math.isnan(out["ruin"].total_return) and out["ruin"].n_trades == 2 and out["ruin"].win_rate == 0.5
    assert math.isnan(out["flat"].buy_hold_return) and (out["flat"].n_trades, out["flat"].total_return) == (0, 0.0)
    assert out["plain"].total_return == pytest.approx(1.998 / 1.001 - 1)


def test_decisions(spark):
    df = spark.createDataFrame([(0.6, 0.4), (0.4, 0.6), (0.6, 0.6), (0.4, 0.4)], "p double, t double")
    got = df.select(M.decide(F.col("p"), F.col("t"), 0.5), M.decide(F.col("p"), F.col("t"), 0.5, "peak")).collect()
    assert [tuple(r) for r in got] == [(1, 1), (2, 2), (0, 1), (0, 0)]


def test_split_falls_back_to_ratios(spark):
    df = spark.createDataFrame([(f"s{i % 3}", dt.datetime(2025, 1, 1) + dt.timedelta(hours=i // 3)) for i in range(90)], "symbol string, ts timestamp_ntz")
    got = S.time_split(df).groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    by = {r.split: r for r in got}
    assert {k: r.n for k, r in by.items()} == {"train": 54, "val": 18, "test": 18}
    assert by["train"].b <= by["val"].a and by["val"].b <= by["test"].a


@pytest.mark.parametrize("kind", ["one time", "equal rows", "mixed"])
def test_ratio_split_inside_one_time(spark, monkeypatch, kind):
    """Positions follow time, tie and digest whatever the number of rows with one time, and equal rows are dealt by number."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    t = dt.datetime(2025, 1, 1)
    made = {
        "one time": [(t, f"s{i:03d}", i) for i in range(101)],
        "equal rows": [(t, "s", 1)] * 53,
        "mixed": [(None, "a", 1)] * 3 + [(t, None, 2)] * 20 + [(t, "b", i % 2) for i in range(40)] + [(t + dt.timedelta(days=1), "c", 3)] * 31,
    }[kind]
    df = spark.createDataFrame(made, "ts timestamp_ntz, symbol string, x int").repartition(4)
    got = S.ratio_split(df).collect()
    n = len(made)
    assert sorted(map(repr, [r[:3] for r in got])) == sorted(map(repr, made))
    rank = {"train": 0, "val": 1, "test": 2}
    sizes = [sum(r.split == k for r in got) for k in rank]
    assert sizes == [int(n * 0.6), int(n * 0.8) - int(n * 0.6), n - int(n * 0.8)]
    order = sorted((rank[r.split], r.ts is not None, r.ts or t, r.symbol is not None, r.symbol or "") for r in got)
    assert [o[1:] for o in order] == sorted(o[1:] for o in order)


def test_splits_of_nothing(spark):
    empty = spark.createDataFrame([], "ts timestamp_ntz, symbol string")
    assert S.time_split(empty).count() == 0 and S.walk_forward(empty).count() == 0


def test_splits_read_the_input_twice(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "a") for i in range(366)], "ts timestamp_ntz, symbol string")
    df.write.parquet(str(tmp_path / "in"))
    plan = S.walk_forward(spark.read.parquet(str(tmp_path / "in")))._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Relation [ts" in line and "symbol" in line]) == 1


def test_walk_forward(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=i),) for i in range(366)], "ts timestamp_ntz")
    got = S.walk_forward(df, train_months=6, test_months=1).groupBy("fold", "role").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    by = {(r.fold, r.role): r for r in got}
    assert len({f for f, _ in by}) == 6
    for f in range(6):
        assert by[f, "train"].b < by[f, "test"].a
    assert S.walk_forward(df.limit(5)).count() == 0
    assert S.walk_forward(df.limit(0)).count() == 0


def test_walk_forward_bounds_step_by_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 10, 31),), (dt.datetime(2024, 4, 30),)], "ts timestamp_ntz")
    got = [(f.fold, f.start, f.cut, f.stop) for f in S.fold_bounds(df, train_months=2, test_months=1).first().folds]
    # Month ends are clamped step by step: from November on every fold starts at the 30th or 29th.
    day = dt.datetime
    assert got == [
        (0, day(2023, 10, 31), day(2023, 12, 31), day(2024, 1, 31)),
        (1, day(2023, 11, 30), day(2024, 1, 30), day(2024, 2, 29)),
        (2, day(2023, 12, 30), day(2024, 2, 29), day(2024, 3, 29)),
        (3, day(2024, 1, 30), day(2024, 3, 30), day(2024, 4, 30)),
    ]


def test_best_weight(spark):
    rng = np.random.default_rng(8)
    y = rng.random(600) < 0.3
    pdf = pd.DataFrame({"g": "x", "a": rng.random(600), "b": np.clip(y * 0.5 + rng.random(600) * 0.6, 0, 1), "y": y})
    flat = pd.DataFrame({"g": "none", "a": [0.1, 0.2], "b": [0.3, 0.4], "y": [False, False]})
    same = pd.DataFrame({"g": "same", "a": [0.1, 0.9], "b": [0.1, 0.9], "y": [False, True]})
    got = {r.g: r for r in ML.best_weight(spark.createDataFrame(pd.concat([pdf, flat, same])), ["g"], "a", "b", "y").collect()}
    best, top = 1.0, _ap(y, pdf["a"].astype("float32").to_numpy())
    for w in ML.WEIGHTS:
        ap = _ap(y, (w * pdf["a"] + (1 - w) * pdf["b"]).astype("float32").to_numpy())
        if ap > top + 1e-12:
            best, top = w, ap
    assert got["x"].w_gbm == pytest.approx(best) and got["x"].val_pr_auc == pytest.approx(top, abs=1e-9)
    assert (got["none"].w_gbm, got["none"].val_pr_auc) == (0.7, 0.0) and got["same"].w_gbm == 1.0


def test_calibrated_scores_keep_their_places(spark):
    df = spark.createDataFrame([(i / 20, int(i > 10)) for i in range(21)], "s double, y int")
    model = ML.calibrate(df, "s", "y")
    near = spark.createDataFrame([(0.5 + d,) for d in (0.0, 1e-8, 2e-8, 0.01)], "s double")
    got = [r.c for r in ML.calibrated(model, near, "s", "c").orderBy("s").collect()]
    assert got[0] < got[1] < got[2] < got[3]


def test_calibration_is_monotone(spark):
    rng = np.random.default_rng(9)
    s = rng.random(500)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": rng.random(500) < s**2}))
    out = ML.calibrated(ML.calibrate(df, "s", "y"), df, "s", "c").toPandas().sort_values("s")
    assert out["c"].between(0, 1).all() and (out["c"].diff().dropna() >= -1e-12).all()


def test_summaries(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 4.0, float("inf")], "b": [2.0, 4.0, 6.0, 8.0, 10.0]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double")
    got = {r.feature: r for r in U.feature_summary(df, ["a", "b"]).collect()}
    assert (got["a"]["count"], got["a"].null_count, got["a"].inf_count) == (4, 1, 1) and got["b"].p25 == 4.0 and got["b"].p50 == 6.0
    assert {(r.a, r.b): r.r for r in U.correlations(df.filter("a < 10"), ["a", "b"]).collect()}[("b", "a")] == pytest.approx(pdf[:4].corr().loc["a", "b"])
    assert {r.bin: r.n for r in U.histogram(df, "b", 4).collect()} == {0: 1, 1: 1, 2: 1, 3: 2}
    cap = U.volume_cap(spark.createDataFrame([("A", 10)] * 30 + [("A", 1000)], "symbol string, volume long")).first()
    assert cap.cap == 10 and cap.has_outliers
    sample = U.seeded_sample(spark.range(1000), ["id"], 10)
    assert sample.count() == 10 and sample.collect() == U.seeded_sample(spark.range(1000).repartition(7), ["id"], 10).collect()


def test_curve_of_scores_crowded_near_zero(spark, monkeypatch):
    """99 % of the scores lie below 1/4096: bins follow them, and precision and recall are those of a plain sort."""
    monkeypatch.setattr(O.value_bins, "__defaults__", (64,))
    rng = np.random.default_rng(11)
    score = np.concatenate([rng.random(3960) / 4096, rng.random(40)]).round(9)
    hit = rng.random(4000) < 0.05
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "score": score, "hit": hit.astype(int)}))
    bins = O.value_bins(M.score_counts(df, ["k"], "score", "hit"), ["k"], "score").groupBy("_bin").count().agg({"count": "max"}).first()[0]
    assert bins <= 64
    got = M.pr_curve(df, ["k"], "score", "hit").toPandas().sort_values("score", ascending=False, ignore_index=True)
    want = pd.DataFrame({"score": score, "hit": hit}).groupby("score")["hit"].agg(["size", "sum"]).sort_index(ascending=False).cumsum().reset_index()
    assert list(got["score"]) == list(want["score"])
    np.testing.assert_allclose(got["precision"], want["sum"] / want["size"], rtol=1e-12)
    np.testing.assert_allclose(got["recall"], want["sum"] / hit.sum(), rtol=1e-12)


def test_search_halves_candidates_and_doubles_rounds(spark, monkeypatch):
    calls = []

    def fitted(rows, p):
        calls.append(p)
        return p

    # The score of a row is its target with noise that shrinks with depth, so the deepest candidate is the best.
    noisy = lambda p, rows, name, keep: rows.select(*keep, (F.col("y") + F.rand(5) * (8 - p.depth)).alias(name))
    monkeypatch.setattr(ML, "train_trees", fitted)
    monkeypatch.setattr(ML, "with_score", noisy)
    rows = spark.range(600).select((F.col("id") % 7 == 0).cast("double").alias("y"), F.lit("val").alias("split"))
    found = ML.search(rows, [ML.TreeParams(rounds=20, depth=d) for d in (1, 3, 5, 7)], first_rounds=2)
    assert [(p.depth, p.rounds) for p, _ in found][:1] == [(7, 20)] and sorted(p.rounds for p, _ in found) == [2, 2, 4, 20]
    assert sorted((p.depth, p.rounds) for p in calls if p.depth == 7) == [(7, 2), (7, 4), (7, 20)] and len(calls) == 7
    assert ML.search(rows, []) == []


def test_both_targets_are_fitted_side_by_side(monkeypatch):
    both = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(P, "_rows", lambda df, label, columns: label)
    monkeypatch.setattr(ML, "train_trees", lambda rows, params: (both.wait(), rows)[1])
    assert P._tree_models(None, []) == P.TARGETS
