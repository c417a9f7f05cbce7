from __future__ import annotations

import datetime as dt
from typing import NamedTuple

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.operators import analysis as A
from tapewright.operators import options as O
from tapewright.operators import trades as T
from tapewright.plans import trades as P

BASE = dt.datetime(2026, 1, 5, 9, 30)
PUT, CALL = "AAPL   260116P00270000", "AAPL   260116C00270000"
CONTRACT = "contract string, underlying string, expiry date, cp string, strike double, period_start date, stock_close double"
SCORED = "symbol string, ts timestamp_ntz, date date, minutes_from_open int, close double, peak_prob double, trough_prob double"
OPTION = "contract string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def _contracts(spark):
    d = dt.date
    rows = [(c, "AAPL", d(2026, 1, 16), c[13], 270.0, d(2026, 1, 5), 270.0) for c in (PUT, CALL)]
    return spark.createDataFrame(rows, CONTRACT)


def _scored(spark, probs, start=BASE, first=0):
    rows = [("AAPL", start + dt.timedelta(minutes=m), start.date(), m, 270.0 + m, p, t) for m, (p, t) in enumerate(probs, first)]
    return spark.createDataFrame(rows, SCORED)


def _quotes(spark, prices, start=BASE, contract=PUT):
    rows = [(contract, start + dt.timedelta(minutes=m), c, c, c, c, v) for m, (c, v) in enumerate(prices)]
    return spark.createDataFrame(rows, OPTION)


class Run(NamedTuple):
    events: object
    market: object
    configs: list

    def log(self):
        return T.bar_log(*self)

    def curve(self, **options):
        return T.equity_curve(self.events, T.bar_times(self.market), self.configs, **options)


def _run(spark, scored, options, config=T.Config(1), configs=None):
    configs = configs or [config]
    market = T.market(scored, _contracts(spark), options, configs)
    events = T.run(market, configs)
    return Run(events, market, configs), T.trades(events, market, configs).orderBy("config_id", "entry_ts").collect()


def test_target_and_signal_exits(spark):
    #   buy at 1, target at 3; buy at 4, trough at 6.
    probs = [(0.1, 0.1), (0.9, 0.1), (0.1, 0.1), (0.1, 0.1), (0.8, 0.1), (0.1, 0.1), (0.1, 0.9), (0.1, 0.1)]
    prices = [(5.0, 1), (5.0, 1), (5.2, 1), (5.9, 1), (6.0, 1), (6.1, 1), (6.0, 1), (6.0, 1)]
    logs, got = _run(spark, _scored(spark, probs), _quotes(spark, prices))
    assert [(r.exit_reason, r.holding_bars, r.holding_minutes) for r in got] == [("TP", 2, 2), ("TROUGH_SIGNAL", 2, 2)]
    first = got[0]
    assert first.entry_price == pytest.approx(5.01 * 1.005) and first.exit_price == pytest.approx(5.89 * 0.995)
    assert first.pnl == pytest.approx(first.exit_price - first.entry_price) and first.cash_pnl == pytest.approx(100 * first.pnl)
    log = logs.log().orderBy("ts").collect()
    assert [r.action for r in log] == ["", "BUY", "", "SELL", "BUY", "", "SELL", ""]
    assert sum(r.d_cash for r in log) == pytest.approx(sum(r.cash_pnl for r in got)) == pytest.approx(sum(r.d_equity for r in log))


def test_stop_comes_before_target_and_signal(spark):
    _, got = _run(spark, _scored(spark, [(0.9, 0.1), (0.1, 0.9)]), _quotes(spark, [(5.0, 1), (4.0, 1)]))
    assert [r.exit_reason for r in got] == ["SL"]


def test_forced_close_comes_first_and_stops_entries(spark):
    probs = [(0.9, 0.1)] * 3
    scored = _scored(spark, probs, BASE + dt.timedelta(minutes=269), first=0).withColumn("minutes_from_open", F.col("minutes_from_open") + 269)
    _, got = _run(spark, scored, _quotes(spark, [(5.0, 1)] * 400))
    assert [(r.exit_reason, r.holding_bars) for r in got] == [("FORCE_CLOSE", 1)]


def test_no_volume_no_fill(spark):
    # No purchase at 0, purchase at 1; the sale waits until there is volume again.
    probs = [(0.9, 0.1), (0.9, 0.1), (0.1, 0.9), (0.1, 0.9)]
    _, got = _run(spark, _scored(spark, probs), _quotes(spark, [(5.0, 0), (5.0, 1), (5.0, 0), (5.0, 2)]))
    assert [(r.entry_ts.minute, r.exit_ts.minute) for r in got] == [(31, 33)]


def test_no_contract_no_trade(spark):
    late = BASE + dt.timedelta(days=20)
    _, got = _run(spark, _scored(spark, [(0.9, 0.1)] * 3, late), _quotes(spark, [(5.0, 1)] * 3, late))
    assert got == []


def test_cooldown_and_daily_limit(spark):
    probs = [(0.9, 0.1), (0.1, 0.9)] * 20
    prices = _quotes(spark, [(5.0, 1)] * 40)
    make = lambda i, **k: T.Config(i, "filtered_put", sl_pct=-0.5, **k)
    configs = [make(1), make(2, cooldown_minutes=6), make(3, max_trades_per_day=3), make(4, min_holding_minutes=3), make(5, min_prob_gap=0.85)]
    _, got = _run(spark, _scored(spark, probs), prices, configs=configs)
    n = {i: sum(r.config_id == i for r in got) for i in range(1, 6)}
    # Sold every second minute; after a sale six minutes pass; every fourth minute is the first allowed sale.
    assert n[1] == 20 and n[2] == 5 and n[3] == 3 and n[5] == 0
    assert all(r.holding_minutes >= 3 for r in got if r.config_id == 4) and n[4] > 0


def test_calls_mirror_puts(spark):
    _, got = _run(spark, _scored(spark, [(0.1, 0.9), (0.1, 0.1), (0.9, 0.1)]), _quotes(spark, [(5.0, 1)] * 3, contract=CALL), T.Config(1, "call_buy"))
    assert [(r.contract, r.exit_reason) for r in got] == [(CALL, "PEAK_SIGNAL")]


def test_open_position_closes_on_the_next_day(spark):
    next_day = BASE + dt.timedelta(days=1)
    scored = _scored(spark, [(0.9, 0.1), (0.1, 0.1)]).union(_scored(spark, [(0.1, 0.1)] * 2, next_day))
    options = _quotes(spark, [(5.0, 1), (5.0, 1)]).union(_quotes(spark, [(5.3, 1)], next_day))
    _, got = _run(spark, scored, options)
    assert [(r.exit_reason, r.exit_ts, r.exit_underlying) for r in got] == [("FORCE_CLOSE", next_day, 270.0)]
    # Without volume then, the position stays open.
    _, got = _run(spark, scored, _quotes(spark, [(5.0, 1), (5.0, 1)]).union(_quotes(spark, [(5.3, 0)], next_day)))
    assert [(r.exit_reason, r.exit_ts) for r in got] == [(None, None)]


def test_carried_position_closes_when_it_can_and_blocks_entries(spark):
    """No volume at the next day's first bar; the strategy's own rules sell later, and nothing is bought meanwhile."""
    days = [BASE + dt.timedelta(days=d) for d in (0, 1, 2, 3)]
    scored = _scored(spark, [(0.1, 0.1), (0.9, 0.1)], days[0])
    for d in days[1:]:
        scored = scored.union(_scored(spark, [(0.9, 0.1)] * 4, d))
    options = _quotes(spark, [(5.0, 1), (5.0, 1)], days[0])
    options = options.union(_quotes(spark, [(5.0, 0), (5.1, 0), (5.1, 0), (5.2, 0)], days[1]))
    options = options.union(_quotes(spark, [(5.2, 0), (5.2, 1), (9.0, 1), (9.0, 0)], days[2])).union(_quotes(spark, [(9.0, 0), (9.0, 1)], days[3]))
    run, got = _run(spark, scored, options, T.Config(1, "put_buy", tp_pct=0.5))
    assert [(r.entry_ts, r.exit_ts, r.exit_reason) for r in got] == [
        (days[0] + dt.timedelta(minutes=1), days[2] + dt.timedelta(minutes=2), "TP"),
        (days[3] + dt.timedelta(minutes=1), days[3] + dt.timedelta(minutes=3), "FORCE_CLOSE"),
    ]
    assert got[0].holding_bars == 1 + 4 + 2 - 0 and got[0].date == days[0].date()
    buys = run.log().filter("action = 'BUY'").orderBy("ts").collect()
    assert [r.ts for r in buys] == [days[0] + dt.timedelta(minutes=1), days[3] + dt.timedelta(minutes=1)]
    rejected = run.log().filter("reject <> ''").collect()
    assert {r.reject for r in rejected} == {"NO_LIQUIDITY"}
    last = run.curve(capital=1000.0).orderBy("ts").collect()[-1]
    assert last.position_value == 0 and last.equity == pytest.approx(1000 + sum(r.cash_pnl for r in got), abs=1e-5)


def test_a_flat_day_is_no_loss(spark):
    """Three days on which nothing moves between two with trades: their returns are exactly 0, however rows arrive."""
    days = [BASE + dt.timedelta(days=d) for d in range(5)]
    scored, options = None, None
    for k, d in enumerate(days):
        s = _scored(spark, [(0.9, 0.1), (0.1, 0.1), (0.1, 0.9)] if k in (0, 4) else [(0.1, 0.1)] * 3, d)
        q = _quotes(spark, [(5.07, 1), (5.11, 1), (5.0 + 0.01 * k, 1)], d)
        scored, options = (s, q) if scored is None else (scored.union(s), options.union(q))
    run, _ = _run(spark, scored.repartition(7), options.repartition(5), configs=[T.Config(i, "put_buy", quantity=i) for i in (1, 3)])
    curve = run.curve(capital=1000.0).repartition(6, F.rand(3))
    last = [r.e for r in curve.filter("config_id = 3").groupBy(F.to_date("ts").alias("d")).agg(F.max_by("equity", "ts").alias("e")).orderBy("d").collect()]
    assert last[0] == last[1] == last[2] == last[3] != last[4]
    m = {r.config_id: r for r in A.equity_metrics(curve).collect()}
    assert m[1].sortino_ratio == m[3].sortino_ratio == 0  # one losing day only, so no spread of losses


def test_equity_is_cash_and_open_value_over_nights(spark):
    next_day = BASE + dt.timedelta(days=1)
    scored = _scored(spark, [(0.9, 0.1), (0.1, 0.1)]).union(_scored(spark, [(0.1, 0.1)] * 2, next_day))
    options = _quotes(spark, [(5.0, 1), (5.2, 1)]).union(_quotes(spark, [(5.6, 1)], next_day))
    logs, got = _run(spark, scored, options, T.Config(1, "put_buy", 0.5, quantity=2))
    curve = logs.curve(capital=10_000.0).orderBy("ts").collect()
    marks = {r.ts: r.qty * r.mark * 100 for r in logs.log().collect()}
    assert [r.exit_ts for r in got] == [next_day] and len(curve) == 4
    for r in curve:
        assert r.equity == pytest.approx(r.cash + marks[r.ts]) and r.position_value == pytest.approx(marks[r.ts])
    assert curve[1].position_value == pytest.approx(2 * 5.2 * 100)
    assert curve[-1].equity == pytest.approx(10_000 + got[0].cash_pnl) == pytest.approx(curve[-1].cash)


def test_tie_is_a_peak_for_the_rule_set_only(spark):
    scored, options = _scored(spark, [(0.7, 0.7), (0.1, 0.1), (0.1, 0.9)]), _quotes(spark, [(5.0, 1)] * 3)
    _, got = _run(spark, scored, options, configs=[T.Config(1, "put_buy"), T.Config(2, "signal_rules")])
    assert [r.config_id for r in got] == [2]


def test_custom_strategy(spark):
    T.register_strategy("always", T.Strategy("P", lambda p, t, c: p >= 0, lambda p, t, c: p >= 0, "IN", "OUT"))
    try:
        logs, got = _run(spark, _scored(spark, [(0.0, 0.0)] * 4), _quotes(spark, [(5.0, 1)] * 4), T.Config(1, "always"))
        assert [r.exit_reason for r in got] == ["OUT", "OUT"]
    finally:
        del T.STRATEGIES["always"]


def test_curve_and_metrics(spark):
    probs = [(0.9, 0.1), (0.1, 0.1), (0.1, 0.9)]
    days = [BASE + dt.timedelta(days=d) for d in range(3)]
    scored = _scored(spark, probs, days[0]).union(_scored(spark, probs, days[1])).union(_scored(spark, probs, days[2]))
    options = None
    for d, last in zip(days, (5.4, 4.9, 5.2)):
        q = _quotes(spark, [(5.0, 1), (5.0, 1), (last, 1)], d)
        options = q if options is None else options.union(q)
    logs, got = _run(spark, scored, options)
    curve = logs.curve(capital=1000.0)
    rows = curve.orderBy("ts").collect()
    gains = [r.cash_pnl for r in got]
    assert len(rows) == 9 and rows[-1].equity == pytest.approx(1000 + sum(gains)) == pytest.approx(rows[-1].cash)
    tops, worst = rows[0].equity, 0.0
    for r in rows:
        tops = max(tops, r.equity)
        worst = min(worst, (r.equity - tops) / tops)
        assert r.equity_peak == pytest.approx(tops)
    m = A.compare(T.trades(*logs), curve).first()
    assert m.total_trades == 3 and m.win_rate == pytest.approx(sum(g > 0 for g in gains) / 3) and m.max_drawdown_pct == pytest.approx(worst)
    assert T.cash_shortfalls(curve, 600.0).count() > 0 and T.cash_shortfalls(curve).count() == 0


def test_profit_factor_without_losses(spark):
    df = spark.sql("SELECT 1 AS config_id, 2.0D AS pnl, 0.1D AS pnl_pct, 5 AS holding_minutes, TIMESTAMP_NTZ '2026-01-05 10:00:00' AS exit_ts")
    assert A.trade_metrics(df).first().profit_factor == float("inf")


def test_nearest_strike_ties_go_to_the_smaller_symbol(spark):
    d = dt.date
    rows = [(f"X{i}", "AAPL", d(2026, 1, 16), "P", s, d(2026, 1, 5), 1.0) for i, s in enumerate((260.0, 280.0, 280.0, 300.0))]
    bars = spark.createDataFrame([("AAPL", d(2026, 1, 5), p) for p in (1.0, 270.0, 271.0, 290.0, 999.0)], "symbol string, date date, close double")
    got = {r.close: r.contract for r in O.at_the_money(bars, spark.createDataFrame(rows, CONTRACT), "P").collect()}
    assert got == {1.0: "X0", 270.0: "X0", 271.0: "X1", 290.0: "X1", 999.0: "X3"}


def test_a_day_gives_its_events_run_by_run():
    """A task holds the events of one run at a time, whatever the number of runs and however the rows are dealt into batches."""
    n, runs = 6, ("a", "b", "c")
    ts = pd.Series(pd.date_range(BASE, periods=n, freq="min").astype("datetime64[us]"))
    none = {"config_id": np.nan, "entry_ts": pd.NaT, "entry_bar": np.nan, "entry_price": np.nan, "entry_underlying": np.nan}
    empty = {"m": np.nan, "close": np.nan, "pp": np.nan, "tp": np.nan, "last": None, "atm_P": None, "run": None}
    bars = [pd.DataFrame({"kind": T.BAR, "run": r, "symbol": "AAPL", "date": BASE.date(), "ts": ts, "m": range(n), "close": 270.0, "pp": 0.9, "tp": 0.1, "last": True, "atm_P": PUT, "contract": None, "mark": np.nan, "volume": np.nan, "ask": np.nan, "bid_0": np.nan, **none}) for r in runs]
    quotes = pd.DataFrame({"kind": T.QUOTE, "symbol": "AAPL", "date": BASE.date(), "ts": ts, "contract": PUT, "mark": 5.0, "volume": 1.0, "ask": 5.1, "bid_0": 4.9, **empty, **none})
    day = pd.concat([*bars, quotes], ignore_index=True)
    configs = [T.Config(10 * k + i, run=r) for k, r in enumerate(runs) for i in range(2)]
    work = T._day(configs, 390)
    for size in (len(day), 4):
        out = list(work(day.iloc[i : i + size] for i in range(0, len(day), size)))
        assert [set(o["run"]) for o in out] == [{r} for r in runs]
        assert all(len(o) == 2 * (n + 1) and list(o["action"][:2]) == ["BUY", "BUY"] for o in out)  # and the sale after the last bar


def test_settings_of_the_grid_need_no_python_worker(spark):
    got = P._params(spark, P.GRID)
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    kinds = [("config_id", "int"), ("strategy", "string"), ("threshold", "double"), ("tp_pct", "double"), ("sl_pct", "double"), ("timeframe", "string"), ("label_config", "string")]
    assert got.dtypes == kinds
    assert [tuple(r) for r in got.orderBy("config_id").collect()] == [(c.config_id, c.strategy, c.threshold, c.tp_pct, c.sl_pct, *c.run.split(" ")) for c in P.GRID]
