from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tapewright.session import STATE_STORE
from tapewright.streaming import bars as SB
from tapewright.streaming import state as SS

TICK = "symbol string, ts timestamp_ntz, price double, volume long"


def _write(spark, path, rows, schema=TICK):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_bars_wait_for_the_watermark(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = dt.datetime(2025, 1, 2, 10, 0)
    _write(spark, src, [("A", t, 5.0, 1), ("A", t + dt.timedelta(minutes=1), 7.0, 1), ("A", t + dt.timedelta(minutes=30), 9.0, 1)])
    made = SB.stream_bars(SB.read_stream(spark, src, TICK), 5, "10 minutes")
    SB.run_to_files(made, out)
    got = spark.read.parquet(out).collect()
    assert [(r.ts, r.open, r.close, r.volume) for r in got] == [(t, 5.0, 7.0, 2)]
    # The run goes on from its checkpoint: a tick behind the watermark is left out, the open bar is finished.
    _write(spark, src, [("A", t, 1.0, 1), ("A", t + dt.timedelta(minutes=60), 1.0, 1)])
    SB.run_to_files(made, out)
    got = sorted((r.ts, r.open) for r in spark.read.parquet(out).collect())
    assert got == [(t, 5.0), (t + dt.timedelta(minutes=30), 9.0)]


def test_repeats_within_the_delay_are_dropped(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = dt.datetime(2025, 1, 2, 10, 0)
    _write(spark, src, [("A", t, 5.0, 1), ("A", t, 5.0, 1), ("B", t, 5.0, 1)])
    SB.run_to_files(SB.without_repeats(SB.read_stream(spark, src, TICK)), out)
    assert spark.read.parquet(out).count() == 2


def test_state_carries_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "symbol string, ts timestamp_ntz, price double, minutes_from_open int, peak_prob double, trough_prob double"
    t = dt.datetime(2025, 1, 2, 9, 30)

    def bar(m, price, p, q):
        return ("A", t + dt.timedelta(minutes=m), price, m, p, q)

    _write(spark, src, [bar(1, 100.0, 0.1, 0.1), bar(0, 100.0, 0.9, 0.1)], schema)
    stream = SS.positions(SB.read_stream(spark, src, schema), 0.5)
    SB.run_to_files(stream, out)
    _write(spark, src, [bar(3, 94.0, 0.1, 0.1), bar(2, 101.0, 0.1, 0.1), bar(1, 1.0, 0.1, 0.1), bar(270, 94.0, 0.9, 0.1)], schema)
    SB.run_to_files(stream, out)
    got = spark.read.parquet(out).orderBy("ts").collect()
    assert [(r.action, r.reason, r.price) for r in got] == [("BUY", "PEAK_SIGNAL", 100.0), ("LATE", "", 1.0), ("SELL", "STOP_LOSS", 94.0)]
    assert round(got[2].pnl_pct, 10) == -0.06


@pytest.mark.parametrize("delay,late", [("60 minutes", False), ("0 minutes", True)])
def test_shuffled_batches_act_as_ordered_ones(spark, tmp_path, delay, late):
    """Bars in random batches give the events of ordered bars, as long as they are not later than the delay; others are named."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    schema = "symbol string, ts timestamp_ntz, price double, minutes_from_open int, peak_prob double, trough_prob double"
    rng = random.Random(6)
    t = dt.datetime(2025, 1, 2, 9, 30)
    rows = [(s, t + dt.timedelta(minutes=m), 100 + rng.uniform(-8, 8), m, rng.random(), rng.random()) for s in "AB" for m in range(40)]
    # The last bars lie far ahead and let the others act.
    rows += [(s, t + dt.timedelta(minutes=300), 100.0, 40, 0.0, 0.0) for s in "AB"]

    def run(name, batches, wait):
        src = str(tmp_path / name)
        (tmp_path / name).mkdir()
        stream = SS.positions(SB.read_stream(spark, src, schema), 0.6, delay=wait)
        for batch in batches:
            _write(spark, src, batch, schema)
            SB.run_to_files(stream, src + "-out")
        return sorted((r.symbol, r.ts, r.action, r.reason) for r in spark.read.parquet(src + "-out").collect())

    ordered = run("ordered", [rows], "0 minutes")
    mixed = rows[:-2]
    rng.shuffle(mixed)
    got = run("mixed", [mixed[:27], mixed[27:55], mixed[55:], rows[-2:]], delay)
    named = [e for e in got if e[2] == "LATE"]
    assert bool(named) == late
    if not late:
        assert got == ordered


def test_corrections_replace_bars(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "bars")
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long, n long"
    t = dt.datetime(2025, 1, 2, 10, 0)
    _write(spark, src, [("A", t, 1.0, 1.0, 1.0, 1.0, 1, 1), ("A", t, 1.0, 1.0, 1.0, 2.0, 1, 2)], schema)
    stream, done = SB.read_stream(spark, src, schema), str(tmp_path / "done")
    SB.run_batches(stream, SB.keep_corrected(path, "us", "n"), done)
    _write(spark, src, [("A", t, 1.0, 1.0, 1.0, 3.0, 1, 3), ("A", t + dt.timedelta(minutes=1), 1.0, 1.0, 1.0, 4.0, 1, 4)], schema)
    SB.run_batches(stream, SB.keep_corrected(path, "us", "n"), done)
    assert [r.close for r in SB.bar_log_table(path).read(spark).orderBy("ts").collect()] == [3.0, 4.0]
    # An older correction in a later batch does not win.
    _write(spark, src, [("A", t, 1.0, 1.0, 1.0, 9.0, 1, 0)], schema)
    SB.run_batches(stream, SB.keep_corrected(path, "us", "n"), done)
    assert [r.close for r in SB.bar_log_table(path).read(spark).orderBy("ts").collect()] == [3.0, 4.0]


def _bars(spark, rows):
    t = dt.datetime(2025, 1, 2, 10, 0)
    data = [(s, t + dt.timedelta(days=d), 1.0, 1.0, 1.0, c, 1, "", "us", (t + dt.timedelta(days=d)).date(), n) for s, d, c, n in rows]
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long, source string, market string, date date, n long")


def test_log_table_resolves_in_any_order(spark, tmp_path):
    rows = [("A", 0, 1.0, 1), ("A", 0, 2.0, 5), ("A", 0, 3.0, 3), ("B", 0, 4.0, 2), ("A", 1, 5.0, 1), ("B", 0, 6.0, 2)]
    results = []
    for k, order in enumerate(([0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0], [2, 0, 5, 1, 3, 4])):
        table = SB.bar_log_table(str(tmp_path / f"t{k}"))
        assert table.read(spark).count() == 0
        for number, i in enumerate(order):
            table.append(_bars(spark, [rows[i]]), number, "n")
            if number == 3:
                assert table.compact(spark) == 4 and len(table.generations(spark)) == 1
        results.append(sorted((r.symbol, r.ts, r.close) for r in table.read(spark).collect()))
    assert results[0] == results[1] == results[2] and [r[2] for r in results[0]] == [2.0, 5.0, 6.0]


def test_log_table_batches_only_add(spark, tmp_path):
    """A batch writes its own folder only; repeated, it replaces itself; unfinished ones are not seen; filters prune folders."""
    path = tmp_path / "t"
    table = SB.bar_log_table(str(path))
    table.append(_bars(spark, [("A", d, 1.0, 1) for d in range(5)]), 0)
    before = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs}
    table.append(_bars(spark, [("A", 0, 2.0, 1)]), 1)
    after = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs}
    assert all(after[f] == at for f, at in before.items() if f.startswith("part"))
    table.append(_bars(spark, [("A", 0, 7.0, 1)]), 1)
    assert table.read(spark).filter("date = '2025-01-02'").first().close == 7.0
    os.makedirs(path / "gen=d000000000099/market=us/date=2025-01-02")
    assert table.generations(spark) == ["d000000000000", "d000000000001"]
    plan = table.read(spark).filter("market = 'us' and date = date'2025-01-03' and symbol = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(market" in plan and "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,A)]" in plan


def test_signals_see_the_days_before(spark, tmp_path):
    """A symbol that trades daily and one with long pauses: both see their last dates, however long ago."""
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"
    t = dt.datetime(2025, 1, 2, 10, 0)
    src, out, done = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "done")
    (tmp_path / "in").mkdir()
    stoch = F.col("tf_stoch")
    each = SB.signals_of_batch(str(tmp_path / "bars"), out, "us", stoch, 1 - stoch, 0.5, history=2, lookback=5)
    stream = SB.read_stream(spark, src, schema)
    for days in ([("A", d) for d in range(3)] + [("B", 0)], [("A", 40), ("B", 40)]):
        _write(spark, src, [(s, t + dt.timedelta(days=d), 10.0 + d, 11.0 + d, 9.0 + d, 10.0 + d, 1) for s, d in days], schema)
        SB.run_batches(stream, each, done)
    got = {(r.symbol, r.ts): r.peak_prob for r in spark.read.parquet(out).collect()}
    # A sees days 1, 2 and 40; B sees days 0 and 40.
    assert len(got) == 6
    assert got["A", t + dt.timedelta(days=40)] == pytest.approx((50 - 10) / (51 - 10))
    assert got["B", t + dt.timedelta(days=40)] == pytest.approx((50 - 9) / (51 - 9))
