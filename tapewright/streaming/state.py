"""Keyed state on streams: recent bars and open positions per symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapewright.params import STOP_LOSS, TAKE_PROFIT

BAR = "ts timestamp, close double"
RECENT = "symbol string, ts timestamp, close double, n_bars int, mean_close double"
POSITION = "seen timestamp, last timestamp, held boolean, entry_price double"
WAITING = "ts timestamp, price double, minutes_from_open int, peak_prob double, trough_prob double"
WAITING_COLUMNS = [f.split()[0] for f in WAITING.split(", ")]
EVENT = "symbol string, ts timestamp, action string, reason string, price double, pnl_pct double"


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    # One symbol's rows of one micro-batch, whose size the source limits.
    return pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable", ignore_index=True)


class RecentBars(StatefulProcessor):
    """Keeps the last ``size`` bars of a symbol and emits, per bar, their number and mean close."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", BAR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _in_order(rows)[["ts", "close"]]
        kept = pd.DataFrame(list(self.bars.get()), columns=["ts", "close"])
        both = pd.concat([kept, new], ignore_index=True) if len(kept) else new
        window = both["close"].rolling(self.size, min_periods=1)
        out = both.assign(symbol=key[0], n_bars=window.count().astype("int32"), mean_close=window.mean())
        self.bars.put([tuple(r) for r in both.tail(self.size).itertuples(index=False)])
        yield out.iloc[len(kept) :][["symbol", "ts", "close", "n_bars", "mean_close"]]

    def close(self) -> None:
        pass


class Positions(StatefulProcessor):
    """One position per symbol: forced close, stop, target and trough signal end it, a peak signal opens it.

    Bars wait until one that is ``delay`` newer has come, so that they act in their own order however batches deliver them. A bar
    that is not newer than one which has acted comes out as an event of its own kind, LATE.
    """

    def __init__(self, threshold: float, last_entry: int, target: float, stop: float, delay: str):
        self.threshold, self.last_entry, self.target, self.stop = threshold, last_entry, target, stop
        self.delay = pd.Timedelta(delay)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", POSITION)
        self.waiting = handle.getListState("waiting", WAITING)

    def _ready(self, rows: Iterator[pd.DataFrame], seen, last) -> tuple[pd.DataFrame, pd.DataFrame, object]:
        """Bars that may act now and bars that come too late; the others are kept."""
        new = pd.concat(list(rows), ignore_index=True)[WAITING_COLUMNS]
        late = new[new["ts"] <= last] if last is not None else new.iloc[:0]
        kept = list(self.waiting.get())
        if kept:
            new = pd.concat([pd.DataFrame(kept, columns=WAITING_COLUMNS), new], ignore_index=True)
        if last is not None:
            new = new[new["ts"] > last]
        seen = max([t for t in (seen, new["ts"].max()) if t is not None and not pd.isna(t)], default=None)
        now = new["ts"] <= seen - self.delay if len(new) else []
        held_back = new[~now] if len(new) else new
        if kept or len(held_back):
            self.waiting.put([tuple(r) for r in held_back.itertuples(index=False)])
        ready = new[now].sort_values("ts", kind="stable", ignore_index=True) if len(new) else new
        # Of bars with one time, the first to come acts.
        again = ready.duplicated("ts")
        return ready[~again], pd.concat([late, ready[again]]) if len(late) or again.any() else late, seen

    def _reason(self, bar, entry: float) -> str | None:
        change = bar.price / entry - 1 if entry > 0 else 0.0
        if bar.minutes_from_open >= self.last_entry:
            return "FORCE_CLOSE"
        if change <= self.stop:
            return "STOP_LOSS"
        if change >= self.target:
            return "PROFIT_TARGET"
        if bar.trough_prob >= self.threshold and bar.trough_prob > bar.peak_prob:
            return "TROUGH_SIGNAL"
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, last, held, entry = self.state.get() if self.state.exists() else (None, None, False, 0.0)
        ready, late, seen = self._ready(rows, seen, last)
        events = [(key[0], bar.ts, "LATE", "", bar.price, 0.0) for bar in late.itertuples(index=False)]
        for bar in ready.itertuples(index=False):
            last = bar.ts
            if held:
                reason = self._reason(bar, entry)
                if reason:
                    pnl = (bar.price - entry) / entry if entry > 0 else 0.0
                    events.append((key[0], bar.ts, "SELL", reason, bar.price, pnl))
                    held = False
            elif bar.minutes_from_open < self.last_entry and bar.peak_prob >= self.threshold and bar.peak_prob >= bar.trough_prob:
                events.append((key[0], bar.ts, "BUY", "PEAK_SIGNAL", bar.price, 0.0))
                held, entry = True, float(bar.price)
        self.state.update((seen, last, held, entry))
        if events:
            yield pd.DataFrame(events, columns=["symbol", "ts", "action", "reason", "price", "pnl_pct"])

    def close(self) -> None:
        pass


def recent_bars(bars: DataFrame, size: int) -> DataFrame:
    return bars.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=RecentBars(size), outputStructType=RECENT, outputMode="append", timeMode="none"
    )


def positions(
    scored: DataFrame, threshold: float, last_entry: int = 270, target: float = TAKE_PROFIT, stop: float = STOP_LOSS, delay: str = "0 minutes"
) -> DataFrame:
    """Trade events from a stream of scored bars with ``price`` and ``minutes_from_open``.

    Bars of a symbol may arrive out of order by up to ``delay``; what comes later still is reported as LATE and does not act.
    """
    return scored.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=Positions(threshold, last_entry, target, stop, delay), outputStructType=EVENT, outputMode="append", timeMode="none"
    )
