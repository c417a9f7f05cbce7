"""Trades from scored bars and option quotes.

What happens on a day depends on the bars before it only through the open position, the cooldown
and the day's trade count. So one fold per (symbol, date) over that day's bars (at most 1,440)
decides entries and exits of all configs at once, in arrays over the configs; symbols and days run
side by side. Contracts and quotes do not depend on the config and are joined once. Positions that
a day leaves open are carried into the next one by running that day again (see ``run``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions.pricing import buy_fill, sell_fill
from tapewright.operators.options import at_the_money, quotes_at
from tapewright.operators.ordered import running_totals
from tapewright.params import CONTRACT_SIZE, FORCE_CLOSE_MINUTES, STOP_LOSS, START_CAPITAL, TAKE_PROFIT
from tapewright.session import stage

NO_LIMIT = 1_000_000
MONEY_UNITS = 1_000_000  # parts of one unit of money in which cash and equity are counted


@dataclass(frozen=True)
class Config:
    """Parameters of one setting; ``strategy`` names an entry of :data:`STRATEGIES`, ``run`` the scores it trades on."""

    config_id: int
    strategy: str = "put_buy"
    threshold: float = 0.5
    tp_pct: float = TAKE_PROFIT
    sl_pct: float = STOP_LOSS
    min_prob_gap: float = 0.0
    min_holding_minutes: int = 0
    cooldown_minutes: int = 0
    max_trades_per_day: int = NO_LIMIT
    force_close_minutes: int = FORCE_CLOSE_MINUTES
    quantity: int = 1
    run: str = ""


@dataclass(frozen=True)
class Strategy:
    """Side, entry and exit predicates over (peak probability, trough probability, config)."""

    cp: str
    entry: Callable[[Column, Column, Column], Column]
    exit: Callable[[Column, Column, Column], Column]
    entry_reason: str
    exit_reason: str
    stop_reason: str = "SL"
    target_reason: str = "TP"
    bid_floor: float | None = None


def _peak(pp: Column, tp: Column, c: Column) -> Column:
    return (pp >= c["threshold"]) & (pp > tp)


def _trough(pp: Column, tp: Column, c: Column) -> Column:
    return (tp >= c["threshold"]) & (tp > pp)


STRATEGIES: dict[str, Strategy] = {
    "put_buy": Strategy("P", _peak, _trough, "PEAK_SIGNAL", "TROUGH_SIGNAL"),
    "filtered_put": Strategy(
        "P", lambda pp, tp, c: (pp - tp >= c["min_prob_gap"]) & (pp >= c["threshold"]), _trough, "PEAK_SIGNAL", "TROUGH_SIGNAL"
    ),
    "call_buy": Strategy("C", _trough, _peak, "TROUGH_SIGNAL", "PEAK_SIGNAL"),
    # Rule set of the session log: a tie above the threshold counts as a peak.
    "signal_rules": Strategy(
        "P", lambda pp, tp, c: (pp >= c["threshold"]) & (pp >= tp), _trough, "PEAK_SIGNAL", "TROUGH_SIGNAL",
        "STOP_LOSS", "PROFIT_TARGET", bid_floor=0.01,
    ),
}


def register_strategy(name: str, strategy: Strategy) -> None:
    STRATEGIES[name] = strategy


def grid(base: Config, thresholds: Sequence[float], tps: Sequence[float], sls: Sequence[float]) -> list[Config]:
    """Every combination, numbered from the base's id on."""
    combos = [(t, a, b) for t in thresholds for a in tps for b in sls]
    return [
        replace(base, config_id=base.config_id + i, threshold=t, tp_pct=a, sl_pct=b) for i, (t, a, b) in enumerate(combos)
    ]


def _literal(c: Config) -> Column:
    return F.struct(
        F.lit(c.config_id).alias("config_id"), F.lit(c.strategy).alias("strategy"),
        F.lit(float(c.threshold)).alias("threshold"), F.lit(float(c.tp_pct)).alias("tp_pct"), F.lit(float(c.sl_pct)).alias("sl_pct"),
        F.lit(float(c.min_prob_gap)).alias("min_prob_gap"), F.lit(c.min_holding_minutes).alias("min_holding_minutes"),
        F.lit(c.cooldown_minutes).alias("cooldown_minutes"), F.lit(c.max_trades_per_day).alias("max_trades_per_day"),
        F.lit(c.force_close_minutes).alias("force_close_minutes"), F.lit(c.quantity).alias("quantity"),
    )


def entry_candidates(scored: DataFrame, configs: Sequence[Config], session_minutes: int = 390) -> DataFrame:
    """Bars on which a config may enter, one row per config and bar."""
    rows = scored.withColumn("c", F.explode(F.array(*[_literal(c) for c in configs])))
    return rows.filter(_wants(F.col("c"), F.col("peak_prob"), F.col("trough_prob")) & _open(F.col("c"), F.col("minutes_from_open"), session_minutes)).select(
        "c.config_id", "c.strategy", *scored.columns
    )


def _by_strategy(c: Column, make: Callable[[Strategy], Column], names: Sequence[str] | None = None) -> Column:
    out = F
    for name in names or STRATEGIES:
        out = out.when(c["strategy"] == name, make(STRATEGIES[name]))
    return out


def _wants(c: Column, pp: Column, tp: Column, names: Sequence[str] | None = None) -> Column:
    return _by_strategy(c, lambda s: s.entry(pp, tp, c), names)


def _open(c: Column, minutes: Column, session_minutes: int) -> Column:
    return minutes < session_minutes - c["force_close_minutes"]


@dataclass(frozen=True)
class Market:
    """What all configs share, as tables written once.

    bars: run, symbol, date, ts, m, close, pp, tp, last (of the symbol's days) and the at-the-money contract per side.
    quotes: symbol, date, ts, contract and the quote then, for each contract that some config could buy that day.
    listed: contract, strike, expiry. calendar: run, symbol, date, next_date.
    """

    bars: DataFrame
    quotes: DataFrame
    listed: DataFrame
    calendar: DataFrame
    option_bars: DataFrame
    session_minutes: int


def market(scored: DataFrame, contracts: DataFrame, option_bars: DataFrame, configs: Sequence[Config], session_minutes: int = 390) -> Market:
    """Bars with their at-the-money contracts, and the quotes of every contract that some config could buy that day.

    A column ``run`` tells apart scores of several timeframes or models of one symbol; quotes are shared between them.
    """
    scored = scored if "run" in scored.columns else scored.withColumn("run", F.lit(""))
    # One config for each way to enter; the others differ in their exits.
    array = F.array(*[_literal(c) for c in {(c.strategy, c.threshold, c.min_prob_gap, c.force_close_minutes): c for c in configs}.values()])
    names = sorted({c.strategy for c in configs})
    keys = ["run", "symbol", "date", "ts"]
    bars = scored.select(*keys, F.col("minutes_from_open").alias("m"), "close", F.col("peak_prob").alias("pp"), F.col("trough_prob").alias("tp"))
    days = bars.select("run", "symbol", "date").distinct()
    calendar = stage(days.withColumn("next_date", F.lead("date").over(Window.partitionBy("run", "symbol").orderBy("date"))), "trade-days")
    picks = bars.join(calendar.select("run", "symbol", "date", F.col("next_date").isNull().alias("last")), ["run", "symbol", "date"])

    def may_enter(own: Sequence[str]) -> Callable[[Column], Column]:
        return lambda c: F.coalesce(_wants(c, F.col("pp"), F.col("tp"), own), F.lit(False)) & _open(c, F.col("m"), session_minutes)

    for cp in sorted({STRATEGIES[n].cp for n in names}):
        could = F.exists(array, may_enter([n for n in names if STRATEGIES[n].cp == cp]))
        atm = at_the_money(bars.filter(could), contracts, cp).filter(F.col("contract").isNotNull())
        picks = picks.join(atm.select(*keys, F.col("contract").alias(f"atm_{cp}")), keys, "left")
    picks = stage(picks, "trade-bars")
    sides = [c for c in picks.columns if c.startswith("atm_")]
    wanted = picks.select("symbol", "date", F.explode(F.array(*sides)).alias("contract")).filter("contract is not null").distinct()
    quotes = stage(_quoted(picks.select("symbol", "date", "ts").distinct().join(wanted, ["symbol", "date"]), option_bars, names), "trade-quotes")
    listed = contracts.groupBy("contract").agg(F.max(F.struct("strike", "expiry")).alias("c")).select("contract", "c.strike", "c.expiry")
    return Market(picks, quotes, stage(listed, "trade-contracts"), calendar, option_bars, session_minutes)


def _floors(names: Sequence[str]) -> list[float | None]:
    return sorted({STRATEGIES[n].bid_floor for n in names}, key=lambda f: (f is not None, f or 0.0))


def _quoted(rows: DataFrame, option_bars: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows whose contract has a quote then: its mark, volume, and what a purchase and a sale would fill at."""
    q = {k: F.col(f"q_{k}") for k in ("close", "high", "low")}
    bids = [sell_fill(q["close"], q["high"], q["low"], floor=f).alias(f"bid_{i}") for i, f in enumerate(_floors(names))]
    found = quotes_at(rows, option_bars).filter(F.col("q_ts").isNotNull())
    return found.select("symbol", "date", "ts", "contract", q["close"].alias("mark"), F.col("q_volume").alias("volume"), buy_fill(q["close"], q["high"], q["low"]).alias("ask"), *bids)


_ENTRY = "entry_ts timestamp_ntz, entry_bar int, entry_price double, entry_underlying double"
EVENTS = (
    "config_id int, run string, symbol string, date date, ts timestamp_ntz, bar int, n_bars int, close double, action string, reason string, reject string, contract string, "
    + _ENTRY
    + ", fill double, quantity int, qty int, mark double, cash_units long, equity_units long, night boolean"
)


def _units(price: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Money in whole units, so that sums do not depend on their order."""
    return np.rint(np.nan_to_num(price * worth) * MONEY_UNITS).astype(np.int64)


def _day(configs: Sequence[Config], session_minutes: int) -> Callable:
    """One symbol's day for all configs at once: a step per bar on which some config holds something or wants to enter.

    Exit order: forced close, stop, target, opposite signal. A sale or purchase without traded
    volume at the quote is not filled; the attempt still starts the cooldown or counts as a trade.
    What was carried in is offered first, at the day's first bar. Events go out run by run, so that a task holds those of one run.
    """
    rules = {n: STRATEGIES[n] for n in sorted({c.strategy for c in configs})}
    floors = _floors(list(rules))
    sides = sorted({r.cp for r in rules.values()})
    configs = list(configs)
    columns = {
        BAR: ["run", "symbol", "date", "ts", "m", "close", "pp", "tp", "last", *[f"atm_{s}" for s in sides]],
        QUOTE: ["ts", "contract", "mark", "volume", "ask", *[f"bid_{i}" for i in range(len(floors))]],
        CARRIED: ["config_id", "contract", "mark", *[f.split()[0] for f in _ENTRY.split(", ")]],
    }

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Each kind of row has columns of its own; the others are not kept.
        kept: dict[int, list[pd.DataFrame]] = {BAR: [], QUOTE: [], CARRIED: []}
        for batch in batches:
            kind = batch["kind"].to_numpy()
            for k, parts in kept.items():
                parts.append(batch.loc[kind == k, columns[k]])
        bars, quotes, carry = (pd.concat(parts, ignore_index=True) for parts in kept.values())
        kept.clear()
        for run, own in bars.groupby("run"):
            out = of_run(run, own.sort_values("ts"), quotes, carry)
            if len(out):
                yield out

    def of_run(run: str, bars: pd.DataFrame, quotes: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        mine = [c for c in configs if c.run == run]
        if len(carry):
            carry = carry.drop_duplicates("config_id").set_index("config_id")
            mine = [c for c in mine if c.config_id in carry.index]
            carry = carry.loc[[c.config_id for c in mine]]
        if not mine:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in EVENT_NAMES})
        n, size = len(bars), len(mine)
        ts = bars["ts"].to_numpy()
        m, close, pp, tp = (bars[x].to_numpy(dtype=float) for x in ("m", "close", "pp", "tp"))

        # Contracts as numbers; -1 is none and leads to the empty last row of the quote tables.
        known: dict[str, int] = {}
        number = lambda col: np.array([known.setdefault(x, len(known)) if isinstance(x, str) else -1 for x in col], np.int64)
        atm_side = [number(bars[f"atm_{s}"]) for s in sides]
        of_quote = number(quotes["contract"])
        held = number(carry["contract"]) if len(carry) else np.full(size, -1)
        contracts = np.array([*known, None], object)
        at = np.searchsorted(ts, quotes["ts"].to_numpy())
        there = np.flatnonzero(np.append(ts, np.datetime64("NaT"))[at] == quotes["ts"].to_numpy())
        of_quote, at = of_quote[there], at[there]

        def grid_of(col: str) -> np.ndarray:
            out = np.full((len(known) + 1, n), np.nan)
            out[of_quote, at] = quotes[col].to_numpy(dtype=float)[there]
            return out

        q_mark, q_volume, q_ask = grid_of("mark"), grid_of("volume"), grid_of("ask")
        q_bid = np.stack([grid_of(f"bid_{i}") for i in range(len(floors))])

        par = {f: np.array([getattr(c, f) for c in mine]) for f in ("threshold", "tp_pct", "sl_pct", "min_prob_gap", "min_holding_minutes", "cooldown_minutes", "max_trades_per_day", "force_close_minutes", "quantity")}
        enter_at, exit_at = np.zeros((n, size), bool), np.zeros((n, size), bool)
        side, floor = np.zeros(size, np.int64), np.zeros(size, np.int64)
        texts = np.full((len(REASONS), size), "", object)  # per reason and config
        for name, rule in rules.items():
            own = np.flatnonzero([c.strategy == name for c in mine])
            c = {k: v[own][None, :] for k, v in par.items()}
            enter_at[:, own] = np.broadcast_to(rule.entry(pp[:, None], tp[:, None], c), (n, len(own)))
            exit_at[:, own] = np.broadcast_to(rule.exit(pp[:, None], tp[:, None], c), (n, len(own)))
            side[own], floor[own] = sides.index(rule.cp), floors.index(rule.bid_floor)
            for code, text in zip(REASONS, ("", "FORCE_CLOSE", rule.stop_reason, rule.target_reason, rule.exit_reason, rule.entry_reason)):
                texts[code, own] = text
        may = m[:, None] < session_minutes - par["force_close_minutes"][None, :]
        enter_at &= may
        worth, qty = par["quantity"] * float(CONTRACT_SIZE), par["quantity"].astype(np.int64)
        every = np.arange(size)

        first = lambda col, kind, none: carry[col].to_numpy(dtype=kind) if len(carry) else np.full(size, none, kind)
        entry_ts = first("entry_ts", "datetime64[us]", np.datetime64("NaT"))
        entry_bar = np.nan_to_num(first("entry_bar", float, 0)).astype(np.int64)
        entry_price, entry_under, mark = (first(x, float, np.nan) for x in ("entry_price", "entry_underlying", "mark"))
        last_sell, entry_m = np.full(size, -np.inf), np.full(size, -np.inf)
        today = np.zeros(size, np.int64)
        out: list[dict] = []

        def put(rows: np.ndarray, k: int, bar: int, action, reason, reject, which, fill, after, now, cash, equity, night: bool) -> None:
            if len(rows):
                pick = lambda x: x[rows] if isinstance(x, np.ndarray) else np.full(len(rows), x)
                out.append({
                    "config": rows, "k": np.full(len(rows), k), "bar": np.full(len(rows), bar), "action": pick(action), "reason": pick(reason), "reject": pick(reject),
                    "contract": pick(which), "entry_ts": pick(entry_ts).copy(), "entry_bar": pick(entry_bar).copy(), "entry_price": pick(entry_price).copy(),
                    "entry_underlying": pick(entry_under).copy(), "fill": pick(fill), "qty": pick(after), "mark": pick(now), "cash": pick(cash), "equity": pick(equity),
                    "night": np.full(len(rows), night),
                })

        def close_all(k: int, bar: int, unfilled: bool) -> None:
            """Offer what is held at bar k, outside of the strategy's own rules."""
            nonlocal held
            sold = (held >= 0) & (q_volume[held, k] > 0)
            fill = q_bid[floor, held, k]
            cash = _units(fill, worth)
            put(np.flatnonzero(sold), k, bar, SELL, FORCED, 0, held, fill, 0, 0.0, cash, cash - _units(mark, worth), True)
            if unfilled:
                put(np.flatnonzero((held >= 0) & ~sold), k, bar, OPEN, 0, 2, held, np.nan, qty, mark, 0, 0, True)
            held = np.where(sold, -1, held)

        if n and len(carry):
            close_all(0, -1, False)
        for k in range(n):
            has = held >= 0
            if not has.any() and not enter_at[k].any():
                continue
            atm = np.choose(side, [a[k] for a in atm_side])
            at_contract = np.where(has, held, atm)
            now = np.where(np.isnan(q_mark[at_contract, k]), mark, q_mark[at_contract, k])
            liquid = q_volume[at_contract, k] > 0
            gain = np.where(entry_price > 0, now / np.where(entry_price > 0, entry_price, 1.0) - 1, 0.0)
            signal = exit_at[k] & (m[k] - entry_m >= par["min_holding_minutes"])
            reason = np.where(~may[k], FORCED, np.where(gain <= par["sl_pct"], STOPPED, np.where(gain >= par["tp_pct"], TARGET, SIGNAL * signal)))
            leave = has & (reason > 0)
            enter = ~has & enter_at[k] & (today < par["max_trades_per_day"]) & (m[k] - last_sell >= par["cooldown_minutes"])
            buys, sells = enter & liquid & (atm >= 0), leave & liquid
            ask, bid = q_ask[at_contract, k], q_bid[floor, at_contract, k]
            was = np.where(has, _units(mark, worth), 0)
            entry_ts = np.where(buys, ts[k].astype("datetime64[us]"), entry_ts)
            entry_bar = np.where(buys, k, entry_bar)
            entry_price, entry_under = np.where(buys, ask, entry_price), np.where(buys, close[k], entry_under)
            holds = (has & ~sells) | buys
            mark = np.where(buys, ask, now)
            value = np.where(holds, _units(mark, worth), 0)
            cash = np.where(buys, -_units(ask, worth), np.where(sells, _units(bid, worth), 0))
            rows = np.flatnonzero(has | enter)
            reject = np.where(enter & (atm < 0), 1, 2 * ((enter & ~buys) | (leave & ~sells)))
            put(rows, k, k, BUY * buys + SELL * sells, np.where(buys, ENTRY, reason * sells), reject, np.where(has | buys, at_contract, -1), np.where(buys, ask, np.where(sells, bid, np.nan)), np.where(holds, qty, 0), np.where(holds, mark, 0.0), cash, value - was + cash, False)
            last_sell = np.where(leave, m[k], last_sell)
            entry_m, today = np.where(enter, m[k], entry_m), today + enter
            held = np.where(buys, atm, np.where(sells, -1, held))
        if n and bool(bars["last"].iloc[0]):
            close_all(n - 1, n - 1, True)
        if not out:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in EVENT_NAMES})
        x = {c: np.concatenate([o[c] for o in out]) for c in out[0]}
        held_ts = np.where(x["contract"] >= 0, x["entry_ts"], np.datetime64("NaT"))
        none = x["contract"] < 0
        blank = lambda v: np.where(none, np.nan, v)
        return pd.DataFrame({
            "config_id": np.array([c.config_id for c in mine])[x["config"]], "run": run, "symbol": bars["symbol"].iloc[0], "date": bars["date"].iloc[0], "ts": ts[x["k"]], "bar": x["bar"],
            "n_bars": n, "close": close[x["k"]], "action": ACTIONS[x["action"]], "reason": texts[x["reason"], x["config"]], "reject": REJECTS[x["reject"]], "contract": contracts[x["contract"]], "entry_ts": held_ts,
            "entry_bar": pd.array(np.where(none, 0, x["entry_bar"]), "Int64"), "entry_price": blank(x["entry_price"]), "entry_underlying": blank(x["entry_underlying"]),
            "fill": x["fill"], "quantity": qty[x["config"]], "qty": x["qty"], "mark": x["mark"], "cash_units": x["cash"], "equity_units": x["equity"], "night": x["night"],
        })

    return work


BAR, QUOTE, CARRIED = range(3)
BUY, SELL, OPEN = range(1, 4)
ACTIONS = np.array(["", "BUY", "SELL", "OPEN"], object)
REASONS = (NO_REASON, FORCED, STOPPED, TARGET, SIGNAL, ENTRY) = range(6)
REJECTS = np.array(["", "NO_CHAIN", "NO_LIQUIDITY"], object)
EVENT_NAMES = [f.split()[0] for f in EVENTS.split(", ")]


def run(market: Market, configs: Sequence[Config]) -> DataFrame:
    """Events of all configs: every bar on which a config holds, buys, sells or fails to, as a written table.

    Days run side by side, each as if nothing were held before it. A position that a day leaves open is then carried into the
    symbol's next day, which runs again for the configs concerned: it is offered at the first bar, and stays with the strategy's own
    rules if it does not fill. This goes on while a day's end changes what the next one begins with; a round costs only those days.
    Of the last day, what is left is offered at the last bar. ``night`` marks sales outside of the strategy's rules, and
    positions still open after the last bar (action OPEN).
    """
    names = sorted({c.strategy for c in configs})
    fold = _day(configs, market.session_minutes)
    base = market.bars.withColumn("kind", F.lit(BAR)).unionByName(market.quotes.withColumn("kind", F.lit(QUOTE)), allowMissingColumns=True)
    # With the columns of carried positions, so that every round has the same frame.
    base = base.selectExpr("*", "cast(null as int) as config_id", *[f"cast(null as {f.split()[1]}) as {f.split()[0]}" for f in _ENTRY.split(", ")])

    def done(rows: DataFrame, name: str) -> DataFrame:
        return stage(rows.groupBy("symbol", "date").applyInPandas(fold, EVENTS), name)

    def left(events: DataFrame) -> DataFrame:
        """What is held after a day's last bar, as the next day's beginning."""
        held = events.filter("not night and qty > 0 and bar = n_bars - 1").join(market.calendar.filter("next_date is not null"), ["run", "symbol", "date"])
        return held.select("config_id", "symbol", F.col("next_date").alias("date"), "contract", "entry_ts", (F.col("entry_bar") - F.col("n_bars")).alias("entry_bar"), "entry_price", "entry_underlying", "mark")

    key = ["config_id", "symbol", "date"]
    run_of = F.create_map(*[F.lit(x) for c in configs for x in (c.config_id, c.run)])
    events = done(base, "trade-events")
    carried = stage(left(events), "trade-carried")
    used = carried.limit(0)
    parts: list[tuple[DataFrame, DataFrame | None]] = [(events, None)]
    while True:
        same = F.col("a.contract").eqNullSafe(F.col("b.contract")) & F.col("a.entry_ts").eqNullSafe(F.col("b.entry_ts")) & F.col("a.mark").eqNullSafe(F.col("b.mark"))
        both = carried.alias("a").join(used.alias("b"), key, "full").filter(~same)
        changed = stage(both.select(*key, *[F.col(f"a.{c}").alias(c) for c in carried.columns if c not in key]), "trade-changed")
        if changed.isEmpty():
            break
        days = changed.select("symbol", "date").distinct()
        extra = changed.filter("contract is not null").select("symbol", "date", "contract").distinct()
        extra = extra.join(market.quotes.select("symbol", "date", "contract").distinct(), ["symbol", "date", "contract"], "left_anti")
        extra = _quoted(market.bars.select("symbol", "date", "ts").distinct().join(extra, ["symbol", "date"]), market.option_bars, names)
        again = base.join(days, ["symbol", "date"], "left_semi").unionByName(extra.withColumn("kind", F.lit(QUOTE)), allowMissingColumns=True)
        again = again.unionByName(changed.withColumn("kind", F.lit(CARRIED)), allowMissingColumns=True)
        events = done(again, "trade-events")
        parts.append((events, changed.select(*key)))
        # A day that has run again says anew what its next day begins with.
        after = changed.select(run_of[F.col("config_id")].alias("run"), "config_id", "symbol", "date").join(market.calendar, ["run", "symbol", "date"]).select("config_id", "symbol", F.col("next_date").alias("date"))
        carried = stage(carried.join(after, key, "left_anti").unionByName(left(events)), "trade-carried")
        used = stage(used.join(changed, key, "left_anti").unionByName(changed.filter("contract is not null")), "trade-used")
    out, later = None, None
    for events, keys in reversed(parts):
        kept = events if later is None else events.join(later, key, "left_anti")
        out = kept if out is None else out.unionByName(kept)
        later = keys if later is None or keys is None else later.unionByName(keys).distinct()
    return out if len(parts) == 1 else stage(out, "trade-all-events")


def _ids_of_run(configs: Sequence[Config]) -> Column:
    """One row for each config of the row's run."""
    ids: dict[str, list[int]] = {}
    for c in configs:
        ids.setdefault(c.run, []).append(c.config_id)
    known = F.create_map(*[x for run, mine in ids.items() for x in (F.lit(run), F.array(*[F.lit(i) for i in mine]))])
    return F.explode(F.try_element_at(known, F.col("run"))).alias("config_id")


def bar_log(events: DataFrame, market: Market, configs: Sequence[Config]) -> DataFrame:
    """One row per config and bar: action, reason, position and money moved by the strategy's rules."""
    bars = market.bars.select("symbol", "date", "ts", "close", "pp", "tp", _ids_of_run(configs))
    acts = events.filter("not night").select("config_id", "symbol", "ts", "action", "reason", "reject", "contract", "fill", "qty", "mark", "cash_units", "equity_units")
    none = {"action": "", "reason": "", "reject": "", "qty": 0, "mark": 0.0, "cash_units": 0, "equity_units": 0}
    out = bars.join(acts, ["config_id", "symbol", "ts"], "left").fillna(none)
    return out.withColumn("d_cash", F.col("cash_units") / MONEY_UNITS).withColumn("d_equity", F.col("equity_units") / MONEY_UNITS)


def trades(events: DataFrame, market: Market, configs: Sequence[Config]) -> DataFrame:
    """Sales with their purchases, and positions still open after the last bar, without an exit."""
    names = F.create_map(*[F.lit(x) for c in configs for x in (c.config_id, c.strategy)])
    rows = events.filter(F.col("action").isin("SELL", "OPEN")).join(market.listed, "contract", "left").withColumn("strategy", names[F.col("config_id")])
    sold = F.col("action") == "SELL"
    gain = F.col("fill") - F.col("entry_price")
    ends = lambda c: F.when(sold, F.col(c))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("entry_ts").cast("timestamp"))
    # A bar outside of the strategy's rules is not counted as held: it comes before the day's first, or after the last.
    bars = F.col("bar") - F.col("entry_bar")
    return rows.select(
        "config_id", "strategy", "symbol", F.to_date("entry_ts").alias("date"), "contract", F.col("strike").alias("entry_strike"), F.col("expiry").alias("entry_expiry"), "entry_ts", "entry_price", "entry_underlying",
        ends("ts").alias("exit_ts"), ends("fill").alias("exit_price"), ends("close").alias("exit_underlying"), ends("reason").alias("exit_reason"), "quantity",
        (ends("fill") - F.col("entry_price")).alias("_gain"), bars.cast("int").alias("holding_bars"), F.when(sold, F.floor(seconds / 60)).cast("int").alias("holding_minutes"),
    ).select(
        "*", (F.col("_gain") * F.col("quantity")).alias("pnl"),
        F.when(F.col("entry_price") > 0, F.col("_gain") / F.when(F.col("entry_price") > 0, F.col("entry_price"))).when(F.col("exit_ts").isNotNull(), F.lit(0.0)).alias("pnl_pct"),
        (F.col("_gain") * F.col("quantity") * CONTRACT_SIZE).alias("cash_pnl"),
    ).drop("_gain")


def bar_times(market: Market) -> DataFrame:
    return market.bars.select("run", "ts").distinct()


def day_starts(market: Market) -> DataFrame:
    """The first time of each date: enough rows for daily figures, since nothing changes between events."""
    return market.bars.groupBy("run", "date").agg(F.min("ts").alias("ts")).select("run", "ts")


def equity_curve(events: DataFrame, times: DataFrame, configs: Sequence[Config], capital: float = START_CAPITAL) -> DataFrame:
    """Cash, position value, equity, running peak and drawdown per config, at ``times`` and wherever something is held.

    Changes are summed per time first; running sums go over days, then inside each day. Sums are of whole units of money, so a day on
    which nothing moves ends on exactly the figure of the day before.
    """
    zero = F.lit(0).cast("long")
    rows = events.select("config_id", "ts", "cash_units", "equity_units").unionByName(times.select(_ids_of_run(configs), "ts", zero.alias("cash_units"), zero.alias("equity_units")))
    per_ts = rows.groupBy("config_id", "ts").agg(F.sum("cash_units").alias("cash_units"), F.sum("equity_units").alias("equity_units")).withColumn("_day", F.to_date("ts"))
    cum = running_totals(per_ts, ["config_id"], "_day", [F.asc("ts")], ["cash_units", "equity_units"])
    start = F.lit(round(capital * MONEY_UNITS)).cast("long")
    money = lambda c: (start + F.col(c)) / MONEY_UNITS
    curve = cum.select(
        "config_id", "_day", "ts", money("cum_cash_units").alias("cash"), money("cum_equity_units").alias("equity"),
        ((F.col("cum_equity_units") - F.col("cum_cash_units")) / MONEY_UNITS).alias("position_value"),
    )
    return with_drawdown(curve, ["config_id"], "_day").drop("_day")


def with_drawdown(curve: DataFrame, by: Sequence[str], bin_col: str) -> DataFrame:
    """Running peak and relative drawdown; days carry their peak forward, times are ordered per day."""
    by = list(by)
    day_top = curve.groupBy(*by, bin_col).agg(F.max("equity").alias("_top"))
    before = Window.partitionBy(*by).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    carried = day_top.select(*by, bin_col, F.max("_top").over(before).alias("_carried"))
    inside = Window.partitionBy(*by, bin_col).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    joined = curve.join(carried, [*by, bin_col])
    joined = joined.withColumn("equity_peak", F.greatest(F.max("equity").over(inside), F.col("_carried"))).drop("_carried")
    top = F.col("equity_peak")
    return joined.withColumn(
        "drawdown_pct", F.when(top > 0, (F.col("equity") - top) / F.when(top > 0, top)).otherwise(F.lit(0.0))
    )


def cash_shortfalls(curve: DataFrame, reserve: float = 0.0) -> DataFrame:
    """Times at which a config's purchases leave less cash than ``reserve``."""
    return curve.filter(F.col("cash") < reserve).select("config_id", "ts", "cash")
