"""Queries on trades, equity and grids."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tapewright.operators import analysis as A
from tapewright.operators import trades as T
from tapewright.operators.joins import rounded, with_names, with_rows_in
from tapewright.plans import inputs as I
from tapewright.plans.inputs import with_tables
from tapewright.plans.registry import query
from tapewright.session import stage

CONFIGS = [
    T.Config(1, "put_buy", 0.5),
    T.Config(2, "filtered_put", 0.5, min_prob_gap=0.2, min_holding_minutes=10, cooldown_minutes=15, max_trades_per_day=3),
    T.Config(3, "call_buy", 0.4, tp_pct=0.2, sl_pct=-0.1, min_holding_minutes=5, cooldown_minutes=10, max_trades_per_day=4),
]
RULES = [T.Config(7, "signal_rules", 0.5)]
RUNS = [f"{minutes}m {label}" for minutes in I.TIMEFRAMES for label in I.LABELS]
# 96 settings on the scores of each timeframe and labelling variant.
GRID = [
    c for k, run in enumerate(RUNS)
    for c in T.grid(T.Config(1000 * (k + 1), "put_buy", run=run), (0.3, 0.4, 0.5, 0.6, 0.7, 0.8), (0.05, 0.10, 0.20, 0.30), (-0.03, -0.05, -0.10, -0.20))
]


def _values(configs) -> str:
    rows = ", ".join(
        f"({c.config_id}, '{c.strategy}', '{T.STRATEGIES[c.strategy].cp}', {c.threshold}, {c.tp_pct}, {c.sl_pct}, {c.min_prob_gap}, "
        f"{c.min_holding_minutes}, {c.cooldown_minutes}, {c.max_trades_per_day}, {c.quantity}, '{c.run}')"
        for c in configs
    )
    return f"""cfg AS MATERIALIZED (SELECT config_id, strategy, cp, CAST(th AS DOUBLE) AS th, CAST(tpp AS DOUBLE) AS tpp, CAST(slp AS DOUBLE) AS slp,
        CAST(gap AS DOUBLE) AS gap, mh, cd, mx, qty, run FROM (VALUES {rows}) v(config_id, strategy, cp, th, tpp, slp, gap, mh, cd, mx, qty, run))"""


# The SQL twin walks each symbol's bars one by one for each config, across days. Money is in millionths.
WALK = """near AS MATERIALIZED (SELECT run, symbol, ts, cp, contract, strike, expiry FROM (
    SELECT s.run, s.symbol, s.ts, a.cp, a.contract, a.strike, a.expiry,
      row_number() OVER (PARTITION BY s.run, s.symbol, s.ts, a.cp ORDER BY abs(a.strike - s.close), a.contract) AS rn
    FROM runs s JOIN active a ON s.symbol = a.underlying AND s.date = a.date) WHERE rn = 1),
  sb AS MATERIALIZED (SELECT *, CAST(row_number() OVER x AS INTEGER) AS rn, minutes_from_open AS m, coalesce(date <> lag(date) OVER x, false) AS fresh,
    lead(ts) OVER x IS NULL AS final FROM runs WINDOW x AS (PARTITION BY run, symbol ORDER BY ts)),
  pairs AS (SELECT DISTINCT symbol, contract FROM near),
  qt AS MATERIALIZED (SELECT p.symbol, p.ts, p.contract, o.close AS qc, o.high AS qh, o.low AS ql, o.volume AS qv
    FROM (SELECT s.symbol, s.ts, p.contract FROM (SELECT DISTINCT symbol, ts FROM runs) s JOIN pairs p ON s.symbol = p.symbol) p
    ASOF JOIN option_bars o ON p.contract = o.contract AND p.ts >= o.ts),
  qf AS MATERIALIZED (SELECT *, (qc + greatest((qh - ql) / 2, 0.01)) * 1.005 AS ask, (qc - greatest((qh - ql) / 2, 0.01)) * 0.995 AS bid,
      greatest(qc - greatest((qh - ql) / 2, 0.01), 0.01) * 0.995 AS bidf FROM qt),
  w AS (SELECT config_id, symbol, CAST(NULL AS DATE) AS date, 0 AS rn, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS DOUBLE) AS close, CAST(NULL AS DOUBLE) AS pp,
      CAST(NULL AS DOUBLE) AS tp, '' AS action, '' AS reason, '' AS reject, CAST(NULL AS DOUBLE) AS fill, CAST(0 AS BIGINT) AS dc, CAST(0 AS BIGINT) AS de,
      CAST(NULL AS VARCHAR) AS held, CAST(NULL AS DOUBLE) AS strike, CAST(NULL AS DATE) AS expiry, CAST(NULL AS TIMESTAMP) AS ets,
      CAST(NULL AS INTEGER) AS ebar, CAST(NULL AS DOUBLE) AS ep, CAST(NULL AS DOUBLE) AS eu, CAST(NULL AS DOUBLE) AS mark,
      CAST(NULL AS INTEGER) AS ls, CAST(NULL AS INTEGER) AS em, 0 AS today, CAST(NULL AS VARCHAR) AS was, CAST(NULL AS TIMESTAMP) AS wts,
      CAST(NULL AS INTEGER) AS wbar, CAST(NULL AS DOUBLE) AS wep, CAST(NULL AS DOUBLE) AS weu, CAST(NULL AS DOUBLE) AS wst, CAST(NULL AS DATE) AS wex,
      false AS nsell, CAST(NULL AS DOUBLE) AS nfill, CAST(0 AS BIGINT) AS nde
      FROM cfg, (SELECT DISTINCT symbol FROM runs)
    UNION ALL SELECT config_id, symbol, date, rn, ts, close, pp, tp, CASE WHEN buys THEN 'BUY' WHEN sells THEN 'SELL' ELSE '' END,
      CASE WHEN buys THEN CASE cp WHEN 'P' THEN 'PEAK_SIGNAL' ELSE 'TROUGH_SIGNAL' END WHEN sells THEN leave ELSE '' END,
      CASE WHEN enter AND atm IS NULL THEN 'NO_CHAIN' WHEN enter AND NOT buys OR leave IS NOT NULL AND NOT sells THEN 'NO_LIQUIDITY' ELSE '' END,
      CASE WHEN buys THEN ask WHEN sells THEN bid END,
      CASE WHEN buys THEN -u(ask * 100 * qty) WHEN sells THEN u(bid * 100 * qty) ELSE 0 END,
      CASE WHEN sells THEN u(bid * 100 * qty) - u(mark * 100 * qty) WHEN h IS NOT NULL THEN u(nm * 100 * qty) - u(mark * 100 * qty) ELSE 0 END,
      CASE WHEN buys THEN atm WHEN sells THEN NULL ELSE h END, CASE WHEN buys THEN ast WHEN h IS NULL OR sells THEN NULL ELSE strike END,
      CASE WHEN buys THEN aex WHEN h IS NULL OR sells THEN NULL ELSE expiry END, CASE WHEN buys THEN ts WHEN h IS NULL OR sells THEN NULL ELSE ets END,
      CASE WHEN buys THEN rn WHEN h IS NULL OR sells THEN NULL ELSE ebar END, CASE WHEN buys THEN ask WHEN h IS NULL OR sells THEN NULL ELSE ep END,
      CASE WHEN buys THEN close WHEN h IS NULL OR sells THEN NULL ELSE eu END, CASE WHEN buys THEN ask WHEN h IS NULL OR sells THEN NULL ELSE nm END,
      CASE WHEN leave IS NOT NULL THEN m ELSE ls END, CASE WHEN enter THEN m ELSE em END, today + CASE WHEN enter THEN 1 ELSE 0 END,
      CASE WHEN sells OR nsell THEN held END, ets, ebar, ep, eu, strike, expiry, nsell, nfill, CASE WHEN nsell THEN u(nfill * 100 * qty) - u(mark * 100 * qty) ELSE 0 END
    FROM (SELECT *, enter AND coalesce(qv > 0, false) AND atm IS NOT NULL AS buys, leave IS NOT NULL AND coalesce(qv > 0, false) AS sells
      FROM (SELECT *, CASE WHEN h IS NULL THEN NULL WHEN m >= 270 THEN 'FORCE_CLOSE'
            WHEN nm / ep - 1 <= slp THEN CASE strategy WHEN 'signal_rules' THEN 'STOP_LOSS' ELSE 'SL' END
            WHEN nm / ep - 1 >= tpp THEN CASE strategy WHEN 'signal_rules' THEN 'PROFIT_TARGET' ELSE 'TP' END
            WHEN (em IS NULL OR m - em >= mh) AND cp = 'P' AND tp >= th AND tp > pp THEN 'TROUGH_SIGNAL'
            WHEN (em IS NULL OR m - em >= mh) AND cp = 'C' AND pp >= th AND pp > tp THEN 'PEAK_SIGNAL' END AS leave,
          h IS NULL AND m < 270 AND today < mx AND (ls IS NULL OR m - ls >= cd) AND CASE strategy
            WHEN 'put_buy' THEN pp >= th AND pp > tp WHEN 'filtered_put' THEN pp - tp >= gap AND pp >= th
            WHEN 'signal_rules' THEN pp >= th AND pp >= tp ELSE tp >= th AND tp > pp END AS enter
        FROM (SELECT s.* EXCLUDE (ls, em, today), CASE WHEN s.fresh THEN NULL ELSE s.ls END AS ls, CASE WHEN s.fresh THEN NULL ELSE s.em END AS em,
            CASE WHEN s.fresh THEN 0 ELSE s.today END AS today, CASE WHEN s.nsell THEN NULL ELSE s.held END AS h,
            CASE WHEN s.held IS NOT NULL AND NOT s.nsell THEN coalesce(s.hc, s.mark) ELSE a.qc END AS nm,
            CASE WHEN s.held IS NOT NULL AND NOT s.nsell THEN s.hv ELSE a.qv END AS qv, a.ask,
            CASE WHEN s.held IS NOT NULL AND NOT s.nsell THEN s.hbid END AS bid
          FROM (SELECT s.config_id, s.symbol, b.date, b.rn, b.ts, b.close, b.peak_prob AS pp, b.trough_prob AS tp, b.m, b.fresh, c.strategy, c.cp, c.th, c.tpp,
              c.slp, c.gap, c.mh, c.cd, c.mx, c.qty, s.held, s.strike, s.expiry, s.ets, s.ebar, s.ep, s.eu, s.mark, s.ls, s.em, s.today,
              n.contract AS atm, n.strike AS ast, n.expiry AS aex, q.qc AS hc, q.qv AS hv, CASE c.strategy WHEN 'signal_rules' THEN q.bidf ELSE q.bid END AS hbid,
              b.fresh AND s.held IS NOT NULL AND coalesce(q.qv > 0, false) AS nsell,
              CASE WHEN b.fresh AND s.held IS NOT NULL AND q.qv > 0 THEN CASE c.strategy WHEN 'signal_rules' THEN q.bidf ELSE q.bid END END AS nfill
            FROM w s JOIN cfg c ON c.config_id = s.config_id JOIN sb b ON s.symbol = b.symbol AND b.run = c.run AND b.rn = s.rn + 1
            LEFT JOIN near n ON n.run = b.run AND n.symbol = b.symbol AND n.ts = b.ts AND n.cp = c.cp
            LEFT JOIN qf q ON q.symbol = b.symbol AND q.ts = b.ts AND q.contract = s.held) s
          LEFT JOIN qf a ON a.symbol = s.symbol AND a.ts = s.ts AND a.contract = s.atm)))),
  log AS MATERIALIZED (SELECT * FROM w WHERE rn > 0),
  sold AS (SELECT config_id, symbol, was AS contract, wst AS entry_strike, wex AS entry_expiry, wts AS entry_ts, wep AS entry_price,
      weu AS entry_underlying, ts AS exit_ts, CASE WHEN nsell THEN nfill ELSE fill END AS exit_price, close AS exit_underlying,
      CASE WHEN nsell THEN 'FORCE_CLOSE' ELSE reason END AS exit_reason, CASE WHEN nsell THEN rn - 1 ELSE rn END - wbar AS holding_bars
    FROM log WHERE action = 'SELL' OR nsell),
  rest AS MATERIALIZED (SELECT l.config_id, l.symbol, l.held AS contract, l.strike AS entry_strike, l.expiry AS entry_expiry, l.ets AS entry_ts,
      l.ep AS entry_price, l.eu AS entry_underlying, CASE WHEN q.qv > 0 THEN l.ts END AS exit_ts,
      CASE WHEN q.qv > 0 THEN CASE c.strategy WHEN 'signal_rules' THEN q.bidf ELSE q.bid END END AS exit_price,
      CASE WHEN q.qv > 0 THEN l.close END AS exit_underlying, CASE WHEN q.qv > 0 THEN 'FORCE_CLOSE' END AS exit_reason, l.rn - l.ebar AS holding_bars, l.mark
    FROM log l JOIN cfg c USING (config_id) JOIN sb b ON l.symbol = b.symbol AND l.rn = b.rn AND b.run = c.run AND b.final
    LEFT JOIN qf q ON q.symbol = l.symbol AND q.ts = l.ts AND q.contract = l.held WHERE l.held IS NOT NULL),
  tr AS MATERIALIZED (SELECT t.*, CAST(t.entry_ts AS DATE) AS date, c.strategy, CAST(c.qty AS INTEGER) AS quantity, (exit_price - entry_price) * c.qty AS pnl,
      CASE WHEN entry_price > 0 THEN (exit_price - entry_price) / entry_price ELSE 0 END AS pnl_pct, (exit_price - entry_price) * c.qty * 100 AS cash_pnl,
      CAST(floor((epoch(exit_ts) - epoch(entry_ts)) / 60) AS INTEGER) AS holding_minutes
    FROM (SELECT * FROM sold UNION ALL SELECT * EXCLUDE (mark) FROM rest) t JOIN cfg c USING (config_id))"""
WALK = re.sub(r"u\(([a-z]+) \* 100 \* qty\)", r"CAST(round(\1 * (100 * qty) * 1000000) AS BIGINT)", WALK)

# Equity is cash plus what is held at its mark, from each bar's position rather than from booked changes.
CURVE = """, st AS (SELECT config_id, symbol, 0 AS late, ts, dc + CASE WHEN nsell THEN u(nfill * 100 * qty) ELSE 0 END AS dc,
      CASE WHEN l.held IS NULL THEN 0 ELSE u(mark * 100 * qty) END AS val FROM log l JOIN cfg c USING (config_id)
    UNION ALL SELECT config_id, symbol, 1, exit_ts, u(exit_price * 100 * qty), 0 FROM rest JOIN cfg c USING (config_id) WHERE exit_ts IS NOT NULL),
  ch AS (SELECT config_id, ts, dc, val - coalesce(lag(val) OVER (PARTITION BY config_id, symbol ORDER BY ts, late), 0) AS dv FROM st),
  eq AS MATERIALIZED (SELECT config_id, ts, CAST(10000000000000 + sum(dc) OVER v AS DOUBLE) / 1000000 AS cash,
      CAST(10000000000000 + sum(dc) OVER v + sum(dv) OVER v AS DOUBLE) / 1000000 AS equity, CAST(sum(dv) OVER v AS DOUBLE) / 1000000 AS position_value
    FROM (SELECT config_id, ts, CAST(sum(dc) AS BIGINT) AS dc, CAST(sum(dv) AS BIGINT) AS dv FROM ch GROUP BY 1, 2) WINDOW v AS (PARTITION BY config_id ORDER BY ts)),
  curve AS MATERIALIZED (SELECT *, max(equity) OVER v AS equity_peak,
    (equity - max(equity) OVER v) / max(equity) OVER v AS drawdown_pct FROM eq WINDOW v AS (PARTITION BY config_id ORDER BY ts)),
  dl AS (SELECT config_id, CAST(ts AS DATE) AS d, arg_max(equity, ts) AS e, arg_min(equity, ts) AS f, min(drawdown_pct) AS dd FROM curve GROUP BY 1, 2),
  rt AS (SELECT *, e / lag(e) OVER (PARTITION BY config_id ORDER BY d) - 1 AS r FROM dl),
  em AS MATERIALIZED (SELECT config_id, (arg_max(e, d) - arg_min(f, d)) / arg_min(f, d) AS total_return, min(dd) AS max_drawdown_pct,
      CASE WHEN count(r) >= 2 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0 END AS sharpe_ratio,
      CASE WHEN count(r) FILTER (r < 0) >= 2 AND stddev_samp(r) FILTER (r < 0) > 0 THEN avg(r) / stddev_samp(r) FILTER (r < 0) * sqrt(252) ELSE 0 END AS sortino_ratio
    FROM rt GROUP BY 1)"""
CURVE = re.sub(r"u\(([a-z_]+) \* 100 \* qty\)", r"CAST(round(\1 * (100 * qty) * 1000000) AS BIGINT)", CURVE)
TM = """, tm AS MATERIALIZED (SELECT config_id, count(*) AS total_trades, count(*) FILTER (pnl > 0) / count(*) AS win_rate,
    coalesce(avg(pnl_pct) FILTER (pnl > 0), 0) AS avg_win_pct, coalesce(avg(pnl_pct) FILTER (pnl < 0), 0) AS avg_loss_pct,
    CASE WHEN coalesce(sum(pnl) FILTER (pnl < 0), 0) = 0 THEN CASE WHEN sum(pnl) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END
      ELSE coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl < 0)) END AS profit_factor,
    avg(holding_minutes) AS avg_holding_minutes, sum(pnl) AS total_pnl FROM tr WHERE exit_ts IS NOT NULL GROUP BY 1)"""


def _sql(body: str, configs, tail: str = "") -> str:
    runs = "SELECT * FROM scored_runs" if configs[0].run else "SELECT *, '' AS run FROM scored"
    return with_tables(body, "scored_runs" if configs[0].run else "scored", "active", "option_bars", recursive=True, extra=f"runs AS MATERIALIZED ({runs}), {_values(configs)}, {WALK}{tail}")


def _run(spark, folder, configs):
    """Events of the configs and what they share, as stage tables, since trades, curves and metrics all read them."""
    listed = stage(I.contracts(spark, folder), "contracts")
    options = stage(I.option_bars(spark, folder, listed), "option_bars")
    market = T.market((I.scored_runs if configs[0].run else I.scored)(spark, folder), listed, options, configs)
    return T.run(market, configs), market


def _log(spark, folder, configs):
    events, market = _run(spark, folder, configs)
    return T.bar_log(events, market, configs)


@query(
    "B-01 X-01",
    with_tables(
        f"""SELECT c.config_id, s.symbol, s.ts FROM scored s, cfg c WHERE minutes_from_open < 270 AND CASE strategy WHEN 'put_buy' THEN peak_prob >= th AND peak_prob > trough_prob
          WHEN 'filtered_put' THEN peak_prob - trough_prob >= gap AND peak_prob >= th ELSE trough_prob >= th AND trough_prob > peak_prob END""",
        "scored",
        extra=_values(CONFIGS),
    ),
)
def entry_candidates(spark, folder):
    return T.entry_candidates(I.scored(spark, folder), CONFIGS).select("config_id", "symbol", "ts")


ROUND_LOG = "config_id, symbol, date, ts, action, reason, reject, round(fill, 8) AS fill, CAST(dc AS DOUBLE) / 1000000 AS d_cash, CAST(de AS DOUBLE) / 1000000 AS d_equity, round(CASE WHEN held IS NULL THEN 0 ELSE mark END, 8) AS mark"


def _show(log):
    return rounded(log.select("config_id", "symbol", "date", "ts", "action", "reason", "reject", "fill", "d_cash", "d_equity", "mark"), ["fill", "mark"])


@query("B-01 B-02 B-03 B-04 B-05 B-06 B-08 S-25 S-27 P-08", _sql(f"SELECT {ROUND_LOG} FROM log", CONFIGS))
def strategy_bar_log(spark, folder):
    return _show(_log(spark, folder, CONFIGS))


@query("B-10 P-13", _sql(f"SELECT {ROUND_LOG} FROM log", RULES))
def signal_rule_log(spark, folder):
    return _show(_log(spark, folder, RULES))


TRADE_COLS = """config_id, strategy, symbol, date, contract, entry_strike, entry_expiry, entry_ts, round(entry_price, 8) AS entry_price, entry_underlying,
  exit_ts, round(exit_price, 8) AS exit_price, exit_underlying, exit_reason, quantity, round(pnl, 8) AS pnl, round(pnl_pct, 8) AS pnl_pct,
  round(cash_pnl, 6) AS cash_pnl, holding_bars, holding_minutes"""


def _trades(spark, folder):
    events, market = _run(spark, folder, CONFIGS)
    return T.trades(events, market, CONFIGS)


@query("B-04 B-06 B-07 W-29 S-19", _sql(f"SELECT {TRADE_COLS} FROM tr", CONFIGS))
def strategy_trades(spark, folder):
    return rounded(rounded(_trades(spark, folder), ["entry_price", "exit_price", "pnl", "pnl_pct"]), ["cash_pnl"], 6)


CURVE_COLS = ["cash", "equity", "position_value", "equity_peak"]


@query(
    "B-08 W-26 A-23",
    _sql(
        f"SELECT config_id, ts, {', '.join(f'round({c}, 6) AS {c}' for c in CURVE_COLS)}, round(drawdown_pct, 8) AS drawdown_pct FROM curve", CONFIGS, CURVE
    ),
)
def equity_curves(spark, folder):
    return rounded(rounded(_curve(spark, folder, CONFIGS), CURVE_COLS, 6), ["drawdown_pct"])


def _curve(spark, folder, configs):
    events, market = _run(spark, folder, configs)
    return T.equity_curve(events, T.bar_times(market), configs)


@query("B-08", _sql("SELECT config_id, ts, round(cash, 6) AS cash FROM curve WHERE cash < 9999000", CONFIGS, CURVE))
def cash_below(spark, folder):
    # A reserve that the test data's purchases reach.
    return rounded(T.cash_shortfalls(_curve(spark, folder, CONFIGS), 9_999_000), ["cash"], 6)


TMC = ["win_rate", "avg_win_pct", "avg_loss_pct", "profit_factor", "avg_holding_minutes", "total_pnl"]
EMC = ["total_return", "max_drawdown_pct", "sharpe_ratio", "sortino_ratio"]


@query(
    "A-25",
    _sql(f"SELECT config_id, total_trades, {', '.join(f'round({c}, 7) AS {c}' for c in TMC)} FROM tm", CONFIGS, TM),
)
def trade_metrics(spark, folder):
    return rounded(A.trade_metrics(_trades(spark, folder)), TMC, 7)


@query(
    "A-26 F-09",
    _sql(
        """SELECT config_id, kind, key, count(*) AS n, round(sum(pnl), 7) AS pnl FROM (
          SELECT config_id, pnl, 'exit_reason' AS kind, exit_reason AS key FROM tr WHERE exit_ts IS NOT NULL
          UNION ALL SELECT config_id, pnl, 'month', strftime(exit_ts, '%Y-%m') FROM tr WHERE exit_ts IS NOT NULL
          UNION ALL SELECT config_id, pnl, 'weekday', strftime(exit_ts, '%A') FROM tr WHERE exit_ts IS NOT NULL) GROUP BY 1, 2, 3""",
        CONFIGS,
    ),
)
def trade_breakdown(spark, folder):
    return rounded(A.breakdown(_trades(spark, folder)), ["pnl"], 7)


@query("A-27 A-23", _sql(f"SELECT config_id, {', '.join(f'round({c}, 8) AS {c}' for c in EMC)} FROM em", CONFIGS, CURVE))
def equity_metrics(spark, folder):
    return rounded(A.equity_metrics(_curve(spark, folder, CONFIGS)), EMC)


@query(
    "A-30 S-27",
    _sql(
        """SELECT config_id, total_bars, buys, sells, round(initial_equity, 4) AS initial_equity, round(final_equity, 4) AS final_equity,
          round(max_drawdown_pct, 8) AS max_drawdown_pct, round(equity_high, 4) AS equity_high, round((final_equity - initial_equity) / initial_equity, 8) AS return_pct
        FROM (SELECT config_id, count(*) AS total_bars, count(*) FILTER (action = 'BUY') AS buys, count(*) FILTER (action = 'SELL') AS sells FROM log GROUP BY 1)
        JOIN (SELECT config_id, arg_min(equity, ts) AS initial_equity, arg_max(equity, ts) AS final_equity, min(drawdown_pct) AS max_drawdown_pct,
          max(equity_peak) AS equity_high FROM curve GROUP BY 1) USING (config_id)""",
        RULES, CURVE,
    ),
)
def tracker_summary(spark, folder):
    events, market = _run(spark, folder, RULES)
    out = A.tracker_summary(T.bar_log(events, market, RULES), T.equity_curve(events, T.bar_times(market), RULES))
    return rounded(rounded(out, ["initial_equity", "final_equity", "equity_high"], 4), ["max_drawdown_pct", "return_pct"])


@query(
    "A-31 J-19",
    _sql(
        """SELECT config_id, symbol, date, buys, sells, round(total_cost, 7) AS total_cost, peak_signals, trough_signals, round(coalesce(net, 0), 7) AS net_pnl
        FROM (SELECT config_id, symbol, date, count(*) FILTER (action = 'BUY') AS buys, count(*) FILTER (action = 'SELL') AS sells,
            coalesce(sum(fill) FILTER (action = 'BUY'), 0) AS total_cost, count(*) FILTER (pp >= 0.5 AND pp >= tp) AS peak_signals,
            count(*) FILTER (tp >= 0.5 AND tp > pp) AS trough_signals FROM log GROUP BY 1, 2, 3) a
        LEFT JOIN (SELECT s.config_id, s.symbol, s.date, sum(s.fill - b.fill) AS net FROM log s JOIN
            (SELECT config_id, symbol, date, held, arg_min(fill, ts) AS fill FROM log WHERE action = 'BUY' GROUP BY 1, 2, 3, 4) b
            ON s.config_id = b.config_id AND s.symbol = b.symbol AND s.date = b.date AND s.was = b.held WHERE s.action = 'SELL' AND NOT s.nsell GROUP BY 1, 2, 3) n
          USING (config_id, symbol, date)""",
        RULES,
    ),
)
def session_summaries(spark, folder):
    return rounded(A.session_summary(_log(spark, folder, RULES), 0.5), ["total_cost", "net_pnl"], 7)


@query(
    "J-18",
    _sql(
        """SELECT l.config_id, l.symbol, l.date, l.ts, l.action, round(CASE WHEN l.action = 'BUY' THEN s.high + greatest(g.span * 0.03, 0.3)
          ELSE s.low - greatest(g.span * 0.03, 0.3) END, 8) AS y
        FROM log l JOIN sess s ON l.symbol = s.symbol AND l.ts = s.ts JOIN (SELECT symbol, date, max(high) - min(low) AS span FROM sess GROUP BY 1, 2) g
          ON l.symbol = g.symbol AND l.date = g.date WHERE l.action <> ''""",
        CONFIGS,
    ),
)
def trade_markers(spark, folder):
    return rounded(A.marker_prices(_log(spark, folder, CONFIGS), I.session(spark, folder)), ["y"])


PARAMS = "config_id, strategy, th AS threshold, tpp AS tp_pct, slp AS sl_pct, split_part(run, ' ', 1) AS timeframe, split_part(run, ' ', 2) AS label_config"


def _params(spark, configs):
    # Literals in the plan: rows handed over by createDataFrame would start Python workers on every executor.
    names = ("config_id", "strategy", "threshold", "tp_pct", "sl_pct", "timeframe", "label_config")
    rows = [(c.config_id, c.strategy, float(c.threshold), float(c.tp_pct), float(c.sl_pct), *c.run.split(" ")) for c in configs]
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row)]) for row in rows])))


def _comparison(spark, folder):
    events, market = _run(spark, folder, GRID)
    curve = T.equity_curve(events, T.day_starts(market), GRID)
    return A.compare(T.trades(events, market, GRID), curve).join(_params(spark, GRID), "config_id")


COMPARED = f"""SELECT {PARAMS}, {', '.join(f'round({c}, 8) AS {c}' for c in EMC)}, coalesce(total_trades, 0) AS total_trades,
  {', '.join(f'round(coalesce({c}, 0), 7) AS {c}' for c in TMC)} FROM cfg JOIN em USING (config_id) LEFT JOIN tm USING (config_id)"""


@query("B-09 A-28 J-11 K-04", _sql(COMPARED, GRID, CURVE + TM))
def grid_comparison(spark, folder):
    return rounded(rounded(_comparison(spark, folder), EMC), TMC, 7)


@query("K-04", _sql(f"SELECT * FROM ({COMPARED}) ORDER BY total_return DESC, config_id LIMIT 1", GRID, CURVE + TM))
def grid_best(spark, folder):
    return A.best(rounded(rounded(_comparison(spark, folder), EMC), TMC, 7))


@query(
    "A-29",
    _sql(
        """SELECT dimension, value, count(*) AS n_configs, round(avg(total_return), 8) AS avg_return, round(max(total_return), 8) AS best_return,
          round(avg(win_rate), 8) AS avg_win_rate, round(avg(total_trades), 8) AS avg_trades, count(*) FILTER (total_return > 0) AS profitable FROM (
          SELECT g.*, d.dimension, CASE d.dimension WHEN 'threshold' THEN CAST(th AS VARCHAR) WHEN 'tp_pct' THEN CAST(tpp AS VARCHAR)
            WHEN 'sl_pct' THEN CAST(slp AS VARCHAR) WHEN 'timeframe' THEN split_part(run, ' ', 1) WHEN 'label_config' THEN split_part(run, ' ', 2) ELSE strategy END AS value
          FROM (SELECT cfg.*, em.total_return, coalesce(tm.win_rate, 0) AS win_rate, coalesce(tm.total_trades, 0) AS total_trades
                FROM cfg JOIN em USING (config_id) LEFT JOIN tm USING (config_id)) g, (VALUES ('threshold'), ('tp_pct'), ('sl_pct'), ('strategy'), ('timeframe'), ('label_config')) d(dimension)) GROUP BY 1, 2""",
        GRID, CURVE + TM,
    ),
)
def grid_marginals(spark, folder):
    out = A.marginals(_comparison(spark, folder), ["threshold", "tp_pct", "sl_pct", "strategy", "timeframe", "label_config"])
    return rounded(out, ["avg_return", "best_return", "avg_win_rate", "avg_trades"])


@query(
    "J-09 S-22",
    with_tables("SELECT symbol, ts FROM scored WHERE symbol IN (SELECT symbol FROM option_bars WHERE volume > 4)", "scored", "option_bars"),
)
def scores_with_options(spark, folder):
    busy = I.option_bars(spark, folder).filter(F.col("volume") > 4)
    return with_rows_in(I.scored(spark, folder), busy, ["symbol"]).select("symbol", "ts")


@query(
    "J-20",
    """SELECT s.s_suppkey, n.name FROM supplier s LEFT JOIN
      (SELECT n_nationkey, CASE WHEN n_nationkey % 5 > 0 THEN n_name END AS name FROM nation) n ON s.s_nationkey = n.n_nationkey""",
)
def instrument_names(spark, folder):
    name = F.when(F.col("n_nationkey") % 5 > 0, F.col("n_name")).otherwise(F.lit(" "))
    names = I.table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), name.alias("name"))
    return with_names(I.table(spark, folder, "supplier"), names, "s_nationkey").select("s_suppkey", "name")
