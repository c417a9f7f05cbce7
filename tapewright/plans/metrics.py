"""Queries on splits, precision-recall measures and signal pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import metrics as M
from tapewright.operators import splits as S
from tapewright.operators.joins import rounded
from tapewright.plans.inputs import minute_bars, scored, table, with_tables
from tapewright.plans.registry import query

LINES = """lines AS (SELECT l_linestatus AS side, round((l_discount * 7 + l_tax * 3) / CAST(1.0 AS DOUBLE) + (l_orderkey % 13) / CAST(100 AS DOUBLE), 4) AS score,
  l_returnflag = 'R' AS y FROM lineitem)"""


def _lines(spark, folder):
    score = F.col("l_discount") * 7 + F.col("l_tax") * 3 + (F.col("l_orderkey") % 13) / 100.0
    return table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("side"), F.round(score, 4).alias("score"), (F.col("l_returnflag") == "R").alias("y")
    )


CURVE = f"""{LINES}, cnt AS (SELECT side, score, count(*) AS n, count(*) FILTER (y) AS pos FROM lines GROUP BY 1, 2),
  cum AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS cn, CAST(sum(pos) OVER w AS DOUBLE) AS cp, sum(pos) OVER (PARTITION BY side) AS allpos
    FROM cnt WINDOW w AS (PARTITION BY side ORDER BY score DESC))"""


@query(
    "A-18",
    f"WITH {CURVE} SELECT side, score, n, pos, round(cp / cn, 8) AS precision, round(cp / allpos, 8) AS recall FROM cum",
)
def precision_recall_curve(spark, folder):
    return rounded(M.pr_curve(_lines(spark, folder), ["side"], "score", "y"), ["precision", "recall"])


@query(
    "A-19",
    f"""WITH {CURVE} SELECT side, round(sum(pos * cp / cn) / sum(pos), 8) AS pr_auc, CAST(sum(n) AS BIGINT) AS n,
      CAST(sum(pos) AS BIGINT) AS positives FROM cum GROUP BY 1""",
)
def average_precision(spark, folder):
    return rounded(M.average_precision(_lines(spark, folder), ["side"], "score", "y"), ["pr_auc"])


@query(
    "A-20",
    f"""WITH {LINES}, c AS (SELECT side, CAST(t AS DOUBLE) AS threshold, count(*) FILTER (y AND score >= CAST(t AS DOUBLE)) AS tp,
        count(*) FILTER (score >= CAST(t AS DOUBLE)) AS pp, count(*) FILTER (y) AS p
        FROM lines, (VALUES (0.3), (0.4), (0.5), (0.6), (0.7)) v(t) GROUP BY 1, 2),
      d AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS prec, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS rec FROM c)
    SELECT side, threshold, tp, pp - tp AS fp, p - tp AS fn, round(prec, 4) AS precision, round(rec, 4) AS recall,
      round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END, 4) AS f1, pp AS predicted_positives FROM d""",
)
def threshold_table(spark, folder):
    return M.threshold_table(_lines(spark, folder), ["side"], "score", "y")


NEAREST = """r AS MATERIALIZED (SELECT symbol, ts, label = {label} AS a, {score} >= 0.6 AS p, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM scored),
  err AS MATERIALIZED (SELECT symbol, ts, CAST(arg_min(d, struct_pack(x := abs(d), y := d)) AS INTEGER) AS error_bars
    FROM (SELECT a.symbol, a.ts, p.rn - a.rn AS d FROM r a JOIN r p ON a.symbol = p.symbol WHERE a.a AND p.p) GROUP BY 1, 2)"""


@query("J-15", with_tables("SELECT * FROM err", "scored", extra=NEAREST.format(label=1, score="peak_prob")))
def nearest_predictions(spark, folder):
    s = scored(spark, folder)
    return M.nearest_event(s, F.col("label") == 1, F.col("peak_prob") >= 0.6).filter(F.col("error_bars").isNotNull())


ERRORS = """SELECT t.symbol, total_actual, total_predicted, count(*) AS matched, round(avg(e), 8) AS mean_error_bars,
    round(quantile_cont(e, 0.5), 8) AS median_error_bars, round(stddev_pop(e), 7) AS std_error_bars, round(avg(abs(e)), 8) AS mae_bars,
    round(avg(CASE WHEN abs(e) <= 3 THEN 1 ELSE 0 END), 8) AS on_time_pct, round(avg(CASE WHEN e < -3 THEN 1 ELSE 0 END), 8) AS early_pct,
    round(avg(CASE WHEN e > 3 THEN 1 ELSE 0 END), 8) AS late_pct, {within}
  FROM (SELECT symbol, CAST(error_bars AS DOUBLE) AS e FROM err) JOIN
    (SELECT symbol, count(*) FILTER (a) AS total_actual, count(*) FILTER (p) AS total_predicted FROM r GROUP BY 1) t USING (symbol)
  GROUP BY 1, 2, 3""".format(within=", ".join(f"round(avg(CASE WHEN abs(e) <= {k} THEN 1 ELSE 0 END), 8) AS within_{k}" for k in (1, 2, 3, 5)))
ERROR_COLS = ["mean_error_bars", "median_error_bars", "mae_bars", "on_time_pct", "early_pct", "late_pct", *[f"within_{k}" for k in (1, 2, 3, 5)]]


@query("A-21", with_tables(ERRORS, "scored", extra=NEAREST.format(label=1, score="peak_prob")))
def timing_errors(spark, folder):
    out = M.time_error(scored(spark, folder), "peak_prob", 1, threshold=0.6)
    return rounded(rounded(out, ERROR_COLS), ["std_error_bars"], 7)


def _target(label: int, score: str) -> str:
    inner = f"""(SELECT symbol, {score} AS score, count(*) AS n, count(*) FILTER (label = {label}) AS pos FROM scored GROUP BY 1, 2)"""
    return f"""SELECT e.*, a.pr_auc, a.n, a.positives, '{'peak' if label == 1 else 'trough'}' AS target FROM
      (WITH {NEAREST.format(label=label, score=score)} {ERRORS}) e JOIN
      (SELECT symbol, round(coalesce(sum(pos * cp / cn) / sum(pos), 0), 8) AS pr_auc, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives FROM
        (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS cn, CAST(sum(pos) OVER w AS DOUBLE) AS cp FROM {inner}
         WINDOW w AS (PARTITION BY symbol ORDER BY score DESC)) GROUP BY 1) a USING (symbol)"""


@query("A-22", with_tables(f"{_target(1, 'peak_prob')} UNION ALL BY NAME {_target(2, 'trough_prob')}", "scored"))
def full_evaluation(spark, folder):
    out = M.full_evaluation(scored(spark, folder), "peak_prob", "trough_prob", 0.6).drop("thresholds", *PAIRED)
    return rounded(rounded(out, [*ERROR_COLS, "pr_auc"]), ["std_error_bars"], 7)


PAIRED = ["buy_hold_return", "n_trades", "total_return", "win_rate", "avg_win", "avg_loss", "profit_factor", "max_drawdown", "sharpe_approx"]


def _thresholds(label: int, score: str) -> str:
    return f"""SELECT symbol, '{'peak' if label == 1 else 'trough'}' AS target, CAST(t AS DOUBLE) AS threshold, tp, pp - tp AS fp, p - tp AS fn,
      round(CASE WHEN pp > 0 THEN tp / pp ELSE 0 END, 4) AS precision, round(CASE WHEN p > 0 THEN tp / p ELSE 0 END, 4) AS recall,
      round(CASE WHEN tp > 0 THEN 2 * (tp / pp) * (tp / p) / (tp / pp + tp / p) ELSE 0 END, 4) AS f1, pp AS predicted_positives FROM
      (SELECT symbol, t, count(*) FILTER (label = {label} AND {score} >= CAST(t AS DOUBLE)) AS tp, count(*) FILTER ({score} >= CAST(t AS DOUBLE)) AS pp,
         count(*) FILTER (label = {label}) AS p FROM scored, (VALUES (0.3), (0.4), (0.5), (0.6), (0.7)) v(t) GROUP BY 1, 2)"""


@query("A-22 A-20", with_tables(f"{_thresholds(1, 'peak_prob')} UNION ALL {_thresholds(2, 'trough_prob')}", "scored"))
def full_evaluation_thresholds(spark, folder):
    out = M.full_evaluation(scored(spark, folder), "peak_prob", "trough_prob", 0.6)
    return out.select("symbol", "target", F.inline("thresholds"))


# The SQL twin walks the bars one by one.
PAIRS = """b AS MATERIALIZED (SELECT symbol, ts, close, peak_prob >= 0.7 AS p, trough_prob >= 0.7 AS t, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM scored),
  walk AS (SELECT symbol, rn, CAST(0 AS INTEGER) AS pos, CAST(NULL AS TIMESTAMP) AS ets, CAST(NULL AS DOUBLE) AS ep, false AS sold FROM b WHERE rn = 1
    UNION ALL SELECT b.symbol, b.rn, CASE WHEN w.pos = 0 AND b.t THEN 1 WHEN w.pos = 1 AND b.p THEN 0 ELSE w.pos END,
      CASE WHEN w.pos = 0 AND b.t THEN b.ts ELSE w.ets END, CASE WHEN w.pos = 0 AND b.t THEN b.close * 1.001 ELSE w.ep END, w.pos = 1 AND b.p
    FROM walk w JOIN b ON b.symbol = w.symbol AND b.rn = w.rn + 1),
  pairs AS MATERIALIZED (SELECT w.symbol, w.ets AS entry_ts, b.ts AS exit_ts, w.ep AS entry_price, b.close * 0.999 AS exit_price,
    (b.close * 0.999 - w.ep) / w.ep AS pnl FROM walk w JOIN b ON w.symbol = b.symbol AND w.rn = b.rn WHERE w.sold)"""


@query(
    "W-25",
    with_tables(
        "SELECT symbol, entry_ts, exit_ts, round(entry_price, 8) AS entry_price, round(exit_price, 8) AS exit_price, round(pnl, 8) AS pnl_pct FROM pairs",
        "scored", recursive=True, extra=PAIRS,
    ),
)
def signal_pairs(spark, folder):
    out = M.signal_pairs(scored(spark, folder), "peak_prob", "trough_prob", 0.7, 0.7)
    return rounded(out, ["entry_price", "exit_price", "pnl_pct"])


@query(
    "A-24 A-23",
    with_tables(
        """SELECT h.symbol, round(bh, 8) AS buy_hold_return, coalesce(n, 0) AS n_trades, round(coalesce(tr, 0), 6) AS total_return,
          round(coalesce(wr, 0), 8) AS win_rate, round(aw, 8) AS avg_win, round(al, 8) AS avg_loss, round(pf, 6) AS profit_factor,
          round(dd, 8) AS max_drawdown, round(sh, 6) AS sharpe_approx
        FROM (SELECT symbol, (arg_max(close, ts) - arg_min(close, ts)) / arg_min(close, ts) AS bh FROM scored GROUP BY 1) h LEFT JOIN
          (SELECT symbol, count(*) AS n, product(1 + pnl) - 1 AS tr, count(*) FILTER (pnl > 0) / count(*) AS wr,
             coalesce(avg(pnl) FILTER (pnl > 0), 0) AS aw, coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS al,
             abs(coalesce(sum(pnl) FILTER (pnl > 0), 0)) / abs(sum(pnl) FILTER (pnl <= 0)) AS pf, max((top - eq) / top) AS dd,
             avg(pnl) / stddev_pop(pnl) * sqrt(252) AS sh
           FROM (SELECT *, greatest(1, max(eq) OVER (PARTITION BY symbol ORDER BY exit_ts)) AS top FROM
             (SELECT *, product(1 + pnl) OVER (PARTITION BY symbol ORDER BY exit_ts) AS eq FROM pairs)) GROUP BY 1) s USING (symbol)""",
        "scored", recursive=True, extra=PAIRS,
    ),
)
def pairing_summary(spark, folder):
    s = scored(spark, folder)
    out = M.pairing_summary(s, M.signal_pairs(s, "peak_prob", "trough_prob", 0.7, 0.7))
    out = rounded(out, ["buy_hold_return", "win_rate", "avg_win", "avg_loss", "max_drawdown"])
    return rounded(out, ["total_return", "profit_factor", "sharpe_approx"], 6)


@query(
    "A-22 A-24",
    with_tables(
        """SELECT symbol, target, coalesce(n, 0) AS n_trades, round(coalesce(r, 0), 6) AS total_return, round(coalesce(wr, 0), 8) AS win_rate
        FROM (SELECT DISTINCT symbol FROM scored) LEFT JOIN (SELECT symbol, count(*) AS n, product(1 + pnl) - 1 AS r, count(*) FILTER (pnl > 0) / count(*) AS wr
          FROM pairs GROUP BY 1) USING (symbol), (VALUES ('peak'), ('trough')) v(target)""",
        "scored", recursive=True, extra=PAIRS.replace("0.7", "0.6"),
    ),
)
def full_evaluation_pairing(spark, folder):
    out = M.full_evaluation(scored(spark, folder), "peak_prob", "trough_prob", 0.6)
    return rounded(rounded(out.select("symbol", "target", "n_trades", "total_return", "win_rate"), ["total_return"], 6), ["win_rate"])


@query(
    "P-12 P-13",
    with_tables(
        """SELECT symbol, ts, CAST(CASE WHEN pp >= 0.5 AND pp > tp THEN 1 WHEN tp >= 0.5 AND tp > pp THEN 2 ELSE 0 END AS TINYINT) AS label,
          CAST(CASE WHEN pp >= 0.5 AND pp > tp THEN 1 WHEN tp >= 0.5 AND tp > pp THEN 2 WHEN pp >= 0.5 THEN 1 WHEN tp >= 0.5 THEN 2 ELSE 0 END AS TINYINT) AS signal
        FROM (SELECT *, round(peak_prob, 1) AS pp, round(trough_prob, 1) AS tp FROM scored)""",
        "scored",
    ),
)
def score_decisions(spark, folder):
    pp, tp = F.round("peak_prob", 1), F.round("trough_prob", 1)
    return scored(spark, folder).select(
        "symbol", "ts", M.decide(pp, tp, 0.5).alias("label"), M.decide(pp, tp, 0.5, tie="peak").alias("signal")
    )


ORDERS = "ord AS (SELECT o_orderkey, o_orderdate AS ts, o_totalprice, max(o_orderdate) OVER () AS last FROM orders)"


def _orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), "o_totalprice")


SPLIT = """CASE WHEN ts < last - INTERVAL 12 MONTH - INTERVAL 6 MONTH THEN 'train' WHEN ts < last - INTERVAL 12 MONTH THEN 'val' ELSE 'test' END"""


@query("W-30", f"WITH {ORDERS} SELECT o_orderkey, {SPLIT} AS split FROM ord")
def time_split(spark, folder):
    return S.time_split(_orders(spark, folder), tie="o_orderkey").select("o_orderkey", "split")


@query(
    "W-30",
    with_tables(
        """SELECT symbol, ts, CASE WHEN r < floor(n * 0.6) THEN 'train' WHEN r < floor(n * 0.8) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT symbol, ts, row_number() OVER (ORDER BY ts, symbol) - 1 AS r, count(*) OVER () AS n FROM bars)""",
        "bars",
    ),
)
def ratio_split(spark, folder):
    # One month of bars is too short for calendar splits, so the fallback applies.
    return S.time_split(minute_bars(spark, folder)).select("symbol", "ts", "split")


@query(
    "W-31 S-18",
    """WITH span AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders),
      folds AS (SELECT CAST(k AS INTEGER) AS fold, a + to_months(CAST(k AS INTEGER)) AS s, a + to_months(CAST(k AS INTEGER) + 6) AS m,
        a + to_months(CAST(k AS INTEGER) + 7) AS e, b FROM span, range(0, 200) r(k))
    SELECT fold, CASE WHEN o_orderdate < m THEN 'train' ELSE 'test' END AS role, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM folds JOIN orders ON o_orderdate >= s AND o_orderdate < e WHERE e <= b + INTERVAL 1 DAY GROUP BY 1, 2""",
)
def walk_forward_folds(spark, folder):
    rows = S.walk_forward(_orders(spark, folder))
    return rounded(rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), ["total"], 2)


@query(
    "A-35 P-10",
    f"""WITH {ORDERS} SELECT split, count(*) AS n, round(avg(y), 8) AS big_rate, round(CASE WHEN avg(y) > 0 THEN (1 - avg(y)) / avg(y) ELSE 1 END, 8) AS big_weight
    FROM (SELECT {SPLIT} AS split, CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS y FROM ord) GROUP BY 1""",
)
def class_balance(spark, folder):
    rows = S.time_split(_orders(spark, folder), tie="o_orderkey")
    return rounded(M.class_balance(rows, {"big": F.col("o_totalprice") > 400000}), ["big_rate", "big_weight"])
