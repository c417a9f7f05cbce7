"""Precision-recall measures, timing errors and signal pairing of scored bars."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions.columns import quotient
from tapewright.operators.ordered import running_totals, value_bins
from tapewright.params import PEAK, TROUGH
from tapewright.session import stage

THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)


def score_counts(df: DataFrame, by: Sequence[str], score: str, target: str) -> DataFrame:
    """Rows and positives per distinct score: equal scores collapse before any ordering."""
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("pos")
    )


def pr_curve(df: DataFrame, by: Sequence[str], score: str, target: str) -> DataFrame:
    """Precision and recall at every distinct score, summed from the highest score down.

    ``by`` must name at least one column. Scores are ordered inside bins that follow them. Rows without a score are left out.
    """
    counts = value_bins(score_counts(df.filter(F.col(score).isNotNull()), by, score, target), by, "score")
    cum = running_totals(counts, by, "_bin", [F.desc("score")], ["n", "pos"], descending=True)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("_all"))
    joined = cum.join(totals, list(by))
    return joined.select(
        *by,
        "score",
        "n",
        "pos",
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        F.when(F.col("_all") > 0, F.col("cum_pos") / F.when(F.col("_all") > 0, F.col("_all"))).otherwise(F.lit(1.0)).alias("recall"),
    )


def average_precision(df: DataFrame, by: Sequence[str], score: str, target: str) -> DataFrame:
    """Step-wise average precision (not the trapezoid), 0 without positives."""
    total = F.sum("pos")
    value = F.sum(F.col("pos") * F.col("precision")) / F.when(total > 0, total)
    return pr_curve(df, by, score, target).groupBy(*by).agg(
        F.coalesce(value, F.lit(0.0)).alias("pr_auc"), F.sum("n").alias("n"), total.alias("positives")
    )


def threshold_table(
    df: DataFrame, by: Sequence[str], score: str, target: str, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Precision, recall and F1 per threshold; every threshold is counted in the same pass."""
    s, y = F.col(score), F.col(target).cast("boolean")
    counted = df.groupBy(*by).agg(
        F.count_if(y).alias("_pos"),
        *[F.count_if(s >= t).alias(f"_p{i}") for i, t in enumerate(thresholds)],
        *[F.count_if((s >= t) & y).alias(f"_tp{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_p{i}").alias("predicted_positives"))
            for i, t in enumerate(thresholds)
        ]
    )
    work = counted.select(*by, "_pos", F.inline(rows))

    def safe(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))

    work = work.withColumns(
        {"_prec": safe(F.col("tp"), F.col("predicted_positives")), "_rec": safe(F.col("tp"), F.col("_pos"))}
    )
    f1 = safe(2 * F.col("_prec") * F.col("_rec"), F.col("_prec") + F.col("_rec"))
    return work.select(
        *by,
        "threshold",
        "tp",
        (F.col("predicted_positives") - F.col("tp")).alias("fp"),
        (F.col("_pos") - F.col("tp")).alias("fn"),
        F.round("_prec", 4).alias("precision"),
        F.round("_rec", 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
        "predicted_positives",
    )


def nearest_event(df: DataFrame, actual: Column, predicted: Column, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per actual event the signed distance, in rows, to the nearest predicted one; ties go back in time.

    Rows are ordered inside their day only; days pass on how many rows and which prediction lie before and after them.
    """
    by = list(by)
    work = df.select(*by, "ts", F.to_date("ts").alias("_day"), actual.alias("_a"), predicted.alias("_p"))
    day = Window.partitionBy(*by, "_day").orderBy("ts")
    work = stage(work.withColumn("_r", F.row_number().over(day)), "events-in-day")
    # Per day: its rows, its first and last prediction; then, over the few days of a key, what lies before and after each.
    at = F.when(F.col("_p"), F.col("_r"))
    days = work.groupBy(*by, "_day").agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"), F.max(at).alias("_last"))
    over = Window.partitionBy(*by).orderBy("_day")
    days = days.withColumn("_off", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    days = days.select(
        *by, "_day", "_off",
        F.last(F.col("_last") + F.col("_off"), True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first(F.col("_first") + F.col("_off"), True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    work = work.join(days, [*by, "_day"]).withColumn("_rn", F.col("_r") + F.col("_off"))
    at = F.when(F.col("_p"), F.col("_rn"))
    work = work.withColumn("_prev", F.coalesce(F.last(at, True).over(day.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before")))
    work = work.withColumn("_next", F.coalesce(F.first(at, True).over(day.rowsBetween(0, Window.unboundedFollowing)), F.col("_after")))
    back, ahead = F.col("_rn") - F.col("_prev"), F.col("_next") - F.col("_rn")
    error = F.when(F.col("_next").isNull() | (back <= ahead), -back).otherwise(ahead)
    return work.filter(F.col("_a")).select(*by, "ts", error.cast("int").alias("error_bars"))


def time_error(
    df: DataFrame, score: str, target_label: int, threshold: float = 0.5, tolerance: int = 3, by: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Timing-error statistics of predicted against actual events."""
    actual, predicted = F.col("label") == target_label, F.col(score) >= threshold
    errors = nearest_event(df, actual, predicted, by).filter(F.col("error_bars").isNotNull())
    # Counted per distinct error first, so the final aggregate sees a short table.
    counted = errors.groupBy(*by, "error_bars").agg(F.count(F.lit(1)).alias("n"))
    e, n = F.col("error_bars").cast("double"), F.col("n")
    total = F.sum(n)

    def part(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0)) / total

    mean = F.sum(e * n) / total
    stats = counted.groupBy(*by).agg(
        total.alias("matched"),
        mean.alias("mean_error_bars"),
        F.percentile("error_bars", F.lit(0.5), n).alias("median_error_bars"),
        F.sqrt(F.greatest(F.sum(e * e * n) / total - mean * mean, F.lit(0.0))).alias("std_error_bars"),
        (F.sum(F.abs(e) * n) / total).alias("mae_bars"),
        part(F.abs(e) <= tolerance).alias("on_time_pct"),
        part(e < -tolerance).alias("early_pct"),
        part(e > tolerance).alias("late_pct"),
        *[part(F.abs(e) <= k).alias(f"within_{k}") for k in (1, 2, 3, 5)],
    )
    totals = df.groupBy(*by).agg(F.count_if(actual).alias("total_actual"), F.count_if(predicted).alias("total_predicted"))
    return totals.join(stats, list(by), "left")


def signal_pairs(
    df: DataFrame, peak: str, trough: str, peak_at: float = 0.5, trough_at: float = 0.5, slippage: float = 0.001
) -> DataFrame:
    """Long trades bought on a trough signal and sold on the next peak signal, per symbol.

    A bar with one signal sets the state, a bar with both flips it, other bars keep it. So the
    state is the last one-sided signal, flipped once per two-sided bar since. Bars are ordered inside their day only; each day is
    one short row that sets or flips the state, and those are put together per symbol. What was bought at a price of 0 gained
    infinitely, or NaN if it is sold at 0.
    """
    rows = stage(df.select("symbol", "ts", "close", (F.col(peak) >= peak_at).alias("_p"), (F.col(trough) >= trough_at).alias("_t"), F.to_date("ts").alias("_day")), "signals")
    first = rows.groupBy("symbol").agg(F.min("ts").alias("_start"))
    rows = rows.join(first, "symbol").withColumn("_late", F.col("ts") > F.col("_start"))  # a symbol's first bar gives no signal
    is_peak, is_trough = F.coalesce(F.col("_p"), F.lit(False)) & F.col("_late"), F.coalesce(F.col("_t"), F.lit(False)) & F.col("_late")
    day = Window.partitionBy("symbol", "_day").orderBy("ts")
    upto = day.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "symbol", "_day", "ts", "close",
        F.when(is_trough & ~is_peak, F.lit(1)).when(is_peak & ~is_trough, F.lit(0)).alias("_one"),
        F.count_if(is_peak & is_trough).over(upto).alias("_both"),
    )
    at_one = F.when(F.col("_one").isNotNull(), F.struct("_one", "_both"))
    rows = stage(rows.withColumn("_s", F.last(at_one, True).over(upto)), "signals-in-day")

    # A day sets the state if it holds a one-sided signal, and flips it once per two-sided bar after that or in all.
    days = rows.groupBy("symbol", "_day").agg(F.max_by(F.struct("_s", "_both"), "ts").alias("_end"))
    over = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("symbol", "_day", "_end", F.coalesce(F.sum("_end._both").over(over), F.lit(0)).alias("_off"))
    set_at = F.when(F.col("_end._s").isNotNull(), F.struct(F.col("_end._s._one").alias("_one"), (F.col("_end._s._both") + F.col("_off")).alias("_both")))
    days = days.select("symbol", "_day", "_off", F.last(set_at, True).over(over).alias("_set"))

    def state(one: Column, flips: Column) -> Column:
        return (F.coalesce(one, F.lit(0)) + flips) % 2

    before = state(F.col("_set._one"), F.col("_off") - F.coalesce(F.col("_set._both"), F.lit(0)))
    rows = rows.join(days.select("symbol", "_day", before.alias("_before")), ["symbol", "_day"])
    in_day = F.when(F.col("_s").isNull(), state(F.col("_before"), F.col("_both"))).otherwise(state(F.col("_s._one"), F.col("_both") - F.col("_s._both")))
    rows = rows.withColumn("_pos", in_day).withColumn("_was", F.coalesce(F.lag("_pos").over(day), F.col("_before")))
    changes = stage(rows.filter(F.col("_pos") != F.col("_was")).select("symbol", "_day", "ts", "close", "_pos"), "signal-changes")

    bought = F.when(F.col("_pos") == 1, F.struct("ts", "close"))
    last = changes.groupBy("symbol", "_day").agg(F.max(bought).alias("_last")).select("symbol", "_day", F.last("_last", True).over(over).alias("_carried"))
    changes = changes.withColumn("_entry", F.last(bought, True).over(upto)).join(last, ["symbol", "_day"]).withColumn("_entry", F.coalesce("_entry", "_carried"))
    entry, exit_ = F.col("_entry.close") * (1 + slippage), F.col("close") * (1 - slippage)
    return changes.filter(F.col("_pos") == 0).select(
        "symbol", F.col("_entry.ts").alias("entry_ts"), F.col("ts").alias("exit_ts"), entry.alias("entry_price"), exit_.alias("exit_price"),
        quotient(exit_ - entry, entry).alias("pnl_pct"),
    )


def pairing_summary(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per symbol: trades, compounded and buy-and-hold return, win rate, drawdown and Sharpe."""
    w = Window.partitionBy("symbol").orderBy("exit_ts").rowsBetween(Window.unboundedPreceding, 0)
    curve = pairs.withColumn("_eq", F.product(1 + F.col("pnl_pct")).over(w))
    curve = curve.withColumn("_top", F.greatest(F.lit(1.0), F.max("_eq").over(w)))
    p = F.col("pnl_pct")
    wins, losses = F.sum(F.when(p > 0, p)), F.sum(F.when(p <= 0, p))
    spread = F.stddev_pop(p)
    lost = F.coalesce(losses, F.lit(0.0))
    stats = curve.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_trades"),
        (F.product(1 + p) - 1).alias("total_return"),
        (F.count_if(p > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(p <= 0, p)), F.lit(0.0)).alias("avg_loss"),
        F.when(lost != 0, F.abs(F.coalesce(wins, F.lit(0.0))) / F.abs(F.when(lost != 0, lost)))
        .otherwise(F.lit(math.inf)).alias("profit_factor"),
        F.max((F.col("_top") - F.col("_eq")) / F.col("_top")).alias("max_drawdown"),
        F.coalesce(F.when(spread > 0, F.avg(p) / F.when(spread > 0, spread) * math.sqrt(252)), F.lit(0.0)).alias("sharpe_approx"),
    )
    hold = df.groupBy("symbol").agg(F.min_by("close", "ts").alias("_a"), F.max_by("close", "ts").alias("_b"))
    hold = hold.select("symbol", quotient(F.col("_b") - F.col("_a"), F.col("_a")).alias("buy_hold_return"))
    # Not by fillna, which would also turn a return of NaN into 0.
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_trades", "total_return", "win_rate")}
    return hold.join(stats, "symbol", "left").withColumns(zero)


def full_evaluation(df: DataFrame, peak: str, trough: str, threshold: float = 0.5, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Average precision, timing errors and the table of thresholds of both targets, one row per key and target.

    By symbol, each row also holds the summary of the trades that the signals of both targets give.
    """
    by = list(by)
    df = stage(df.select(*by, "ts", "close", "label", peak, trough), "evaluated")
    parts = []
    for name, label, score in (("peak", PEAK, peak), ("trough", TROUGH, trough)):
        scored = df.withColumn("_y", F.col("label") == label)
        ap = average_precision(scored, by, score, "_y")
        te = time_error(df, score, label, threshold, by=by)
        table = threshold_table(scored, by, score, "_y")
        table = table.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*[c for c in table.columns if c not in by]))).alias("thresholds"))
        parts.append(ap.join(te, by).join(table, by).withColumn("target", F.lit(name)))
    out = parts[0].unionByName(parts[1])
    if by != ["symbol"]:
        return out
    return out.join(pairing_summary(df, signal_pairs(df, peak, trough, threshold, threshold)), "symbol", "left")


def class_balance(df: DataFrame, targets: dict[str, Column], by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows, positive rate and the weight of a positive that balances the classes."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c.cast("int")).alias(f"{k}_rate") for k, c in targets.items()]
    )
    for k in targets:
        rate = F.col(f"{k}_rate")
        out = out.withColumn(f"{k}_weight", F.when(rate > 0, (1 - rate) / F.when(rate > 0, rate)).otherwise(F.lit(1.0)))
    return out


def decide(peak: Column, trough: Column, threshold: float, tie: str = "none") -> Column:
    """0, 1 (peak) or 2 (trough). A tie above the threshold is 0, or the peak with ``tie='peak'``."""
    out = F.when((peak >= threshold) & (peak > trough), F.lit(PEAK)).when(
        (trough >= threshold) & (trough > peak), F.lit(TROUGH)
    )
    if tie == "peak":
        out = out.when(peak >= threshold, F.lit(PEAK)).when(trough >= threshold, F.lit(TROUGH))
    return out.otherwise(F.lit(0)).cast("byte")
