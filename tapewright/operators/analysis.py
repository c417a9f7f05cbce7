"""Performance tables of trades and equity curves."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions.columns import floor_to
from tapewright.operators.metrics import decide


def trade_metrics(trades: DataFrame, by: Sequence[str] = ("config_id",)) -> DataFrame:
    """Win rate, average win and loss, profit factor, holding time and total profit of closed trades."""
    pnl, pct = F.col("pnl"), F.col("pnl_pct")
    won, lost = F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), F.abs(F.sum(F.when(pnl < 0, pnl).otherwise(0.0)))
    factor = F.when(lost == 0, F.when(won > 0, F.lit(math.inf)).otherwise(F.lit(0.0))).otherwise(won / F.when(lost != 0, lost))
    return trades.filter(F.col("exit_ts").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_trades"),
        (F.count_if(pnl > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.coalesce(F.avg(F.when(pnl > 0, pct)), F.lit(0.0)).alias("avg_win_pct"),
        F.coalesce(F.avg(F.when(pnl < 0, pct)), F.lit(0.0)).alias("avg_loss_pct"),
        factor.alias("profit_factor"),
        F.avg("holding_minutes").alias("avg_holding_minutes"),
        F.sum(pnl).alias("total_pnl"),
    )


def breakdown(trades: DataFrame, by: Sequence[str] = ("config_id",)) -> DataFrame:
    """Count and profit by exit reason, by month and by weekday of the exit, in one pass."""
    done = trades.filter(F.col("exit_ts").isNotNull())
    keys = F.array(
        F.struct(F.lit("exit_reason").alias("kind"), F.col("exit_reason").alias("key")),
        F.struct(F.lit("month").alias("kind"), F.date_format("exit_ts", "yyyy-MM").alias("key")),
        F.struct(F.lit("weekday").alias("kind"), F.date_format("exit_ts", "EEEE").alias("key")),
    )
    return done.select(*by, "pnl", F.inline(keys)).groupBy(*by, "kind", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl")
    )


def equity_metrics(curve: DataFrame, by: Sequence[str] = ("config_id",)) -> DataFrame:
    """Total return, worst drawdown, Sharpe and Sortino from the last equity of each day."""
    by = list(by)
    daily = curve.groupBy(*by, F.to_date("ts").alias("_day")).agg(
        F.max_by("equity", "ts").alias("_last"), F.min_by("equity", "ts").alias("_first"), F.min("drawdown_pct").alias("_dd")
    )
    w = Window.partitionBy(*by).orderBy("_day")
    prev = F.lag("_last").over(w)
    daily = daily.withColumn("_r", F.when(prev > 0, F.col("_last") / F.when(prev > 0, prev) - 1))
    r, down = F.col("_r"), F.when(F.col("_r") < 0, F.col("_r"))

    def annual(spread: Column, enough: Column) -> Column:
        return F.coalesce(F.when(enough & (spread > 0), F.avg(r) / F.when(spread > 0, spread) * math.sqrt(252)), F.lit(0.0))

    first, last = F.min_by("_first", "_day"), F.max_by("_last", "_day")
    return daily.groupBy(*by).agg(
        F.when(first > 0, (last - first) / F.when(first > 0, first)).otherwise(F.lit(0.0)).alias("total_return"),
        F.min("_dd").alias("max_drawdown_pct"),
        annual(F.stddev_samp(r), F.count(r) >= 2).alias("sharpe_ratio"),
        annual(F.stddev_samp(down), (F.count(r) >= 2) & (F.count(down) >= 2)).alias("sortino_ratio"),
    )


def compare(trades: DataFrame, curve: DataFrame) -> DataFrame:
    """One row per config; configs without trades keep their equity figures."""
    t = trade_metrics(trades)
    out = equity_metrics(curve).join(t, "config_id", "left")
    return out.fillna(0, subset=[c for c in t.columns if c != "config_id"])


def best(comparison: DataFrame, n: int = 1) -> DataFrame:
    """The configs with the highest return."""
    return comparison.orderBy(F.desc("total_return"), "config_id").limit(n)


def marginals(comparison: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Averages by each value of each dimension, from a single pass over grouping sets."""
    values = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    return comparison.select("*", F.inline(values)).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n_configs"),
        F.avg("total_return").alias("avg_return"),
        F.max("total_return").alias("best_return"),
        F.avg("win_rate").alias("avg_win_rate"),
        F.avg("total_trades").alias("avg_trades"),
        F.count_if(F.col("total_return") > 0).alias("profitable"),
    )


def tracker_summary(log: DataFrame, curve: DataFrame) -> DataFrame:
    """Bars, purchases, sales, first and last equity, return and drawdown per config."""
    acts = log.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("total_bars"),
        F.count_if(F.col("action") == "BUY").alias("buys"),
        F.count_if(F.col("action") == "SELL").alias("sells"),
    )
    eq = curve.groupBy("config_id").agg(
        F.min_by("equity", "ts").alias("initial_equity"),
        F.max_by("equity", "ts").alias("final_equity"),
        F.min("drawdown_pct").alias("max_drawdown_pct"),
        F.max("equity_peak").alias("equity_high"),
    )
    change = (F.col("final_equity") - F.col("initial_equity")) / F.col("initial_equity")
    return acts.join(eq, "config_id").withColumn("return_pct", change)


def session_summary(log: DataFrame, threshold: float) -> DataFrame:
    """Purchases, sales, cost, profit and signal counts per symbol and day.

    A sale is matched with the first purchase of its contract that day.
    """
    signal = decide(F.col("pp"), F.col("tp"), threshold, tie="peak")
    keys = ["config_id", "symbol", "date"]
    base = log.groupBy(*keys).agg(
        F.count_if(F.col("action") == "BUY").alias("buys"),
        F.count_if(F.col("action") == "SELL").alias("sells"),
        F.coalesce(F.sum(F.when(F.col("action") == "BUY", F.col("fill"))), F.lit(0.0)).alias("total_cost"),
        F.count_if(signal == 1).alias("peak_signals"),
        F.count_if(signal == 2).alias("trough_signals"),
    )
    first = log.filter(F.col("action") == "BUY").groupBy(*keys, "contract").agg(F.min_by("fill", "ts").alias("_paid"))
    sold = log.filter(F.col("action") == "SELL").join(first, [*keys, "contract"])
    net = sold.groupBy(*keys).agg(F.sum(F.col("fill") - F.col("_paid")).alias("net_pnl"))
    return base.join(net, keys, "left").fillna(0.0, subset=["net_pnl"])


def marker_prices(log: DataFrame, bars: DataFrame) -> DataFrame:
    """Chart height of each purchase (above the bar) and sale (below it); without a bar, the close."""
    span = bars.groupBy("symbol", "date").agg((F.max("high") - F.min("low")).alias("_span"))
    at = bars.select("symbol", floor_to(F.col("ts"), 1).alias("_m"), "high", "low")
    acts = log.filter(F.col("action") != "").withColumn("_m", floor_to(F.col("ts"), 1))
    acts = acts.join(at, ["symbol", "_m"], "left").join(span, ["symbol", "date"], "left")
    off = F.greatest(F.coalesce("_span", F.lit(0.0)) * 0.03, F.lit(0.3))
    y = F.when(F.col("action") == "BUY", F.coalesce("high", "close") + off).otherwise(F.coalesce("low", "close") - off)
    return acts.select("config_id", "symbol", "date", "ts", "action", y.alias("y"))
