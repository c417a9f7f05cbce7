"""Option chains, contract choice and quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions.contracts import next_week_friday, parse_symbol
from tapewright.operators.ordered import asof_join

# A contract row: contract, underlying, expiry, cp, strike, period_start, stock_close.


def by_day(contracts: DataFrame) -> DataFrame:
    """One row per contract and day it is active on (``period_start <= date < expiry``).

    Turns the range predicate into an equality; the factor is the contract's life in days.
    """
    alive = contracts.filter(F.col("period_start") < F.col("expiry"))
    return alive.withColumn("date", F.explode(F.sequence("period_start", F.date_sub("expiry", 1))))


def chain(bars: DataFrame, contracts: DataFrame, cp: str | None = None) -> DataFrame:
    """Bars with every contract of their symbol that is active on the day."""
    active = by_day(contracts if cp is None else contracts.filter(F.col("cp") == cp))
    return bars.join(active.withColumnRenamed("underlying", "symbol"), ["symbol", "date"])


def at_the_money(bars: DataFrame, contracts: DataFrame, cp: str, price: str = "close") -> DataFrame:
    """Each bar with the active contract whose strike is nearest to its price.

    Strikes and bars are ordered together by price, so a bar sees its two neighbours only and no
    bar-contract pairs are formed. Ties go to the smaller contract symbol.
    """
    best = F.struct(F.col("contract"), F.col("strike"), F.col("expiry"))
    strikes = (
        by_day(contracts.filter(F.col("cp") == cp))
        .groupBy(F.col("underlying").alias("symbol"), "date", "strike")
        .agg(F.min(best).alias("_c"))
        .select("symbol", "date", F.col("strike").alias("_p"), F.lit(0).alias("_side"), "_c")
    )
    rows = bars.select(
        "symbol", "date", F.col(price).cast("double").alias("_p"), F.lit(1).alias("_side"), F.struct("*").alias("_row")
    )
    both = rows.unionByName(strikes, allowMissingColumns=True)
    part = Window.partitionBy("symbol", "date")
    seen = (Window.unboundedPreceding, 0)
    both = both.withColumn("_below", F.last("_c", True).over(part.orderBy("_p", "_side").rowsBetween(*seen)))
    both = both.withColumn("_above", F.last("_c", True).over(part.orderBy(F.desc("_p"), "_side").rowsBetween(*seen)))
    rows = both.filter(F.col("_side") == 1)

    def scored(c: str) -> Column:
        s = F.struct(F.abs(F.col(f"{c}.strike") - F.col("_p")).alias("gap"), F.col(f"{c}.contract"), F.col(f"{c}.strike"), F.col(f"{c}.expiry"))
        return F.when(F.col(c).isNotNull(), s)

    return rows.withColumn("_pick", F.least(scored("_below"), scored("_above"))).select(
        "_row.*",
        F.col("_pick.contract").alias("contract"),
        F.col("_pick.strike").alias("strike"),
        F.col("_pick.expiry").alias("expiry"),
    )


def quotes_at(rows: DataFrame, option_bars: DataFrame, prefix: str = "q_") -> DataFrame:
    """Rows (with ``contract``, ``ts``) and the contract's last bar at or before ``ts``."""
    quotes = option_bars.select(
        "contract", F.col("ts"), *[F.col(c).alias(prefix + c) for c in ("open", "high", "low", "close", "volume")]
    )
    names = [c for c in quotes.columns if c.startswith(prefix)]
    return asof_join(rows, quotes, ["contract"], names, matched=f"{prefix}ts")


def contract_metadata(option_bars: DataFrame, cache: DataFrame) -> DataFrame:
    """Contracts seen in the bars with parsed parts and, where the cache knows them, start and close."""
    seen = option_bars.select(F.trim("contract").alias("contract")).distinct()
    parsed = seen.withColumn("_c", parse_symbol(F.col("contract"))).filter(F.col("_c").isNotNull())
    known = cache.groupBy("contract").agg(
        F.max_by(F.struct("period_start", "stock_close"), "period_start").alias("_m")
    )
    return parsed.join(known, "contract", "left").select(
        "contract", "_c.underlying", "_c.expiry", "_c.cp", "_c.strike", "_m.period_start", "_m.stock_close"
    )


def for_day(days: DataFrame, periods: DataFrame) -> DataFrame:
    """Trading days with the weekly row whose [period_start, period_end) holds them."""
    spread = periods.filter(F.col("period_start") < F.col("period_end")).withColumn(
        "date", F.explode(F.sequence("period_start", F.date_sub("period_end", 1)))
    )
    return days.join(spread, ["symbol", "date"])


def daily_selection(
    days: DataFrame, contracts: DataFrame, strike_range: float, expiry_days: int, cps: Sequence[str] = ("P",)
) -> DataFrame:
    """Per day the contracts within ``strike_range`` of ``price`` that expire in (day, day + n]."""
    near = F.abs(F.col("strike") - F.col("price")) <= strike_range
    soon = (F.col("expiry") > F.col("date")) & (F.col("expiry") <= F.date_add("date", expiry_days))
    active = by_day(contracts.filter(F.col("cp").isin(*cps))).withColumnRenamed("underlying", "symbol")
    return days.join(active, ["symbol", "date"]).filter(near & soon)


def pick_one(selection: DataFrame) -> DataFrame:
    """Per symbol and day: expiry nearest to next week's Friday, then strike nearest to the price."""
    rank = F.struct(
        F.abs(F.date_diff("expiry", next_week_friday(F.col("date")))).alias("days_off"),
        F.abs(F.col("strike") - F.col("price")).alias("gap"),
        F.col("contract"),
    )
    best = selection.groupBy("symbol", "date").agg(
        F.min(F.struct(rank.alias("r"), F.col("expiry"), F.col("strike"))).alias("_b")
    )
    return best.select("symbol", "date", F.col("_b.r.contract").alias("contract"), "_b.expiry", "_b.strike")


def traded_days(option_bars: DataFrame) -> DataFrame:
    return option_bars.groupBy("contract", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n_bars"))


def nearest_traded(days: DataFrame, contracts: DataFrame, option_bars: DataFrame, cp: str = "P") -> DataFrame:
    """Per symbol and day the traded contract whose strike is nearest to that day's ``price``."""
    traded = traded_days(option_bars).join(contracts.filter(F.col("cp") == cp), "contract")
    rank = F.struct(F.abs(F.col("strike") - F.col("price")).alias("gap"), F.col("contract"), F.col("strike"), F.col("n_bars"))
    joined = days.join(traded.withColumnRenamed("underlying", "symbol"), ["symbol", "date"])
    best = joined.groupBy("symbol", "date").agg(F.min(rank).alias("_b"))
    return best.select("symbol", "date", "_b.contract", "_b.strike", "_b.n_bars")


def first_with_data(days: DataFrame, contracts: DataFrame, option_bars: DataFrame, cp: str = "P") -> DataFrame:
    """Per symbol and day the first active contract with bars, in order of distance to ``stock_close``.

    Contracts of the wanted side come first; the others serve days that have none of it.
    """
    active = by_day(contracts).withColumnRenamed("underlying", "symbol").join(days.select("symbol", "date"), ["symbol", "date"])
    side = F.col("cp") == cp
    has_side = active.groupBy("symbol", "date").agg(F.max(side).alias("_any"))
    usable = active.join(has_side, ["symbol", "date"]).filter(side | ~F.col("_any"))
    rank = F.struct(F.abs(F.col("strike") - F.col("stock_close")).alias("gap"), F.col("contract"), F.col("strike"), F.col("n_bars"))
    best = usable.join(traded_days(option_bars), ["contract", "date"]).groupBy("symbol", "date").agg(F.min(rank).alias("_b"))
    return best.select("symbol", "date", "_b.contract", "_b.strike", "_b.n_bars")


def by_strike(days: DataFrame, contracts: DataFrame, option_bars: DataFrame, cp: str = "P") -> DataFrame:
    """Bars of the active contract with exactly the wanted ``strike`` on each symbol and day."""
    active = by_day(contracts.filter(F.col("cp") == cp)).withColumnRenamed("underlying", "symbol")
    match = days.join(active, ["symbol", "date", "strike"]).groupBy("symbol", "date", "strike").agg(F.min("contract").alias("contract"))
    bars = option_bars.drop("symbol").withColumn("date", F.to_date("ts"))
    return bars.join(match, ["contract", "date"])


def days_without_bars(days: DataFrame, contracts: DataFrame, option_bars: DataFrame) -> DataFrame:
    """Symbol days with an active contract but no option bar at all."""
    active = by_day(contracts).select(F.col("underlying").alias("symbol"), "date").distinct()
    have = (
        traded_days(option_bars)
        .join(contracts.select("contract", F.col("underlying").alias("symbol")), "contract")
        .select("symbol", "date")
        .distinct()
    )
    return days.select("symbol", "date").join(active, ["symbol", "date"]).join(have, ["symbol", "date"], "left_anti")
