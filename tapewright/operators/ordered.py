"""Order-dependent work on long series: as-of joins, running totals and exact quantiles.

Each operator cuts a series into bins, works inside the bins, and carries one row per bin
forward. No window partition holds a whole key, so a hot key is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.session import stage

BIN_ROWS = 4096  # distinct values that a bin may hold
BIN_SHIFTS = (52, 40, 28, 16, 4, 0)  # bits below those that name a bin, level by level


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    left_on: str = "ts",
    right_on: str = "ts",
    tolerance: str | None = None,
    matched: str | None = None,
    shared_times: bool = False,
) -> DataFrame:
    """Left rows with the values of the last right row at or before them.

    With ``shared_times``, for keys under which many rows have the same time, only the distinct times are looked up, and the rows
    join them by key and time. Rows meet per key and day. A day's last right row is carried to later days through a table of
    one row per key and day, so only that short table is ordered per key.
    """
    by = list(by)
    if shared_times:
        times = left.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col(left_on).alias("_k_at")).distinct()
        looked = asof_join(times.select(*[F.col(f"_k_{c}").alias(c) for c in by], F.col("_k_at").alias(left_on)), right, by, values, left_on, right_on, tolerance, matched)
        looked = looked.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col(left_on).alias("_k_at"), *values, *([matched] if matched else []))
        same = reduce(lambda x, y: x & y, [left[c] == looked[f"_k_{c}"] for c in by] + [left[left_on] == looked["_k_at"]])
        return left.join(looked, same, "left").drop("_k_at", *[f"_k_{c}" for c in by])
    payload = F.struct(F.col(right_on).alias("_at"), *values).alias("_v")
    quotes = right.select(*by, F.to_date(right_on).alias("_day"), F.col(right_on).alias("_t"), F.lit(1).alias("_side"), payload)
    rows = left.select(
        *by,
        F.to_date(left_on).alias("_day"),
        F.col(left_on).alias("_t"),
        F.lit(2).alias("_side"),
        F.struct(*[c for c in left.columns]).alias("_row"),
    )
    closing = quotes.groupBy(*by, "_day").agg(F.max_by("_v", "_t").alias("_v"))
    days = rows.select(*by, "_day").distinct().withColumn("_probe", F.lit(True))
    carried = F.last("_v", ignorenulls=True).over(
        Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    )
    seeds = (
        closing.join(days, [*by, "_day"], "full")
        .withColumn("_v", carried)
        .filter(F.col("_probe") & F.col("_v").isNotNull())
        .select(*by, "_day", F.lit(None).cast(left.schema[left_on].dataType).alias("_t"), F.lit(0).alias("_side"), "_v")
    )
    both = rows.unionByName(quotes, allowMissingColumns=True).unionByName(seeds, allowMissingColumns=True)
    day = Window.partitionBy(*by, "_day").orderBy(F.asc_nulls_first("_t"), "_side")
    found = both.withColumn(
        "_v", F.last("_v", ignorenulls=True).over(day.rowsBetween(Window.unboundedPreceding, 0))
    ).filter(F.col("_side") == 2)
    if tolerance is not None:
        fresh = F.col("_v._at") >= F.col("_t") - F.expr(f"INTERVAL {tolerance}")
        found = found.withColumn("_v", F.when(fresh, F.col("_v")))
    extra = [F.col("_v._at").alias(matched)] if matched else []
    return found.select("_row.*", *[f"_v.{c}" for c in values], *extra)


def order_key(value: Column) -> Column:
    """A long in the order of a double: its bits, those of negative numbers turned round."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def value_bins(distinct: DataFrame, by: Sequence[str], value: str, most: int = BIN_ROWS) -> DataFrame:
    """Rows with distinct values per key, and ``_bin``: bins in the order of the values with at most ``most`` of them each.

    The bits of a double are refined from the top: values are counted by their leading bits, and only bins with too many are
    counted again by the next ones. Nothing is sampled, and bins follow the values however they lie: a key with 99 % of its
    values in a thousandth of their range has its bins there. The driver sees one flag per level, of six at most.
    """
    by = list(by)
    rows = stage(distinct.withColumn("_key", order_key(F.col(value))), "ordered-values")
    left, parts = rows, []
    for shift in BIN_SHIFTS:
        placed = left.withColumn("_bin", F.shiftleft(F.shiftright("_key", shift), shift))
        if shift == 0:
            parts.append(placed)
            break
        counts = stage(placed.groupBy(*by, "_bin").agg((F.count(F.lit(1)) > most).alias("_many")), "ordered-bins")
        full = counts.filter("_many").select(*by, "_bin")
        if full.isEmpty():
            parts.append(placed)
            break
        parts.append(placed.join(full, [*by, "_bin"], "left_anti"))
        left = placed.join(full, [*by, "_bin"], "left_semi").drop("_bin")
    return reduce(lambda x, y: x.unionByName(y), parts).drop("_key")


def running_totals(
    df: DataFrame, by: Sequence[str], bin_col: str, order: Sequence[Column], sums: Sequence[str], descending: bool = False
) -> DataFrame:
    """Inclusive running sums over an order whose bins ``bin_col`` already follow it.

    Totals per bin are summed over the few bins of a key and joined back; rows are ordered
    inside their bin only.
    """
    by = list(by)
    key = F.desc(bin_col) if descending else F.asc(bin_col)
    totals = df.groupBy(*by, bin_col).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, bin_col, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    inside = Window.partitionBy(*by, bin_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(c).over(inside).alias(f"_l_{c}") for c in sums])
    return local.join(offsets, [*by, bin_col]).select(
        *df.columns, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums]
    )


def quantiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: columns ``by``, ``q`` and ``quantile``.

    Equal values are counted first, then dealt into bins that follow the values; the wanted ranks are found from the bins' totals,
    and only bins that hold one are ordered.
    """
    by = list(by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_one", F.lit(1))
    keys = [*by, "_one"]
    binned = value_bins(counted, keys, "_x")
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_in"))
    over_bins = Window.partitionBy(*keys).orderBy("_bin")
    per_bin = per_bin.withColumns(
        {
            "_upto": F.sum("_in").over(over_bins.rowsBetween(Window.unboundedPreceding, 0)),
            "_all": F.sum("_in").over(Window.partitionBy(*keys)),
        }
    )
    wanted = per_bin.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in points]))).withColumn(
        "_pos", (F.col("_all") - 1) * F.col("q")
    )
    lo, hi = F.floor("_pos") + 1, F.ceil("_pos") + 1
    start = F.col("_upto") - F.col("_in")
    holds = ((lo > start) & (lo <= F.col("_upto"))) | ((hi > start) & (hi <= F.col("_upto")))
    targets = wanted.filter(holds).select(
        *keys, "_bin", "q", "_pos", lo.alias("_lo"), hi.alias("_hi"), start.alias("_start")
    )
    needed = binned.join(targets.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi")
    inside = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = needed.withColumn("_c", F.sum("_n").over(inside))
    hit = ranked.join(targets, [*keys, "_bin"])
    rank_end = F.col("_start") + F.col("_c")
    rank_start = rank_end - F.col("_n")
    low = F.max(F.when((F.col("_lo") > rank_start) & (F.col("_lo") <= rank_end), F.col("_x")))
    high = F.max(F.when((F.col("_hi") > rank_start) & (F.col("_hi") <= rank_end), F.col("_x")))
    part = F.col("_pos") - F.floor("_pos")
    return (
        hit.groupBy(*keys, "q", "_pos")
        .agg(low.alias("_a"), high.alias("_b"))
        .select(*by, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias("quantile"))
    )
