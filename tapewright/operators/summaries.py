"""Descriptive summaries of feature, bar and ledger tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.operators.ordered import quantiles


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row and column: ``feature``, ``value``."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))


def feature_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes, quartiles, nulls and infinities per feature."""
    def cell(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("feature"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(x.isNull()).alias("null_count"),
            (F.count_if(x.isNull()) / F.count(F.lit(1))).alias("null_pct"),
            F.count_if(F.abs(x) == math.inf).alias("inf_count"),
        )

    wide = df.agg(F.array(*[cell(c) for c in columns]).alias("_cells")).select(F.inline("_cells"))
    q = quantiles(long_form(df, columns), ["feature"], "value", (0.25, 0.5, 0.75))
    q = q.groupBy("feature").agg(
        *[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    )
    return wide.join(q, "feature", "left")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, all in one aggregation pass."""
    pairs = list(combinations_with_replacement(columns, 2))
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs])
    upper = df.agg(cells.alias("_c")).select(F.inline("_c"))
    lower = upper.filter(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    return upper.unionByName(lower)


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width counts between minimum and maximum."""
    x = F.col(value).cast("double")
    rows = df.filter(x.isNotNull())
    lo, hi = rows.agg(F.min(x)).scalar(), rows.agg(F.max(x)).scalar()
    place = F.when(hi > lo, F.least(F.floor((x - lo) / F.when(hi > lo, hi - lo) * bins), F.lit(bins - 1)))
    return rows.select(F.coalesce(place, F.lit(0)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def box_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Quartiles, extremes and mean per group and feature."""
    rows = long_form(df, columns, by)
    base = rows.groupBy(*by, "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    q = quantiles(rows, [*by, "feature"], "value", (0.25, 0.5, 0.75)).groupBy(*by, "feature").agg(
        *[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    )
    return base.join(q, [*by, "feature"])


def volume_cap(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """95th percentile of volume, and whether the bars above it average more than twice that."""
    q = quantiles(bars, by, "volume", (0.95,)).select(*by, F.col("quantile").alias("cap"))
    above = bars.join(q, list(by)).groupBy(*by).agg(
        F.max("cap").alias("cap"), F.avg(F.when(F.col("volume") > F.col("cap"), F.col("volume"))).alias("_m")
    )
    return above.select(*by, "cap", F.coalesce(F.col("_m") > 2 * F.col("cap"), F.lit(False)).alias("has_outliers"))


def market_summary(bars: DataFrame, by: Sequence[str] = ("market",)) -> DataFrame:
    per_symbol = bars.groupBy(*by, "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")
    )
    return per_symbol.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_symbols"),
        F.sum("n").alias("total_bars"),
        F.min("a").alias("first_date"),
        F.max("b").alias("last_date"),
    )


def upsert_ledger(ledger: DataFrame, updates: DataFrame, keys: Sequence[str] = ("symbol", "exchange", "source")) -> DataFrame:
    """Later rows (by ``seq``) replace earlier ones; missing start and end dates keep the old value."""
    rows = ledger.withColumn("seq", F.lit(-1).cast("long")).unionByName(updates)

    def kept(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)

    return rows.groupBy(*keys).agg(
        F.max_by(F.struct("market", "bar_count", "status", "error_message"), "seq").alias("_r"),
        kept("start_date"),
        kept("end_date"),
    ).select(*keys, "_r.market", "start_date", "end_date", "_r.bar_count", "_r.status", "_r.error_message")


def ledger_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("market", "source", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bar_count").alias("total_bars")
    )


def pending(ledger: DataFrame, market: str, source: str) -> DataFrame:
    return ledger.filter((F.col("market") == market) & (F.col("source") == source) & (F.col("status") != "complete"))


def without_entries(ledger: DataFrame, gone: DataFrame, keys: Sequence[str] = ("symbol", "exchange", "source")) -> DataFrame:
    return ledger.join(gone.select(*keys), list(keys), "left_anti")


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, the same ones on every run: the smallest seeded hashes of the key.

    The hash is the MD5 of the key's texts, times as microseconds. ``orderBy().limit()`` keeps the n best rows of each partition, so
    no full sort takes place.
    """
    times = {name for name, kind in df.dtypes if kind.startswith("timestamp")}
    texts = [F.unix_micros(F.col(k).cast("timestamp")).cast("string") if k in times else F.col(k).cast("string") for k in keys]
    seeded = F.md5(F.concat_ws("|", *texts, F.lit(str(seed))).cast("binary"))
    return df.withColumn("_h", seeded).orderBy("_h", *keys).limit(n).drop("_h")
