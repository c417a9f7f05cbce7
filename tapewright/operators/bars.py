"""Bar tables: normalising, merging, resampling, precedence and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions.columns import clock_minutes, floor_to, minute_of_day
from tapewright.params import MIN_BARS_PER_DAY, VENUE_ORDER, session_of

PRICES = ("open", "high", "low", "close")
BAR_COLUMNS = ("ts", *PRICES, "volume")

# --- Fixed values: vendor column names and their canonical names -------------
VENDOR_NAMES = {
    "Datetime": "ts",
    "Date": "ts",
    "datetime": "ts",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Volume": "volume",
    "날짜": "ts",
    "시가": "open",
    "고가": "high",
    "저가": "low",
    "종가": "close",
    "거래량": "volume",
}


def rename_vendor(df: DataFrame) -> DataFrame:
    """Vendor column names become canonical ones; timestamps lose their zone."""
    df = df.withColumnsRenamed({k: v for k, v in VENDOR_NAMES.items() if k in df.columns})
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def normalise(df: DataFrame, source: str = "", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Canonical bar columns; a given source wins over a stored one, missing volume is 0."""
    missing = [c for c in BAR_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    stored = F.col("source") if "source" in df.columns and not source else F.lit(source)
    return df.select(
        *keys,
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in PRICES],
        F.coalesce(F.col("volume").cast("long"), F.lit(0).cast("long")).alias("volume"),
        stored.alias("source"),
    )


def quality_filter(df: DataFrame) -> DataFrame:
    """Bars with all four prices and some volume."""
    return df.dropna(subset=list(PRICES)).filter(F.col("volume") > 0)


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], drop_order: bool = True) -> DataFrame:
    """The last row per key by ``order``; rows equal in that compare by their other columns.

    An aggregate rather than a row number: copies of a hot key collapse before the shuffle. The whole
    row is compared, so the result never depends on which task delivers first.
    """
    rest = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    out = [c for c in df.columns if c not in keys and not (drop_order and c in order)]
    return df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, *[f"_row.{c}" for c in out])


def merge_loads(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("symbol", "ts"), order: Sequence[str] = ()) -> DataFrame:
    """Union of a stored and a new load; the new row wins on the same key.

    Inside one load the row that is last by ``order`` (a file position or sequence number, kept in the
    result) wins.
    """
    tagged = existing.withColumn("_load", F.lit(0)).unionByName(
        new.withColumn("_load", F.lit(1)), allowMissingColumns=True
    )
    if "source" in tagged.columns:
        tagged = tagged.withColumn("source", F.coalesce("source", F.lit("")))
    return latest_by_key(tagged, keys, ["_load", *order], drop_order=False).drop("_load")


def by_precedence(
    parts: Sequence[tuple[int, DataFrame]], keys: Sequence[str] = ("symbol", "ts"), order: Sequence[str] = ()
) -> DataFrame:
    """Union of sources with ranks; per key the highest rank stays, inside a source the last row by ``order``."""
    union = None
    for rank, part in parts:
        tagged = part.withColumn("_rank", F.lit(rank))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    return latest_by_key(union, keys, ["_rank", *order], drop_order=False).drop("_rank")


def _candle(order: Column, price: dict[str, Column]) -> list[Column]:
    return [
        F.min_by(price["open"], order).alias("open"),
        F.max(price["high"]).alias("high"),
        F.min(price["low"]).alias("low"),
        F.max_by(price["close"], order).alias("close"),
        F.sum("volume").alias("volume"),
    ]


def _order(columns: Sequence[str]) -> Column:
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)


def bars_from_ticks(
    ticks: DataFrame, minutes: int = 1, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), price: str = "price"
) -> DataFrame:
    """OHLCV per key and time bin.

    The bin is part of the key, so no symbol is one group, and partial aggregation leaves at most
    one row per key, bin and input split for the shuffle.
    """
    p = F.col(price)
    return (
        ticks.groupBy(*keys, floor_to(F.col("ts"), minutes).alias("_bin"))
        .agg(*_candle(_order(order), {c: p for c in PRICES}))
        .withColumnRenamed("_bin", "ts")
    )


def resample(bars: DataFrame, minutes: int = 5, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Coarser bars stamped at their window start; every bar carries its key's first source."""
    grouped = bars.groupBy(*keys, floor_to(F.col("ts"), minutes).alias("_bin"))
    price = {c: F.col(c) for c in PRICES}
    if "source" not in bars.columns:
        return grouped.agg(*_candle(F.col("ts"), price)).withColumnRenamed("_bin", "ts")
    out = grouped.agg(*_candle(F.col("ts"), price)).withColumnRenamed("_bin", "ts")
    first = bars.groupBy(*keys).agg(F.min_by("source", "ts").alias("source"))
    return out.join(first, list(keys))


def merge_venues(
    bars: DataFrame, keys: Sequence[str] = ("symbol",), venue: str = "venue", ranks: Sequence[str] = VENUE_ORDER
) -> DataFrame:
    """Bars of several venues or publishers summed per minute; open and close follow venue order."""
    rank = F
    for i, name in enumerate(ranks):
        rank = rank.when(F.col(venue) == name, F.lit(i))
    order = F.struct(rank.otherwise(F.lit(len(ranks))), F.col(venue), F.col("ts"))
    return (
        quality_filter(bars)
        .groupBy(*keys, floor_to(F.col("ts"), 1).alias("_bin"))
        .agg(*_candle(order, {c: F.col(c) for c in PRICES}))
        .withColumnRenamed("_bin", "ts")
    )


def session_bars(bars: DataFrame, market: str) -> DataFrame:
    """Regular-session bars with their date and minutes from the open."""
    _, opens, closes, _ = session_of(market)
    start, end = clock_minutes(opens), clock_minutes(closes)
    minute = minute_of_day(F.col("ts"))
    return bars.filter((minute >= start) & (minute < end)).select(
        *bars.columns,
        F.to_date("ts").alias("date"),
        (minute - start).cast("int").alias("minutes_from_open"),
    )


def full_days(bars: DataFrame, least: int = MIN_BARS_PER_DAY) -> DataFrame:
    """Bars of days that have at least ``least`` bars."""
    day = Window.partitionBy("symbol", "date")
    return bars.withColumn("_n", F.count(F.lit(1)).over(day)).filter(F.col("_n") >= least).drop("_n")


def validate_bars(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Quality counts per key. Duplicates are counted on a pre-aggregated (key, ts) table."""
    bad = (F.col("open") < 0) | (F.col("high") < 0) | (F.col("low") < 0) | (F.col("close") < 0)
    per_ts = bars.groupBy(*keys, "ts").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in (*PRICES, "volume")],
        F.count_if(bad).alias("negative"),
        F.count_if(F.col("volume") == 0).alias("zero"),
    )
    out = per_ts.groupBy(*keys).agg(
        F.sum("n").alias("bar_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        *[F.sum(f"null_{c}").alias(f"null_{c}") for c in (*PRICES, "volume")],
        F.sum("negative").alias("negative_prices"),
        (F.sum("zero") / F.sum("n")).alias("zero_volume_share"),
        F.sum(F.col("n") - 1).alias("duplicate_ts"),
    )
    return out.withColumn("valid", (F.col("negative_prices") == 0) & (F.col("duplicate_ts") == 0))


def validate_sessions(bars: DataFrame, expected: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Days with at least 80 % of the expected bars, and the shorter ones."""
    per_day = bars.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n"))
    full = F.col("n") >= 0.8 * expected
    return per_day.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_days"),
        F.count_if(full).alias("full_days"),
        F.count_if(~full).alias("short_days"),
        F.avg("n").alias("avg_bars_per_day"),
        F.sum("n").alias("total_bars"),
    )


def short_days(bars: DataFrame, expected: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    per_day = bars.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n"))
    return per_day.filter(F.col("n") < 0.8 * expected)


def recent_dates(bars: DataFrame, history: int = 5, target: str | None = None) -> DataFrame:
    """Bars of the target date (or the latest one) and of the ``history`` dates before it, per symbol."""
    if target is not None:
        bars = bars.filter(F.col("date") <= F.lit(target).cast("date"))
    days = bars.select("symbol", "date").distinct()
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    keep = days.withColumn("_r", rank).filter(F.col("_r") <= history + 1)
    is_target = F.col("_r") == 1
    if target is not None:
        has_target = F.max(F.col("date") == F.lit(target).cast("date")).over(Window.partitionBy("symbol"))
        keep = keep.withColumn("_has", has_target).filter("_has").drop("_has")
    return bars.join(keep, ["symbol", "date"]).withColumn("is_target", is_target).drop("_r")


def replay_dates(bars: DataFrame, history: int = 5, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dates in a range that have at least ``history`` earlier dates, per symbol."""
    days = bars.select("symbol", "date").distinct()
    days = days.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))
    keep = F.col("_r") > history
    if start is not None:
        keep = keep & (F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        keep = keep & (F.col("date") <= F.lit(end).cast("date"))
    return days.filter(keep).select("symbol", "date")


def common_dates(bars: DataFrame) -> DataFrame:
    """Dates on which every symbol of the table has bars."""
    days = bars.select("symbol", "date").distinct()
    total = days.select("symbol").distinct().agg(F.count(F.lit(1)).alias("_all"))
    per_date = days.groupBy("date").agg(F.count(F.lit(1)).alias("n_symbols"))
    return per_date.join(total, F.col("n_symbols") == F.col("_all")).select("date", "n_symbols")


def missing_ranges(bars: DataFrame, today: str, start: str, universe: DataFrame) -> DataFrame:
    """Per symbol of the universe the range still to load, up to ``today``."""
    have = bars.groupBy("symbol").agg(F.max(F.to_date("ts")).alias("_last"))
    begin = F.coalesce(F.date_add("_last", 1), F.lit(start).cast("date"))
    return (
        universe.select("symbol")
        .distinct()
        .join(have, "symbol", "left")
        .select("symbol", begin.alias("range_start"), F.lit(today).cast("date").alias("range_end"))
        .filter(F.col("range_start") <= F.col("range_end"))
    )


def gaps(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Breaks longer than twice the median step.

    Steps are whole seconds, counted per value first, so the median reads a short histogram.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    step = (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("_prev").cast("timestamp"))).alias("step")
    steps = bars.withColumn("_prev", F.lag("ts").over(w)).filter(F.col("_prev").isNotNull()).select(*keys, "ts", "_prev", step)
    counts = steps.groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("n"))
    median = counts.groupBy(*keys).agg(F.percentile("step", F.lit(0.5), F.col("n")).alias("median"))
    return (
        steps.join(median, list(keys))
        .filter((F.col("median") > 0) & (F.col("step") > 2 * F.col("median")))
        .select(
            *keys,
            (F.col("_prev") + F.make_dt_interval(secs=F.col("median").cast("decimal(18,6)"))).alias("gap_start"),
            (F.col("step") - F.col("median")).alias("gap_seconds"),
        )
    )


def daily_bars(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Daily OHLCV and the mean of the four prices."""
    out = bars.groupBy(*keys, F.to_date("ts").alias("date")).agg(*_candle(F.col("ts"), {c: F.col(c) for c in PRICES}))
    return out.withColumn("avg_price", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)


def next_days(days: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Each trading day with the following one; the last is followed by the next calendar day."""
    w = Window.partitionBy(*keys).orderBy("date")
    return days.select(*keys, "date").distinct().withColumn(
        "next_date", F.coalesce(F.lead("date").over(w), F.date_add("date", 1))
    )
