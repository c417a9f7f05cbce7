"""Price peaks and troughs per symbol and day, and the labels made from them.

A day's bars form one array (at most 1,440 on a one-minute grid), so one shuffle on
(symbol, date) carries everything and detection, labelling and grids are expressions on arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.operators.bars import latest_by_key
from tapewright.params import MIN_BARS_PER_DAY, NEITHER, PEAK, TROUGH, LabelVariant

GRID_PROMINENCE = (0.001, 0.002, 0.003, 0.005, 0.007, 0.01)
GRID_DISTANCE = (3, 5, 7, 10)
GRID_WIDTH = (1, 2, 3, 5)


def day_arrays(bars: DataFrame, least: int = MIN_BARS_PER_DAY) -> DataFrame:
    """One row per symbol and day with its bars in time order; short days are left out."""
    rest = [c for c in bars.columns if c not in ("symbol", "date", "ts")]
    out = bars.groupBy("symbol", "date").agg(F.array_sort(F.collect_list(F.struct("ts", *rest))).alias("bars"))
    return out.filter(F.size("bars") >= least)


def _maxima(x: Column) -> Column:
    """Indices of strict local maxima; a plateau counts once, at its middle rounded down."""
    start = F.struct(F.lit(-1).alias("rise"), F.array().cast("array<int>").alias("peaks"))

    def step(acc: Column, i: Column) -> Column:
        middle = F.floor((acc["rise"] + i - 1) / 2).cast("int")
        ended = F.when(acc["rise"] >= 0, F.concat(acc["peaks"], F.array(middle))).otherwise(acc["peaks"])
        return (
            F.when(x[i] > x[i - 1], F.struct(i.alias("rise"), acc["peaks"].alias("peaks")))
            .when(x[i] < x[i - 1], F.struct(F.lit(-1).alias("rise"), ended.alias("peaks")))
            .otherwise(acc)
        )

    found = F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), start, step, lambda acc: acc["peaks"])
    return F.when(F.size(x) >= 3, found).otherwise(F.array().cast("array<int>"))


def _lowest_until_higher(side: Column, height: Column) -> Column:
    start = F.struct(F.lit(True).alias("open"), height.alias("low"))

    def step(acc: Column, v: Column) -> Column:
        go = acc["open"] & (v <= height)
        return F.struct(go.alias("open"), F.when(go, F.least(acc["low"], v)).otherwise(acc["low"]).alias("low"))

    return F.aggregate(side, start, step, lambda acc: acc["low"])


def _measured(df: DataFrame, x: str, out: str) -> DataFrame:
    """Candidates of ``x`` with height, prominence and width at half prominence."""
    v, n = F.col(x), F.size(x)

    def bases(i: Column) -> Column:
        left = _lowest_until_higher(F.reverse(F.slice(v, F.lit(1), i)), v[i])
        right = _lowest_until_higher(F.slice(v, i + 2, n - i - 1), v[i])
        return F.struct(i.alias("i"), v[i].alias("height"), (v[i] - F.greatest(left, right)).alias("prominence"))

    def feet(p: Column) -> Column:
        level = p["height"] - p["prominence"] * 0.5
        left = F.array_max(F.filter(F.sequence(F.lit(0), p["i"] - 1), lambda k: v[k] <= level))
        right = F.array_min(F.filter(F.sequence(p["i"] + 1, n - 1), lambda k: v[k] <= level))
        return F.struct(p["i"].alias("i"), p["height"].alias("height"), p["prominence"].alias("prominence"),
                        level.alias("level"), left.alias("left"), right.alias("right"))

    def width(p: Column) -> Column:
        a, b = p["left"], p["right"]
        left = a + (p["level"] - v[a]) / (v[a + 1] - v[a])
        right = b - (p["level"] - v[b]) / (v[b - 1] - v[b])
        return F.struct(p["i"].alias("i"), p["height"].alias("height"), p["prominence"].alias("prominence"),
                        (right - left).alias("width"))

    return (
        df.withColumn("_m", _maxima(v))
        .withColumn("_m", F.transform("_m", bases))
        .withColumn("_m", F.transform("_m", feet))
        .withColumn(out, F.transform("_m", width))
        .drop("_m")
    )


def turning_candidates(days: DataFrame) -> DataFrame:
    """Adds ``peaks`` and ``troughs`` (all candidates, unfiltered) and the day's first open."""
    closes = F.transform("bars", lambda b: b["close"].cast("double"))
    work = days.withColumn("_x", closes).withColumn("_y", F.transform("_x", lambda c: -c))
    work = _measured(_measured(work, "_x", "peaks"), "_y", "troughs")
    return work.withColumn("first_open", F.col("bars")[0]["open"]).drop("_x", "_y")


def _kept_apart(candidates: Column, distance: int) -> Column:
    """Highest first, candidates closer than ``distance`` bars to a kept one go; of equals the later stays."""
    ranked = F.array_sort(
        F.transform(candidates, lambda p: F.struct((-p["height"]).alias("h"), (-p["i"]).alias("j"), p.alias("p")))
    )
    none = F.filter(candidates, lambda p: F.lit(False))

    def step(kept: Column, c: Column) -> Column:
        near = F.exists(kept, lambda k: F.abs(k["i"] - c["p"]["i"]) < distance)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(c["p"])))

    return F.aggregate(ranked, none, step)


def select_turning(candidates: Column, least: Column, distance: int, width: int) -> Column:
    """Distance first, then prominence and width."""
    apart = _kept_apart(candidates, distance)
    return F.filter(apart, lambda p: (p["prominence"] >= least) & (p["width"] >= width))


def _selected(bars: DataFrame, v: LabelVariant) -> DataFrame:
    days = turning_candidates(day_arrays(bars))
    least = F.col("first_open") * v.prominence
    return days.withColumns(
        {c: select_turning(F.col(c), least, v.distance, v.width) for c in ("peaks", "troughs")}
    )


def turning_points(bars: DataFrame, variant: LabelVariant) -> DataFrame:
    """One row per selected peak or trough: bar number (from 0), time, prominence and width."""
    days = _selected(bars, variant)

    def tag(name: str, kind: int) -> Column:
        return F.transform(name, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("p")))

    tagged = F.concat(tag("peaks", PEAK), tag("troughs", TROUGH))
    return days.select("symbol", "date", "bars", F.explode(tagged).alias("t")).select(
        "symbol",
        "date",
        F.col("t.kind").alias("kind"),
        F.col("t.p.i").alias("bar"),
        F.col("bars")[F.col("t.p.i")]["ts"].alias("ts"),
        F.col("t.p.prominence").alias("prominence"),
        F.col("t.p.width").alias("width"),
    )


def label_bars(bars: DataFrame, variant: LabelVariant) -> DataFrame:
    """Bars with ``label``: 1 ``shift`` bars after a peak, 2 after a trough, else 0.

    Where both fall on one bar the more prominent wins, the peak on a tie.
    """
    days = _selected(bars, variant)
    rest = [c for c in bars.columns if c not in ("symbol", "date")]

    def labelled(b: Column, at: Column) -> Column:
        peak = F.get(F.filter("peaks", lambda p: p["i"] + variant.shift == at), 0)
        trough = F.get(F.filter("troughs", lambda p: p["i"] + variant.shift == at), 0)
        lower = peak.isNull() | (trough["prominence"] > peak["prominence"])
        label = F.when(trough.isNotNull() & lower, F.lit(TROUGH)).when(peak.isNotNull(), F.lit(PEAK))
        return F.struct(*[b[c].alias(c) for c in rest], label.otherwise(F.lit(NEITHER)).alias("label"))

    return days.select("symbol", "date", F.inline(F.transform("bars", labelled)))


def parameter_grid(
    bars: DataFrame,
    prominences: Sequence[float] = GRID_PROMINENCE,
    distances: Sequence[int] = GRID_DISTANCE,
    widths: Sequence[int] = GRID_WIDTH,
    least_bars: int = 1,
) -> DataFrame:
    """Counts of peaks and troughs per day and parameter set; candidates are measured once."""
    days = turning_candidates(day_arrays(bars, least_bars))
    for d in distances:
        days = days.withColumn(f"_p{d}", _kept_apart(F.col("peaks"), d)).withColumn(
            f"_t{d}", _kept_apart(F.col("troughs"), d)
        )

    levels = F.array(
        *[F.struct(F.lit(float(p)).alias("pct"), F.lit(w).alias("width")) for p in prominences for w in widths]
    )

    def cells(d: int) -> Column:
        def count(c: str, level: Column) -> Column:
            least = F.col("first_open") * level["pct"]
            return F.size(F.filter(c, lambda p: (p["prominence"] >= least) & (p["width"] >= level["width"])))

        def cell(level: Column) -> Column:
            return F.struct(
                level["pct"].alias("prominence_pct"), F.lit(d).alias("distance"), level["width"].alias("width"),
                count(f"_p{d}", level).alias("n_peaks"), count(f"_t{d}", level).alias("n_troughs"),
            )

        return F.transform(levels, cell)

    out = days.select("symbol", "date", F.size("bars").alias("n_bars"), F.inline(F.concat(*[cells(d) for d in distances])))
    total = F.col("n_peaks") + F.col("n_troughs")
    return out.withColumns({"total_labels": total, "label_ratio": total / F.col("n_bars")})


def apply_overrides(labelled: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual labels win where they exist. The join side is chosen by size at run time."""
    edits = manual.select("symbol", "ts", F.col("label").alias("_manual"))
    return labelled.join(edits, ["symbol", "ts"], "left").select(
        *[c for c in labelled.columns if c != "label"], F.coalesce("_manual", "label").alias("label")
    )


def edit_overrides(manual: DataFrame, edits: DataFrame) -> DataFrame:
    """Insert, replace or (label 0) remove manual labels; later edits win."""
    both = manual.withColumn("seq", F.lit(-1).cast("long")).unionByName(edits)
    return latest_by_key(both, ["symbol", "ts"], ["seq"]).filter(F.col("label") != NEITHER)


def label_statistics(labelled: DataFrame) -> DataFrame:
    """Counts, shares and per-day means and deviations of the labels."""
    per_day = labelled.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == PEAK).alias("peaks"),
        F.count_if(F.col("label") == TROUGH).alias("troughs"),
    )
    return per_day.agg(
        F.sum("n").alias("total_bars"),
        (F.sum("n") - F.sum("peaks") - F.sum("troughs")).alias("n_neither"),
        F.sum("peaks").alias("n_peaks"),
        F.sum("troughs").alias("n_troughs"),
        (F.sum("peaks") / F.sum("n")).alias("peak_ratio"),
        (F.sum("troughs") / F.sum("n")).alias("trough_ratio"),
        F.count_distinct("symbol").alias("n_symbols"),
        F.count_distinct("date").alias("n_days"),
        F.avg("peaks").alias("avg_peaks_per_day"),
        F.avg("troughs").alias("avg_troughs_per_day"),
        F.stddev_samp("peaks").alias("std_peaks_per_day"),
        F.stddev_samp("troughs").alias("std_troughs_per_day"),
    )


def label_counts(labelled: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    return labelled.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
