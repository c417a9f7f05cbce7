"""Per-bar features.

All windows of one pass share a single exchange on (symbol, year) and a single sort on
(symbol, year, date, ts): the day windows name the year too, so the same layout serves them.
A partition is one symbol's bars of one year, at most 527,040 on a one-minute grid however
many ticks stand behind them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions.columns import clip, finite, is_feature, lag_of, ratio, share
from tapewright.operators.ordered import asof_join
from tapewright.params import (
    BAND_PERIOD,
    BAND_WIDTH,
    FEATURE_PREFIXES,
    INDEX_RETURN_WINDOWS,
    INDEX_TOLERANCE,
    MA_PERIODS,
    MACD_FAST,
    MACD_SIGNAL,
    MACD_SLOW,
    MOMENTUM_WINDOWS,
    RETURN_WINDOWS,
    RSI_PERIODS,
    STOCH_PERIOD,
)

def _series():
    return Window.partitionBy("symbol", "year").orderBy("date", "ts")


def _day():
    return Window.partitionBy("symbol", "year", "date").orderBy("ts")


def _whole_day():
    return Window.partitionBy("symbol", "year", "date")


def _so_far():
    return _day().rowsBetween(Window.unboundedPreceding, 0)


# Shortest block; it serves spans up to 26, longer spans take longer blocks.
BLOCK = 512
# Natural logarithm of a weight that no longer shows in a double.
FADED = 39.0


def _last(k: int):
    return _series().rowsBetween(-(k - 1), 0)


def _prepared(bars: DataFrame) -> DataFrame:
    if "date" not in bars.columns:
        bars = bars.withColumn("date", F.to_date("ts"))
    if "year" not in bars.columns:
        bars = bars.withColumn("year", F.year("date"))
    return bars


@dataclass
class Family:
    """What a group of features needs: window values in two passes, smoothed series, then plain columns.

    Families computed together share each pass, so their windows meet in the same operators.
    """

    first: dict[str, Column]
    second: dict[str, Column]
    smooth: dict[str, tuple[Column, int, int]]
    then: dict[str, tuple[Column, int, int]]
    out: dict[str, Column]


def _common() -> dict[str, Column]:
    return {"_open": F.first("open").over(_so_far()), "_rn": F.row_number().over(_series())}


def _price() -> Family:
    close, opened, high, low = (F.col(c) for c in ("close", "open", "high", "low"))
    direction = F.signum(close - opened)
    first = {
        "_high": F.max("high").over(_so_far()),
        "_low": F.min("low").over(_so_far()),
        "_before": F.lag(direction).over(_series()),
        **{f"_c{k}": F.lag("close", k).over(_series()) for k in sorted({*RETURN_WINDOWS, 2})},
        **{f"_m{k}": F.avg("close").over(_last(k)) for k in MOMENTUM_WINDOWS},
    }
    changed = F.when(F.col("_before").isNull() | (F.col("_before") != direction), F.col("_rn"))
    second = {"_run": F.max(changed).over(_series().rowsBetween(Window.unboundedPreceding, 0))}
    o, rng = F.col("_open"), high - low
    out = {"pf_open_return": ratio(close - o, o)}
    for k in RETURN_WINDOWS:
        out[f"pf_return_{k}m"] = ratio(close, F.col(f"_c{k}")) - 1
    out |= {
        "pf_range_position": share(close - F.col("_low"), F.col("_high") - F.col("_low"), 0.5),
        "pf_cum_range": ratio(F.col("_high") - F.col("_low"), o),
        "pf_bar_range": ratio(rng, o),
        "pf_body_ratio": share(F.abs(close - opened), rng, 0.0),
        "pf_upper_shadow": share(high - F.greatest(opened, close), rng, 0.0),
        "pf_lower_shadow": share(F.least(opened, close) - low, rng, 0.0),
        "pf_bar_direction": direction,
        "pf_consec_direction": (F.col("_rn") - F.col("_run") + 1) * direction,
    }
    for k in MOMENTUM_WINDOWS:
        out[f"pf_momentum_{k}"] = F.when(F.col("_rn") >= k, ratio(close, F.col(f"_m{k}")) - 1)
    out["pf_acceleration"] = (ratio(close, F.col("_c1")) - 1) - (ratio(F.col("_c1"), F.col("_c2")) - 1)
    return Family(first, second, {}, {}, out)


def _volume(causal: bool = False) -> Family:
    volume, close = F.col("volume").cast("double"), F.col("close")
    first = {
        "_vol": F.sum("volume").over(_so_far()),
        "_pv": F.sum(close * volume).over(_so_far()),
        "_day": F.sum("volume").over(_so_far() if causal else _whole_day()),
        "_v1": F.lag(volume).over(_series()),
        "_dir": F.coalesce(F.signum(close - F.lag("close").over(_series())), F.lit(0.0)),
        **{f"_vm{k}": F.avg(volume).over(_last(k)) for k in MA_PERIODS},
    }
    second = {"_obv": F.sum(volume * F.col("_dir")).over(_so_far())}
    out = {f"vf_vol_ma{k}_ratio": share(volume, F.col(f"_vm{k}"), 1.0) for k in MA_PERIODS}
    change = F.when(F.col("_v1") == 0, F.when(volume > 0, F.lit(10.0)).otherwise(F.lit(0.0))).otherwise(
        volume / F.when(F.col("_v1") != 0, F.col("_v1")) - 1
    )
    vwap = F.when(F.col("_vol") > 0, F.col("_pv") / F.when(F.col("_vol") > 0, F.col("_vol"))).otherwise(close)
    out |= {
        "vf_cum_vol_share": share(F.col("_vol"), F.col("_day"), 0.0),
        "vf_vol_change": clip(F.coalesce(change, F.lit(0.0)), -10, 10),
        "vf_vol_spike": share(volume, F.col(f"_vm{MA_PERIODS[-1]}"), 1.0),
        "vf_obv": F.col("_obv"),
        "vf_obv_norm": share(F.col("_obv"), F.col("_day"), 0.0),
        "vf_vwap_dev": ratio(close - vwap, F.col("_open")),
    }
    return Family(first, second, {}, {}, out)


def _technical() -> Family:
    close, delta = F.col("close"), F.col("_delta")
    first = {
        "_delta": close - F.lag("close").over(_series()),
        **{f"_m{k}": F.avg("close").over(_last(k)) for k in MA_PERIODS},
        "_std": F.coalesce(F.stddev_samp("close").over(_last(BAND_PERIOD)), F.lit(0.0)),
        "_top": F.max("high").over(_last(STOCH_PERIOD)),
        "_bottom": F.min("low").over(_last(STOCH_PERIOD)),
    }
    gain = F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0)))
    loss = F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))
    smooth = {"_fast": (close, MACD_FAST, 1), "_slow": (close, MACD_SLOW, 1)}
    for k in RSI_PERIODS:
        smooth |= {f"_gain{k}": (gain, k, 2), f"_loss{k}": (loss, k, 2)}
    macd, signal = F.col("_fast") - F.col("_slow"), F.col("_signal")
    o = F.col("_open")
    out = {f"tf_ma{k}_ratio": ratio(close, F.col(f"_m{k}")) - 1 for k in MA_PERIODS}
    short, mid, long = (F.col(f"_m{k}") for k in MA_PERIODS)
    out |= {"tf_ma5_10_cross": ratio(short - mid, o), "tf_ma5_20_cross": ratio(short - long, o)}
    out |= {f"tf_rsi{k}": strength_index(F.col(f"_gain{k}"), F.col(f"_loss{k}")) for k in RSI_PERIODS}
    band = 2 * BAND_WIDTH * F.col("_std")
    out |= {
        "tf_macd": ratio(macd, o),
        "tf_macd_signal": ratio(signal, o),
        "tf_macd_hist": ratio(macd - signal, o),
        "tf_bb_position": share(close - (F.col(f"_m{BAND_PERIOD}") - BAND_WIDTH * F.col("_std")), band, 0.5),
        "tf_bb_width": ratio(band, o),
        "tf_stoch": share(close - F.col("_bottom"), F.col("_top") - F.col("_bottom"), 0.5),
    }
    return Family(first, {}, smooth, {"_signal": (macd, MACD_SIGNAL, 1)}, out)


def _computed(bars: DataFrame, families: Sequence[Family]) -> DataFrame:
    bars = _prepared(bars)
    merged = Family(_common(), {}, {}, {}, {})
    for f in families:
        for part in ("first", "second", "smooth", "then", "out"):
            getattr(merged, part).update(getattr(f, part))
    work = bars.select("*", *[c.alias(n) for n, c in merged.first.items()])
    if merged.second:
        work = work.select("*", *[c.alias(n) for n, c in merged.second.items()])
    for series in (merged.smooth, merged.then):
        if series:
            work = smoothed(work, series)
    return work.select(*bars.columns, *[c.alias(n) for n, c in merged.out.items()])


def price_features(bars: DataFrame) -> DataFrame:
    return _computed(bars, [_price()])


def volume_features(bars: DataFrame, causal: bool = False) -> DataFrame:
    """Volume features. ``causal`` replaces the whole day's volume by the volume so far."""
    return _computed(bars, [_volume(causal)])


def technical_features(bars: DataFrame) -> DataFrame:
    return _computed(bars, [_technical()])


def block_of(span: int) -> int:
    """Rows per block: so many that what a row weighs one whole block later is below double precision."""
    size, fade = BLOCK, -math.log(1 - 2.0 / (span + 1))
    while size * fade < FADED:
        size *= 2
    return size


def _blocks(block: str):
    # Ordering by the block first changes nothing in a series, and lets both windows share one sort.
    return Window.partitionBy("symbol", "year").orderBy(block, "date", "ts")


def _in_block(block: str):
    w = Window.partitionBy("symbol", "year", block).orderBy("date", "ts")
    return w.rowsBetween(Window.unboundedPreceding, 0)


def smoothed(df: DataFrame, series: dict[str, tuple[Column, int, int]]) -> DataFrame:
    """Exponentially weighted means (weight 2/(span+1), started at the first value), for any span.

    ``series`` maps an output name to (input, span, number of its first row); ``df`` has the row
    number of the series as ``_rn``. Within a block the mean is a running sum of inputs scaled by
    the decay, which restarts at each block so that the scale stays in range; the previous block's
    mean is then carried in. Blocks grow with the span, so that older blocks weigh nothing a double
    could hold. Inputs may be null before their first row only.
    """
    kept, terms, local, full = df.columns, [], [], []
    sizes = sorted({block_of(span) for _, span, _ in series.values() if span > 1})
    for size in sizes:
        df = df.withColumns({f"_block{size}": F.floor((F.col("_rn") - 1) / size), f"_j{size}": (F.col("_rn") - 1) % size})
    for name, (x, span, start) in series.items():
        if span <= 1:
            terms.append(F.when(F.col("_rn") >= start, x).alias(f"_l_{name}"))
            local.append(F.col(f"_l_{name}"))
            full.append(F.col(f"_l_{name}").alias(name))
            continue
        size = block_of(span)
        block, j = f"_block{size}", F.col(f"_j{size}")
        alpha = 2.0 / (span + 1)
        decay = F.lit(1 - alpha)
        own = F.when(F.col("_rn") == start, x).otherwise(x * alpha)
        terms.append((own * F.pow(decay, -j.cast("double"))).alias(f"_x_{name}"))
        local.append((F.sum(f"_x_{name}").over(_in_block(block)) * F.pow(decay, j.cast("double"))).alias(f"_l_{name}"))
        at_end = F.when(j == size - 1, F.col(f"_l_{name}"))
        carried = F.last(at_end, ignorenulls=True).over(_blocks(block).rowsBetween(Window.unboundedPreceding, -1))
        full.append((F.col(f"_l_{name}") + F.coalesce(carried, F.lit(0.0)) * F.pow(decay, j + 1.0)).alias(name))
    blocks = [c for size in sizes for c in (f"_block{size}", f"_j{size}")]
    return df.select("*", *terms).select(*kept, *blocks, *local).select(*kept, *full)


def strength_index(gain: Column, loss: Column) -> Column:
    """Relative strength in [0, 1]; no losses counts as a ratio of 100."""
    rs = F.when(loss > 0, gain / F.when(loss > 0, loss)).otherwise(F.lit(100.0))
    return 1 - 1 / (1 + rs)


def time_features(bars: DataFrame, session_minutes: int = 390) -> DataFrame:
    bars = _prepared(bars)
    known = "minutes_from_open" in bars.columns
    if known:
        work, m = bars, F.col("minutes_from_open")
    else:
        begin = F.min("ts").over(_whole_day()).cast("timestamp")
        micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(begin)
        work, m = bars.withColumn("_elapsed", micros / 60e6), F.col("_elapsed")
    turn = 2 * math.pi
    dow, month = F.weekday("ts"), F.month("ts")
    out = {
        "tmf_elapsed_norm": m / float(session_minutes),
        "tmf_dow_sin": F.sin(turn * dow / 5),
        "tmf_dow_cos": F.cos(turn * dow / 5),
        "tmf_month_sin": F.sin(turn * month / 12),
        "tmf_month_cos": F.cos(turn * month / 12),
    }
    if known:
        out |= {
            "tmf_progress_sq": F.pow(m / float(session_minutes), F.lit(2.0)),
            "tmf_minutes_from_open": m,
            "tmf_elapsed_sin": F.sin(turn * m / session_minutes),
            "tmf_elapsed_cos": F.cos(turn * m / session_minutes),
            "tmf_session_phase": F.floor(m / (session_minutes / 6)).cast("double"),
            "tmf_is_first_hour": (m < 60).cast("int"),
            "tmf_is_last_hour": (m >= session_minutes - 60).cast("int"),
        }
    return work.select(*bars.columns, *[c.alias(n) for n, c in out.items()])


def index_features(index: DataFrame, by: Sequence[str] = ("market",)) -> DataFrame:
    """Returns and 10-bar volatility of an index series."""
    w = Window.partitionBy(*by).orderBy("ts")
    lags = index.select(
        *by, "ts", "close", *[F.lag("close", k).over(w).alias(f"_c{k}") for k in INDEX_RETURN_WINDOWS]
    ).withColumn("_r", ratio(F.col("close"), F.col("_c1")) - 1)
    recent = w.rowsBetween(-9, 0)
    return lags.select(
        *by,
        "ts",
        *[(ratio(F.col("close"), F.col(f"_c{k}")) - 1).alias(f"mf_idx_return_{k}m") for k in INDEX_RETURN_WINDOWS],
        F.when(F.count("_r").over(recent) == 10, F.stddev_samp("_r").over(recent)).alias("mf_idx_volatility"),
    )


def add_index_features(bars: DataFrame, index: DataFrame, by: Sequence[str] = ("market",)) -> DataFrame:
    """Index features of the last index bar at most two minutes old.

    All symbols of a market share its times, so those are looked up, and bars join them by market and time.
    """
    feats = index_features(index, by)
    names = [c for c in feats.columns if c.startswith("mf_")]
    return asof_join(bars, feats, by, names, tolerance=INDEX_TOLERANCE, shared_times=True)


def build_features(bars: DataFrame, session_minutes: int = 390, index: DataFrame | None = None) -> DataFrame:
    """Price, volume, technical and time features, and index features when an index is given."""
    out = time_features(_computed(bars, [_price(), _volume(), _technical()]), session_minutes)
    return out if index is None else add_index_features(out, index)


def feature_columns(df: DataFrame, lags: bool = True) -> list[str]:
    """Feature names in alphabetical order, which is the order of model vectors."""
    names = [c for c in df.columns if is_feature(c, FEATURE_PREFIXES)]
    return sorted(c for c in names if lags or lag_of(c) is None)


def add_lags(df: DataFrame, lookback: int, fill: str = "0fill") -> DataFrame:
    """``{column}_lag{n}`` of every base feature.

    One lagged struct per step rather than one lag per column keeps the window narrow.
    """
    if lookback == 0:
        return df
    base = feature_columns(df, lags=False)
    work = df.withColumn("_f", F.struct(*base))
    work = work.select("*", *[F.lag("_f", n).over(_series()).alias(f"_f{n}") for n in range(1, lookback + 1)])
    if fill == "drop":
        work = work.filter(F.col(f"_f{lookback}.{base[0]}").isNotNull())
    value = "coalesce(_f{n}.`{c}`, 0)" if fill == "0fill" else "_f{n}.`{c}`"
    lagged = [f"{value} AS `{{c}}_lag{{n}}`".format(n=n, c=c) for n in range(1, lookback + 1) for c in base]
    return work.selectExpr(*[f"`{c}`" for c in df.columns], *lagged)


def clean_features(df: DataFrame) -> DataFrame:
    """Infinities become null, gaps take the day's last value, what is left becomes 0.

    Written as SQL text: with several hundred columns, building them one call at a time is slow.
    """
    names = set(feature_columns(df))
    work = _prepared(df)

    def each(template: str) -> list[str]:
        return [(template if c in names else "`{c}`").format(c=c) for c in work.columns]

    finite_only = "CASE WHEN NOT isnan(`{c}`) AND abs(`{c}`) < double('inf') THEN double(`{c}`) END AS `{c}`"
    so_far = "PARTITION BY symbol, year, date ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    filled = f"coalesce(last_value(`{{c}}`) IGNORE NULLS OVER ({so_far}), 0D) AS `{{c}}`"
    return work.selectExpr(*each(finite_only)).selectExpr(*each(filled))


def sequences(df: DataFrame, lookback: int, fill: str = "drop", columns: Sequence[str] | None = None) -> DataFrame:
    """Per bar the last ``lookback`` feature rows of its day, oldest first, as ``seq``.

    ``0fill`` pads early bars with zero rows in front; ``drop`` leaves them out.
    """
    names = list(columns or feature_columns(df))
    row = F.array(*[F.coalesce(finite(F.col(c)), F.lit(0.0)).cast("float") for c in names])
    work = _prepared(df).withColumn("_row", row)
    work = work.withColumn("seq", F.collect_list("_row").over(_day().rowsBetween(-(lookback - 1), 0))).drop("_row")
    if fill == "drop":
        return work.filter(F.size("seq") == lookback)
    zero = F.array_repeat(F.lit(0.0).cast("float"), len(names))
    pad = F.array_repeat(zero, F.lit(lookback) - F.size("seq"))
    return work.withColumn("seq", F.concat(pad, F.col("seq")))


def drop_early_bars(df: DataFrame, lookback: int) -> DataFrame:
    """Bars from the ``lookback``-th of their day on."""
    work = _prepared(df).withColumn("_n", F.row_number().over(_day()))
    return work.filter(F.col("_n") >= lookback).drop("_n")


def bar_numbers(df: DataFrame) -> DataFrame:
    return _prepared(df).withColumn("bar_num", F.row_number().over(_day()))
