"""Column helpers: guarded ratios, clock and date parts, text clean-up."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """``num / den``; where ``den`` is 0 the default, or the IEEE result when none is given."""
    num, den = num.cast("double"), den.cast("double")
    if default is not None:
        return F.when(den == 0, F.lit(float(default))).otherwise(num / F.when(den != 0, den))
    at_zero = (
        F.when(num > 0, F.lit(math.inf)).when(num < 0, F.lit(-math.inf)).otherwise(F.lit(None).cast("double"))
    )
    return F.when(den == 0, at_zero).otherwise(num / F.when(den != 0, den))


def quotient(num: Column, den: Column) -> Column:
    """``num / den`` as doubles give it: infinity where ``den`` is 0, NaN where both are, null where one is missing."""
    num, den = num.cast("double"), den.cast("double")
    return F.when(den == 0, num * F.lit(math.inf)).otherwise(num / F.when(den != 0, den))


def share(num: Column, den: Column, default: float) -> Column:
    """``num / den`` where ``den`` is positive, else the default."""
    return F.when(den > 0, num.cast("double") / F.when(den > 0, den.cast("double"))).otherwise(F.lit(float(default)))


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == math.inf), F.lit(None).cast("double")).otherwise(c.cast("double"))


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def floor_to(ts: Column, minutes: int) -> Column:
    """``ts`` floored to a bin of ``minutes`` (a divisor of 60), keeping its zone-less type."""
    return ts - F.make_dt_interval(
        F.lit(0), F.lit(0), (F.minute(ts) % minutes).cast("int"), F.extract(F.lit("SECOND"), ts)
    )


def minute_of(ts: Column) -> Column:
    return floor_to(ts, 1)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def clock_minutes(text: str) -> int:
    hours, minutes = text.split(":")
    return int(hours) * 60 + int(minutes)


def to_market_time(ts: Column, source_zone: str, target_zone: str) -> Column:
    """Wall-clock time moved between zones; daylight saving follows the zone rules."""
    return F.convert_timezone(F.lit(source_zone), F.lit(target_zone), ts)


def pad_code(code: Column, width: int = 6) -> Column:
    """Numeric exchange codes padded with zeros to ``width``; other codes only trimmed."""
    text = F.trim(code)
    return F.when(text.rlike("^[0-9]+$"), F.lpad(text, width, "0")).otherwise(text)


def between_dates(ts: Column, start: str | None, end: str | None, closed: str = "day") -> Column:
    """Range predicate on ``ts``.

    closed: ``day`` keeps all of the end date, ``midnight`` keeps only its first instant,
    ``open`` leaves the end date out, ``next_midnight`` also keeps the first instant after it.
    """
    keep = F.lit(True)
    if start is not None:
        keep = keep & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        last = F.lit(end).cast("timestamp_ntz")
        after = F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp_ntz")
        keep = keep & {
            "day": ts < after,
            "midnight": ts <= last,
            "open": ts < last,
            "next_midnight": ts <= after,
        }[closed]
    return keep


def is_feature(name: str, prefixes: tuple[str, ...]) -> bool:
    return name.startswith(prefixes)


def lag_of(name: str) -> int | None:
    head, mark, tail = name.rpartition("_lag")
    return int(tail) if mark and tail.isdigit() and head else None
