"""Option values, quotes, fills and strike ladders as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tapewright.params import RISK_FREE, SLIPPAGE, VOLATILITY

# --- Fixed values: strike tick by price band (price at least, tick) ----------
STRIKE_TICKS = ((100000, 2500), (50000, 1000), (10000, 500), (1000, 100), (100, 5))
SMALLEST_TICK = 1
# --- Fixed values: distance of the ladder's strikes from the money -----------
LADDER = (-0.03, -0.02, -0.01, 0.0, 0.01, 0.02, 0.03)


def normal_cdf(x: Column, terms: int = 60) -> Column:
    """Standard normal distribution function.

    Inside |x| < 5 the series of phi(x) * (x + x^3/3 + x^5/15 + ...), summed by nesting; beyond,
    the continued fraction of the tail. Both agree with erf to about 1e-15.
    """
    a = F.abs(x)
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    a2 = F.least(a, F.lit(5.0)) * F.least(a, F.lit(5.0))
    odd = F.array(*[F.lit(float(2 * k + 1)) for k in range(terms, 0, -1)])
    series = F.aggregate(odd, F.lit(1.0), lambda acc, k: acc * a2 / k + 1)
    near = 0.5 + density * F.least(a, F.lit(5.0)) * series
    far_a = F.greatest(a, F.lit(5.0))
    steps = F.array(*[F.lit(float(k)) for k in range(30, 0, -1)])
    tail = F.aggregate(steps, far_a, lambda acc, k: far_a + k / acc)
    upper = F.when(a < 5, near).otherwise(1 - density / tail)
    return F.when(x >= 0, upper).otherwise(F.when(a < 5, 1 - near).otherwise(density / tail))


def put_value(
    spot: Column, strike: Column, days: Column, vol: float = VOLATILITY, rate: float = RISK_FREE
) -> Column:
    """European put value; intrinsic once expired, never below 0."""
    years = F.greatest(days, F.lit(1e-9)) / 365.0
    root = F.sqrt(years)
    d1 = (F.ln(F.when(spot > 0, spot / strike)) + (rate + 0.5 * vol * vol) * years) / (vol * root)
    d2 = d1 - vol * root
    paid = strike * F.exp(-rate * years)
    alive = paid * normal_cdf(-d2) - spot * normal_cdf(-d1)
    # A worthless underlying leaves the discounted strike.
    return F.greatest(F.when(days <= 0, strike - spot).when(spot <= 0, paid).otherwise(alive), F.lit(0.0))


def model_quote(mid: Column) -> Column:
    """Bid, ask and last around a model value: half spread 1 % of it, at least 1."""
    half = F.greatest(mid * 0.01, F.lit(1.0))
    return F.struct(F.greatest(mid - half, F.lit(0.0)).alias("bid"), (mid + half).alias("ask"), mid.alias("last"))


def half_spread(high: Column, low: Column) -> Column:
    return F.greatest((high - low) / 2, F.lit(0.01))


def buy_fill(close: Column, high: Column, low: Column, slippage: float = SLIPPAGE) -> Column:
    return (close + half_spread(high, low)) * (1 + slippage)


def sell_fill(close: Column, high: Column, low: Column, slippage: float = SLIPPAGE, floor: float | None = None) -> Column:
    bid = close - half_spread(high, low)
    if floor is not None:
        bid = F.greatest(bid, F.lit(float(floor)))
    return bid * (1 - slippage)


def strike_tick(price: Column) -> Column:
    tick = F
    for least, size in STRIKE_TICKS:
        tick = tick.when(price >= least, F.lit(float(size)))
    return tick.otherwise(F.lit(float(SMALLEST_TICK)))


def _to_tick(value: Column, tick: Column) -> Column:
    # Halves go to the even multiple.
    return F.bround(value / tick) * tick


def strike_ladder(spot: Column) -> Column:
    """Sorted distinct positive strikes around the money."""
    tick = strike_tick(spot)
    money = _to_tick(spot, tick)
    steps = F.array(*[F.lit(1 + p) for p in LADDER])
    strikes = F.transform(steps, lambda s: _to_tick(money * s, tick))
    return F.array_sort(F.array_distinct(F.filter(strikes, lambda s: s > 0)))


def average_entry(fill: Column, quantity: Column) -> Column:
    """Quantity-weighted average entry price, as an aggregate."""
    return F.sum(fill * quantity) / F.sum(quantity)
