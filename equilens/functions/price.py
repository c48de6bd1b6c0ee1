"""Price, return, ratio and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as double, NULL for a zero or missing denominator."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def growth(now: Column, then: Column) -> Column:
    return ratio(now, then) - 1


def round_exact(x: Column, digits: int) -> Column:
    """Half-up rounding of a mean or quotient of decimals: binary noise is dropped before halves are judged."""
    return F.round(F.round(x, digits + 5), digits)


def pct(a: Column, b: Column) -> Column:
    """Percentage of ``b``, two decimals."""
    return F.round(ratio(a, b) * 100, 2)


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def rs_raw(c0: Column, c3m: Column, c6m: Column, c12m: Column) -> Column:
    """Relative-strength score: the latest quarter counts twice."""
    return ratio(2 * c0, c3m) + ratio(c0, c6m) + ratio(c0, c12m)


def net_of(*parts: Column) -> Column:
    """Sum that treats missing parts as zero."""
    total = F.lit(0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0))
    return total


def dividend_ratio(prev_close: Column, cash: Column, stock: Column) -> Column:
    """Reference-price ratio of a dividend; stock dividends are per ten-unit par."""
    return F.when(
        prev_close > 0,
        (prev_close - F.coalesce(cash, F.lit(0.0))) / (prev_close * (1 + F.coalesce(stock, F.lit(0.0)) / 10)),
    )


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def spread_ratios(high: Column, low: Column, close: Column, volume: Column, vol_avg: Column, spr_avg: Column):
    """Volume multiple, spread multiple and where the close sits in the bar."""
    spread = high - low
    return ratio(volume, vol_avg), ratio(spread, spr_avg), ratio(close - low, spread)


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos`` between two float arrays, in double precision."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return 1 - ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
