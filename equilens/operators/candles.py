"""Candlestick patterns of each bar, found with lags over the security's series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.functions.windows import KEY, TIME, at_least_one, last_n, prior_trend, series, with_age

# Pattern key -> (name, direction), in reporting order.
CATALOG = {
    "doji": ("十字星", "neutral"),
    "hammer": ("錘子線", "bull"),
    "hanging_man": ("吊人線", "bear"),
    "inverted_hammer": ("倒錘線", "bull"),
    "shooting_star": ("流星線", "bear"),
    "bull_engulfing": ("多頭吞噬", "bull"),
    "bear_engulfing": ("空頭吞噬", "bear"),
    "piercing": ("貫穿線", "bull"),
    "dark_cloud": ("烏雲罩頂", "bear"),
    "bull_harami": ("多頭孕線", "bull"),
    "bear_harami": ("空頭孕線", "bear"),
    "morning_star": ("晨星", "bull"),
    "evening_star": ("夜星", "bear"),
    "three_soldiers": ("紅三兵", "bull"),
    "three_crows": ("黑三鴉", "bear"),
}
TREND_BARS = 5
CONTEXT_BARS = TREND_BARS + 2  # two earlier candles, then the trend before them


class Candle:
    """Anatomy of the bar ``back`` rows before the current one."""

    def __init__(self, back: int = 0):
        w = series()

        def price(name: str) -> Column:
            x = F.col(f"adj_{name}").cast("double")
            return F.lag(x, back).over(w) if back else x

        self.open, self.high, self.low, self.close = (price(x) for x in ("open", "high", "low", "close"))

    @staticmethod
    def from_columns(prefix: str) -> Candle:
        candle = Candle.__new__(Candle)
        candle.open, candle.high, candle.low, candle.close = (F.col(f"{prefix}{x}") for x in "ohlc")
        return candle

    range = property(lambda b: b.high - b.low)
    body = property(lambda b: F.abs(b.close - b.open))
    top = property(lambda b: F.greatest(b.open, b.close))
    bottom = property(lambda b: F.least(b.open, b.close))
    upper = property(lambda b: b.high - b.top)
    lower = property(lambda b: b.bottom - b.low)
    middle = property(lambda b: (b.open + b.close) / 2)
    white = property(lambda b: b.close > b.open)
    long = property(lambda b: (b.range > 0) & (b.body >= 0.6 * b.range))


def anatomy(bars: DataFrame) -> DataFrame:
    """Range, body, shadows, colour and midpoint of every bar."""
    b = Candle()
    return bars.select(
        "*",
        b.range.alias("range"), b.body.alias("body"), b.upper.alias("upper_shadow"),
        b.lower.alias("lower_shadow"), b.white.alias("white"), b.middle.alias("midpoint"),
    )


def _with_context(bars: DataFrame) -> DataFrame:
    """Bars with the two previous candles and the trend before a 1-, 2- or 3-bar pattern."""
    w = series()
    close = F.col("adj_close").cast("double")
    context = []
    for back in (0, 1, 2):
        c = Candle(back)
        context += [x.alias(f"_{back}{n}") for n, x in zip("ohlc", (c.open, c.high, c.low, c.close))]
    trends = [prior_trend(close, n, TREND_BARS, w).alias(f"_trend{n}") for n in (1, 2, 3)]
    return bars.select("*", *context, *trends)


def _rules() -> dict[str, Column]:
    a, p, pp = (Candle.from_columns(f"_{back}") for back in (0, 1, 2))
    before1, before2, before3 = (F.col(f"_trend{n}") for n in (1, 2, 3))
    falling1 = before1 < 0

    small_real = (a.body > 0) & (a.body <= 0.4 * a.range)
    long_tail = small_real & (a.lower >= 2 * a.body) & (a.upper <= 0.3 * a.range)
    long_wick = small_real & (a.upper >= 2 * a.body) & (a.lower <= 0.3 * a.range)

    turned_up, turned_down = ~p.white & a.white, p.white & ~a.white
    outgrows = a.body > p.body
    held_inside = p.long & (a.body < p.body) & (a.top <= p.top) & (a.bottom >= p.bottom)

    star = p.body <= 0.4 * F.greatest(p.range, F.lit(1e-9))
    closes_up = (a.close > p.close) & (p.close > pp.close)
    closes_down = (a.close < p.close) & (p.close < pp.close)
    opens_up = (a.open > p.open) & (p.open > pp.open)
    opens_down = (a.open < p.open) & (p.open < pp.open)

    return {
        "doji": a.body <= 0.1 * a.range,
        "hammer": long_tail & falling1,
        "hanging_man": long_tail & ~falling1,
        "inverted_hammer": long_wick & falling1,
        "shooting_star": long_wick & ~falling1,
        "bull_engulfing": turned_up & outgrows & (a.close >= p.open) & (a.open <= p.close),
        "bear_engulfing": turned_down & outgrows & (a.open >= p.close) & (a.close <= p.open),
        "piercing": (before2 < 0) & turned_up & (a.open < p.low) & (a.close > p.middle) & (a.close < p.open),
        "dark_cloud": (before2 > 0) & turned_down & (a.open > p.high) & (a.close > p.open) & (a.close < p.middle),
        "bull_harami": turned_up & held_inside,
        "bear_harami": turned_down & held_inside,
        "morning_star": (before3 < 0) & pp.long & ~pp.white & star & (p.top < pp.close) & a.white
        & (a.close > pp.middle),
        "evening_star": (before3 > 0) & pp.long & pp.white & star & (p.bottom > pp.close) & ~a.white
        & (a.close < pp.middle),
        "three_soldiers": pp.white & p.white & a.white & closes_up & opens_up
        & (p.open <= pp.close) & (a.open <= p.close),
        "three_crows": ~pp.white & ~p.white & ~a.white & closes_down & opens_down,
    }


def pattern_flags(bars: DataFrame) -> DataFrame:
    """Bars with one boolean column per pattern."""
    moved = F.col("_0h") > F.col("_0l")
    flags = [F.coalesce(moved & rule, F.lit(False)).alias(k) for k, rule in _rules().items()]
    return _with_context(bars).select(*[F.col(c) for c in bars.columns], *flags)


def pattern_list() -> Column:
    """Array of (pattern, name, dir) for the flags that are set, in catalog order."""
    entries = [
        F.when(F.col(k), F.struct(F.lit(k).alias("pattern"), F.lit(n).alias("name"), F.lit(d).alias("dir")))
        for k, (n, d) in CATALOG.items()
    ]
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def pattern_events(bars: DataFrame, days: int | None = 90, truncate_context: bool = False) -> DataFrame:
    """One row per (security, bar, pattern) over the newest ``days`` bars, None for all.

    Only the reported bars and the look-back before them are kept ahead of the
    windows. ``truncate_context`` forgets the look-back too, as a caller that
    fetched only the reported range would.
    """
    n = at_least_one(days)
    read = n if truncate_context or n is None else n + CONTEXT_BARS
    flagged = last_n(pattern_flags(last_n(bars, read)), n)
    return flagged.select(KEY, TIME, F.explode(pattern_list()).alias("e")).select(KEY, TIME, "e.*")


def last_patterns(bars: DataFrame) -> DataFrame:
    """Patterns of every security's newest bar as an array of (name, dir)."""
    newest = with_age(pattern_flags(last_n(bars, 12))).filter(F.col("rn") == 1)
    named = F.transform(pattern_list(), lambda e: F.struct(e["name"].alias("name"), e["dir"].alias("dir")))
    return newest.select(KEY, TIME, named.alias("last_patterns"))


def catalog(spark) -> DataFrame:
    """The pattern catalog as a table."""
    return spark.createDataFrame([(k, n, d) for k, (n, d) in CATALOG.items()], "key string, name string, dir string")


def signed_candles(flags: DataFrame) -> DataFrame:
    """Five candle flags as +100 / -100 / 0, from the pattern columns.

    The thresholds are this module's and the same for all bars; ``adaptive_candles`` takes each security's recent bars.
    """

    def mark(up: str | None, down: str | None) -> Column:
        value = F.lit(0)
        if down:
            value = F.when(F.col(down), -100).otherwise(value)
        return F.when(F.col(up), 100).otherwise(value) if up else value

    return flags.select(
        "*",
        mark("hammer", None).alias("cdl_hammer"),
        mark("bull_engulfing", "bear_engulfing").alias("cdl_engulf"),
        mark("morning_star", None).alias("cdl_morning"),
        mark(None, "shooting_star").alias("cdl_shooting"),
        mark(None, "evening_star").alias("cdl_evening"),
    )


@dataclass(frozen=True)
class Yardstick:
    """``factor`` times the mean of a bar's ``measure`` (body or range) over the ``bars`` before it; over no bars, times
    the bar's own."""

    measure: str
    bars: int
    factor: float


@dataclass(frozen=True)
class CandleSettings:
    """What counts as a long or short body, a long or very short shadow, and near; ``penetration`` is the part of the
    first body that the third bar of a star must take back."""

    # The customary defaults of charting libraries.
    body_long: Yardstick = Yardstick("body", 10, 1.0)
    body_short: Yardstick = Yardstick("body", 10, 1.0)
    shadow_long: Yardstick = Yardstick("body", 0, 1.0)
    shadow_very_short: Yardstick = Yardstick("range", 10, 0.1)
    near: Yardstick = Yardstick("range", 5, 0.2)
    penetration: float = 0.3


def adaptive_candles(bars: DataFrame, settings: CandleSettings = CandleSettings()) -> DataFrame:
    """Five candle flags as +100 / -100 / 0 beside the columns of ``bars``, held against each security's own recent bars.

    ``adaptive_hammer``, ``adaptive_engulf``, ``adaptive_morning``, ``adaptive_shooting`` and ``adaptive_evening``. A flag
    stays 0 until every yardstick that it needs has all its bars. One window per security serves all of them.
    """
    w = series()
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    top, bottom = F.greatest(o, c), F.least(o, c)
    values = {"body": F.abs(c - o), "range": h - l, "top": top, "bottom": bottom, "upper": h - top, "lower": bottom - l,
              "sign": F.when(c >= o, 1).otherwise(-1), "close": c, "open": o, "low": l}

    def at(name: str, back: int = 0) -> Column:
        return F.lag(values[name], back).over(w) if back else values[name]

    def than(y: Yardstick, back: int = 0) -> Column:
        if not y.bars:
            return at(y.measure, back) * y.factor
        return F.avg(values[y.measure]).over(w.rowsBetween(-y.bars - back, -1 - back)) * y.factor

    s = settings

    def ready(back: int, *yards: Yardstick) -> Column:
        return F.row_number().over(w) > max([y.bars for y in yards], default=0) + back

    short, tiny = at("body") < than(s.body_short), s.shadow_very_short
    single = ready(1, s.body_short, s.shadow_long, s.shadow_very_short)
    hammer = (single & ready(1, s.near) & short & (at("lower") > than(s.shadow_long)) & (at("upper") < than(tiny))
              & (at("bottom") <= at("low", 1) + than(s.near, 1)))
    shooting = single & short & (at("upper") > than(s.shadow_long)) & (at("lower") < than(tiny)) & (at("bottom") > at("top", 1))

    def engulfs(sign: int) -> Column:
        end, start = ("close", "open") if sign > 0 else ("open", "close")
        above, below = at(end) - at("open" if sign > 0 else "close", 1), at("close" if sign > 0 else "open", 1) - at(start)
        return (ready(2) & (at("sign") == sign) & (at("sign", 1) == -sign)
                & (((above >= 0) & (below > 0)) | ((above > 0) & (below >= 0))))

    def star(sign: int) -> Column:
        """Turning up (1) or down (-1): a long bar, a short one beyond a gap, and one that takes part of the first back."""
        gap = at("top", 1) < at("bottom", 2) if sign > 0 else at("bottom", 1) > at("top", 2)
        taken = (at("close") - at("close", 2)) * sign > at("body", 2) * s.penetration
        return (ready(2, s.body_long, s.body_short) & (at("body", 2) > than(s.body_long, 2)) & (at("sign", 2) == -sign)
                & (at("body", 1) <= than(s.body_short, 1)) & gap & (at("body") > than(s.body_short)) & (at("sign") == sign) & taken)

    flag = lambda cond, value: F.when(cond, value).otherwise(0)
    return bars.select(
        "*", flag(hammer, 100).alias("adaptive_hammer"),
        F.when(engulfs(1), 100).when(engulfs(-1), -100).otherwise(0).alias("adaptive_engulf"), flag(star(1), 100).alias("adaptive_morning"),
        flag(shooting, -100).alias("adaptive_shooting"), flag(star(-1), -100).alias("adaptive_evening"))
