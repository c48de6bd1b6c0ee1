"""Volume-price analysis: what volume and spread say about each bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.functions.price import spread_ratios
from equilens.functions.windows import KEY, TIME, at_least_one, last_n, prior_trend, series, trailing_baseline

# Signal key -> (name, direction, phase), and the thresholds.
CATALOG = {
    "stopping_vol": ("停損量(賣壓宣洩)", "bull", "承接"),
    "accumulation": ("承接量(高量收高)", "bull", "承接"),
    "no_supply": ("測試無賣壓", "bull", "測試"),
    "no_demand": ("無買氣(虛漲)", "bear", "測試"),
    "churning": ("量價背離(換手)", "neutral", "出貨"),
    "buying_climax": ("買盤高潮(出貨)", "bear", "出貨"),
}
BASELINE_BARS = 20
TREND_BARS = 10
MIN_PRIOR_BARS = 6
WARM_UP_BARS = 25
ULTRA, HIGH, LOW = 2.0, 1.5, 0.6
WIDE, NARROW = 1.5, 0.6


def with_baseline(bars: DataFrame) -> DataFrame:
    """Bars with ``vr``, ``sr``, ``pos`` against the previous 20 bars, and the previous close.

    The ratios are NULL where the baseline or the bar's own spread is zero.
    """
    w = series()
    h, lo, c = (F.col(f"adj_{x}").cast("double") for x in ("high", "low", "close"))
    v = F.col("volume").cast("double")
    based = bars.select(
        "*",
        trailing_baseline(v, BASELINE_BARS, w).alias("vol_avg"),
        trailing_baseline(h - lo, BASELINE_BARS, w).alias("spr_avg"),
        F.lag(c).over(w).alias("prev_close"),
        (F.row_number().over(w) - 1).alias("_prior"),
        prior_trend(c, 1, TREND_BARS, w).alias("_trend"),
    )
    vr, sr, pos = spread_ratios(h, lo, c, v, F.col("vol_avg"), F.col("spr_avg"))
    usable = (F.col("vol_avg") > 0) & (F.col("spr_avg") > 0) & (h > lo) & F.col("prev_close").isNotNull()
    return based.select(
        "*",
        F.when(usable, vr).alias("vr"), F.when(usable, sr).alias("sr"), F.when(usable, pos).alias("pos"),
        F.when(usable, F.signum(c - F.col("prev_close")).cast("int")).alias("_move"),
    )


def _terms() -> dict[str, Column]:
    vr, sr, pos, move = (F.col(x) for x in ("vr", "sr", "pos", "_move"))
    quiet = (vr <= LOW) & (sr <= NARROW)
    return {
        "stopping_vol": (move < 0) & (vr >= ULTRA) & (sr >= WIDE) & (pos >= 0.45),
        "absorbed": (move < 0) & (vr >= HIGH) & (pos >= 0.6),
        "no_supply": (move < 0) & quiet,
        "no_demand": (move > 0) & quiet,
        "churning": (vr >= HIGH) & (sr <= NARROW),
        "climax": (move > 0) & (vr >= ULTRA) & (sr >= WIDE) & (pos <= 0.5),
    }


def support_flags() -> tuple[Column, Column]:
    """(accumulating, distributing) of a bar as the snapshot counts them: any rule, no trend."""
    t = _terms()
    return t["stopping_vol"] | t["absorbed"] | t["no_supply"], t["no_demand"] | t["churning"] | t["climax"]


def vpa_flags(bars: DataFrame) -> DataFrame:
    """Bars with one boolean column per signal; at least six earlier bars are needed."""
    t = _terms()
    rules = {
        "stopping_vol": t["stopping_vol"],
        "accumulation": t["absorbed"] & ~t["stopping_vol"],
        "no_supply": t["no_supply"],
        "no_demand": t["no_demand"],
        "churning": t["churning"],
        "buying_climax": t["climax"] & (F.col("_trend") > 0),
    }
    enough = F.col("_prior") >= MIN_PRIOR_BARS
    flags = [F.coalesce(enough & rule, F.lit(False)).alias(k) for k, rule in rules.items()]
    return with_baseline(bars).select(*[F.col(c) for c in bars.columns], *flags)


def vpa_events(bars: DataFrame, days: int | None = 90) -> DataFrame:
    """One row per (security, bar, signal) over the newest ``days`` bars, None for all."""
    n = at_least_one(days)
    entries = [
        F.when(
            F.col(k),
            F.struct(
                F.lit(k).alias("signal"), F.lit(name).alias("name"), F.lit(d).alias("dir"), F.lit(ph).alias("phase")
            ),
        )
        for k, (name, d, ph) in CATALOG.items()
    ]
    recent = last_n(vpa_flags(last_n(bars, None if n is None else n + WARM_UP_BARS)), n)
    fired = F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull()))
    return recent.select(KEY, TIME, fired.alias("e")).select(KEY, TIME, "e.*")
