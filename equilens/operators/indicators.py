"""Chart overlays and recursive indicators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.functions.windows import KEY, TIME, rolling_full, series

# Overlay windows and the published indicator defaults.
PRICE_OVERLAYS = (5, 10, 20, 60, 120, 240)
VOLUME_OVERLAYS = (5, 20)
MACD_DEFAULTS = (12, 26, 9)
KDJ_DEFAULTS = (9, 3, 3)


def chart_overlays(bars: DataFrame) -> DataFrame:
    """Moving averages of the adjusted close and of the volume, complete windows only."""
    w = series()
    c, v = F.col("adj_close").cast("double"), F.col("volume").cast("double")
    return bars.select(
        "*",
        *[rolling_full(F.avg, c, n, w).alias(f"ma{n}") for n in PRICE_OVERLAYS],
        *[rolling_full(F.avg, v, n, w).alias(f"vol_ma{n}") for n in VOLUME_OVERLAYS],
    )


def _ema(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean seeded with the plain mean of the first ``n`` values."""
    out = np.full(len(x), np.nan)
    start = int(np.argmax(~np.isnan(x))) if len(x) and not np.isnan(x).all() else len(x)
    if len(x) - start < n:
        return out
    seed_at = start + n - 1
    tail = np.concatenate(([x[start : seed_at + 1].mean()], x[seed_at + 1 :]))
    out[seed_at:] = pd.Series(tail).ewm(alpha=2.0 / (n + 1), adjust=False).mean().to_numpy()
    return out


def _smoothed(x: np.ndarray, n: int, seed: float = 50.0) -> np.ndarray:
    """``((n-1) * previous + value) / n`` starting from ``seed`` at the first value."""
    out = np.full(len(x), np.nan)
    known = ~np.isnan(x)
    values = pd.Series(np.concatenate(([seed], x[known])))
    out[known] = values.ewm(alpha=1.0 / n, adjust=False).mean().to_numpy()[1:]
    return out


def macd_kdj(bars: DataFrame) -> DataFrame:
    """MACD (dif, dea, histogram x2) and KDJ of every bar.

    The recursions run along one security's bars, which the unique
    (stock_id, trade_date) key bounds by the number of trading dates.
    """
    fast, slow, signal = MACD_DEFAULTS
    n, k_n, d_n = KDJ_DEFAULTS

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        c, h, lo = (pdf[x].to_numpy(dtype=float) for x in ("c", "h", "l"))
        dif = _ema(c, fast) - _ema(c, slow)
        dea = _ema(dif, signal)
        top = pd.Series(h).rolling(n).max().to_numpy()
        bottom = pd.Series(lo).rolling(n).min().to_numpy()
        spread = np.where(top == bottom, 1.0, top - bottom)
        k = _smoothed((c - bottom) / spread * 100, k_n)
        d = _smoothed(k, d_n)
        return pd.DataFrame(
            {KEY: pdf[KEY], TIME: pdf[TIME], "dif": dif, "dea": dea, "macd": (dif - dea) * 2, "k": k, "d": d,
             "j": 3 * k - 2 * d}
        )

    slim = bars.select(
        KEY, TIME, F.col("adj_close").cast("double").alias("c"), F.col("adj_high").cast("double").alias("h"),
        F.col("adj_low").cast("double").alias("l"),
    )
    names = ("dif", "dea", "macd", "k", "d", "j")
    out = slim.groupBy(KEY).applyInPandas(
        one, f"{KEY} string, {TIME} date, " + ", ".join(f"{x} double" for x in names)
    )
    return out.select(KEY, TIME, *[F.nanvl(F.col(x), F.lit(None).cast("double")).alias(x) for x in names])
