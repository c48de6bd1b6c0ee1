"""Moving-average, volume and breakout states of each bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.functions.windows import KEY, TIME, last_n, rolling_full, series

# Window lengths, thresholds and the labels of the signals.
SHORT, MID, LONG = 20, 60, 120
VOLUME_DAYS = 20
BREAKOUT_DAYS = 60
BREAKOUT_VOLUME = 1.5
SQUEEZE = 0.03
LABELS = {
    "bull_ma": "均線多頭排列",
    "ma_squeeze": "三線聚攏(蓄勢)",
    "vol_price_up": "價漲量增",
    "bear_divergence": "價高量縮(背離)",
    "golden_cross": "黃金叉",
    "death_cross": "死亡叉",
    "breakout": "帶量突破60日高",
}
CANDLE_LABELS = {
    "cdl_hammer": "錘子線",
    "cdl_engulf": "吞噬",
    "cdl_morning": "晨星",
    "cdl_shooting": "射擊之星",
    "cdl_evening": "夜星",
}
FLAGS = tuple(LABELS)


def moving_averages(bars: DataFrame) -> DataFrame:
    """Full-window means of the close (20/60/120) and of the volume (20)."""
    w = series()
    c, v = F.col("close").cast("double"), F.col("volume").cast("double")
    return bars.select(
        "*",
        rolling_full(F.avg, c, SHORT, w).alias("ma20"),
        rolling_full(F.avg, c, MID, w).alias("ma60"),
        rolling_full(F.avg, c, LONG, w).alias("ma120"),
        rolling_full(F.avg, v, VOLUME_DAYS, w).alias("vma20"),
    )


def technical_flags(bars: DataFrame) -> DataFrame:
    """Bars with the four states and three events; an unknown comparison is false."""
    w = series()
    c, v = F.col("close").cast("double"), F.col("volume").cast("double")
    s, m, lng, vma = (F.col(x) for x in ("ma20", "ma60", "ma120", "vma20"))
    with_ma = moving_averages(bars).select(
        "*",
        F.lag(c).over(w).alias("_prev"),
        rolling_full(F.max, c, BREAKOUT_DAYS, w, ending=-1).alias("_ceiling"),
        rolling_full(F.max, c, 20, w).alias("_top20"),
    )
    s1, m1 = F.lag("ma20").over(w), F.lag("ma60").over(w)
    rules = {
        "bull_ma": (s > m) & (m > lng) & (c > s),
        "ma_squeeze": F.try_divide(F.greatest(s, m, lng) - F.least(s, m, lng), c) < SQUEEZE,
        "vol_price_up": (c > F.col("_prev")) & (v > vma),
        "bear_divergence": (c >= F.col("_top20")) & (v < vma),
        "golden_cross": (s > m) & (s1 <= m1),
        "death_cross": (s < m) & (s1 >= m1),
        "breakout": (c > F.col("_ceiling")) & (v > BREAKOUT_VOLUME * vma),
    }
    flagged = with_ma.select("*", *[F.coalesce(rule, F.lit(False)).alias(k) for k, rule in rules.items()])
    return flagged.drop("_prev", "_ceiling", "_top20")


def fired_labels(flags: DataFrame) -> Column:
    """Labels of the signals that fired, candle flags with an arrow for their sign."""
    parts = [F.when(F.col(k), F.lit(text)) for k, text in LABELS.items()]
    for k, text in CANDLE_LABELS.items():
        if k in flags.columns:
            parts.append(
                F.when(F.col(k) > 0, F.lit(text + "↑")).when(F.col(k) < 0, F.lit(text + "↓"))
            )
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def scan_signals(bars: DataFrame, n: int = 1) -> DataFrame:
    """``label_scan`` from bars, keeping only the look-back the newest ``n`` need ahead of the windows."""
    return label_scan(technical_flags(last_n(bars, n + LONG)), n)


def label_scan(flags: DataFrame, n: int = 1) -> DataFrame:
    """The newest ``n`` bars of every security that fired anything, labels joined."""
    tail = last_n(flags, n)
    labelled = tail.withColumn("labels", F.array_join(fired_labels(flags), "、"))
    return labelled.filter(F.col("labels") != "").select(KEY, TIME, "close", "labels")
