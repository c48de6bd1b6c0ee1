"""Rule-based screens over the snapshot."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.functions.windows import KEY, TIME, head, trailing_calendar, with_age
from equilens.operators.candles import CATALOG, last_patterns, pattern_flags

# Criterion key -> snapshot column, by the way it compares.
AT_LEAST = {
    "ret_1m_min": "ret_1m", "ret_3m_min": "ret_3m", "ret_6m_min": "ret_6m", "ret_12_1_min": "ret_12_1",
    "dist_52w_high_min": "dist_52w_high", "rs_6m_min": "rs_6m", "rs_rating_min": "rs_rating",
    "pct_from_low_min": "pct_from_low", "near_pivot_min": "near_pivot", "vpa_accum_min": "vpa_accum_20d",
    "vpa_distrib_min": "vpa_distrib_20d", "roe_min": "roe", "eps_min": "eps", "gross_margin_min": "gross_margin",
    "net_margin_min": "net_margin", "rev_yoy_min": "rev_yoy", "per_min": "per",
    "dividend_yield_min": "dividend_yield", "inst_net_20d_min": "inst_net_20d", "foreign_ratio_min": "foreign_ratio",
    "big1000_pct_min": "big1000_pct", "amt20_min": "amt20",
}
AT_MOST = {
    "debt_ratio_max": "debt_ratio", "per_max": "per", "pbr_max": "pbr", "margin_chg_20d_max": "margin_chg_20d",
}
FLAGS = (
    "above_ma60", "ma_bull", "ma200_up", "trend_template", "vcp", "mf_accumulate", "mf_distribute", "in_universe",
)
EXACT = ("industry", "market", "security_type")
POSITIVE_ONLY = ("per_max",)
SORTABLE = (
    "ret_1m", "ret_3m", "ret_6m", "ret_12m", "ret_12_1", "rs_6m", "rs_rating", "pct_from_low", "near_pivot",
    "tight_recent", "roe", "eps", "gross_margin", "net_margin", "rev_yoy", "per", "pbr", "dividend_yield",
    "inst_net_20d", "margin_chg_20d", "foreign_ratio", "big1000_pct", "big1000_chg", "amt20", "vpa_accum_20d",
    "vpa_distrib_20d",
)
DEFAULT_SORT = "ret_3m"
DEFAULT_LIMIT = 50
# The one-click screens.
STRATEGIES = {
    "momentum": {
        "name": "動能股",
        "filters": {"ret_12_1_min": 0.15, "above_ma60": True, "inst_net_20d_min": 0, "amt20_min": 20000000,
                    "in_universe": True},
        "sort": "ret_12_1",
    },
    "garp": {
        "name": "價值成長 (GARP)",
        "filters": {"roe_min": 15, "per_max": 15, "rev_yoy_min": 10, "debt_ratio_max": 60, "in_universe": True},
        "sort": "roe",
    },
    "dividend": {
        "name": "高息存股",
        "filters": {"dividend_yield_min": 4, "roe_min": 8, "debt_ratio_max": 50, "in_universe": True},
        "sort": "dividend_yield",
    },
    "chip": {
        "name": "籌碼強勢",
        "filters": {"inst_net_20d_min": 0, "above_ma60": True, "margin_chg_20d_max": 0, "in_universe": True},
        "sort": "inst_net_20d",
    },
    "minervini": {
        "name": "趨勢範本 (Minervini)",
        "filters": {"trend_template": True, "in_universe": True},
        "sort": "rs_rating",
        "limit": 100,
    },
    "vcp": {
        "name": "VCP 收縮買點 (Minervini)",
        "filters": {"vcp": True, "in_universe": True},
        "sort": "rs_rating",
    },
    "mf_accumulate": {
        "name": "主力承接",
        "filters": {"mf_accumulate": True, "in_universe": True},
        "sort": "vpa_accum_20d",
    },
    "mf_distribute": {
        "name": "主力出貨",
        "filters": {"mf_distribute": True, "in_universe": True},
        "sort": "vpa_distrib_20d",
    },
}


def clean_filters(filters: dict | None) -> dict:
    """Criteria that carry a value."""
    return {k: v for k, v in (filters or {}).items() if v is not None and v != ""}


def _criterion(key: str, value) -> Column | None:
    if key in FLAGS:
        return F.col(key) == F.lit(bool(value))
    if key in EXACT:
        return F.col(key) == F.lit(str(value))
    compare, column = (operator.ge, AT_LEAST[key]) if key in AT_LEAST else (operator.le, AT_MOST.get(key))
    if column is None:
        return None
    try:
        bound = F.lit(float(value))
    except (TypeError, ValueError):
        return None
    test = compare(F.col(column), bound)
    return test & (F.col(column) > 0) if key in POSITIVE_ONLY else test


def build_predicate(filters: dict | None) -> Column:
    """AND of the known criteria; unknown, empty and unreadable ones are ignored."""
    tests = [_criterion(k, v) for k, v in clean_filters(filters).items()]
    return reduce(operator.and_, [t for t in tests if t is not None], F.lit(True))


def screen(snapshot: DataFrame, filters=None, sort: str = DEFAULT_SORT, desc: bool = True, limit: int | None = DEFAULT_LIMIT):
    """Filtered securities, best first, unknown values last, ties by code; ``limit=None`` returns all."""
    column = F.col(sort if sort in SORTABLE else DEFAULT_SORT)
    order = column.desc_nulls_last() if desc else column.asc_nulls_last()
    return head(snapshot.filter(build_predicate(filters)).orderBy(order, KEY), limit)


def run_strategy(snapshot: DataFrame, name: str, limit: int | None | str = "preset") -> DataFrame:
    """A preset screen; its own limit unless one is given, None returns all."""
    preset = STRATEGIES[name]
    if limit == "preset":
        limit = preset.get("limit", DEFAULT_LIMIT)
    return screen(snapshot, preset["filters"], preset["sort"], True, limit)


def with_last_patterns(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Screen rows with the patterns of their newest bar."""
    shown = bars.join(rows.select(KEY), KEY, "left_semi")
    return rows.join(last_patterns(shown).drop(TIME), KEY, "left")


def search(stock: DataFrame, q: str, limit: int | None = 30, escape: bool = False) -> DataFrame:
    """Code prefix or name part; code hits first; ``limit=None`` returns all.

    ``%`` and ``_`` in the text act as wildcards unless ``escape`` is set.
    """
    text = (q or "").strip()
    if not text:
        return stock.limit(0).select(KEY, "name", "market", "industry")
    if escape:
        by_code, by_name = F.col(KEY).startswith(text), F.col("name").contains(text)
    else:
        by_code, by_name = F.col(KEY).like(f"{text}%"), F.col("name").like(f"%{text}%")
    found = stock.filter(by_code | by_name).orderBy(F.when(by_code, 0).otherwise(1), KEY)
    return head(found, limit).select(KEY, "name", "market", "industry")


def screen_by_pattern(
    snapshot: DataFrame, bars: DataFrame, pattern: str, limit: int | None = 100, days: int = 20
) -> DataFrame:
    """Universe members whose newest bar within ``days`` shows the pattern, most traded first; ``limit=None`` returns all.

    The trend before the pattern is read from those days only.
    """
    if pattern not in CATALOG:
        raise ValueError(f"unknown pattern: {pattern}")
    newest = with_age(pattern_flags(trailing_calendar(bars, TIME, days))).filter(F.col("rn") == 1)
    hits = newest.filter(F.col(pattern)).select(KEY)
    members = snapshot.filter(F.col("in_universe")).join(hits, KEY, "left_semi")
    return head(members.orderBy(F.col("amt20").desc_nulls_last(), KEY), limit).select(
        KEY, "name", "industry", "close", "ret_1m", "ret_3m", "per", "inst_net_20d", "big1000_pct")


def codes_numeric_first(df: DataFrame, key: str = KEY) -> DataFrame:
    """Numeric codes ascending, the others after them."""
    return df.orderBy(F.col(key).try_cast("double").asc_nulls_last(), key)
