"""Candle flags by each security's own recent bars, every one with a near miss."""

import datetime as dt

import pytest

from equilens.operators import candles as cd

# Twelve bars of body 2 and range 4: a body below 2 is short, a shadow below 0.4 very short, 0.8 is near.
QUIET = [(100.0, 103.0, 99.0, 102.0), (102.0, 103.0, 99.0, 100.0)] * 6
LONG_DOWN, LONG_UP = (102.0, 103.0, 95.0, 96.0), (100.0, 107.0, 99.0, 106.0)
CASES = {  # open, high, low, close of the bars after the quiet ones, and the flag of the last
    "hammer": ("hammer", [(99.2, 99.9, 97.0, 99.7)], 100),
    "hammer, upper shadow of 0.5": ("hammer", [(99.2, 100.2, 97.0, 99.7)], 0),
    "hammer, too far above the last low": ("hammer", [(99.9, 100.2, 97.0, 100.1)], 0),
    "hammer, body of 2": ("hammer", [(97.7, 99.8, 94.0, 99.7)], 0),
    "bull engulfing": ("engulf", [(99.9, 103.0, 99.0, 102.1)], 100),
    "bull engulfing, one end equal": ("engulf", [(100.0, 103.0, 99.0, 102.1)], 100),
    "bull engulfing, both ends equal": ("engulf", [(100.0, 103.0, 99.0, 102.0)], 0),
    "bear engulfing": ("engulf", [(99.9, 103.0, 99.0, 102.1), (102.2, 103.0, 99.0, 99.8)], -100),
    "bear engulfing, end inside": ("engulf", [(99.9, 103.0, 99.0, 102.1), (102.2, 103.0, 99.0, 100.0)], 0),
    "morning star": ("morning", [LONG_DOWN, (95.0, 95.9, 94.0, 95.5), (95.6, 99.0, 95.0, 98.0)], 100),
    "morning star, no gap": ("morning", [LONG_DOWN, (95.0, 96.9, 94.0, 96.0), (95.6, 99.0, 95.0, 98.2)], 0),
    "morning star, too little taken back": ("morning", [LONG_DOWN, (95.0, 95.9, 94.0, 95.5), (94.0, 99.0, 94.0, 97.7)], 0),
    "shooting star, no gap": ("shooting", [(101.9, 105.0, 101.8, 102.4)], 0),
    "shooting star above the last body": ("shooting", [(99.9, 103.0, 99.0, 102.1), (102.5, 105.0, 102.4, 103.0)], -100),
    "shooting star, lower shadow of 0.5": ("shooting", [(99.9, 103.0, 99.0, 102.1), (102.7, 105.0, 102.2, 103.0)], 0),
    "evening star": ("evening", [LONG_UP, (106.5, 108.0, 106.2, 107.0), (106.6, 107.0, 103.0, 104.0)], -100),
    "evening star, short third body": ("evening", [LONG_UP, (106.5, 108.0, 106.2, 107.0), (106.2, 107.0, 103.0, 104.1)], 0),
}


@pytest.fixture(scope="module")
def flags(spark):
    rows = [(name, dt.date(2026, 1, 1) + dt.timedelta(i), *bar) for name, (_, tail, _) in CASES.items() for i, bar in enumerate([*QUIET, *tail])]
    rows += [("short history", dt.date(2026, 1, 1) + dt.timedelta(i), *bar) for i, bar in enumerate([*QUIET[:9], (99.2, 99.9, 97.0, 99.7)])]
    df = spark.createDataFrame(rows, "stock_id string, trade_date date, open double, high double, low double, close double")
    out = {}
    for r in cd.adaptive_candles(df).orderBy("trade_date").collect():
        out[r.stock_id] = r
    return out


@pytest.mark.parametrize("name", CASES)
def test_the_last_bar(flags, name):
    flag, _, want = CASES[name]
    assert flags[name][f"adaptive_{flag}"] == want


def test_no_flag_before_the_yardsticks_are_full(flags):
    assert flags["short history"].adaptive_hammer == 0


def test_other_settings(spark):
    df = spark.createDataFrame([("A", dt.date(2026, 1, 1) + dt.timedelta(i), *bar) for i, bar in enumerate([*QUIET, (99.2, 100.2, 97.0, 99.7)])],
                               "stock_id string, trade_date date, open double, high double, low double, close double")
    wide = cd.CandleSettings(shadow_very_short=cd.Yardstick("range", 10, 0.15))
    assert [r.adaptive_hammer for r in cd.adaptive_candles(df, wide).orderBy("trade_date").collect()][-1] == 100
