"""Candles, volume-price signals, levels, technical flags and indicators on small hand-made series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from equilens.operators import candles as cd
from equilens.operators import levels as lv
from equilens.operators import technical as tc
from equilens.operators import vpa
from equilens.operators.indicators import macd_kdj

DAY0 = dt.date(2026, 1, 1)
SCHEMA = ("stock_id string, trade_date date, open double, high double, low double, close double, volume bigint, amount bigint,"
          " adj_open double, adj_high double, adj_low double, adj_close double")


def bars(spark, series):
    rows = []
    for sid, candles in series.items():
        for i, c in enumerate(candles):
            o, h, lo, cl, v = (*c, 1000)[:5]
            rows.append((sid, DAY0 + dt.timedelta(i), float(o), float(h), float(lo), float(cl), int(v), int(v) * 100,
                         float(o), float(h), float(lo), float(cl)))
    return spark.createDataFrame(rows, SCHEMA)


DOWN = [(x, x + 1, x - 1, x - 0.5) for x in (110, 108, 106, 104, 102, 100)]
UP = [(x, x + 1, x - 1, x + 0.5) for x in (90, 92, 94, 96, 98, 100)]
FLAT = [(100, 101, 99, 100)] * 6
POSITIVE = {
    "doji": FLAT + [(100, 105, 95, 100.5)],
    "hammer": DOWN + [(98, 99.3, 92, 99)],
    "hanging_man": UP + [(101, 102.3, 95, 102)],
    "inverted_hammer": DOWN + [(98, 105, 97.8, 99)],
    "shooting_star": UP + [(101, 108, 100.8, 102)],
    "bull_engulfing": FLAT + [(100, 101, 97, 98), (97.5, 102, 97, 101)],
    "bear_engulfing": FLAT + [(98, 101, 97, 100), (100.5, 101, 96, 97)],
    "piercing": DOWN + [(99, 99.5, 94, 95), (93, 98.5, 92.5, 98)],
    "dark_cloud": UP + [(101, 106, 100.5, 105), (107, 107.5, 101, 102)],
    "bull_harami": FLAT + [(105, 105.5, 94.5, 95), (97, 101, 96, 99)],
    "bear_harami": FLAT + [(95, 105.5, 94.5, 105), (103, 104, 99, 101)],
    "morning_star": DOWN + [(99, 99.5, 92.5, 93), (91.5, 92.5, 90.5, 91.8), (93, 98.5, 92.5, 98)],
    "evening_star": UP + [(101, 107.5, 100.5, 107), (108.2, 109.5, 107.8, 108.5), (107, 107.5, 101, 102)],
    "three_soldiers": FLAT + [(100, 103, 99.5, 102), (101, 105, 100.5, 104), (103, 107, 102.5, 106)],
    "three_crows": FLAT + [(106, 106.5, 103, 104), (105, 105.5, 101, 102), (103, 103.5, 99, 100)],
}
NEAR_MISS = {
    "doji": FLAT + [(100, 105, 95, 101.5)],
    "hammer": FLAT + [(98, 99.3, 92, 99)],
    "hanging_man": DOWN + [(98, 99.3, 92, 99)],
    "inverted_hammer": FLAT + [(98, 105, 97.8, 99)],
    "shooting_star": DOWN + [(98, 105, 97.8, 99)],
    "bull_engulfing": FLAT + [(100, 101, 97, 98), (98.5, 102, 97, 101)],
    "bear_engulfing": FLAT + [(98, 101, 97, 100), (99.5, 101, 96, 97)],
    "piercing": DOWN + [(99, 99.5, 94, 95), (93, 99.6, 92.5, 99.5)],
    "dark_cloud": UP + [(101, 106, 100.5, 105), (106, 106.5, 101, 102)],
    "bull_harami": FLAT + [(105, 105.5, 85, 95), (97, 101, 96, 99)],
    "bear_harami": FLAT + [(95, 105.5, 94.5, 105), (103, 106, 99, 94)],
    "morning_star": DOWN + [(99, 99.5, 92.5, 93), (91.5, 92.5, 90.5, 93.2), (93, 98.5, 92.5, 98)],
    "evening_star": UP + [(101, 107.5, 100.5, 107), (106.9, 109.5, 106.5, 108.5), (107, 107.5, 101, 102)],
    "three_soldiers": FLAT + [(100, 103, 99.5, 102), (102.5, 105, 100.5, 104), (103, 107, 102.5, 106)],
    "three_crows": FLAT + [(106, 106.5, 103, 104), (105, 105.5, 101, 102), (105, 105.5, 99, 100)],
}


def last_flags(df, names):
    out = {}
    for r in df.orderBy("stock_id", "trade_date").collect():
        out[r.stock_id] = {k for k in names if r[k]}
    return out


def test_every_pattern_fires_and_its_near_miss_does_not(spark):
    names = tuple(cd.CATALOG)
    hit = last_flags(cd.pattern_flags(bars(spark, POSITIVE)), names)
    miss = last_flags(cd.pattern_flags(bars(spark, NEAR_MISS)), names)
    for k in names:
        assert k in hit[k], k
        assert k not in miss[k], k


def test_zero_range_and_short_history(spark):
    got = last_flags(cd.pattern_flags(bars(spark, {"Z": FLAT + [(100, 100, 100, 100)], "ONE": [(100, 105, 95, 100)]})), cd.CATALOG)
    assert got["Z"] == set() and got["ONE"] == {"doji"}


def test_pattern_events_and_last_patterns(spark, rows):
    df = bars(spark, {"A": POSITIVE["bull_engulfing"] * 3})
    events = cd.pattern_events(df, 10)
    assert events.select("trade_date").distinct().count() <= 10
    last = cd.last_patterns(df).collect()
    assert [p["name"] for p in last[0]["last_patterns"]] == ["多頭吞噬"]
    assert cd.pattern_events(df, 10, truncate_context=True).count() <= events.count()
    assert cd.catalog(spark).count() == 15


QUIET = [(100, 102, 98, 100, 1000)] * 25
VPA = {
    "stopping_vol": QUIET + [(100, 100, 90, 95, 2500)],
    "accumulation": QUIET + [(99, 100, 97, 99, 1600)],
    "no_supply": QUIET + [(99.5, 100.5, 98.5, 99.5, 500)],
    "no_demand": QUIET + [(100, 101.5, 99.5, 101, 500)],
    "churning": QUIET + [(100, 101, 99, 100, 2000)],
    "buying_climax": [(90 + i, 92 + i, 88 + i, 90 + i, 1000) for i in range(25)] + [(115, 125, 113, 118, 2500)],
}


def test_vpa_signals(spark):
    got = last_flags(vpa.vpa_flags(bars(spark, VPA)), vpa.CATALOG)
    for k in vpa.CATALOG:
        assert got[k] == {k}, (k, got[k])


def test_vpa_edges(spark):
    df = bars(spark, {
        "SHORT": QUIET[:5] + [(100, 100, 90, 95, 2500)], "ENOUGH": QUIET[:6] + [(100, 100, 90, 95, 2500)],
        "FLATBAR": QUIET + [(95, 95, 95, 95, 2500)], "NOVOL": [(100, 102, 98, 100, 0)] * 8 + [(100, 100, 90, 95, 2500)],
        "BOTH": QUIET + [(100, 100, 90, 97, 2500)], "NOTREND": QUIET + [(100, 110, 99, 104, 2500)],
    })
    got = last_flags(vpa.vpa_flags(df), vpa.CATALOG)
    assert got == {"SHORT": set(), "ENOUGH": {"stopping_vol"}, "FLATBAR": set(), "NOVOL": set(), "BOTH": {"stopping_vol"}, "NOTREND": set()}
    assert vpa.vpa_events(df, 30).filter("stock_id = 'BOTH'").count() == 1


def levels_loop(highs, lows, close):
    k = lv.PIVOT_BARS

    def cluster(vals):
        out = []
        for v in sorted(vals):
            m = sum(out[-1]) / len(out[-1]) if out else None
            if out and abs(v - m) <= 0.02 * m:
                out[-1].append(v)
            else:
                out.append([v])
        return [(round(sum(g) / len(g), 2), len(g)) for g in out]

    mid = range(k, len(highs) - k)
    ph = cluster([highs[i] for i in mid if highs[i] == max(highs[i - k : i + k + 1])])
    pl = cluster([lows[i] for i in mid if lows[i] == min(lows[i - k : i + k + 1])])
    out = {}
    res = sorted((-n, p - close, p) for p, n in ph if p > close * 1.005)
    sup = sorted((-n, close - p, p) for p, n in pl if p < close * 0.995)
    if res:
        out["resistance"] = (res[0][2], -res[0][0])
    if sup:
        neck = sup[0]
        out["neckline"] = (neck[2], -neck[0])
        near = min(sup, key=lambda x: x[1])
        if abs(near[2] - neck[2]) > 0.02 * neck[2]:
            out["support"] = (near[2], -near[0])
    return out


def test_levels_equal_the_loop(spark):
    rng = np.random.default_rng(5)
    series = {}
    for s in range(6):
        c = 100 + np.cumsum(rng.normal(0, 2, 90))
        series[f"S{s}"] = [(round(x, 2), round(x + rng.uniform(0.5, 3), 2), round(x - rng.uniform(0.5, 3), 2), round(x, 2)) for x in c]
    series["FEW"] = series["S0"][:19]
    got = {}
    for r in lv.levels(bars(spark, series), 60).collect():
        got.setdefault(r.stock_id, {})[r.type] = (r.price, r.touches)
    for s in range(6):
        tail = series[f"S{s}"][-60:]
        want = levels_loop([b[1] for b in tail], [b[2] for b in tail], tail[-1][3])
        assert got.get(f"S{s}", {}) == {k: (pytest.approx(p, abs=0.011), n) for k, (p, n) in want.items()}
    assert "FEW" not in got


def test_technical_flags_equal_pandas(spark):
    rng = np.random.default_rng(3)
    c = 100 + np.cumsum(rng.normal(0, 1, 200))
    v = rng.integers(500, 3000, 200)
    df = bars(spark, {"A": [(x, x + 1, x - 1, x, int(y)) for x, y in zip(c, v)]})
    got = tc.technical_flags(df).orderBy("trade_date").toPandas()
    close, vol = pd.Series(c), pd.Series(v.astype(float))
    s, m, lng, vma = close.rolling(20).mean(), close.rolling(60).mean(), close.rolling(120).mean(), vol.rolling(20).mean()
    mas = pd.concat([s, m, lng], axis=1)
    want = {
        "bull_ma": (s > m) & (m > lng) & (close > s),
        "golden_cross": (s > m) & (s.shift(1) <= m.shift(1)),
        "death_cross": (s < m) & (s.shift(1) >= m.shift(1)),
        "ma_squeeze": ((mas.max(axis=1) - mas.min(axis=1)) / close) < 0.03,
        "breakout": (close > close.shift(1).rolling(60).max()) & (vol > 1.5 * vma),
        "vol_price_up": (close > close.shift(1)) & (vol > vma),
        "bear_divergence": (close >= close.rolling(20).max()) & (vol < vma),
    }
    for k, w in want.items():
        assert (got[k].to_numpy() == w.to_numpy()).all(), k


def test_labels_with_candle_arrows(spark):
    flags = cd.signed_candles(cd.pattern_flags(bars(spark, {"A": POSITIVE["bear_engulfing"]})))
    for k in tc.FLAGS:
        flags = flags.withColumn(k, F.lit(k == "golden_cross"))
    assert tc.label_scan(flags).collect()[0]["labels"] == "黃金叉、吞噬↓"


def test_macd_kdj_equal_a_loop(spark):
    rng = np.random.default_rng(9)
    c = 100 + np.cumsum(rng.normal(0, 1, 80))
    series = [(x, x + 1.5, x - 1, x) for x in c]
    got = macd_kdj(bars(spark, {"A": series, "SHORT": series[:5]})).filter("stock_id = 'A'").orderBy("trade_date").toPandas()

    def ema(x, n):
        out, prev = [None] * len(x), None
        seen = []
        for i, val in enumerate(x):
            if val is None:
                continue
            seen.append(val)
            if len(seen) == n:
                prev = sum(seen) / n
            elif len(seen) > n:
                prev = (2 * val + (n - 1) * prev) / (n + 1)
            out[i] = prev if len(seen) >= n else None
        return out

    fast, slow = ema(list(c), 12), ema(list(c), 26)
    dif = [a - b if b is not None else None for a, b in zip(fast, slow)]
    dea = ema(dif, 9)
    k = d = 50.0
    for i in range(80):
        row = got.iloc[i]
        assert (dif[i] is None and np.isnan(row.dif)) or row.dif == pytest.approx(dif[i])
        assert (dea[i] is None and np.isnan(row.dea)) or row.dea == pytest.approx(dea[i])
        if i >= 8:
            hi = max(b[1] for b in series[i - 8 : i + 1])
            low = min(b[2] for b in series[i - 8 : i + 1])
            k = (2 * k + (c[i] - low) / (hi - low) * 100) / 3
            d = (2 * d + k) / 3
            assert (row.k, row.d, row.j) == pytest.approx((k, d, 3 * k - 2 * d))
