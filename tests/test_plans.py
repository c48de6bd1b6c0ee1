"""Ranks, adjustment, snapshot, screens, diagnosis and portfolio."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from equilens.operators import adjust as adj
from equilens.operators.rank import percent_rank_spread
from equilens.operators.relational import as_of_known, keep_first, keep_last, overlay, point_in_time
from equilens.plans import portfolio as pf
from equilens.plans import screen as sc
from equilens.plans import snapshot as sn
from equilens.plans.diagnose import diagnose

D = dt.date
DAY0 = D(2026, 1, 1)


# -- rank -------------------------------------------------------------------------

@pytest.mark.parametrize("width", [1.0 / 64, 10.0, 1e-6])
def test_spread_rank_equals_window_rank(spark, width):
    rng = np.random.default_rng(1)
    values = [None] * 300 + [4.0] * 400 + [float(x) for x in rng.normal(4, 2, 300)] + [float(x) for x in rng.integers(-3, 3, 100)]
    rows = [(i, "stock" if i % 10 else "etf", v) for i, v in enumerate(values)] + [(-1, "alone", 1.0), (-2, None, 2.0), (-3, None, None)]
    df = spark.createDataFrame(rows, "i int, t string, x double")
    df.createOrReplaceTempView("r")
    want = {r.i: r.p for r in spark.sql("select i, percent_rank() over (partition by t order by x nulls first) p from r").collect()}
    got = {r.i: r.pct_rank for r in percent_rank_spread(df, "t", "x", bucket_width=width).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_spread_rank_orders_no_whole_group(spark):
    df = spark.range(10).select(F.lit("a").alias("t"), F.col("id").cast("double").alias("x"))
    plan = percent_rank_spread(df, "t", "x")._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "_bucket" in line


# -- relational -------------------------------------------------------------------

def test_overlay_and_dedupe(spark, rows):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, None, 1)], "k int, v string, s int")
    assert {tuple(r) for r in overlay(old, new, ("k",), "s").collect()} == {(1, "a"), (2, "y"), (3, None)}
    assert {tuple(r) for r in keep_first(new, ("k",), "s").collect()} == {(2, "x", 1), (3, None, 1)}
    assert {tuple(r) for r in keep_last(new, ("k",), "s").collect()} == {(2, "y", 2), (3, None, 1)}


def test_statement_is_seen_only_when_known(spark):
    bars = spark.createDataFrame([("A", D(2026, 5, 14)), ("A", D(2026, 5, 15)), ("A", D(2026, 9, 1))], "stock_id string, trade_date date")
    facts = spark.createDataFrame([("A", D(2026, 3, 31), D(2026, 5, 15), 1.0), ("A", D(2026, 6, 30), D(2026, 8, 14), 2.0)],
                                  "stock_id string, period_date date, available_date date, roe double")
    got = as_of_known(bars, facts, "available_date", ["period_date", "roe"]).orderBy("trade_date").collect()
    assert [r.roe for r in got] == [None, 1.0, 2.0]
    assert point_in_time(facts, "available_date", "2026-05-15").count() == 1


# -- adjusted prices ------------------------------------------------------------------

def price_rows(spark, dates, closes, sid="A"):
    return spark.createDataFrame([(sid, d, c, c, c, c, 10, 10) for d, c in zip(dates, closes)],
                                 "stock_id string, trade_date date, open double, high double, low double, close double, volume int, amount int")


def adjusted_loop(dates, closes, divs, cuts):
    ratio = [1.0] * len(dates)
    for ex, (cash, stock) in divs.items():
        before = [c for d, c in zip(dates, closes) if d < ex]
        after = [i for i, d in enumerate(dates) if d >= ex]
        if before and before[-1] > 0 and after:
            r = (before[-1] - cash) / (before[-1] * (1 + stock / 10))
            if r > 0:
                ratio[after[0]] *= r
    for ex, r in cuts.items():
        after = [i for i, d in enumerate(dates) if d >= ex]
        if after and r > 0:
            ratio[after[0]] *= r
    return [float(np.prod(ratio[i + 1 :])) for i in range(len(dates))]


def test_adjust_places_every_kind_of_event(spark):
    dates = [D(2026, 1, d) for d in (5, 6, 7, 9, 12, 13)]
    closes = [100.0, 102.0, 101.0, 98.0, 97.0, 99.0]
    divs = {D(2026, 1, 5): (3.0, 0.0), D(2026, 1, 7): (2.0, 1.0), D(2026, 1, 8): (1.5, 0.0), D(2026, 1, 10): (0.0, 0.5),
            D(2026, 1, 20): (9.0, 0.0), D(2026, 1, 13): (500.0, 0.0)}
    cuts = {D(2026, 1, 12): 1.25, D(2025, 12, 1): 2.0, D(2026, 2, 1): 3.0}
    d = spark.createDataFrame([("A", k, *v) for k, v in divs.items()], "stock_id string, ex_date date, cash double, stock double")
    c = spark.createDataFrame([("A", k, v) for k, v in cuts.items()], "stock_id string, ex_date date, reduction double")
    got = adj.adjust_prices(price_rows(spark, dates, closes), d, c).orderBy("trade_date").collect()
    want = adjusted_loop(dates, closes, divs, cuts)
    assert [r.adj_factor for r in got] == pytest.approx(want)
    assert [r.adj_close for r in got] == pytest.approx([round(x * f, 4) for x, f in zip(closes, want)])
    assert got[-1].adj_factor == 1.0
    assert [r.adj_factor for r in adj.adjust_prices(price_rows(spark, dates, closes), None, None).collect()] == [1.0] * 6


def test_missing_dividend_component(spark, rows):
    df = spark.createDataFrame([("A", 1.0, None, None, D(2026, 1, 5), None), ("A", 1.0, 2.0, None, D(2026, 1, 6), None),
                                ("A", 0.0, 0.0, None, D(2026, 1, 7), None), ("A", 1.0, 1.0, None, None, None)],
                               "stock_id string, a double, b double, s double, ex_cash_date date, ex_stock_date date")
    def dates(how):
        return [r.ex_date.day for r in adj.dividend_events(df, cash=("a", "b"), stock=("s",), missing_component=how).orderBy("ex_date").collect()]
    assert dates("drop") == [6]
    assert dates("zero") == [5, 6]


def test_reductions_multiply_and_need_positive_prices(spark):
    df = spark.createDataFrame([("A", D(2026, 1, 5), 10.0, 20.0), ("A", D(2026, 1, 5), 10.0, 15.0), ("A", D(2026, 1, 6), 0.0, 5.0)],
                               "stock_id string, resume_date date, pre_close double, post_ref_price double")
    assert [(r.ex_date.day, r.reduction) for r in adj.reduction_events(df).collect()] == [(5, 3.0)]


# -- snapshot -----------------------------------------------------------------------------

def make_market(spark, n_days=300, seed=2):
    rng = np.random.default_rng(seed)
    rows, frames = [], {}
    for sid, days in (("A", n_days), ("B", 120), ("C", 300), ("E", 290)):
        c = 100 * np.exp(np.cumsum(rng.normal(0.001, 0.02, days)))
        v = rng.integers(1000, 9000, days)
        dates = [D(2026, 12, 31) - dt.timedelta(days - 1 - i) for i in range(days)]
        for i in range(days):
            rows.append((sid, dates[i], float(c[i]), float(c[i] * 1.01), float(c[i] * 0.98), float(c[i]), int(v[i]), int(v[i] * 1000)))
        frames[sid] = pd.DataFrame({"c": c, "v": v.astype(float), "h": c * 1.01, "l": c * 0.98})
    bars = spark.createDataFrame(rows, "stock_id string, trade_date date, open double, high double, low double, close double, volume bigint, amount bigint")
    bars = bars.select("*", *[F.col(x).alias(f"adj_{x}") for x in ("open", "high", "low", "close")])
    stock = spark.createDataFrame([(s, s, "上市", "i", "etf" if s == "E" else "stock") for s in ("A", "B", "C", "E", "NOBARS")],
                                  "stock_id string, name string, market string, industry string, security_type string")
    return stock, bars, frames


def test_snapshot_prices_only(spark):
    stock, bars, frames = make_market(spark)
    got = {r.stock_id: r for r in sn.snapshot({"stock": stock, "price_daily": bars}).collect()}
    assert set(got) == {"A", "B", "C", "E"}
    for sid, f in frames.items():
        c = f.c.to_numpy()[::-1]
        r = got[sid]
        assert r.ret_1m == pytest.approx(c[0] / c[20] - 1)
        assert r.ma200 == pytest.approx(round(c[:200].mean(), 4), abs=1e-4)
        assert r.high_52w == pytest.approx(round(c[:252].max(), 4), abs=1e-4)
        assert r.near_pivot == pytest.approx(c[0] / c[:60].max(), abs=1e-4)
        assert r.trading_days == len(c) and r.in_universe == (f.v[-20:].mean() * 1000 >= 5_000_000 and len(c) >= 60)
        assert r.roe is None and r.rs_6m is None
    assert got["B"].rs_raw is None and got["B"].rs_rating == 0 and got["B"].trend_template in (None, False)
    assert got["E"].rs_rating == 0  # alone in its pool
    best = max("AC", key=lambda s: got[s].rs_raw)
    assert got[best].rs_rating == 100


def test_snapshot_as_of_hides_later_facts(spark):
    stock, bars, _ = make_market(spark)
    q = spark.createDataFrame([("A", D(2026, 3, 31), D(2026, 5, 15), 1.0), ("A", D(2026, 6, 30), D(2026, 8, 14), 2.0)],
                              "stock_id string, period_date date, available_date date, roe double"
                              ).select("*", *[F.lit(None).cast("double").alias(c) for c in ("eps", "gross_margin", "net_margin", "debt_ratio")])
    tables = {"stock": stock, "price_daily": bars, "fundamentals_quarterly": q}
    newest = {r.stock_id: r for r in sn.snapshot(tables).collect()}
    early = {r.stock_id: r for r in sn.snapshot(tables, as_of="2026-08-13").collect()}
    assert newest["A"].roe == 2.0 and early["A"].roe == 1.0
    assert early["A"].as_of_date == D(2026, 8, 13)


def test_build_predicate_and_screen(spark):
    snap = spark.createDataFrame(
        [("A", 10.0, 0.5, True, "x"), ("B", -5.0, None, True, "x"), ("C", 30.0, 0.1, False, "y"), ("D", 5.0, 0.5, None, "x")],
        "stock_id string, per double, ret_3m double, in_universe boolean, industry string")
    ids = lambda f: sorted(r.stock_id for r in snap.filter(sc.build_predicate(f)).collect())
    assert ids(None) == ["A", "B", "C", "D"]
    assert ids({"per_max": 15}) == ["A", "D"]
    assert ids({"per_max": "15", "industry": "x", "in_universe": True, "nonsense": 1, "per_min": None, "ret_3m_min": "abc"}) == ["A"]
    assert [r.stock_id for r in sc.screen(snap, {}, "not a column", True, 1).collect()] == ["A"]
    assert sc.screen(snap, {}, limit=None).count() == 4
    with pytest.raises(ValueError):
        sc.screen(snap, {}, limit=0)
    assert [r.stock_id for r in sc.screen(snap, {}, "ret_3m", True, 99).collect()] == ["A", "D", "C", "B"]
    assert [r.stock_id for r in sc.screen(snap, {}, "ret_3m", False, 99).collect()] == ["C", "A", "D", "B"]


def test_catalog_sizes():
    assert len(sc.AT_LEAST) + len(sc.AT_MOST) + len(sc.FLAGS) + len(sc.EXACT) == 37
    assert len(sc.SORTABLE) == 26 and len(sc.STRATEGIES) == 8
    for preset in sc.STRATEGIES.values():
        assert preset["sort"] in sc.SORTABLE


def test_search(spark):
    stock = spark.createDataFrame([("2330", "台積電"), ("0050", "元大23"), ("1%2", "a_b")], "stock_id string, name string"
                                  ).select("*", F.lit("m").alias("market"), F.lit("i").alias("industry"))
    ids = lambda *a, **k: [r.stock_id for r in sc.search(stock, *a, **k).collect()]
    assert ids("23") == ["2330", "0050"]
    assert ids("") == [] and len(ids("%")) == 3 and ids("%", escape=True) == []
    assert [r.stock_id for r in sc.codes_numeric_first(stock).collect()] == ["0050", "2330", "1%2"]


# -- diagnosis ------------------------------------------------------------------------------

NEUTRAL = dict(trend_template=False, vcp=False, mf_accumulate=False, mf_distribute=False, above_ma60=True, ma_bull=False, rs_rating=50,
               inst_net_20d=0, big1000_chg=0.0, vpa_accum_20d=0, vpa_distrib_20d=0, roe=None, rev_yoy=None, per=None, dividend_yield=None,
               dist_52w_high=None)
DIAG_SCHEMA = ("stock_id string, trend_template boolean, vcp boolean, mf_accumulate boolean, mf_distribute boolean, above_ma60 boolean,"
               " ma_bull boolean, rs_rating int, inst_net_20d bigint, big1000_chg double, vpa_accum_20d bigint, vpa_distrib_20d bigint,"
               " roe double, rev_yoy double, per double, dividend_yield double, dist_52w_high double")


def test_diagnosis_thresholds(spark):
    cases = {
        "neutral": {}, "rs0": {"rs_rating": 0}, "rsnull": {"rs_rating": None}, "allnull": dict.fromkeys(NEUTRAL),
        "strong": dict(trend_template=True, vcp=True, mf_accumulate=True, ma_bull=True, rs_rating=99, inst_net_20d=5, big1000_chg=1.0,
                       vpa_accum_20d=9, roe=15.0, rev_yoy=20.0, per=20.0, dividend_yield=4.0, dist_52w_high=-0.03),
        "weak": dict(above_ma60=False, mf_distribute=True, rs_rating=1, inst_net_20d=-5, big1000_chg=-1.0, vpa_distrib_20d=9, roe=-1.0,
                     rev_yoy=-1.0, per=41.0),
        "leaving": dict(above_ma60=False, inst_net_20d=-1), "per0": {"per": 0.0}, "roe8": {"roe": 8.0}, "yoy0": {"rev_yoy": 0.0},
    }
    df = spark.createDataFrame([(k, *({**NEUTRAL, **v}).values()) for k, v in cases.items()], DIAG_SCHEMA)
    got = {r.stock_id: r for r in diagnose(df).collect()}
    assert got["neutral"].score == 26 + 17 + 12 and got["neutral"].level == "watch"
    assert tuple(got["neutral"].facets) == (26, 17, 12)
    assert got["rs0"].score == got["rsnull"].score == got["neutral"].score
    assert got["allnull"].score == 14 + 17 + 12 and got["allnull"].level == "watch"
    assert tuple(got["strong"].facets) == (40, 35, 25) and got["strong"].level == "strong" and got["strong"].score == 100
    assert [r.text for r in got["strong"].reasons] == ["趨勢範本", "VCP收縮", "主力承接", "站上季線", "RS強勢(99)", "法人買超"]
    assert got["weak"].level == "reduce" and tuple(got["weak"].facets) == (4, 0, 3)
    assert [r.text for r in got["weak"].reasons] == ["主力出貨", "跌破季線", "RS弱勢(1)", "法人賣超", "大戶減持", "營收衰退"]
    assert got["leaving"].level == "reduce"
    assert [got[k].facets.fund for k in ("per0", "roe8", "yoy0")] == [12, 15, 12]


# -- portfolio --------------------------------------------------------------------------------

def test_portfolio_with_an_unpriced_holding(spark):
    stock, bars, _ = make_market(spark)
    snap = sn.snapshot({"stock": stock, "price_daily": bars})
    trades = spark.createDataFrame(
        [(1, "A", "buy", DAY0, 100.0, 50.0, 10.0, None), (2, "A", "sell", D(2026, 2, 1), 40.0, 60.0, 4.0, 4.0),
         (3, "ZZ", "buy", DAY0, 10.0, 5.0, None, None), (4, "C", "buy", DAY0, 5.0, 10.0, None, None),
         (5, "C", "sell", DAY0, 5.0, 8.0, None, None)],
        "id bigint, stock_id string, action string, trade_date date, shares double, price double, fee double, tax double")
    items, total = pf.portfolio(trades, snap, bars)
    by = {r.stock_id: r for r in items.collect()}
    assert set(by) == {"A", "ZZ"}
    assert by["ZZ"].close is None and by["ZZ"].level == "watch" and by["ZZ"].name == "ZZ" and by["ZZ"].market_value is None
    close = bars.filter("stock_id = 'A'").agg(F.max_by("close", "trade_date")).first()[0]
    assert by["A"].market_value == pytest.approx(60 * close) and by["A"].cost == 50.0
    t = total.collect()[0]
    assert t.n == 2 and t.closed_n == 2 and t.win_rate == 50.0
    assert t.total_cost == pytest.approx(60 * 50 + 50) and t.unrealized == pytest.approx(t.total_value - t.total_cost)
    assert t.realized_total == 388 - 10 and t.top_industry == "i" and t.top_industry_share == 100.0


def test_rank_with_many_unknown_and_far_values(spark):
    rng = np.random.default_rng(2)
    far = np.concatenate([rng.normal(0, 1, 40), rng.normal(0, 1e6, 30), [256.0, -256.0, 256.0001, -1e300, 1e300, 5e-324]])
    rows = [("s" if i % 2 else "e", float(x)) for i, x in enumerate(np.concatenate([far, far[:9]]))] + [("s", None)] * 700 + [(None, 3.0), (None, None)]
    df = spark.createDataFrame(rows, "security_type string, x double")
    got = percent_rank_spread(df, "security_type", "x", "p")
    from pyspark.sql import Window

    want = df.withColumn("p", F.percent_rank().over(Window.partitionBy("security_type").orderBy(F.col("x").asc_nulls_first())))
    key = lambda d: sorted((str(r.security_type), str(r.x), round(r.p, 12)) for r in d.collect())
    assert key(got) == key(want)


def test_summary_written_with_the_positions_equals_that_of_all_round_trips(spark):
    from equilens.operators.ledger import matches

    stock, bars, _ = make_market(spark)
    snap = sn.snapshot({"stock": stock, "price_daily": bars})
    rng = np.random.default_rng(4)
    rows = [(i, str(rng.choice(["A", "C", "ZZ", "Y"])), str(rng.choice(["buy", "buy", "sell"])), D(2026, 1, 1 + int(rng.integers(28))),
             float(rng.integers(1, 30)), float(rng.integers(5, 90)), 1.0, None) for i in range(200)] + [(999, None, "buy", DAY0, 1.0, 1.0, None, None)]
    trades = spark.createDataFrame(rows, "id bigint, stock_id string, action string, trade_date date, shares double, price double, fee double, tax double")
    items, total = pf.portfolio(trades, snap, bars)
    assert total.collect() == pf.summary(items, matches(trades)).collect()
    assert total.first().closed_n > 40
    alone, none = pf.portfolio(trades, snap, bars, summarized=False)
    assert none is None and sorted(map(str, alone.collect())) == sorted(map(str, items.collect()))
    nothing = pf.portfolio(trades.limit(0), snap, bars)[1].first()
    assert (nothing.n, nothing.closed_n, nothing.realized_total, nothing.win_rate) == (0, 0, 0, None)
