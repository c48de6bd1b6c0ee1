"""FIFO matching against a plain loop, and its behaviour on a dominating security."""

import datetime as dt
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from equilens.operators import ledger as lg

SCHEMA = "id bigint, stock_id string, action string, trade_date date, shares double, price double, fee double, tax double"
DAY0 = dt.date(2026, 1, 1)


def loop(trades):
    """Lot queue per security, one trade at a time."""
    matched, book = {}, {}
    by = defaultdict(list)
    for t in trades:
        by[t[1]].append(t)
    for sid, ts in by.items():
        lots, real = [], 0.0
        for t in sorted(ts, key=lambda t: (t[3], t[2] != "buy", t[0])):
            i, _, action, d, q, p, fee, tax = t
            fee, tax = fee or 0.0, tax or 0.0
            if q <= 0:
                continue
            if action == "buy":
                lots.append([q, p, d, fee / q, i])
                continue
            left = q
            while left > 1e-9 and lots:
                take = min(left, lots[0][0])
                gain = (p - lots[0][1]) * take - ((fee + tax) / q + lots[0][3]) * take
                matched[(lots[0][4], i)] = (take, gain, (d - lots[0][2]).days)
                real += gain
                lots[0][0] -= take
                left -= take
                if lots[0][0] <= 1e-9:
                    lots.pop(0)
        net = sum(x[0] for x in lots)
        book[sid] = (net, sum(x[0] * x[1] for x in lots) / net if net > 1e-9 else None, real)
    return matched, book


def check(spark, trades, id_block=2):
    df = spark.createDataFrame(trades, SCHEMA)
    want, book = loop(trades)
    m = lg.matches(df, id_block)
    got = {(r.buy_id, r.sell_id): (r.shares, r.pnl_exact, r.days) for r in m.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6)
    pos = {r.stock_id: r for r in lg.positions(df, id_block).collect()}
    for sid, (net, cost, real) in book.items():
        if sid not in pos:  # only empty trades
            assert net == real == 0
            continue
        assert pos[sid].net_shares == pytest.approx(net, abs=1e-6)
        assert (pos[sid].avg_cost is None) == (cost is None)
        if cost is not None:
            assert pos[sid].avg_cost == pytest.approx(cost, abs=1e-4)
        assert pos[sid].realized_pnl == pytest.approx(real, abs=0.51)
    days = df.filter("shares > 0").groupBy("stock_id", "trade_date").agg(
        F.sum(F.when(F.col("action") == "buy", F.col("shares")).otherwise(0.0)).alias("bought"),
        F.sum(F.when(F.col("action") == "sell", F.col("shares")).otherwise(0.0)).alias("sold"))
    for r in lg.open_shares(days).collect():
        assert r.net_shares == pytest.approx(book[r.stock_id][0], abs=1e-6)


trade = st.tuples(
    st.sampled_from(["A", "B"]), st.sampled_from(["buy", "sell"]), st.integers(0, 4), st.integers(0, 30),
    st.integers(1, 50), st.sampled_from([None, 1.0, 2.5]),
)


@settings(max_examples=8, deadline=None, phases=(Phase.explicit, Phase.generate), suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(trade, min_size=1, max_size=25))
def test_matches_equal_the_loop(spark, raw):
    check(spark, [(i, s, a, DAY0 + dt.timedelta(d), float(q), float(p), fee, fee) for i, (s, a, d, q, p, fee) in enumerate(raw)])


def test_oversell_is_dropped_and_never_covered(spark):
    d = [DAY0 + dt.timedelta(i) for i in range(4)]
    trades = [(1, "A", "sell", d[0], 5.0, 10.0, None, None), (2, "A", "buy", d[1], 10.0, 10.0, None, None),
              (3, "A", "sell", d[2], 15.0, 12.0, 1.0, 2.0), (4, "A", "buy", d[3], 4.0, 11.0, None, None)]
    check(spark, trades)
    df = spark.createDataFrame(trades, SCHEMA)
    assert [(r.buy_id, r.sell_id, r.shares) for r in lg.matches(df).collect()] == [(2, 3, 10.0)]


def test_same_day_buys_come_first(spark):
    check(spark, [(1, "A", "sell", DAY0, 5.0, 10.0, None, None), (2, "A", "buy", DAY0, 5.0, 9.0, 1.0, None)])


def hot_log(n=4000):
    """One security holds two thirds of the log."""
    out = []
    for i in range(n):
        sid = "HOT" if i % 3 else f"S{i % 50}"
        day = DAY0 + dt.timedelta((i * 7) % 90)
        out.append((i, sid, "sell" if i * 31 % 5 < 2 else "buy", day, float(1 + i * 13 % 40), float(10 + i * 17 % 90), 1.0, 2.0))
    return out


def test_dominating_security_is_exact_with_small_bins(spark, monkeypatch):
    monkeypatch.setattr(lg, "ROWS_PER_BIN", 16)
    check(spark, hot_log(), id_block=64)


def test_one_huge_lot_among_tiny_trades(spark, monkeypatch):
    monkeypatch.setattr(lg, "ROWS_PER_BIN", 16)
    trades = [(0, "A", "buy", DAY0, 1_000_000.0, 10.0, 5.0, None)]
    trades += [(i, "A", "sell" if i % 2 else "buy", DAY0 + dt.timedelta(1 + i % 3), 1.0 + i % 2 * 0.5, 11.0, None, None) for i in range(1, 400)]
    check(spark, trades, id_block=64)


def test_no_window_gathers_a_security(spark):
    """Trade rows are only windowed by day, side and id block, or by bin; windows by security alone see day rows."""
    df = spark.createDataFrame(hot_log(200), SCHEMA)
    plan = lg.matches(df, 64)._jdf.queryExecution().optimizedPlan().toString()
    keyed = [x for x in plan.splitlines() if "Window [" in x]
    assert keyed and "CartesianProduct" not in plan
    for line in keyed:
        spec = line.split("windowspecdefinition(", 1)[1].split("specifiedwindowframe")[0]
        by_security_alone = spec.count("#") == 2 and "trade_date" in spec
        if by_security_alone:
            assert "bought" in line or "balance" in line
        else:
            assert "_block" in spec or "_part" in spec


def test_small_fractions_and_large_sums_are_kept(spark):
    trades = [(1, "A", "buy", DAY0, 3e-7, 10.0, None, None), (2, "A", "buy", DAY0, 1e-9, 10.0, None, None),
              (3, "A", "buy", DAY0, 2.5, 8.0, None, None), (4, "A", "sell", DAY0, 1.0, 9.0, None, None), (5, "A", "sell", DAY0, 0.0, 9.0, None, None)]
    df = spark.createDataFrame(trades, SCHEMA)
    got = {r.id: r.cum_shares for r in lg.cumulative(df).collect()}
    assert got == pytest.approx({1: 3e-7, 2: 3.01e-7, 3: 2.500000301, 4: 1.0}, abs=1e-15)
    assert [(r.buy_id, r.sell_id) for r in lg.matches(df).orderBy("buy_id").collect()] == [(1, 4), (2, 4), (3, 4)]
    big = spark.createDataFrame([(i, "A", "buy", DAY0, 9e15, 1.0, None, None) for i in range(1000)], SCHEMA)
    assert lg.positions(big).first().buy_shares == 9e18


def test_securities_of_few_trades_take_one_exchange(spark):
    """What is not crowded is shuffled once by its security; sums and pairs are told in that order."""
    df = spark.createDataFrame(hot_log(400), SCHEMA)
    for frame in (lg.matches(df, 64), lg.positions(df, 64)):
        assert len(frame.collect()) > 0
        plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("ShuffleQueryStage") <= 2  # the count per security and the trades


def test_crowded_and_other_securities_meet(spark, monkeypatch):
    """One security goes through blocks and bins, the others in order."""
    monkeypatch.setattr(lg, "ROWS_PER_BIN", 16)
    monkeypatch.setattr(lg, "ROWS_IN_ORDER", 100)
    check(spark, hot_log(1500), id_block=64)
    df = spark.createDataFrame(hot_log(300), SCHEMA)
    monkeypatch.setattr(lg, "ROWS_IN_ORDER", 1)
    blocks = {tuple(r) for frame in (lg.matches(df, 64), lg.cumulative(df, 64), lg.positions(df, 64)) for r in frame.collect()}
    monkeypatch.setattr(lg, "ROWS_IN_ORDER", 1 << 16)
    whole = {tuple(r) for frame in (lg.matches(df, 64), lg.cumulative(df, 64), lg.positions(df, 64)) for r in frame.collect()}
    assert blocks == whole


def test_a_trade_without_id_or_date_counts_but_is_not_matched(spark, monkeypatch):
    trades = [(1, "A", "buy", DAY0, 10.0, 10.0, None, None), (None, "A", "buy", DAY0, 5.0, 9.0, None, None), (3, "A", "buy", None, 2.0, 9.0, None, None),
              (4, "A", "sell", DAY0 + dt.timedelta(1), 12.0, 12.0, 1.0, 2.0), (5, None, "buy", DAY0, 1.0, 1.0, None, None), (6, "A", "sell", DAY0, 4.0, 12.0, None, None)]
    df = spark.createDataFrame(trades, SCHEMA)
    seen = []
    for rows in (1, 1 << 16):
        monkeypatch.setattr(lg, "ROWS_IN_ORDER", rows)
        seen.append([sorted(map(str, f(df, 2).collect())) for f in (lg.matches, lg.positions, lg.cumulative)])
    assert seen[0] == seen[1]
