"""Matches of a live feed against the batch form, over several batches and restarts."""

import datetime as dt
import random

import pytest

from equilens.operators import ledger as lg
from equilens.streaming import jobs, lots

TRADE = "id bigint, stock_id string, action string, trade_date date, shares double, price double, fee double, tax double"
DAY0 = dt.date(2026, 1, 1)


def log(n=300, seed=4):
    rng = random.Random(seed)
    days = sorted(rng.randrange(60) for _ in range(n))
    rows = [(i, rng.choice("AAAB") if i % 5 else "C", rng.choice(["buy", "buy", "sell"]), DAY0 + dt.timedelta(d),
             rng.choice([0.25, 1.0, 3.0, 3e-7, 40.0]), float(rng.randrange(5, 30)), rng.choice([None, 1.0]), rng.choice([None, 0.5])) for i, d in enumerate(days)]
    return sorted(rows, key=lambda t: (t[3], t[2] != "buy", t[0]))


def run(spark, base, part, name):
    df = spark.createDataFrame(part, TRADE)
    df.write.mode("append").parquet(f"{base}/src")
    stock = spark.createDataFrame([("A",), ("B",), ("C",)], "stock_id string")
    feed = jobs.arriving(spark, f"{base}/src", df.schema)
    lots.start_matches(feed, f"{base}/out", f"{base}/{name}", stock).awaitTermination()


def comparable(df):
    return {(r.stock_id, r.buy_id, r.sell_id): (r.shares, r.buy_date, r.sell_date, r.pnl, r.days, pytest.approx(r.pnl_exact, abs=1e-9)) for r in df.collect()}


def test_stream_over_restarts_equals_batch(spark, tmp_path):
    rows = log()
    rows += [(900, "ZZ", "buy", DAY0, 1.0, 1.0, None, None), (901, "A", "hold", DAY0, 1.0, 1.0, None, None)]  # invalid ones
    # Cut where a day ends: within a day the batch form takes all buys first.
    valid = rows[:-2]
    edges = [i for i in range(1, len(valid)) if valid[i][3] != valid[i - 1][3]]
    a, b = edges[len(edges) // 3], edges[2 * len(edges) // 3]
    for part in (valid[:a], valid[a:b] + rows[-2:], valid[b:]):  # every run is a new query on the same checkpoint
        run(spark, tmp_path, part, "ck")
    batch = lg.matches(spark.createDataFrame(valid, TRADE))
    got = lots.read_matches(spark, str(tmp_path / "out"))
    assert got.schema.names == batch.schema.names and comparable(got) == comparable(batch) and batch.count() > 50
    assert lots.read_late(spark, str(tmp_path / "out")).count() == 0
    # State holds the open lots and one row of ends per security.
    state = spark.read.format("statestore").option("stateVarName", "lots").load(str(tmp_path / "ck")).collect()
    held = {}
    for r in state:
        held[r.key.stock_id] = held.get(r.key.stock_id, 0.0) + float(r.user_map_value.open)
    want = {r.stock_id: r.net_shares for r in lg.positions(spark.createDataFrame(valid, TRADE)).collect() if r.net_shares}
    assert held == pytest.approx(want, abs=1e-3) and len(state) < sum(t[2] == "buy" for t in valid)


def test_late_and_repeated_trades_go_aside(spark, tmp_path, rows):
    first = [(1, "A", "buy", DAY0 + dt.timedelta(2), 5.0, 10.0, None, None), (2, "A", "sell", DAY0 + dt.timedelta(3), 2.0, 12.0, None, 1.0)]
    second = [(2, "A", "sell", DAY0 + dt.timedelta(3), 2.0, 12.0, None, 1.0), (0, "A", "buy", DAY0, 9.0, 1.0, None, None),
              (3, "A", "sell", DAY0 + dt.timedelta(4), 9.0, 12.0, None, None)]
    run(spark, tmp_path, first, "ck")
    run(spark, tmp_path, second, "ck")
    assert rows(lots.read_late(spark, str(tmp_path / "out")).select("id", "shares")) == [(0, 9.0), (2, 2.0)]
    assert rows(lots.read_matches(spark, str(tmp_path / "out")).select("buy_id", "sell_id", "shares", "pnl")) == [(1, 2, 2.0, 3), (1, 3, 3.0, 6)]


def test_lots_that_are_sold_in_their_batch_never_reach_the_store():
    from decimal import Decimal

    from pyspark.sql import Row

    class Value:
        def __init__(self):
            self.held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Map(dict):
        calls = 0

        def getValue(self, at):  # noqa: N802
            Map.calls += 1
            return self[at]

        def updateValue(self, at, value):  # noqa: N802
            Map.calls += 1
            self[at] = value

        def removeKey(self, at):  # noqa: N802
            Map.calls += 1
            del self[at]

    lot = lots.OpenLots()
    lot.ends, lot.lots = Value(), Map()
    trade = lambda i, action, q: Row(stock_id="A", id=i, action=action, trade_date=DAY0 + dt.timedelta(i), q=Decimal(q), price=1.0, fee=0.0, tax=0.0)
    batch = [t for i in range(0, 200, 2) for t in (trade(i, "buy", 2), trade(i + 1, "sell", 2))]
    assert len(list(lot.handleInputRows(("A",), iter([*batch, trade(200, "buy", 5)]), None))) == 100
    assert Map.calls == 1 and [v[5] for v in lot.lots.values()] == [5]
    list(lot.handleInputRows(("A",), iter([trade(201, "sell", 1), trade(202, "sell", 1)]), None))
    assert Map.calls == 3 and [v[5] for v in lot.lots.values()] == [3]
    assert [r.qty for r in lot.handleInputRows(("A",), iter([trade(203, "sell", 9)]), None)] == [3] and not lot.lots
