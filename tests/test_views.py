"""Views read from one weekly and one monthly sum are those read from the ticks."""

import datetime as dt

import pytest

from checks.views import Loaded, Views

VIEWS = ("bars", "inst", "margin", "revenue_raw", "statement_wide", "valuation", "quarterly")


@pytest.fixture
def folder(spark, tmp_path):
    """Ticks with equal days, a missing date and security, and every mark."""
    rows = []
    for i in range(400):
        day = None if i % 97 == 5 else dt.datetime(1994, 1, 3) + dt.timedelta(days=(i * 11) % 300)
        rows.append((i // 3, i % 4 + 1, i % 7, None if i % 89 == 7 else i % 5, float(1 + i % 50), 100.25 + i * 13.37, (i % 11) / 100, "RAN"[i % 3], day))
    spark.createDataFrame(
        rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
        "l_discount double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_loaded_views_equal_those_of_the_ticks(spark, folder):
    plain, loaded = Views(spark, folder), Loaded(spark, folder)
    for name in VIEWS:
        a, b = getattr(plain, name), getattr(loaded, name)
        assert a.schema.simpleString() == b.schema.simpleString(), name
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name


def test_loaded_views_do_not_read_the_ticks_again(spark, folder):
    loaded = Loaded(spark, folder)
    for name in VIEWS:
        assert "FileScan" not in getattr(loaded, name)._jdf.queryExecution().executedPlan().toString(), name
    assert "FileScan" in Views(spark, folder).bars._jdf.queryExecution().executedPlan().toString()


def test_views_of_stored_columns_equal_those_of_the_ticks_and_do_not_read_them(spark, folder):
    plain, loaded = Views(spark, folder), Views(spark, folder).loaded
    for name in VIEWS:
        a, b = getattr(plain, name), getattr(loaded, name)
        assert a.schema.simpleString() == b.schema.simpleString(), name
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name
        assert b.inputFiles() and not any("lineitem" in f for f in b.inputFiles()), name
    assert any("lineitem" in f for f in plain.bars.inputFiles())


def test_holders_are_dealt_out_once(spark, folder):
    """By security and month, whatever their level, of which both the cells and their share of the month are made."""
    orders = [(k, None if k % 31 == 3 else k % 23) for k in range(134) if k % 17]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    holder = Views(spark, folder).holder
    plan = holder._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(stock_id") == 1
    customers, cells, months = dict(orders), {}, {}
    for r in Views(spark, folder).ticks.collect():
        if r.l_orderkey in customers:
            month = r.d and r.d.replace(day=1)
            customer = customers[r.l_orderkey]
            key = (r.stock_id, month, None if customer is None else 1 + customer % 15)
            n, shares = cells.get(key, (0, 0))
            cells[key] = (n + 1, shares + int(r.l_quantity))
            months[key[:2]] = months.get(key[:2], 0) + int(r.l_quantity)
    got = {(r.stock_id, r.data_date, r.level): (r.holders, r.shares, r.pct) for r in holder.collect()}
    assert got == {k: (*c, pytest.approx(c[1] * 100 / months[k[:2]], abs=1e-4)) for k, c in cells.items()} and len(got) > 100
