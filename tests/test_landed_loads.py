"""Queries of several loads: what is loaded is stored once, and rows that are picked carry no more than is wanted."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks import catalog, file_queries
from checks.views import Views
from equilens.operators.fundamentals import best_dividends
from equilens.operators.relational import keep_last
from equilens.session import configure

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lines")
    rows = [(k, k % 5, s, 1 + k % 3, 1.0 + k % 4, 100.0 + k, 0.05, 0.0, "RAN"[k % 3], "O", dt.datetime(1996, 12, 10) + dt.timedelta(k * 9 % 50))
            for k in range(90) for s in (1, 2)]
    rows += [(900, 1, None, 1, 1.0, 10.0, 0.0, 0.0, "R", "O", dt.datetime(1996, 12, 10)), (901, 1, 1, 1, 1.0, 10.0, 0.0, 0.0, "A", "O", None)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{folder}/lineitem.parquet")
    return Views(configure(spark), str(folder))


def reads_lines(df):
    return any("lineitem.parquet" in f for f in df.inputFiles())


def test_upserted_loads_are_stored(lines, monkeypatch):
    loads, upsert = [], file_queries.sk.upsert
    monkeypatch.setattr(file_queries.sk, "upsert", lambda spark, path, updates, *a, **k: (loads.append(updates), upsert(spark, path, updates, *a, **k)))
    got = sorted(map(tuple, catalog()["k01_upsert_stored"].spark(lines).select("stock_id", "trade_date", "price").collect()))
    ticks = lines.ticks.where("stock_id is not null and d is not null").groupBy("stock_id", "d").agg(
        F.max_by("price", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")))
    assert got == sorted(map(tuple, ticks.collect()))
    assert len(loads) == 2 and not any(map(reads_lines, loads))


def test_readjusted_loads_are_stored(lines, monkeypatch):
    loads, readjust = [], file_queries.readjust
    monkeypatch.setattr(file_queries, "readjust", lambda spark, path, *inputs, **k: (loads.extend(inputs), readjust(spark, path, *inputs, **k)))
    columns = ["stock_id", "trade_date", "adj_open", "adj_close", "adj_factor"]
    got = sorted(map(tuple, catalog()["d05_readjusted"].spark(lines).where("trade_date is not null").select(*columns).collect()), key=str)
    assert got == sorted(map(tuple, lines.adjusted.where("stock_id is not null and trade_date is not null").select(*columns).collect()), key=str)
    assert len(loads) == 6 and not any(map(reads_lines, loads))


def picked(df):
    """Fields of the row that the aggregate carries."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return plan.split("_by(struct(")[1].split("), struct(")[0]


def test_picked_rows_carry_what_is_wanted(spark, lines):
    df = spark.createDataFrame([("a", 1.0, 2, "x"), ("a", 1.0, 3, "y"), (None, -0.0, 1, "z")], "k string, f double, o int, v string")
    rows = keep_last(df, ("k", "f"), "o")
    assert sorted(map(str, rows.collect())) == sorted(map(str, df.where("v <> 'x'").collect()))
    assert "k, " not in picked(rows) and "f, " in picked(rows)  # 0.0 and -0.0 are one key and two values
    assert keep_last(df, ("k", "f"), "o", keep=["v", "k"]).columns == ["v", "k"]
    assert sorted(map(tuple, keep_last(df.select("k"), ("k",), "k").collect()), key=str) == [("a",), (None,)]
    assert "seq, " not in picked(lines.dividend) and "stock_id, " not in picked(lines.dividend)
    all_columns = best_dividends(lines.dividend_rows, "seq")
    assert all_columns.columns == lines.dividend_rows.columns
    assert sorted(map(str, all_columns.drop("seq").collect())) == sorted(map(str, lines.dividend.collect()))
