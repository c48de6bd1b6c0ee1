"""Stored facts: what their partition column means, which folders an update touches, and records in nested JSON."""

import datetime as dt
import json

import pytest

from equilens.functions.windows import latest_date, trailing_calendar
from equilens.sinks import tables as sk
from equilens.sources import market_files as mf
from equilens.sources.tables import scan_recent

D = dt.date
BARS = "stock_id string, trade_date date, close double"


def test_a_column_called_part_means_nothing(spark, rows):
    bars = spark.createDataFrame([("A", D(2025, 1, 1), 9), ("A", D(2026, 1, 1), 7), ("A", D(2026, 1, 20), 3)], "stock_id string, trade_date date, part int")
    assert bars.select(latest_date(bars).alias("d")).first().d == D(2026, 1, 20)
    assert rows(trailing_calendar(bars, "trade_date", 60)) == [("A", D(2026, 1, 1), 7), ("A", D(2026, 1, 20), 3)]


def folders(path):
    return {p.name: sorted((f.name, f.stat().st_mtime_ns) for f in p.glob("*.parquet")) for p in path.glob("part=*")}


def test_a_day_rewrites_its_month_only(spark, tmp_path, rows):
    path = tmp_path / "t"
    df = spark.createDataFrame([(s, D(2025, m, d), 1.0) for s in "ABC" for m in range(1, 13) for d in (3, 9)], BARS)
    sk.upsert(spark, str(path), df, ("stock_id", "trade_date"))
    before = folders(path)
    assert len(before) == 12
    sk.upsert(spark, str(path), spark.createDataFrame([("B", D(2025, 6, 9), 5.0), ("D", D(2026, 1, 2), 4.0)], BARS), ("stock_id", "trade_date"))
    after = folders(path)
    assert {k for k in after if after[k] != before.get(k)} == {"part=202506", "part=202601"}
    assert rows(sk.read_fact(spark, str(path)).where("close > 1")) == [("B", D(2025, 6, 9), 5.0), ("D", D(2026, 1, 2), 4.0)]


@pytest.mark.parametrize("part, opened", [(sk.by_month(), 3), (sk.by_year(), 2)])
def test_recent_days_open_recent_partitions(spark, tmp_path, rows, part, opened):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("A", D(2020 + y, m, 1), 1.0) for y in range(6) for m in range(1, 13)] + [("A", D(2026, 1, 5), 1.0)], BARS)
    sk.write_fact(df, path, part)
    recent = scan_recent(spark, path, 50)
    assert rows(recent.select("trade_date")) == [(D(2025, 12, 1),), (D(2026, 1, 5),)] and recent.columns == ["stock_id", "trade_date", "close"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        recent = scan_recent(spark, path, 50)
        recent.collect()
        scan = recent._jdf.queryExecution().executedPlan().collectLeaves().head()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert scan.metrics().get("numPartitions").get().value() <= opened


def test_a_table_keeps_its_partition(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("A", D(2025, 1, 2), 1.0), ("A", D(2025, 3, 2), 1.0)], BARS)
    sk.write_fact(df, path, sk.by_year())
    sk.upsert(spark, path, df.where("month(trade_date) = 3").withColumn("close", df.close + 1), ("stock_id", "trade_date"))
    assert rows(sk.read_fact(spark, path)) == [("A", D(2025, 1, 2), 1.0), ("A", D(2025, 3, 2), 2.0)] and list(folders(tmp_path / "t")) == ["part=2025"]
    with pytest.raises(ValueError, match="partitioned by"):
        sk.merge_day_into_month(spark, path, df)


def test_news_by_hash_are_read_whole(spark, tmp_path):
    path = str(tmp_path / "news")
    news = spark.createDataFrame([("A", f"u{i}", i, D(2020 + i % 7, 1, 1)) for i in range(70)], "stock_id string, url string, pos int, published date")
    sk.append_news(spark, path, news, "pos")
    stored = sk.read_fact(spark, path, partitioned=True)
    assert stored.select(latest_date(stored, "published").alias("d")).first().d == D(2026, 1, 1)
    assert trailing_calendar(stored, "published", 400).count() == 20


def nav(spark, tmp_path, text):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "nav.json").write_text(text)
    return {r.stock_id: r.nav for r in mf.read_etf_nav(spark, str(tmp_path / "n")).collect()}


def test_fund_records_with_nested_values(spark, tmp_path):
    deep = {"a": "C2", "e": "2.5", "i": "20260102", "h": {"u": {"v": [1, {"a": "no", "e": "1", "i": "20260102"}]}}}
    text = {"p": {"q": [{"a": "C1", "e": "1.5", "i": "20260102", "h": {"u": [1]}}, [[{"w": {"x": [deep]}}]]]}, "s": "{\"a\": \"T\", \"e\": \"1\", \"i\": \"20260102\"}",
            "k": 5, "z": None, "b": {"a": "C3", "i": "20260102", "m": {"a": "C4", "f": "3", "i": "20260102"}}}
    assert nav(spark, tmp_path, json.dumps(text)) == {"C1": 1.5, "C2": 2.5, "C4": None}


def test_first_fund_record_in_the_order_written(spark, tmp_path):
    record = lambda e: {"a": "X", "e": e, "i": "20260102"}
    assert nav(spark, tmp_path, json.dumps({"z": {"y": [record("1")]}, "a": [record("2")]})) == {"X": 1.0}


@pytest.mark.parametrize("text", ["", "[]", "{}", "not json", "[1, null, \"x\"]", "null"])
def test_files_without_fund_records(spark, tmp_path, text):
    assert nav(spark, tmp_path, text) == {}


@pytest.mark.parametrize("path, day", [
    ("/raw/20260709/inst.csv", D(2026, 7, 9)), ("/raw/2026-07-09/20260710.csv", D(2026, 7, 10)), ("/raw/inst_20260709_b.csv", D(2026, 7, 9)),
    ("/x/day=1995-01-09/part-00003-4821-9012-20260105-c000.csv", D(1995, 1, 9)), ("/x/20261399/a.csv", None), ("/x/2330_202607.csv", None),
    ("/2026-07-09/99999999.csv", D(2026, 7, 9))])
def test_the_date_of_a_path(spark, path, day):
    from pyspark.sql import functions as F

    from equilens.sources.landed import date_in_path

    assert spark.range(1).select(date_in_path(F.lit(path))).first()[0] == day
