"""Tables on disk and the streaming jobs, which must equal their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from equilens.operators import news as nw
from equilens.operators import quality as ql
from equilens.operators.ledger import positions
from equilens.sinks import tables as sk
from equilens.streaming import jobs

D = dt.date
PRICE = "stock_id string, trade_date date, close double, seq int"


def test_upsert_touches_only_its_partitions(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("A", D(2025, 1, 2), 1.0, 1), ("A", D(2026, 1, 2), 2.0, 1), ("A", D(2026, 1, 2), 2.5, 2)], PRICE)
    sk.upsert(spark, path, first, ("stock_id", "trade_date"), order_col="seq")
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "part=2025").glob("*.parquet")}
    second = spark.createDataFrame([("A", D(2026, 1, 2), 3.0, 1), ("B", D(2026, 1, 5), 9.0, 1)], PRICE)
    for _ in range(2):
        sk.upsert(spark, path, second, ("stock_id", "trade_date"), order_col="seq")
    assert rows(sk.read_fact(spark, path)) == [("A", D(2025, 1, 2), 1.0), ("A", D(2026, 1, 2), 3.0), ("B", D(2026, 1, 5), 9.0)]
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "part=2025").glob("*.parquet")}


def test_scan_recent_opens_only_recent_years(spark, tmp_path, rows):
    from equilens.sources.tables import scan_recent

    path = str(tmp_path / "t")
    df = spark.createDataFrame([("A", D(2020 + y, m, 1), 1.0) for y in range(6) for m in (1, 12)], "stock_id string, trade_date date, close double")
    sk.write_fact(df, path, sk.by_year())
    recent = scan_recent(spark, path, 400)
    assert rows(recent.select("trade_date")) == [(D(2024, 12, 1),), (D(2025, 1, 1),), (D(2025, 12, 1),)]
    assert "PartitionFilters: [isnotnull(part" in recent._jdf.queryExecution().executedPlan().toString()


def test_month_merge_index_merge_and_insert_only(spark, tmp_path, rows):
    path = str(tmp_path / "m")
    sk.merge_day_into_month(spark, path, spark.createDataFrame([("A", D(2026, 1, 2), 1.0)], "stock_id string, trade_date date, close double"))
    sk.merge_day_into_month(spark, path, spark.createDataFrame([("A", D(2026, 1, 2), 5.0), ("A", D(2026, 1, 3), 2.0)], "stock_id string, trade_date date, close double"))
    assert rows(sk.read_fact(spark, path)) == [("A", D(2026, 1, 2), 5.0), ("A", D(2026, 1, 3), 2.0)]
    ipath = str(tmp_path / "i")
    for v in (1.0, 2.0):
        sk.merge_index(spark, ipath, spark.createDataFrame([("TWSE", D(2026, 1, 2), v)], "index_id string, trade_date date, close double"))
    assert rows(sk.read_fact(spark, ipath)) == [("TWSE", D(2026, 1, 2), 2.0)]
    kpath = str(tmp_path / "k")
    for batch in ([("A",), ("A",)], [("A",), ("B",)]):
        sk.insert_only(spark, kpath, spark.createDataFrame(batch, "stock_id string"), ("stock_id",), part=F.substring("stock_id", 1, 1))
    assert rows(sk.read_fact(spark, kpath)) == [("A",), ("B",)]


def test_versions(spark, tmp_path, rows):
    path = str(tmp_path / "v")
    assert sk.read_version(spark, path) is None
    one = spark.createDataFrame([("A", 1), ("B", 1)], "stock_id string, x int")
    assert sk.refresh_snapshot(one, path) == 1
    assert sk.upsert_small(spark, path, spark.createDataFrame([("B", 2), ("C", 2)], "stock_id string, x int"), ("stock_id",)) == 2
    assert rows(sk.read_version(spark, path)) == [("A", 1), ("B", 2), ("C", 2)]
    sk.replace_keys(spark, path, spark.createDataFrame([("C", 7), ("C", 8)], "stock_id string, x int"))
    assert rows(sk.read_version(spark, path)) == [("A", 1), ("B", 2), ("C", 7), ("C", 8)]
    (tmp_path / "v" / "version=9").mkdir()  # a job that died
    assert sk.read_version(spark, path).count() == 4


TRADE = "id bigint, stock_id string, action string, trade_date date, shares double, price double, fee double, tax double"


def test_trade_log(spark, tmp_path, rows):
    path = str(tmp_path / "log")
    stock = spark.createDataFrame([("A",), ("B",)], "stock_id string")
    t = spark.createDataFrame([(1, " A ", "BUY", D(2026, 1, 2), 1.0, 0.0, None, None), (2, "A", "hold", D(2026, 1, 2), 1.0, 1.0, None, None),
                               (3, "X", "buy", D(2026, 1, 2), 1.0, 1.0, None, None), (4, "A", "sell", D(2026, 2, 2), 0.0, 1.0, None, None),
                               (5, "B", "sell", D(2026, 2, 2), 1.0, -1.0, None, None), (6, "B", "sell", D(2026, 2, 2), 1.0, 1.0, None, None)], TRADE)
    accepted, rejected = sk.append_trades(spark, path, t, stock)
    assert sorted(r.id for r in accepted.collect()) == [1, 6]
    assert {r.id: r.reason for r in rejected.collect()} == {2: "action", 3: "unknown security", 4: "shares", 5: "price"}
    assert rows(sk.read_fact(spark, path).select("id", "stock_id", "action")) == [(1, "A", "buy"), (6, "B", "sell")]
    sk.delete_trades(spark, path, [6])
    assert rows(sk.read_fact(spark, path).select("id")) == [(1,)]


def test_other_outputs(spark, tmp_path, rows):
    df = spark.createDataFrame([("A", D(2026, 1, 2)), ("", D(2026, 1, 5)), ("B", D(2025, 1, 5))], "stock_id string, trade_date date")
    assert rows(sk.incremental(df, "2026-01-01", "trade_date")) == [("A", D(2026, 1, 2))]
    assert sk.incremental(df, "2026-01-01", None).count() == 2
    assert sk.dry_run_profile(df).collect()[0].rows == 3
    sk.write_codes(df.filter("stock_id <> ''"), str(tmp_path / "codes"))
    assert rows(spark.read.text(str(tmp_path / "codes"))) == [("A",), ("B",)]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("x")
    files = spark.read.format("binaryFile").load(str(tmp_path / "raw")).select("path", "content")
    sk.archive_raw(files, str(tmp_path / "arch"), "2026-01-02", "inst")
    sk.archive_raw(files.limit(0), str(tmp_path / "arch"), "2026-01-03", "inst")
    assert [p.name for p in sorted((tmp_path / "arch").glob("ingest_date=*"))] == ["ingest_date=2026-01-02"]
    nav = df.filter("stock_id = 'A'").withColumn("nav", F.lit(1.5))
    sk.write_nav_snapshot(nav, str(tmp_path / "nav"))
    assert (tmp_path / "nav" / "trade_date=2026-01-02").exists()


def test_export_text(spark, tmp_path):
    row = {c: None for c, _, _ in sk.EXPORT}
    row |= {"stock_id": "A", "ret_3m": 0.12345, "above_ma60": True, "vcp": False, "rs_rating": 70}
    types = {"ret_3m": "double", "ret_12_1": "double", "rs_rating": "int", "above_ma60": "boolean", "trend_template": "boolean", "vcp": "boolean",
             "mf_accumulate": "boolean", "mf_distribute": "boolean", "last_patterns": "array<struct<name:string,dir:string>>"}
    row["last_patterns"] = [("錘子線", "bull"), ("十字星", "neutral")]
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {types.get(c, 'string')}" for c in row))
    out = sk.export_screen(df).collect()[0]
    assert (out["代碼"], out["近3月%"], out["站季線"], out["VCP"], out["趨勢範本"], out["ROE"], out["K棒型態"]) == (
        "A", "12.35", "是", "", "", "", "錘子線、十字星")
    assert len(out) == 22
    sk.write_export(df, str(tmp_path / "e"))
    text = next((tmp_path / "e").glob("*.csv")).read_bytes()
    assert text.startswith("﻿代碼".encode())


def test_news(spark, tmp_path, rows):
    schema = "stock_id string, url string, title string, pos int"
    path = str(tmp_path / "news")
    sk.append_news(spark, path, spark.createDataFrame([("A", "u1", "first", 1), ("A", "u1", "again", 2)], schema), "pos")
    sk.append_news(spark, path, spark.createDataFrame([("A", "u1", "old", 1), ("B", "u1", "other", 2), ("B", "u2", "x", 3), ("B", "u2", "y", 4)], schema), "pos")
    assert rows(spark.read.parquet(path).select("stock_id", "url", "title")) == [("A", "u1", "first"), ("B", "u1", "other"), ("B", "u2", "x")]
    at = dt.datetime(2026, 1, 2, 12)
    df = spark.createDataFrame([(1, "A", "t1", "c1", at, [1.0, 0.0]), (2, "A", "t2", "c2", at, [0.0, 1.0]), (3, "A", None, "c3", None, [1.0, 1.0]),
                                (4, "B", "t", "c", at, [1.0, 0.0])],
                               "news_id bigint, stock_id string, title string, content string, published_at timestamp, embedding array<float>")
    hits = nw.retrieve(df, [1.0, 0.1], 2, "A")
    assert [r.news_id for r in hits.collect()] == [1, 3]
    assert nw.build_context(hits).collect()[0][0] == "[來源1｜2026-01-02] t1\nc1\n\n[來源2｜] \nc3"
    assert [r.news_id for r in nw.retrieve(df, [1.0, 0.1], 5, "A", "2026-01-02 13:00:00").collect()] == [1, 2]


def test_quality(spark, rows):
    bars = spark.createDataFrame([("A", D(2026, 1, 30)), ("A", D(2026, 2, 27)), ("B", D(2026, 1, 29))], "stock_id string, trade_date date")
    stock = spark.createDataFrame([("A", D(2025, 12, 5), "上市"), ("B", D(2026, 2, 1), "上市"), ("C", D(2027, 1, 1), "上市")],
                                  "stock_id string, list_date date, market string")
    assert rows(ql.month_completeness(bars, stock, "2026-01-01").select("stock_id", "status")) == [("A", "complete"), ("B", "short"), ("C", "missing")]
    log = spark.createDataFrame([("A", D(2025, 12, 1))], "stock_id string, month date")
    assert rows(ql.backfill_plan(stock, bars, "2026-03-01", log)) == [("A", D(2026, 3, 1)), ("B", D(2026, 2, 1)), ("B", D(2026, 3, 1))]


# -- streams ---------------------------------------------------------------------------------------

def test_stream_upsert_equals_batch(spark, tmp_path, rows):
    src, path, ck = (str(tmp_path / x) for x in ("src", "t", "ck"))
    frames = [spark.createDataFrame([("A", D(2026, 1, 2), 1.0, 1), ("B", D(2026, 1, 2), 2.0, 1)], PRICE),
              spark.createDataFrame([("A", D(2026, 1, 2), 5.0, 2), ("A", D(2026, 2, 2), 6.0, 2)], PRICE)]
    for f in frames:
        f.write.mode("append").parquet(src)
        stream = jobs.arriving(spark, src, f.schema)
        jobs.start_upsert(stream, path, ck, ("stock_id", "trade_date"), sk.by_month(), "seq").awaitTermination()
    assert rows(sk.read_fact(spark, path)) == [("A", D(2026, 1, 2), 5.0), ("A", D(2026, 2, 2), 6.0), ("B", D(2026, 1, 2), 2.0)]


def test_stream_bars_equal_batch_for_finished_windows(spark, tmp_path, rows):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    events.write.parquet(src)
    jobs.start_bars(jobs.arriving(spark, src, events.schema), out, ck).awaitTermination()
    streamed = spark.read.parquet(out)
    edge = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0] - dt.timedelta(days=1)
    batch = jobs.bars_from_events(events).filter(F.col("bar_start") + F.expr("interval 7 days") <= F.lit(edge))
    key = lambda df: [(r[0], r[1], round(r.volume, 6), r.open, r.high, r.low, r.close, r.trades) for r in df.orderBy("event_type", "bar_start").collect()]
    assert streamed.count() > 0 and key(streamed) == key(batch)


def test_stream_news_dedupe_across_runs(spark, tmp_path, rows):
    schema = "stock_id string, url string, title string, published_at timestamp"
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    at = dt.datetime(2026, 1, 2)
    for batch in ([("A", "u1", "x", at), ("A", "u2", "x", at)], [("A", "u1", "again", at), ("B", "u1", "x", at)]):
        df = spark.createDataFrame(batch, schema)
        df.write.mode("append").parquet(src)
        jobs.start_news_dedupe(jobs.arriving(spark, src, df.schema), out, ck).awaitTermination()
    assert rows(spark.read.parquet(out).select("stock_id", "url")) == [("A", "u1"), ("A", "u2"), ("B", "u1")]


def test_stream_ledger_equals_batch(spark, tmp_path, rows):
    src, log, days, ck = (str(tmp_path / x) for x in ("src", "log", "days", "ck"))
    stock = spark.createDataFrame([("A",), ("B",)], "stock_id string")
    raw = [(i, "A" if i % 4 else "B", "sell" if i % 3 == 0 else "buy", D(2026, 1 + i % 3, 1 + i % 9), float(1 + i % 7), 10.0 + i, 1.0, 1.0)
           for i in range(60)] + [(99, "ZZ", "buy", D(2026, 1, 1), 1.0, 1.0, None, None)]
    for part in (raw[:30], raw[30:], raw[20:40]):  # the last batch arrives twice
        df = spark.createDataFrame(part, TRADE)
        df.write.mode("append").parquet(src)
        jobs.start_ledger(jobs.arriving(spark, src, df.schema), log, days, ck, stock).awaitTermination()
    want = positions(spark.createDataFrame(raw[:60], TRADE)).select("stock_id", "net_shares")
    assert rows(jobs.current_positions(spark, days)) == rows(want)
    assert sk.read_fact(spark, log).count() == 60


def test_only_touched_partitions_are_read(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    sk.write_fact(spark.createDataFrame([("A", D(2020 + y, 1, 2), 1.0) for y in range(6)], "stock_id string, trade_date date, close double"), path, sk.by_year())
    day = spark.createDataFrame([("A", D(2025, 1, 2), 9.0), ("B", D(2024, 1, 2), 8.0)], "stock_id string, trade_date date, close double")
    part = sk.touched_parts(spark.read.parquet(path), day, sk.by_year())
    assert sorted(f.split("part=")[1][:4] for f in part.inputFiles()) == ["2020", "2021", "2022", "2023", "2024", "2025"]
    plan = part._jdf.queryExecution().executedPlan()
    part.collect()
    assert "PartitionFilters: [part" in plan.toString() or "part" in plan.toString().split("PartitionFilters")[1][:60]
    scan = plan.collectLeaves().head()
    assert scan.metrics().get("numPartitions").get().value() == 2
    sk.upsert(spark, path, day, ("stock_id", "trade_date"))
    assert rows(sk.read_fact(spark, path).where("close > 5")) == [("A", D(2025, 1, 2), 9.0), ("B", D(2024, 1, 2), 8.0)]


def test_clashing_updates_need_an_order(spark, tmp_path, rows):
    path, schema = str(tmp_path / "t"), "stock_id string, trade_date date, close double"
    same = spark.createDataFrame([("A", D(2026, 1, 2), 1.0)] * 2, schema)
    sk.upsert(spark, path, same, ("stock_id", "trade_date"))
    assert sk.read_fact(spark, path).count() == 1
    clash = spark.createDataFrame([("A", D(2026, 1, 2), 1.0), ("A", D(2026, 1, 2), 2.0)], schema)
    with pytest.raises(Exception, match="no order column"):
        sk.upsert(spark, path, clash, ("stock_id", "trade_date"))
    keys = spark.createDataFrame([("A", D(2026, 1, 2)), ("A", D(2026, 1, 2)), ("B", D(2026, 1, 2))], "stock_id string, trade_date date")
    for _ in range(2):
        sk.upsert(spark, str(tmp_path / "k"), keys, ("stock_id", "trade_date"))
    assert rows(sk.read_fact(spark, str(tmp_path / "k"))) == [("A", D(2026, 1, 2)), ("B", D(2026, 1, 2))]


def test_stream_news_keeps_undated_and_late_items_once(spark, tmp_path, rows):
    schema = "stock_id string, url string, title string, published_at timestamp"
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    new, old = dt.datetime(2026, 6, 1), dt.datetime(2025, 1, 1)
    for batch in ([("A", "u1", "x", new), ("A", "u0", "undated", None)], [("A", "u0", "again", None), ("A", "u9", "late", old), ("A", "u9", "later", new)]):
        df = spark.createDataFrame(batch, schema)
        df.write.mode("append").parquet(src)
        jobs.start_news_dedupe(jobs.arriving(spark, src, df.schema), out, ck).awaitTermination()
    assert rows(sk.read_fact(spark, out).select("url", "title")) == [("u0", "undated"), ("u1", "x"), ("u9", "late")]


def test_stream_ledger_keeps_rejects(spark, tmp_path):
    src, log, days, ck = (str(tmp_path / x) for x in ("src", "log", "days", "ck"))
    stock = spark.createDataFrame([("A",)], "stock_id string")
    raw = [(1, "A", "buy", D(2026, 1, 1), 1.0, 1.0, None, None), (2, "ZZ", "buy", D(2026, 1, 1), 1.0, 1.0, None, None), (3, "A", "hold", D(2026, 1, 1), 1.0, 1.0, None, None)]
    df = spark.createDataFrame(raw, TRADE)
    df.write.parquet(src)
    jobs.start_ledger(jobs.arriving(spark, src, df.schema), log, days, ck, stock).awaitTermination()
    got = {r.id: r.reason for r in spark.read.parquet(f"{log}_rejected").collect()}
    assert got == {2: "unknown security", 3: "action"} and sk.read_fact(spark, log).count() == 1
