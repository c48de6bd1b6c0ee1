"""Raw files of several days that land in any order: tables equal the batch readers, bad files are kept."""

import datetime as dt
import json
import random

import pytest

from equilens.sinks import tables as sk
from equilens.sources import market_files as mf
from equilens.streaming import landing as ld

D = dt.date


def line(*values):
    return ",".join(f'"{v}"' for v in values)


def landed(root, day, seed):
    """One day's files of every kind below ``root``, as (path, bytes)."""
    rng = random.Random(seed)
    codes = [f"{c}" for c in rng.sample(range(1101, 1140), 12)]
    n = lambda: f"{rng.randrange(1, 10**6):,}"
    p = lambda: f"{rng.uniform(10, 900):,.2f}"
    listed = lambda cells, head=(): "\r\n".join([*head, *[line(c, "名稱", *cells()) for c in codes[:6]], "說明:", ""]).encode("big5")
    otc = lambda cells: json.dumps({"tables": [{"data": [cells(c) for c in codes[6:]]}]}, ensure_ascii=False).encode()
    out = {
        f"daily_listed_{day}.csv": listed(lambda: [n(), n(), n(), p(), p(), p(), p(), "+", "1.5"], ["標題", line("證券代號", "證券名稱")]),
        f"daily_otc_{day}.json": otc(lambda c: [c, "x", p(), "+1", p(), p(), p(), n(), n(), "7"]),
        f"inst_listed/{day}.csv": listed(lambda: [n() for _ in range(18)]),
        f"inst_otc/{day}.json": otc(lambda c: [c, "x", *[n() for _ in range(20)]]),
        f"margin_listed_{day}.csv": listed(lambda: [n() for _ in range(14)], [line("合計", "1"), line("代號", "名稱")]),
        f"margin_otc_{day}.json": otc(lambda c: [c, "x", *[n() for _ in range(14)]]),
        f"foreign_listed_{day}.csv": listed(lambda: [n() for _ in range(5)] + ["12.5", "1"]),
        f"foreign_otc_{day}.json": otc(lambda c: ["1", c, "x", *[n() for _ in range(4)], "33.25%", "1"]),
        f"valuation_listed_{day}.csv": listed(lambda: [p() for _ in range(6)]),
        f"valuation_otc_{day}.json": json.dumps([
            {"Date": day if i else "20200101", "SecuritiesCompanyCode": c, "PriceEarningRatio": p(), "PriceBookRatio": p(), "YieldRatio": p()}
            for i, c in enumerate(codes[6:])]).encode(),
    }
    return [(root / name, body) for name, body in out.items()]


READERS = {
    "price_daily": [(lambda s, p: mf.read_daily_listed(s, p).drop("name"), "daily_listed"), (mf.read_daily_otc, "daily_otc")],
    "inst_trades": [(mf.read_inst_listed, "inst_listed"), (mf.read_inst_otc, "inst_otc")],
    "margin_trading": [(mf.read_margin_listed, "margin_listed"), (mf.read_margin_otc, "margin_otc")],
    "shareholding": [(mf.read_foreign_listed, "foreign_listed"), (mf.read_foreign_otc, "foreign_otc")],
    "valuation_daily": [(mf.read_valuation_listed, "valuation_listed"), (mf.read_valuation_otc, "valuation_otc")],
}


def test_files_in_any_order_equal_the_readers(spark, tmp_path, rows):
    src, sorted_out = tmp_path / "src", tmp_path / "kinds"
    src.mkdir()
    every = [f for i, day in enumerate(("20260707", "20260708", "20260803")) for f in landed(src, day, i)]
    bad = [(src / "notes_20260707.txt", b"hello"), (src / "inst_otc" / "20260709.json", b" "), (src / "daily_listed_20260709.csv", b"\xff\xfe\x00"),
           (src / "margin_listed_latest.csv", every[4][1]), (src / "valuation_otc_20260709.json", b"{not json"),
           (src / "foreign_otc_20260710.json", json.dumps({"tables": [{"data": []}]}).encode())]
    random.Random(7).shuffle(every)
    for path, body in every:  # the same files, sorted by kind, for the batch readers
        kind = next(k for k in ld.ROUTES if k in str(path.relative_to(src)))
        target = sorted_out / kind / path.name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    runs = (every[:11] + bad[:2], every[11:17] + bad[2:4], every[17:] + bad[4:])
    for part in runs:
        for path, body in part:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(body)
        feed = ld.arriving_files(spark, str(src), files_per_trigger=9)
        ld.start_landing(feed, str(tmp_path / "tables"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    for table, readers in READERS.items():
        stored = sk.read_fact(spark, str(tmp_path / "tables" / table))
        want = [tuple(r) for read, kind in readers for r in read(spark, str(sorted_out / kind)).select(*stored.columns).collect()]
        assert rows(stored) == sorted(want) and len(want) >= 30, table
    kept = spark.read.parquet(str(tmp_path / "bad")).collect()
    got = {r.path.split("/src/")[1]: r.reason for r in kept}
    assert got == {
        "notes_20260707.txt": "no parser for its name", "inst_otc/20260709.json": "no row that its parser knows",
        "daily_listed_20260709.csv": "no row that its parser knows", "margin_listed_latest.csv": "no date in its path",
        "valuation_otc_20260709.json": "no row that its parser knows", "foreign_otc_20260710.json": "no row that its parser knows"}
    assert {r.path.split("/src/")[1]: bytes(r.content) for r in kept}["notes_20260707.txt"] == b"hello"


def test_a_corrected_file_replaces_rows(spark, tmp_path, rows):
    src = tmp_path / "src"
    src.mkdir()
    for run, price in (("a", "10.00"), ("b", "11.00")):
        body = json.dumps({"tables": [{"data": [["6488", "x", price, "+1", "9", "12", "8", "1,000", "5", "7"]]}]}).encode()
        (src / f"daily_otc_20260707_{run}.json").write_bytes(body)
        ld.start_landing(ld.arriving_files(spark, str(src)), str(tmp_path / "t"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    assert rows(sk.read_fact(spark, str(tmp_path / "t" / "price_daily")).select("stock_id", "close")) == [("6488", 11.0)]


@pytest.mark.parametrize("path, kind", [
    ("file:/x/inst_otc/raw/daily_otc_20260101.json", "daily_otc"), ("s3://b/inst_listed/2026/20260101.csv", "inst_listed"),
    ("margin_otc.json", "margin_otc"), ("/x/inst_otcs/a.json", None), ("/x/my_inst_otc.json", None)])
def test_kinds(spark, path, kind):
    from pyspark.sql import functions as F

    assert spark.range(1).select(ld.kind_of(F.lit(path), list(ld.ROUTES))).first()[0] == kind


def test_every_file_is_parsed_once(spark, tmp_path, rows):
    from pyspark.sql import functions as F

    (tmp_path / "src").mkdir()
    for day in (1, 2, 3):
        (tmp_path / "src" / f"x_2026010{day}.txt").write_bytes(f"110{day}".encode())
    (tmp_path / "src" / "x_20260104.txt").write_bytes(b"none")
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(content):
        parsed.add(1)
        return bytes(content).decode()

    def parse(found):
        seen = found.select("path", "trade_date", F.explode(F.array(read("content"))).alias("stock_id"))
        return seen.where("stock_id <> 'none'").withColumn("close", F.lit(1.0))

    files = ld.arriving_files(spark, str(tmp_path / "src"))
    ld.start_landing(files, str(tmp_path / "t"), str(tmp_path / "bad"), str(tmp_path / "ck"), {"x": ld.Route("t", parse)}).awaitTermination()
    assert parsed.value == 4
    assert [r[0] for r in rows(sk.read_fact(spark, str(tmp_path / "t" / "t")).select("stock_id"))] == ["1101", "1102", "1103"]
    assert [(r.kind, r.reason) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [("x", "no row that its parser knows")]


def test_of_two_files_with_a_row_the_later_one_wins_whole(spark, tmp_path, rows):
    import os

    (tmp_path / "src").mkdir()
    for name, at, cells in (("b", 1000, ["6488"] + [""] * 3 + ["1"] + [""] * 8 + ["2"] + [""] * 6), ("a", 2000, ["6488"] + [""] * 12 + ["3"] + [""] * 6)):
        path = tmp_path / "src" / f"inst_otc_20260707_{name}.json"
        path.write_text(json.dumps({"tables": [{"data": [cells]}]}))
        os.utime(path, (at, at))
    ld.start_landing(ld.arriving_files(spark, str(tmp_path / "src")), str(tmp_path / "t"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    assert rows(sk.read_fact(spark, str(tmp_path / "t" / "inst_trades")).select("stock_id", "foreign_net", "trust_net")) == [("6488", None, 3)]
