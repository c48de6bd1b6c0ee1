"""Adjusted prices after every load against a full recompute, and what a load writes."""

import datetime as dt
import random

from pyspark.sql import functions as F

from equilens.operators.adjust import adjust_prices, dividend_events, reduction_events
from equilens.plans import readjust as ra
from equilens.sinks.tables import ADJUSTED

D = dt.date
BAR = "stock_id string, trade_date date, open double, high double, low double, close double, volume long, amount double"
DIV = "stock_id string, ex_cash_date date, ex_stock_date date, cash_dividend double, stock_dividend double"
RED = "stock_id string, resume_date date, pre_close double, post_ref_price double"
CODES = [f"S{i}" for i in range(12)]
DAYS = [D(2025, 1, 1) + dt.timedelta(i) for i in range(0, 100, 2)]


def bars_of(days, codes=CODES, **changed):
    rng = random.Random(1)
    price = {(s, d): round(rng.uniform(10, 90), 2) for s in CODES for d in DAYS}
    return [(s, d, p, p + 1, p - 1, changed.get(f"{s}_{d}", p), 100, p * 100) for s in codes for d in days for p in [price[s, d]]]


def frames(spark, bars, div, red):
    return (spark.createDataFrame(bars, BAR), dividend_events(spark.createDataFrame(div, DIV)), reduction_events(spark.createDataFrame(red, RED)))


def written(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def check(spark, path, *inputs):
    want = sorted(tuple(r) for r in adjust_prices(*inputs).select(*ADJUSTED).collect())
    assert sorted(tuple(r) for r in ra.read_adjusted(spark, str(path)).collect()) == want


def test_loads_equal_a_full_recompute(spark, tmp_path):
    path = tmp_path / "adjusted"
    div = [("S1", DAYS[10], None, 1.0, None), ("S2", DAYS[41], DAYS[42], 2.0, 0.5), ("S3", D(2030, 1, 1), None, 1.0, None)]
    red = [("S4", DAYS[20], 20.0, 30.0)]

    def load(bars, div=div, red=red):
        before = written(path)
        inputs = frames(spark, bars, div, red)
        dirty = sorted(r.stock_id for r in ra.readjust(spark, str(path), *inputs, buckets=16).collect())
        check(spark, path, *inputs)
        after = written(path)
        return dirty, {f for f in after if after[f] != before.get(f)} | (before.keys() - after.keys())

    bucket = {r.stock_id: r.b for r in spark.createDataFrame([(s,) for s in CODES], "stock_id string").select(
        "stock_id", F.pmod(F.xxhash64("stock_id"), F.lit(16)).alias("b")).collect()}
    of = lambda files: {int(f.split("bucket=")[1].split("/")[0]) for f in files}

    dirty, _ = load(bars_of(DAYS[:40]))
    assert dirty == sorted(CODES)  # the first load
    dirty, files = load(bars_of(DAYS[:41]))
    assert dirty == [] and all("part=202503" in f for f in files)  # a plain day: its month only
    dirty, files = load(bars_of(DAYS[:41]))
    assert dirty == [] and files == set()  # the same again
    dirty, files = load(bars_of(DAYS[:43]))  # two dividends of S2 land and change all its earlier factors
    assert dirty == ["S2"] and of(f for f in files if "part=202503" not in f) == {bucket["S2"]}
    dirty, files = load(bars_of(DAYS[:43], **{f"S5_{DAYS[3]}": 77.0}))  # an old bar is corrected
    assert dirty == ["S5"] and of(files) == {bucket["S5"]}
    corrected = {f"S5_{DAYS[3]}": 77.0}
    dirty, files = load(bars_of(DAYS[:43], **corrected), red=red + [("S6", DAYS[2], 10.0, 20.0)])  # an event is filed late
    assert dirty == ["S6"] and of(files) == {bucket["S6"]}
    late = red + [("S6", DAYS[2], 10.0, 20.0)]
    gone = [s for s in CODES if s != "S7"]
    dirty, files = load(bars_of(DAYS[:44], gone, **corrected), red=late)  # a security is withdrawn
    assert dirty == ["S7"]
    dirty, _ = load(bars_of(DAYS, gone + ["S7"], **corrected), red=late, div=div[:2])  # it is back, among many new days
    assert dirty == ["S7"]


def test_a_load_that_died_is_repeated(spark, tmp_path):
    from equilens.sinks.tables import remove

    path = tmp_path / "adjusted"
    first, second = frames(spark, bars_of(DAYS[:20]), [], []), frames(spark, bars_of(DAYS[:22]), [("S1", DAYS[21], None, 1.0, None)], [])
    ra.readjust(spark, str(path), *first, buckets=4)
    ra.readjust(spark, str(path), *second, buckets=4)
    remove(spark, f"{path}_fingerprints/version=2")  # as if the job had ended before its last step
    assert [r.stock_id for r in ra.readjust(spark, str(path), *second, buckets=4).collect()] == ["S1"]
    check(spark, path, *second)


def test_only_bars_and_no_bars(spark, tmp_path):
    bars = spark.createDataFrame(bars_of(DAYS[:3]), BAR)
    ra.readjust(spark, str(tmp_path / "a"), bars, None, None)
    check(spark, tmp_path / "a", bars, None, None)
    none = spark.createDataFrame([], BAR)
    assert ra.readjust(spark, str(tmp_path / "a"), none, None, None).count() == len(CODES)
    assert not written(tmp_path / "a")
