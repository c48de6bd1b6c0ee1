"""Writes that check themselves, and appends that read stored keys only where one may repeat."""

import datetime as dt
import random

from pyspark.sql import functions as F

from equilens.operators.relational import keep_first
from equilens.sinks import checked as ck
from equilens.sinks import keyfilter as kf
from equilens.sinks import tables as sk

TRADE = "id long, stock_id string, shares double, price double, note string"


def test_a_write_counts_and_keeps_out(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    stock = spark.createDataFrame([("A",), ("B",), ("B",)], "code string")
    df = spark.createDataFrame([(1, "A", 5.0, 1.0, "x"), (1, "A", 5.0, 1.0, "y"), (2, "Z", 5.0, 1.0, "x"), (3, "B", -1.0, 1.0, "x"), (4, "B", None, 1.0, "x"),
                                (5, None, 5.0, 1.0, "x"), (6, "B", 5.0, -2.0, "x"), (3, "B", 2.0, 1.0, "x")], TRADE)
    rules = {"shares": F.col("shares") > 0, "price": F.col("price") >= 0}
    report = ck.checked_write(df, path, ["id"], rules, {"security": ("stock_id", stock)}, ["note"], fatal=["price"])
    assert report == {"rows": 8, "good": 2, "shares": 2, "price": 1, "security": 2, "duplicate": 1, "version": 0}
    assert sk.read_version(spark, path) is None  # a broken constraint publishes nothing
    kept = {(r.id, r.note, r._reason) for r in ck.quarantine(spark, path).collect()}
    assert kept == {(1, "y", "duplicate"), (2, "x", "security"), (3, "x", "shares"), (4, "x", "shares"), (5, "x", "security"), (6, "x", "price")}
    report = ck.checked_write(df.where("id <> 6"), path, ["id"], rules, {"security": ("stock_id", stock)}, ["note"], fatal=["price"])
    assert report["version"] == 2 and report["price"] == 0
    assert rows(sk.read_version(spark, path).select("id", "note")) == [(1, "x"), (3, "x")] and sk.read_version(spark, path).columns == df.columns
    assert ck.checked_write(df.where("id = 6"), path, ["id"], rules, fatal=["price"])["version"] == 0
    assert sk.read_version(spark, path).count() == 2  # readers keep what they had
    assert ck.checked_write(df.where("id = 1 and note = 'x'"), path, ["id"], rules)["good"] == 1
    assert ck.quarantine(spark, path).count() == 0
    assert ck.checked_write(df.limit(0), path, ["id"], rules)["rows"] == 0 and sk.read_version(spark, path).count() == 0


def test_a_write_reads_its_input_once(spark, tmp_path):
    source = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            source.add(b.num_rows)
            yield b

    df = spark.range(500).mapInArrow(count, "id long")
    assert ck.checked_write(df, str(tmp_path / "t"), ["id"], {"even": F.col("id") % 2 == 0})["good"] == 250
    assert source.value == 500


NEWS = "stock_id string, url string, title string, pos int"


def test_appends_equal_the_anti_join(spark, tmp_path, rows):
    rng = random.Random(5)
    path, plain = str(tmp_path / "news"), []
    for step in range(4):
        batch = [(rng.choice(["A", "B", None]), f"u{rng.randrange(400)}", f"t{step}", k) for k in range(150)]
        sk.append_news(spark, path, spark.createDataFrame(batch, NEWS), "pos")
        seen = {r[:2] for r in plain}
        first = {}
        for r in batch:
            first.setdefault(r[:2], r)
        plain += [r for k, r in first.items() if k not in seen]
    assert sorted(map(str, rows_of(sk.read_fact(spark, path)))) == sorted(map(str, plain))


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_only_folders_that_hit_are_read(spark, tmp_path):
    path = str(tmp_path / "news")
    batch = lambda a, b: spark.createDataFrame([("A", f"u{i}", "t", i) for i in range(a, b)], NEWS)
    assert sk.append_news(spark, path, batch(0, 300), "pos") == []
    read = sk.append_news(spark, path, batch(300, 600), "pos")
    assert len(read) <= 2  # all new: hits are false ones
    again = batch(5, 6)
    folder = again.select(sk.by_url().alias("p")).first().p
    assert folder in sk.append_news(spark, path, again, "pos") and sk.read_fact(spark, path).count() == 600


def test_false_hits_growth_and_old_tables(spark, tmp_path):
    path, part, pk = str(tmp_path / "t"), F.lit(3), ("k",)
    rows = lambda a, b: spark.range(a, b).withColumnRenamed("id", "k")
    # A load that died after its filter was written: its keys hit, and are still new.
    kf._grow(spark, path, kf.read_filter(spark, path), rows(0, 50).withColumn("part", part), pk)
    assert kf.append_once(spark, path, rows(0, 100), pk, part, F.col("k")) == [3] and sk.read_fact(spark, path).count() == 100
    kf.append_once(spark, path, rows(50, 9000), pk, part, F.col("k"))  # more than the blocks were made for
    blocks = {r.blocks for r in kf.read_filter(spark, path).collect()}
    assert sk.read_fact(spark, path).count() == 9000 and min(blocks) >= 5
    assert kf.append_once(spark, path, rows(8990, 9010), pk, part, F.col("k")) == [3] and sk.read_fact(spark, path).count() == 9010
    sk.remove(spark, f"{path}/_keys")  # as a table from before there were filters
    assert kf.append_once(spark, path, rows(0, 9011), pk, part, F.col("k")) == [3] and sk.read_fact(spark, path).count() == 9011
    before = len(list((tmp_path / "t").rglob("part=3/*.parquet")))
    assert before > 3 and kf.merge_files(spark, path, pk, part, most=3) == [3]
    assert len(list((tmp_path / "t" / "part=3").glob("*.parquet"))) == 1 and sk.read_fact(spark, path).distinct().count() == 9011
