"""Histories of revisions against a plain replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from equilens.sinks import revisions as rv

D = dt.date
FACT = "stock_id string, period_date date, value double, note string, loaded date"
PK = ("stock_id", "period_date")


def loads(seed=2):
    """Loads in the order they come, one of them late and one repeated."""
    rng = random.Random(seed)
    keys = [(s, D(2025, m, 1)) for s in "ABCD" for m in (3, 6, 9)]
    out = []
    for day in (5, 9, 20, 14, 28, 28):  # 14 is late, 28 comes twice
        rng2 = random.Random(28) if day == 28 else rng
        out.append([(s, p, rng2.choice([1.0, 2.0, None]), rng2.choice(["x", None]), D(2026, 1, day)) for s, p in keys if rng2.random() < 0.6])
    return out


def replay(all_loads, day):
    """Latest value known per key up to a day."""
    out = {}
    for s, p, v, note, at in sorted((r for part in all_loads for r in part), key=lambda r: r[4]):
        if at <= day:
            out[(s, p)] = (s, p, v, note)
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("stored", [False, True])
def test_every_day_s_view_equals_a_replay(spark, tmp_path, stored):
    path, parts, history = str(tmp_path / "h"), loads(), None
    for part in parts:
        df = spark.createDataFrame(part, FACT)
        if stored:
            rv.revise(spark, path, df, PK, "loaded")
        else:
            history = rv.revised(history, df, PK, "loaded")
    history = rv.read_history(spark, path) if stored else history
    assert set(history.columns) == {"stock_id", "period_date", "value", "note", "known_from", "known_to"}
    for day in (D(2026, 1, d) for d in (1, 5, 8, 9, 13, 14, 15, 20, 27, 28, 30)):
        got = rv.known_on(history, day).select("stock_id", "period_date", "value", "note")
        assert sorted((tuple(r) for r in got.collect()), key=str) == replay(parts, day), day
    rows = sorted((tuple(r) for r in history.select(*PK, "known_from", "known_to", "value", "note").collect()), key=lambda r: r[:3])
    for a, b in zip(rows, rows[1:]):
        if a[:2] == b[:2]:
            assert a[3] == b[2] and a[4:] != b[4:]  # no gap, no overlap, no equal neighbours
        else:
            assert a[3] is None


def test_both_axes_and_orders(spark):
    df = spark.createDataFrame([("A", D(2025, 3, 1), 1.0, "first", D(2026, 1, 5)), ("A", D(2025, 3, 1), 2.0, "second", D(2026, 1, 5)),
                                ("A", D(2025, 6, 1), 3.0, "first", D(2026, 1, 5))], FACT)
    history = rv.revised(None, df.withColumn("seq", F.col("value") * 10), PK, "loaded", order_col="seq")
    later = df.where("value = 3").drop("loaded").withColumn("value", F.lit(4.0))
    history = rv.revised(history, later, PK, F.lit(D(2026, 2, 1)))
    assert sorted(r.value for r in rv.known_on(history, D(2026, 2, 1)).collect()) == [2.0, 4.0]
    got = rv.as_of(history, D(2026, 1, 9), "period_date", D(2025, 4, 1))
    assert [r.note for r in got.collect()] == ["second"]


def test_a_load_rewrites_its_months_only(spark, tmp_path):
    path = tmp_path / "h"
    parts = loads()
    rv.revise(spark, str(path), spark.createDataFrame(parts[0], FACT), PK, "loaded")
    before = {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    one = spark.createDataFrame([("A", D(2025, 6, 1), 9.0, "y", D(2026, 3, 1))], FACT)
    rv.revise(spark, str(path), one, PK, "loaded")
    after = {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    changed = {f.split("part=")[1][:6] for f in after.keys() | before.keys() if after.get(f) != before.get(f)}
    assert changed == {"202506"}
    assert rv.known_on(rv.read_history(spark, str(path)), D(2026, 3, 1)).where("value = 9").count() == 1
    empty = spark.createDataFrame([], FACT)
    rv.revise(spark, str(path), empty, PK, "loaded")
    assert rv.revised(None, empty, PK, "loaded").count() == 0
