"""The driver contract, a cross-section of the SQL comparisons, and the shape of hot plans."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from equilens.functions.windows import last_n
from equilens.operators import adjust, candles, technical, vpa
from equilens.operators.relational import as_of_known
from equilens.sinks import tables as sk

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "w03_trailing_baseline", "w04_rs_rating", "w05_back_adjust_factor", "w22_macd_kdj", "d01_trend_template", "d12_bull_engulfing",
    "d24_no_supply", "d32_diagnose", "d33_levels", "d34_fifo_matches", "d34_positions", "d36_retrieve", "g10_sectors_listed",
    "g18_build_quarterly", "j12_statement_known_at_bar", "p01_build_predicate", "q05_backfill_plan", "t01_screen_momentum",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
              " conversations").split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 8) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, FOLDER)
    got = plain(df.columns, df.collect())
    cur = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == plain(names, cur.fetchall())
    assert got or name in ("p01_build_predicate", "t01_screen_momentum")  # few securities at this scale


def test_entry_and_keys(spark):
    assert entry_module.entry(spark).count() > 0
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 200
    assert all(re.match(r"^[a-z]\d\d_|op\d+_|pipeline$", k) for k in queries)


@pytest.fixture(scope="module")
def stored_bars(spark, tmp_path_factory):
    from checks.views import Views

    path = str(tmp_path_factory.mktemp("bars"))
    sk.write_adjusted(Views(spark, FOLDER).adjusted, path)
    return sk.read_fact(spark, path)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan
    return plan.count("Exchange hashpartitioning")


def test_one_exchange_per_series(stored_bars):
    assert exchanges(technical.technical_flags(stored_bars)) == 1
    assert exchanges(candles.pattern_flags(stored_bars)) == 1
    assert exchanges(vpa.vpa_flags(stored_bars)) == 1
    assert exchanges(candles.pattern_events(stored_bars, 90)) == 1
    assert exchanges(adjust.adjust_prices(stored_bars, None, None)) <= 1


def test_newest_rows_are_limited_before_the_shuffle(stored_bars):
    plan = last_n(stored_bars, 12)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_only_needed_columns_are_read(stored_bars):
    plan = technical.moving_averages(stored_bars).select("stock_id", "ma20")._jdf.queryExecution().executedPlan().toString()
    assert "adj_open" not in plan.split("ReadSchema")[-1]


def test_as_of_join_is_one_shuffle_without_range_join(spark, stored_bars):
    facts = stored_bars.selectExpr("stock_id", "trade_date as known", "close as roe")
    plan = as_of_known(stored_bars.select("stock_id", "trade_date"), facts, "known", ["roe"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_recent_days_open_recent_years_only(spark, tmp_path):
    import datetime as dt

    from equilens.operators.market import latest_bars
    from equilens.plans.snapshot import price_features

    path = str(tmp_path / "bars")
    rows = [("A", dt.date(2015 + i // 4, 1 + 3 * (i % 4), 5), *[10.0 + i] * 9, 1) for i in range(44)]
    names = "open high low close adj_open adj_high adj_low adj_close amount".split()
    df = spark.createDataFrame(rows, "stock_id string, trade_date date, " + ", ".join(f"{n} double" for n in names) + ", volume long")
    sk.write_fact(df, path, sk.by_year())

    def years(frame):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            frame = frame.select("*")
            frame.collect()
            leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        scans = [leaves.apply(i) for i in range(leaves.size())]
        return [x.metrics().get("numPartitions").get().value() for x in scans if x.metrics().contains("numPartitions")]

    whole, part = sk.read_fact(spark, path), sk.read_fact(spark, path, partitioned=True)
    for view in (lambda b: price_features(b, 400), lambda b: latest_bars(b, 200)):
        assert sorted(map(str, view(whole).collect())) == sorted(map(str, view(part).select(*view(whole).columns).collect()))
        assert years(view(part)) and max(years(view(part))) <= 2 and max(years(view(whole))) == 11


def test_the_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) >= 250 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)
