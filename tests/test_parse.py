import datetime as dt

from pyspark.sql import functions as F

from equilens.functions import calendar as cal
from equilens.functions import parse as p

D = dt.date


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x")).alias("y")).collect()]


def test_parse_num(spark):
    got = column(spark, ["1,234.5", " 7 ", "", "nan", "None", "--", "inf", "-inf", "abc", "1e3", "-2", "1e999", None, "5d"], p.parse_num)
    assert got == [1234.5, 7.0, None, None, None, None, None, None, None, 1000.0, -2.0, None, None, None]


def test_parse_bigint_rounds_half_even(spark):
    assert column(spark, ["2.5", "3.5", "1,000", "x"], p.parse_bigint) == [2, 4, 1000, None]


def test_to_num(spark):
    assert column(spark, ['"1,234"', "---", "X", "x", "--", "12.5"], p.to_num) == [1234.0, None, None, None, None, 12.5]


def test_iso_date(spark):
    got = column(spark, ["2023/01/03", "1962-02-09 00:00", "2023-1-3", "20230103", "", None], p.iso_date)
    assert got == [D(2023, 1, 3), D(1962, 2, 9), None, None, None, None]


def test_roc_dates(spark):
    assert column(spark, ['"112/03/16"', " 99/01/04", "112/3/6", "日期", "112/13/01"], p.roc_date) == [
        D(2023, 3, 16), D(2010, 1, 4), D(2023, 3, 6), None, None]
    assert column(spark, ["11506", "115006", "1150", "abcde"], p.roc_month) == [D(2026, 6, 1), D(2026, 6, 1), None, None]


def test_other_dates(spark):
    assert column(spark, ["20260709", "2026-07-09", "x"], p.ymd_date) == [D(2026, 7, 9), None, None]
    assert column(spark, ["1150709", "20260709", "2026/07/09", "2026-07-09T00:00", "?"], p.any_date) == [D(2026, 7, 9)] * 4 + [None]


def test_codes(spark):
    values = ['="0050"', "2330 ", "00679B", "12", "2330AB", "合計"]
    assert column(spark, values, p.clean_code)[:3] == ["0050", "2330", "00679B"]
    assert column(spark, values, p.is_security_code) == [True, True, True, False, False, False]


def test_to_lots(spark):
    assert column(spark, ["1000", "1500", "1234567", "", "10000000000", "1"], p.to_lots) == [
        "1", "1.5", "1234.567", "0", "10000000", "0.001"]


def test_signed_change_and_traded(spark):
    df = spark.createDataFrame([("+", "1.5"), ("-", " 2 "), ("X", "0.00"), (" ", "3")], "s string, m string")
    assert [r[0] for r in df.select(p.signed_change(F.col("s"), F.col("m"))).collect()] == ["+1.5", "-2", "0.00", "3"]
    assert column(spark, ["--", "", "---", " 10 "], p.traded) == [False, False, False, True]


def test_text(spark):
    assert column(spark, ["<b>a</b> b<br/>"], p.strip_tags) == ["a b"]
    got = column(spark, ["Tue, 07 Jul 2026 08:00:00 GMT", "07 Jul 2026 08:00:00 +0800", "7 Jul 2026 08:00:00", "soon", None], p.parse_rfc822)
    assert got == [dt.datetime(2026, 7, 7, 8), dt.datetime(2026, 7, 7, 0), dt.datetime(2026, 7, 7, 8), None, None]
    assert column(spark, ['"1,234",a,"say ""x""",,'], p.csv_cells) == [["1,234", "a", 'say "x"', "", ""]]


def test_payload_rows(spark):
    got = column(spark, ['{"tables":[{"data":[["1","2"],["3",4]]}]}', '{"tables":[]}', '{"data":[["9"]]}', "{}"], p.payload_rows)
    assert got == [[["1", "2"], ["3", "4"]], None, [["9"]], None]


def test_calendar_rules(spark):
    days = [D(2026, 3, 31), D(2026, 6, 30), D(2026, 9, 30), D(2025, 12, 31), D(2026, 2, 28)]
    assert column(spark, days, cal.statement_available, "date") == [
        D(2026, 5, 15), D(2026, 8, 14), D(2026, 11, 14), D(2026, 3, 31), D(2026, 2, 28)]
    assert column(spark, [D(2025, 12, 1), D(2026, 1, 1)], cal.revenue_available, "date") == [D(2026, 1, 10), D(2026, 2, 10)]
    assert column(spark, [D(2026, 4, 1), D(2026, 5, 15), D(2026, 5, 16), D(2026, 8, 15), D(2026, 11, 15), D(2026, 7, 1)],
                  cal.publishable_quarter, "date") == ["2025Q4", None, "2026Q1", "2026Q2", "2026Q3", None]
    assert column(spark, [D(2027, 1, 1), D(2026, 7, 8)], cal.iso_week_label, "date") == ["2026W53", "2026W28"]
    assert column(spark, [D(2026, 7, 11), D(2026, 7, 13), D(2026, 9, 12)], cal.in_dividend_season, "date") == [True, False, False]


def test_revenue_month_and_start(spark):
    df = spark.createDataFrame([("2026", "6"), ("1899", "1"), ("2026", "13"), ("x", "1")], "y string, m string")
    assert [r[0] for r in df.select(cal.revenue_month(F.col("y"), F.col("m"))).collect()] == [D(2026, 6, 1), None, None, None]
    df = spark.createDataFrame([(D(2015, 3, 9), "上市"), (D(1990, 1, 1), "上市"), (D(1990, 1, 1), "上櫃"), (None, "上櫃")],
                               "d date, m string")
    assert [r[0] for r in df.select(cal.effective_start(F.col("d"), F.col("m"))).collect()] == [
        D(2015, 3, 1), D(2010, 1, 1), D(1994, 1, 1), D(1994, 1, 1)]


def test_csv_cells_of_plain_lines_equal_those_taken_cell_by_cell(spark):
    import itertools

    lines = ["".join(x) for n in range(6) for x in itertools.product('",a', repeat=n)] + ['"a\r","b"', '"1,2","",', 'x,"a"', '"a" ,"b"', "a, b ,", '" "']
    slow = lambda x: F.transform(F.regexp_extract_all(F.concat(F.lit(","), x), F.lit(p._CSV_CELL), 1), p._unquoted)
    assert column(spark, lines, p.csv_cells) == column(spark, lines, slow)


def test_clean_code_without_wrapping(spark):
    assert column(spark, [" 2330 ", '="0050"', '"1101"', "==x", None, ""], p.clean_code) == ["2330", "0050", "1101", "x", None, ""]
