import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from equilens.functions import parse
from equilens.sources import feeds, landed
from equilens.sources import market_files as mf
from equilens.sources import tables as tb

D = dt.date
DAY = "2026-07-09"


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def cells(*values):
    return ",".join(f'"{v}"' for v in values)


def test_month_bars_of_both_boards(spark, tmp_path, rows):
    put(tmp_path / "2330" / "2330_201001.csv", "\r\n".join([
        "99年01月 2330 台積電 各日成交資訊", cells("日期", "成交股數", "成交金額", "開盤價", "最高價", "最低價", "收盤價", "漲跌", "筆數"),
        cells(" 99/01/04", "39,511,138", "2,557,720,928", "65.00", "65.00", "64.00", "64.90", "0", "1"),
        cells(" 99/01/04", "1", "1", "1", "1", "1", "1", "0", "1"),
        cells(" 99/01/05", "1", "1", "--", "--", "--", "--", "0", "0"), "說明:", ""]), "big5")
    put(tmp_path / "6488" / "6488_201001.csv", "﻿日期,成交股數(張),成交金額(千元),開盤,最高,最低,收盤,漲跌,成交筆數\r\n"
        "99/01/04,12,340.5,10,11,9,10.5,0,3\r\n")
    put(tmp_path / "2330" / "2330_adj.csv", "date\n2010-01-04\n")
    got = rows(mf.read_month_bars(spark, str(tmp_path)).select("stock_id", "trade_date", "volume", "close", "market"))
    assert got == [("2330", D(2010, 1, 4), 39511138.0, 64.9, "上市"), ("6488", D(2010, 1, 4), 12.0, 10.5, "上櫃")]


def test_daily_listed_reads_only_its_section(spark, tmp_path, rows):
    body = [cells("2330", "x", "1", "1", "1", "9", "9", "9", "9", "+", "1"),
            cells("證券代號", "證券名稱", "成交股數", "筆數", "金額", "開", "高", "低", "收", "漲跌", "價差"),
            '="0050",' + cells("元大台灣50", "1,000", "5", "100,000", "99", "101", "98", "100", "+", "1.50"),
            cells("2330", "台積電", "10", "5", "1", "--", "--", "--", "--", " ", "0.00"), cells("短", "列")]
    put(tmp_path / "20260709.csv", "\r\n".join(body), "big5")
    got = mf.read_daily_listed(spark, str(tmp_path)).select("stock_id", "trade_date", "close", "volume", "amount", "trades", "change")
    assert rows(got) == [("0050", D(2026, 7, 9), 100.0, 1000, 100000, 5, "+1.50")]


def otc(path, data, name):
    return put(path / f"{name}_20260709.json", json.dumps({"tables": [{"data": data}]}, ensure_ascii=False))


def test_daily_otc(spark, tmp_path, rows):
    otc(tmp_path, [["6488", "環球晶", "500", "+1", "490", "505", "489", "1,000", "500,000", "7"],
                   ["6489", "x", "---", "", "", "", "", "0", "0", "0"]], "otc")
    # cell order of the payload: 0 code, 2 close, 3 change, 4 open, 5 high, 6 low, 7 shares, 8 amount, 9 trades
    got = mf.read_daily_otc(spark, str(tmp_path)).select("stock_id", "trade_date", "open", "high", "low", "close", "volume", "trades")
    assert rows(got) == [("6488", D(2026, 7, 9), 490.0, 505.0, 489.0, 500.0, 1000, 7)]
    otc(tmp_path / "empty", [], "none")
    assert mf.read_daily_otc(spark, str(tmp_path / "empty")).count() == 0


def test_institutional(spark, tmp_path, rows):
    numbers = [str(100 + i) for i in range(19)]
    put(tmp_path / "l" / "a.csv", cells("2330", *numbers[1:]) + "\r\n" + cells("2331", "1") + "\r\n" + cells("合計", *numbers[1:]), "big5")
    assert rows(mf.read_inst_listed(spark, str(tmp_path / "l"), as_of_date=DAY)) == [("2330", D(2026, 7, 9), 104, 107, 110, 114, 117)]
    otc(tmp_path / "o", [["6488"] + [str(100 + i) for i in range(1, 20)], ["6489", "1"]], "inst")
    assert rows(mf.read_inst_otc(spark, str(tmp_path / "o"))) == [("6488", D(2026, 7, 9), 104, 107, 113, 116, 119)]


def test_margin(spark, tmp_path, rows):
    line = cells("2330", "x", *[str(i) for i in range(2, 13)])
    put(tmp_path / "l" / "a.csv", "\r\n".join([line.replace("2330", "9999"), cells("代號", "名稱"), line]), "big5")
    assert rows(mf.read_margin_listed(spark, str(tmp_path / "l"), as_of_date=DAY)) == [("2330", D(2026, 7, 9), 6, 12, 2, 3, 9, 8)]
    otc(tmp_path / "o", [["6488"] + [str(i) for i in range(1, 15)]], "margin")
    assert rows(mf.read_margin_otc(spark, str(tmp_path / "o"))) == [("6488", D(2026, 7, 9), 6, 14, 3, 4, 11, 12)]


def test_foreign(spark, tmp_path, rows):
    put(tmp_path / "l" / "a.csv", cells("2330", "n", "i", "1,000", "x", "700", "x", "70.00"), "big5")
    assert rows(mf.read_foreign_listed(spark, str(tmp_path / "l"), as_of_date=DAY)) == [("2330", D(2026, 7, 9), 70.0, 700, 1000)]
    otc(tmp_path / "o", [["1", "6488", "n", "1,000", "x", "500", "x", "50.5%"]], "qfii")
    assert rows(mf.read_foreign_otc(spark, str(tmp_path / "o"))) == [("6488", D(2026, 7, 9), 50.5, 500, 1000)]


def test_valuation(spark, tmp_path, rows):
    put(tmp_path / "l" / "a.csv", cells("2330", "n", "600", "2.50", "112", "20.1", "5.0"), "big5")
    assert rows(mf.read_valuation_listed(spark, str(tmp_path / "l"), as_of_date=DAY)) == [("2330", D(2026, 7, 9), 20.1, 5.0, 2.5)]
    feed = [{"Date": "1150709", "SecuritiesCompanyCode": "6488", "PriceEarningRatio": "-", "PriceBookRatio": "3.1", "YieldRatio": "1.2"},
            {"Date": "1150708", "SecuritiesCompanyCode": "6489", "PriceEarningRatio": "9", "PriceBookRatio": "1", "YieldRatio": "1"}]
    put(tmp_path / "o" / "v.json", json.dumps(feed))
    assert rows(mf.read_valuation_otc(spark, str(tmp_path / "o"), as_of_date=DAY)) == [("6488", D(2026, 7, 9), None, 3.1, 1.2)]


def test_month_revenue_of_known_codes(spark, tmp_path, rows):
    def row(code, ym):
        return {"資料年月": ym, "公司代號": code, "營業收入-當月營收": "1,234", "營業收入-上月比較增減(%)": "1.5", "營業收入-去年同月增減(%)": ""}

    a = put(tmp_path / "a.json", json.dumps([row("2330", "11506"), row("9999", "11506"), row("2331", "bad")], ensure_ascii=False))
    b = put(tmp_path / "b.json", json.dumps([row("6488", "11506")], ensure_ascii=False))
    stock = spark.createDataFrame([("2330",), ("2331",), ("6488",)], "stock_id string")
    got = rows(mf.read_month_revenue(spark, [a, b], stock))
    assert got == [(c, D(2026, 6, 1), 1234000, 1.5, None, D(2026, 7, 10)) for c in ("2330", "6488")]


def test_holder_dist(spark, tmp_path, rows):
    path = put(tmp_path / "h.csv", "資料日期,證券代號,持股分級,人數,股數,占比\n20260703,2330 ,1,10,100,0.5\n20260703,2330,15,2,900,80.25\n"
               "20260703,2330,16,0,0,0\n20260703,2330,17,12,1000,100\n2026070,2330,1,1,1,1\n20260703,9999,1,1,1,1\n")
    stock = spark.createDataFrame([("2330",)], "stock_id string")
    assert rows(mf.read_holder_dist(spark, path, stock)) == [
        ("2330", D(2026, 7, 3), 1, 10, 100, 0.5), ("2330", D(2026, 7, 3), 15, 2, 900, 80.25)]


@pytest.mark.parametrize("wrap", [lambda r: {"a1": [{"msgArray": r, "rtCode": "0"}]}, lambda r: r, lambda r: {"x": {"y": {"msgArray": r}}}])
def test_etf_nav_at_any_depth(spark, tmp_path, rows, wrap):
    records = [{"a": "0050", "b": "元大{台灣50", "c": "1,000", "e": "150.5", "f": "149", "g": "1.0", "i": "20260709"},
               {"a": "0050", "c": "1", "e": "1", "i": "20260709"}, {"a": "0056", "c": "10", "f": "30", "i": "20260709"},
               {"a": "0057", "i": "20260709"}, {"a": "", "e": "1", "i": "20260709"}]
    records[0]["b"] = "元大台灣50"
    path = put(tmp_path / "nav.json", json.dumps(wrap(records), ensure_ascii=False))
    got = rows(mf.read_etf_nav(spark, path))
    assert got == [("0050", D(2026, 7, 9), 150.5, 149.0, 1000.0, 150500.0, 1.0), ("0056", D(2026, 7, 9), None, 30.0, 10.0, None, None)]


def test_index_files(spark, tmp_path, rows):
    put(tmp_path / "l" / "m.csv", cells("日期", "a", "b", "c", "指數", "d") + "\r\n" + cells("115/07/09", "1", "1", "1", "23,456.78", "1"), "big5")
    assert rows(mf.read_index_month(spark, str(tmp_path / "l"), "TWSE")) == [("TWSE", D(2026, 7, 9), 23456.78)]
    otc(tmp_path / "o", [["115/07/09", "1", "1", "1", "250.5"], ["115/07/10", "1", "1", "1", "n/a"]], "index")
    assert rows(mf.read_index_month(spark, str(tmp_path / "o"), "TPEx", otc=True)) == [("TPEx", D(2026, 7, 9), 250.5)]
    put(tmp_path / "Index" / "TAIEX.csv", "﻿date,price\n2026-07-09,100.5\nbad,1\n")
    assert rows(tb.read_index_dir(spark, str(tmp_path / "Index"))) == [("TAIEX", D(2026, 7, 9), 100.5)]


def test_security_master(spark, tmp_path, rows):
    lines = ["有價證券代號及名稱\tISIN\t上市日\t市場別\t產業別\tCFICode\t備註", "股票\t\t\t\t\t\t",
             "2330　台積電\tTW0002330008\t1994/09/05\t上市\t半導體業\tESVUFR\t", "2330　重複\tTW0002330008\t1994/09/05\t上市\t半導體業\tESVUFR\t",
             "上市認購(售)權證\t\t\t\t\t\t",
             "030001　權證\tTW03\t2026/01/01\t上市\t\tRWSCCA\t", "ETF\t\t\t\t\t\t", "0050　元大台灣50\tTW0050\t2003/06/30\t上市\t\tCEOGEU\t"]
    path = put(tmp_path / "list.txt", "\n".join(lines))
    got = tb.read_security_master(spark, path, "all")
    assert rows(got) == [("0050", "元大台灣50", "上市", D(2003, 6, 30), "", "etf"),
                         ("2330", "台積電", "上市", D(1994, 9, 5), "半導體業", "stock")]
    assert [r[0] for r in rows(tb.read_security_master(spark, path, "etf"))] == ["0050"]
    filed = spark.createDataFrame([(" 2330 ", "台積電", "上市", "1994/09/05", ""), ("", "x", "", "", "")],
                                  "`股票代碼` string, `中文名稱` string, `市場別` string, `上市櫃日期` string, `產業別` string")
    assert rows(tb.load_security_master(filed)) == [("2330", "台積電", "上市", D(1994, 9, 5), None, "stock")]


def test_master_json_and_statements(spark, tmp_path, rows):
    a = put(tmp_path / "a.json", json.dumps([{"公司代號": "2330", "公司簡稱": "台積電", "產業別": "24", "x": 1}], ensure_ascii=False))
    b = put(tmp_path / "b.json", json.dumps([{"公司代號": "6488", "公司簡稱": "環球晶", "產業別": "24"}], ensure_ascii=False))
    assert rows(tb.combine_master_json(spark, a, b)) == [("2330", "台積電", "上市", "24"), ("6488", "環球晶", "上櫃", "24")]
    s = put(tmp_path / "s.json", json.dumps({"data": [{"date": "2026-03-31", "stock_id": "2330", "type": "Revenue", "value": 10.5}]}))
    assert rows(tb.read_statement_long(spark, s, "income")) == [("2330", D(2026, 3, 31), "income", "Revenue", 10.5)]


def test_per_security_datasets(spark, tmp_path, rows):
    put(tmp_path / "6488" / "6488_adj.csv", "﻿date,open,high,low,close,volume,amount,adj_open,adj_high,adj_low,adj_close,cumfactor\n"
        "2026-07-09,1,2,1,2,3,4,1,2,1,2,1.0\nbad,1,2,1,2,3,4,1,2,1,2,1.0\n")
    stock = spark.createDataFrame([("6488", "上櫃"), ("2330", "上市")], "stock_id string, market string")
    bars = tb.load_prices(spark, str(tmp_path), stock)
    assert rows(bars.select("stock_id", "trade_date", "close", "volume", "amount")) == [("6488", D(2026, 7, 9), 2.0, 3000, 4000)]
    f = tmp_path / "Fundamentals" / "2330"
    put(f / "2330_revenue.csv", "date,revenue,revenue_month,revenue_year,月增率(%),年增率(%)\n2026-07-01,100,6,2026,1.5,inf\n2026-08-01,50,,,,\n")
    assert rows(tb.load_revenue(spark, str(f))) == [
        ("2330", D(2026, 6, 1), 100, 1.5, None, D(2026, 7, 10)), ("2330", D(2026, 8, 1), 50, None, None, D(2026, 9, 10))]
    put(f / "2330_dividend.csv", "AnnouncementDate,year,CashEarningsDistribution,CashStatutorySurplus,StockEarningsDistribution,"
        "StockStatutorySurplus,CashExDividendTradingDate,StockExDividendTradingDate,CashDividendPaymentDate\n"
        "2026-06-01,114年,0,0,0,0,,,\n2026-06-01,114年,3.5,0.5,,,2026-07-10,,2026-08-01\n")
    got = rows(tb.load_dividend(spark, str(f)))
    assert got == [("2330", D(2026, 6, 1), "114年", 4.0, 0.0, D(2026, 7, 10), None, D(2026, 8, 1))]
    put(f / "2330_margin.csv", "date,MarginPurchaseTodayBalance,ShortSaleTodayBalance\n2026-07-09,\"1,000\",5\n")
    assert rows(tb.load_margin(spark, str(f)).select("stock_id", "margin_balance", "short_balance", "margin_buy")) == [("2330", 1000, 5, None)]
    put(f / "2330_institutional.csv", "date,Foreign_Investor_net,Dealer_self_net\n2026-07-09,-7,2\n")
    assert rows(tb.load_inst(spark, str(f)).select("foreign_net", "dealer_self_net", "trust_net")) == [(-7, 2, None)]
    put(f / "2330_per.csv", "date,PER,PBR,dividend_yield\n2026-07-09,20.5,5,1.5\n")
    assert rows(tb.load_per(spark, str(f))) == [("2330", D(2026, 7, 9), 20.5, 5.0, 1.5)]
    put(f / "2330_shareholding.csv", "date,ForeignInvestmentSharesRatio,ForeignInvestmentShares,NumberOfSharesIssued\n2026-07-09,70.5,7,10\n")
    assert rows(tb.load_shareholding(spark, str(f))) == [("2330", D(2026, 7, 9), 70.5, 7, 10)]
    put(f / "2330_capreduction.csv", "date,ClosingPriceonTheLastTradingDay,PostReductionReferencePrice,ReasonforCapitalReduction\n2026-07-09,10,12,x\n")
    assert rows(tb.load_capreduction(spark, str(f))) == [("2330", D(2026, 7, 9), 10.0, 12.0, "x")]


def test_codes_and_encoding(spark, tmp_path, rows):
    path = put(tmp_path / "codes.txt", "0050, 0056\n2330 0050\n\n")
    assert rows(tb.read_codes(spark, path)) == [("0050",), ("0056",), ("2330",)]
    put(tmp_path / "f" / "a.csv", "﻿上櫃")
    put(tmp_path / "f" / "b.csv", "上市", "big5")
    found = landed.files(spark, str(tmp_path / "f"))
    from pyspark.sql import functions as F

    got = found.select(landed.sniff_text(F.col("content")), landed.sniff_market(F.col("content")))
    assert rows(got) == [("上市", "上市"), ("上櫃", "上櫃")]


def test_rss(spark, tmp_path, rows):
    path = put(tmp_path / "feed.xml", """<?xml version="1.0"?><rss><channel><title>t</title>
<item><title>A</title><link>http://x/1</link><pubDate>Tue, 07 Jul 2026 08:00:00 GMT</pubDate><source url="http://s">Src</source>
<description>&lt;a href="q"&gt;body&lt;/a&gt; text</description></item>
<item><title>B</title><link>http://x/2</link></item><item><title>no link</title></item></channel></rss>""")
    got = feeds.read_rss(spark, path, "2330").orderBy("url").collect()
    assert [tuple(r) for r in got] == [
        ("2330", "A", "body text", "Src", "http://x/1", dt.datetime(2026, 7, 7, 8)),
        ("2330", "B", "B", "Google News", "http://x/2", None)]


def test_each_file_is_read_by_its_own_heading(spark, tmp_path, rows):
    put(tmp_path / "p" / "1_per.csv", "date,PER,PBR,dividend_yield\n2026-07-09,10,1.5,3\n")
    put(tmp_path / "p" / "2_per.csv", "\ufeffdividend_yield, date ,PBR,PER,extra\r\n2.2,2026-07-09,5.5,25,\"a,b\"\r\n\r\n")
    put(tmp_path / "p" / "3_per.csv", "date,PER\n2026-07-09,\n")
    assert rows(tb.load_per(spark, str(tmp_path / "p"))) == [
        ("1", D(2026, 7, 9), 10.0, 1.5, 3.0), ("2", D(2026, 7, 9), 25.0, 5.5, 2.2), ("3", D(2026, 7, 9), None, None, None)]
    put(tmp_path / "i" / "TAIEX.csv", "date,price\n2026-07-09,\"1,000.5\"\n")
    put(tmp_path / "i" / "TPEx.csv", "close,date\n200,2026-07-09\n")
    assert rows(tb.read_index_dir(spark, str(tmp_path / "i"))) == [("TAIEX", D(2026, 7, 9), 1000.5), ("TPEx", D(2026, 7, 9), 200.0)]


def test_wide_statements_of_different_items(spark, tmp_path, rows):
    from equilens.operators.fundamentals import build_quarterly

    put(tmp_path / "1_financials.csv", "date,stock_id,Revenue,GrossProfit\n2026-03-31,1,100,40\n2026-06-30,1,200,\n")
    put(tmp_path / "2_financials.csv", "EPS,date,Revenue\n1.5,2026-03-31,50\n")
    long = tb.load_statement(spark, str(tmp_path), "_financials", "income")
    assert rows(long.select("stock_id", "period_date", "item", "value")) == [
        ("1", D(2026, 3, 31), "GrossProfit", 40.0), ("1", D(2026, 3, 31), "Revenue", 100.0), ("1", D(2026, 6, 30), "Revenue", 200.0),
        ("2", D(2026, 3, 31), "EPS", 1.5), ("2", D(2026, 3, 31), "Revenue", 50.0)]
    got = build_quarterly(long).select("stock_id", "period_date", "revenue", "gross_profit", "eps")
    assert rows(got) == [("1", D(2026, 3, 31), 100, 40, None), ("1", D(2026, 6, 30), 200, None, None), ("2", D(2026, 3, 31), 50, None, 1.5)]


def test_cells_of_odd_lines(spark):
    from equilens.functions.parse import csv_cells

    lines = ['a,b', ',a,', '"x,y",z', '="0050",1', '"say ""hi""",2', 'a"b,c', '', '"1,234"," 5 "']
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").orderBy("i").select(csv_cells(F.col("x"))).collect()
    assert [r[0] for r in got] == [["a", "b"], ["", "a", ""], ["x,y", "z"], ['="0050"', "1"], ['say "hi"', "2"], ['a"b', "c"], [""], ["1,234", " 5 "]]


def test_fund_names_with_brackets_and_nested_values(spark, tmp_path):
    put(tmp_path / "n.json", '{"x": {"msgArray": [{"a": "1", "b": "Fund [TW] {x} \\"q\\"", "c": "10", "e": "2", "f": "1", "i": "20260709"},'
        ' {"a": "2", "n": [1, 2], "o": {"p": 1}, "c": "5", "e": "3", "i": "20260709"}]}, "y": {"z": {"a": "3", "c": "1", "f": "4", "i": "20260709"}}}')
    assert sorted(r.stock_id for r in mf.read_etf_nav(spark, str(tmp_path)).collect()) == ["1", "2", "3"]


def test_a_line_is_taken_apart_once(spark, tmp_path):
    """Filters on cells must not parse the line anew, nor the search for the header whole lines."""
    found = spark.createDataFrame([("daily/2026-01-05/a", b"x", None)], "path string, content binary, trade_date date")
    for parser in (mf.daily_listed_rows, mf.margin_listed_rows, mf.inst_listed_rows):
        assert parser(found)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    plan = mf.daily_otc_rows(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_first_cell_and_numbers_as_before(spark):
    lines = ['"a""b",c', ' "x" ,y', "", '"', '""', "a,b", '"1,2"', 'a"b', '="0050",x']
    got = spark.createDataFrame([(x,) for x in lines], "x string").select(
        parse.csv_cells(F.col("x"))[0], parse.first_csv_cell(F.col("x"))).collect()
    assert [r[0] for r in got] == [r[1] for r in got] == ['a"b', "x", "", '"', "", "a", "1,2", 'a"b', '="0050"']
    texts = ["1,234.5", "-0.5", "1e999", "-1e999", "nan", "--", "X", "", None, " 7 ", '"8"', "1e3", "0"]
    nums = spark.createDataFrame([(x,) for x in texts], "x string").select(parse.parse_num(F.col("x")), parse.to_num(F.col("x"))).collect()
    assert [r[0] for r in nums] == [1234.5, -0.5, None, None, None, None, None, None, None, 7.0, None, 1000.0, 0.0]
    assert [r[1] for r in nums] == [1234.5, -0.5, None, None, None, None, None, None, None, 7.0, 8.0, 1000.0, 0.0]
