"""Files and stored tables: the given tables are written as files land, read by the library and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from checks.registry import query
from checks.signal_queries import _LEDGER
from checks.text_queries import _scratch
from checks.views import Views
from equilens.functions.parse import ROC_YEAR_OFFSET
from equilens.operators.adjust import dividend_events, reduction_events
from equilens.operators.fundamentals import best_dividends
from equilens.operators.relational import latest_row, union_all
from equilens.plans.readjust import read_adjusted, readjust
from equilens.sinks import checked
from equilens.sinks import revisions as rv
from equilens.sinks import tables as sk
from equilens.sources import market_files as mf
from equilens.sources import tables as tb
from equilens.sources.landed import date_in_path, files
from equilens.streaming import jobs, landing, lots

# -- day files: one per day and kind, a folder per day -----------------------------------------

def _code() -> Column:
    return F.substring("stock_id", -6, 6)


def _cells(size: int, at: dict[int, Column]) -> Column:
    return F.array(*[F.coalesce(at[i].cast("string"), F.lit("")) if i in at else F.lit("") for i in range(size)])


def _whole(c: str) -> Column:
    return F.format_number(c, 0)


def _price(c: str) -> Column:
    return F.format_number(c, 4)


def _csv_files(rows: DataFrame, path: str, head: str | None = None) -> str:
    """Lines of quoted cells in Big5, one file per day; ``head`` opens the section of securities."""
    lines = rows.select("day", F.lit(1).alias("at"), F.concat(F.lit('"'), F.array_join("cells", '","'), F.lit('"')).alias("value"))
    if head:
        first = rows.select("day").distinct()
        lines = lines.unionByName(first.select("day", F.lit(-1).alias("at"), F.lit("標題").alias("value"))).unionByName(
            first.select("day", F.lit(0).alias("at"), F.lit(f'"{head}","名稱"').alias("value")))
    lines = lines.repartition("day").sortWithinPartitions("day", "at").select("value", "day")
    # The text writer knows UTF-8 only; as CSV of one column that is not quoted, a line stays as it is.
    lines.write.partitionBy("day").options(encoding="Big5", sep="\u0001", quote="", escapeQuotes="false").csv(path)
    return path


# What stands around the rows in a payload of the OTC board.
TABLE = ('{"tables":[{"data":[', "]}]}")


def _json_files(rows: DataFrame, path: str, entry: Column | None = None, head: str = TABLE[0], tail: str = TABLE[1]) -> str:
    """One payload per day: an array of what ``entry`` makes of each row, between ``head`` and ``tail``, an entry to a
    line; the tables of the OTC board unless others are given."""
    day = Window.partitionBy("day").orderBy(F.lit(0))
    value = F.concat(
        F.when(F.row_number().over(day) == 1, head).otherwise(","), F.col("entry"),
        F.when(F.lead(F.lit(0)).over(day).isNull(), tail).otherwise(""))
    entries = rows.select("day", F.to_json(F.col("cells") if entry is None else entry).alias("entry"))
    entries.select(value.alias("value"), "day").write.partitionBy("day").text(path)
    return path


def _rows(df: DataFrame, size: int, at: dict[int, Column]) -> DataFrame:
    return df.select(F.col("trade_date").alias("day"), _cells(size, at).alias("cells"))


def _valuations() -> Column:
    return F.struct(
        F.date_format("day", "yyyyMMdd").alias("Date"), F.col("code").alias("SecuritiesCompanyCode"), F.col("per").alias("PriceEarningRatio"),
        F.col("pbr").alias("PriceBookRatio"), F.col("yield").alias("YieldRatio"))


def _valuation_rows(v: Views) -> DataFrame:
    return v.valuation.select(
        F.col("trade_date").alias("day"), _code().alias("code"), _price("per").alias("per"), _price("pbr").alias("pbr"), _price("dividend_yield").alias("yield"))


LAND = {
    "daily_listed": lambda v, path: _csv_files(_rows(v.bars, 11, {
        0: _code(), 1: F.lit("名稱"), 2: _whole("volume"), 3: _whole("trades"), 4: _whole("amount"), 5: _price("open"), 6: _price("high"),
        7: _price("low"), 8: _price("close"), 9: F.lit("+"), 10: F.lit("1.00")}), path, mf.DAILY_SECTION),
    "daily_otc": lambda v, path: _json_files(_rows(v.bars, 10, {
        0: _code(), 2: _price("close"), 3: F.lit("+1"), 4: _price("open"), 5: _price("high"), 6: _price("low"), 7: _whole("volume"),
        8: _whole("amount"), 9: _whole("trades")}), path),
    "inst_listed": lambda v, path: _csv_files(_rows(v.inst, 19, {0: _code(), 4: _whole("foreign_net"), 10: _whole("trust_net"), 14: _whole("dealer_self_net")}), path),
    "inst_otc": lambda v, path: _json_files(_rows(v.inst, 20, {0: _code(), 4: _whole("foreign_net"), 13: _whole("trust_net"), 16: _whole("dealer_self_net")}), path),
    "margin_listed": lambda v, path: _csv_files(_rows(v.margin, 13, {0: _code(), 6: _whole("margin_balance"), 12: _whole("short_balance")}), path, mf.MARGIN_SECTION),
    "margin_otc": lambda v, path: _json_files(_rows(v.margin, 15, {0: _code(), 6: _whole("margin_balance"), 14: _whole("short_balance")}), path),
    "foreign_listed": lambda v, path: _csv_files(_rows(v.shareholding, 8, {
        0: _code(), 3: _whole("shares_issued"), 5: _whole("foreign_shares"), 7: _price("foreign_ratio")}), path),
    "foreign_otc": lambda v, path: _json_files(_rows(v.shareholding, 8, {
        1: _code(), 3: _whole("shares_issued"), 5: _whole("foreign_shares"), 7: F.concat(_price("foreign_ratio"), F.lit("%"))}), path),
    "valuation_listed": lambda v, path: _csv_files(_rows(v.valuation, 7, {
        0: _code(), 5: _price("per"), 6: _price("pbr"), 3: _price("dividend_yield")}), path),
    "valuation_otc": lambda v, path: _json_files(_valuation_rows(v), path, _valuations(), "[", "]"),
}
_BARS = "SELECT right(stock_id, 6) AS stock_id, trade_date, open, high, low, close, volume, amount, trades::INT AS trades FROM fx_bars"
_FOUR = {c: 4 for c in ("open", "high", "low", "close")}
_INST = "SELECT right(stock_id, 6) AS stock_id, trade_date, foreign_net, trust_net, dealer_self_net FROM fx_inst"
_MARGIN = "SELECT right(stock_id, 6) AS stock_id, trade_date, margin_balance::BIGINT AS margin_balance, short_balance FROM fx_margin"
_FOREIGN = "SELECT right(stock_id, 6) AS stock_id, trade_date, foreign_ratio, foreign_shares, shares_issued FROM fx_shareholding"
_VALUATION = "SELECT right(stock_id, 6) AS stock_id, trade_date, per, pbr, dividend_yield FROM fx_valuation"


def _day_files(name: str, kind: str, read, columns: str, sql: str, view: str, **digits: int) -> None:
    def run(v: Views) -> DataFrame:
        path = LAND[kind](v, f"{_scratch(v)}/{kind}")
        return read(v.spark, path).select(*columns.split())

    query(name, run, sql, view, **digits)


_PRICES = "stock_id trade_date open high low close volume amount trades"
_day_files("s03_daily_listed", "daily_listed", mf.read_daily_listed, _PRICES, _BARS, "fx_bars", **_FOUR)
_day_files("s04_daily_otc", "daily_otc", mf.read_daily_otc, _PRICES, _BARS, "fx_bars", **_FOUR)
_NETS = "stock_id trade_date foreign_net trust_net dealer_self_net"
_day_files("s05_inst_listed", "inst_listed", mf.read_inst_listed, _NETS, _INST, "fx_inst")
_day_files("s05_inst_otc", "inst_otc", mf.read_inst_otc, _NETS, _INST, "fx_inst")
_BALANCES = "stock_id trade_date margin_balance short_balance"
_day_files("s06_margin_listed", "margin_listed", mf.read_margin_listed, _BALANCES, _MARGIN, "fx_margin")
_day_files("s06_margin_otc", "margin_otc", mf.read_margin_otc, _BALANCES, _MARGIN, "fx_margin")
_HOLDINGS = "stock_id trade_date foreign_ratio foreign_shares shares_issued"
_day_files("s07_foreign_listed", "foreign_listed", mf.read_foreign_listed, _HOLDINGS, _FOREIGN, "fx_shareholding", foreign_ratio=2)
_day_files("s07_foreign_otc", "foreign_otc", mf.read_foreign_otc, _HOLDINGS, _FOREIGN, "fx_shareholding", foreign_ratio=2)
_RATIOS = "stock_id trade_date per pbr dividend_yield"
_day_files("s08_valuation_listed", "valuation_listed", mf.read_valuation_listed, _RATIOS, _VALUATION, "fx_valuation", per=2, pbr=2, dividend_yield=2)
_day_files("s08_valuation_otc", "valuation_otc", mf.read_valuation_otc, _RATIOS, _VALUATION, "fx_valuation", per=2, pbr=2, dividend_yield=2)

# -- other feeds -------------------------------------------------------------------------------


def _revenue_files(v: Views) -> DataFrame:
    names = mf.REVENUE_FIELDS
    month = F.col("revenue_month")
    ym = F.concat(F.lpad((F.year(month) - ROC_YEAR_OFFSET).cast("string"), 3, "0"), F.date_format(month, "MM"))
    entry = F.struct(
        ym.alias(names["ym"]), F.col("stock_id").alias(names["code"]), F.format_number(F.expr("revenue div 1000"), 0).alias(names["revenue"]),
        F.col("mom_pct").cast("string").alias(names["mom"]), F.col("yoy_pct").cast("string").alias(names["yoy"]))
    path = _json_files(v.revenue.withColumn("day", month), f"{_scratch(v)}/revenue", entry, "[", "]")
    return mf.read_month_revenue(v.spark, path, v.stock).select("stock_id", "revenue_month", "revenue", "mom_pct", "yoy_pct", "available_date")


query("s09_month_revenue", _revenue_files,
      "SELECT stock_id, revenue_month, (revenue // 1000) * 1000 AS revenue, mom_pct, yoy_pct, available_date FROM fx_revenue",
      "fx_revenue", mom_pct=2, yoy_pct=2)


def _holder_files(v: Views) -> DataFrame:
    path = f"{_scratch(v)}/holder"
    v.holder.select(
        F.date_format("data_date", "yyyyMMdd").alias("資料日期"), F.concat("stock_id", F.lit(" ")).alias("證券代號"), F.col("level").alias("持股分級"),
        F.col("holders").alias("人數"), F.col("shares").alias("股數"), F.col("pct").alias("占比")).write.csv(path, header=True)
    return mf.read_holder_dist(v.spark, path, v.stock).withColumn("level", F.col("level").cast("int"))


query("s10_holder_dist", _holder_files, "SELECT stock_id, data_date, level, holders, shares, pct FROM fx_holder", "fx_holder", pct=4)


def _nav_files(v: Views) -> DataFrame:
    record = F.struct(
        F.col("stock_id").alias("a"), F.lit("基金 {x} [y]").alias("b"), _whole("units").alias("c"), _price("nav").alias("e"),
        _price("prev_nav").alias("f"), F.date_format("day", "yyyyMMdd").alias("i"), F.struct(F.array(F.struct(F.lit(1).alias("w"))).alias("u")).alias("h"))
    path = _json_files(v.etf.withColumn("day", F.col("trade_date")), f"{_scratch(v)}/nav", record, '{"a1":[{"msgArray":[', '],"rtCode":"0"}]}')
    return mf.read_etf_nav(v.spark, path, v.stock).select("stock_id", "trade_date", "nav", "prev_nav", "units", "aum")


query("s11_etf_nav", _nav_files, "SELECT stock_id, trade_date, nav, prev_nav, units, units * nav AS aum FROM fx_etf", "fx_etf", nav=4, prev_nav=4, units=0, aum=4)


def _index_files(v: Views, otc: bool) -> DataFrame:
    name = "TPEx" if otc else "TWSE"
    day = F.col("trade_date")
    roc = F.concat_ws("/", (F.year(day) - ROC_YEAR_OFFSET).cast("string"), F.date_format(day, "MM"), F.date_format(day, "dd"))
    rows = v.index.where(F.col("index_id") == name).select(F.trunc(day, "month").alias("day"), _cells(6, {0: roc, 4: _price("close")}).alias("cells"))
    path = (_json_files if otc else _csv_files)(rows, f"{_scratch(v)}/index")
    return mf.read_index_month(v.spark, path, name, otc)


for _otc, _name in ((False, "TWSE"), (True, "TPEx")):
    query(f"s12_index_{'otc' if _otc else 'listed'}", lambda v, otc=_otc: _index_files(v, otc),
          f"SELECT index_id, trade_date, close FROM fx_index WHERE index_id = '{_name}'", "fx_index", close=2)


def _code_lists(v: Views) -> DataFrame:
    path = f"{_scratch(v)}/codes"
    parity = F.col("stock_id").cast("long") % 3
    union_all(v.stock, v.stock.where(parity == 0)).groupBy(parity.alias("k")).agg(F.array_join(F.collect_list("stock_id"), ", ").alias("value")).select(
        "value").write.text(path)
    return tb.read_codes(v.spark, path)


query("s24_code_lists", _code_lists, "SELECT stock_id FROM fx_stock", "fx_stock")


def _stored(v: Views, df: DataFrame, part=None, pk=("stock_id", "trade_date")) -> str:
    path = f"{_scratch(v)}/stored"
    sk.write_fact(df, path, part or sk.by_month(), pk)
    return path


query("s25_scan_prices", lambda v: tb.scan_prices(v.spark, _stored(v, v.bars.select("stock_id", "trade_date", "volume")), ["000000000003", "000000000007"])
      .select("stock_id", "trade_date", "volume"),
      "SELECT stock_id, trade_date, volume FROM fx_bars WHERE stock_id IN ('000000000003', '000000000007')", "fx_bars")
query("s26_scan_trades", lambda v: tb.scan_trades(v.spark, _stored(v, v.trades, pk=("stock_id", "trade_date", "id"))).select("id", "stock_id", "action", "shares"),
      "SELECT id, stock_id, action, shares FROM fx_trades", "fx_trades")

# -- tables ------------------------------------------------------------------------------------


def _landed(v: Views, rows: DataFrame, path: str, *parts: str) -> DataFrame:
    """Rows as a load finds them: stored, so that its steps read them again and don't build them again."""
    rows.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    return v.spark.read.schema(rows.schema).parquet(path)


def _upserted(v: Views) -> DataFrame:
    base, key = _scratch(v), ("stock_id", "trade_date")
    seq = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    ticks = v.ticks.select("stock_id", F.col("d").alias("trade_date"), "price", F.struct(*seq).alias("seq")).dropna(subset=key)
    newest = F.max("seq").over(Window.partitionBy(*key))
    landed = _landed(v, ticks.withColumn("last", (F.col("seq") == newest).cast("int")), f"{base}/landed", "last")
    for last in (0, 1):  # a second load replaces and adds
        sk.upsert(v.spark, f"{base}/t", landed.where(F.col("last") == last).drop("last"), key, order_col="seq")
    return sk.read_fact(v.spark, f"{base}/t")


query("k01_upsert_stored", _upserted, """SELECT stock_id, d AS trade_date, price FROM fx_ticks QUALIFY row_number() OVER (PARTITION BY stock_id, d ORDER BY
      l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) = 1""", "fx_ticks", price=6)


def _day_merged(v: Views) -> DataFrame:
    path, bars = f"{_scratch(v)}/m", v.bars.select("stock_id", "trade_date", "volume")
    sk.merge_day_into_month(v.spark, path, bars)
    day = bars.where(F.col("trade_date") == bars.agg(F.max("trade_date")).scalar())
    sk.merge_day_into_month(v.spark, path, day.withColumn("volume", F.col("volume") + 1))
    return sk.read_fact(v.spark, path)


query("k04_merge_day_stored", _day_merged,
      """SELECT stock_id, trade_date, CASE WHEN trade_date = (SELECT max(trade_date) FROM fx_bars) THEN volume + 1 ELSE volume END AS volume
         FROM fx_bars""", "fx_bars")


def _index_merged(v: Views) -> DataFrame:
    path = f"{_scratch(v)}/i"
    sk.merge_index(v.spark, path, v.index.where("index_id = 'TWSE'"))
    sk.merge_index(v.spark, path, v.index.where("index_id = 'TPEx' and month(trade_date) = 3").withColumn("index_id", F.lit("TWSE")))
    return sk.read_fact(v.spark, path)


query("k11_merge_index_stored", _index_merged,
      """SELECT index_id, trade_date, coalesce(n.close, o.close) AS close FROM (FROM fx_index WHERE index_id = 'TWSE') o
         FULL JOIN (SELECT 'TWSE' AS index_id, trade_date, close FROM fx_index WHERE index_id = 'TPEx' AND month(trade_date) = 3) n
         USING (index_id, trade_date)""", "fx_index", close=4)


def _archived(v: Views) -> DataFrame:
    base = _scratch(v)
    path = LAND["daily_listed"](v, f"{base}/daily_listed")
    for _ in range(2):  # the same day's archive again replaces itself
        sk.archive_raw(files(v.spark, path), f"{base}/archive", "2026-01-05", "daily_listed")
    kept = v.spark.read.parquet(f"{base}/archive").where("source = 'daily_listed'").select("path", "content")
    return mf.daily_listed_rows(kept.withColumn("trade_date", date_in_path(F.col("path")))).select(*_PRICES.split())


query("k05_archive_raw", _archived, _BARS, "fx_bars", **_FOUR)


def _adjusted(v: Views) -> DataFrame:
    path = f"{_scratch(v)}/a"
    sk.write_adjusted(v.adjusted, path)
    return sk.read_fact(v.spark, path)


_ADJUSTED = f"SELECT {', '.join(sk.ADJUSTED)} FROM fx_adjusted"
_ADJ_DIGITS = {"adj_factor": 8} | {c: 6 for c in _FOUR}
query("k06_write_adjusted", _adjusted, _ADJUSTED, "fx_adjusted", **_ADJ_DIGITS)


def _refreshed(v: Views) -> DataFrame:
    path = f"{_scratch(v)}/s"
    sk.refresh_snapshot(v.valuation.limit(1), path)
    sk.refresh_snapshot(latest_row(v.valuation, ["per", "pbr", "dividend_yield"]), path)
    return sk.read_version(v.spark, path)


query("k07_refresh_snapshot", _refreshed, """SELECT stock_id, per, pbr, dividend_yield FROM fx_valuation
      QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) = 1""", "fx_valuation", per=2, pbr=2, dividend_yield=2)


def _nav_snapshot(v: Views) -> DataFrame:
    path, nav = f"{_scratch(v)}/nav", v.etf.select("stock_id", "trade_date", "nav")
    sk.write_nav_snapshot(nav.repartition(4, "trade_date"), path)
    return v.spark.read.schema("stock_id string, nav double, trade_date date").csv(path, header=True)


query("k12_nav_snapshot", _nav_snapshot, "SELECT stock_id, trade_date, nav FROM fx_etf", "fx_etf", nav=4)

_NEWS = "SELECT stock_id, url, title FROM fx_news WHERE stock_id IS NOT NULL"


def _news(v: Views) -> DataFrame:
    return v.news.where("stock_id is not null").select("stock_id", "url", "title", "published_at", "news_id")


def _appended(v: Views) -> DataFrame:
    path, news = f"{_scratch(v)}/news", _news(v)
    for rows in (news.where("news_id % 3 < 2"), news.where("news_id % 3 > 0").withColumn("title", F.when(F.col("news_id") % 3 == 1, "later").otherwise(F.col("title")))):
        sk.append_news(v.spark, path, rows, "news_id")
    return sk.read_fact(v.spark, path).select("stock_id", "url", "title")


query("k13_append_news", _appended, _NEWS, "fx_news")


def _streamed_news(v: Views) -> DataFrame:
    base, news = _scratch(v), _news(v)
    for rows in (news.where("news_id % 3 < 2"), news.where("news_id % 3 > 0")):
        rows.write.mode("append").parquet(f"{base}/src")
        jobs.start_news_dedupe(jobs.arriving(v.spark, f"{base}/src", news.schema), f"{base}/news", f"{base}/ck").awaitTermination()
    return sk.read_fact(v.spark, f"{base}/news").select("stock_id", "url", "title")


query("r03_news_stream", _streamed_news, _NEWS, "fx_news")


def _streamed_files(v: Views) -> DataFrame:
    """Day files of five kinds, one per table, in both encodings, through the landing stream."""
    base = _scratch(v)
    for kind in ("daily_otc", "inst_listed", "margin_listed", "foreign_otc", "valuation_otc"):
        LAND[kind](v.loaded, f"{base}/src/{kind}")
    landing.start_landing(landing.arriving_files(v.spark, f"{base}/src", 5000), f"{base}/t", f"{base}/bad", f"{base}/ck").awaitTermination()
    value = {"price_daily": "volume", "inst_trades": "trust_net", "margin_trading": "margin_balance", "shareholding": "foreign_shares",
             "valuation_daily": "cast(round(per * 100) as bigint)"}
    return union_all(*[sk.read_fact(v.spark, f"{base}/t/{t}").select(F.lit(t).alias("table_name"), "stock_id", "trade_date", F.expr(x).cast("bigint").alias("value"))
                       for t, x in value.items()])


query("r01_landing_stream", _streamed_files, """
      SELECT 'price_daily' AS table_name, right(stock_id, 6) AS stock_id, trade_date, volume AS value FROM fx_bars
      UNION ALL SELECT 'inst_trades', right(stock_id, 6), trade_date, trust_net FROM fx_inst
      UNION ALL SELECT 'margin_trading', right(stock_id, 6), trade_date, margin_balance::BIGINT FROM fx_margin
      UNION ALL SELECT 'shareholding', right(stock_id, 6), trade_date, foreign_shares FROM fx_shareholding
      UNION ALL SELECT 'valuation_daily', right(stock_id, 6), trade_date, round(per * 100)::BIGINT FROM fx_valuation""",
      "fx_bars", "fx_inst", "fx_margin", "fx_shareholding", "fx_valuation")


def _matched_stream(v: Views) -> DataFrame:
    """The trade log through the matching stream in three runs."""
    base, trades = _scratch(v), v.trades
    for low, high in (("1900-01-01", "1994-06-01"), ("1994-06-01", "1997-01-01"), ("1997-01-01", "9999-01-01")):
        trades.where((F.col("trade_date") >= low) & (F.col("trade_date") < high)).write.mode("append").parquet(f"{base}/src")
        lots.start_matches(jobs.arriving(v.spark, f"{base}/src", trades.schema), f"{base}/out", f"{base}/ck", v.stock).awaitTermination()
    return lots.read_matches(v.spark, f"{base}/out").drop("pnl_exact")


query("r04_lot_matches", _matched_stream,
      """SELECT stock_id, buy_id, sell_id, round(qty, 3) AS shares, buy_date, buy_price, sell_date, sell_price,
         round_even(gain, 0)::BIGINT AS pnl, sell_price / nullif(buy_price, 0) - 1 AS ret_pct, (sell_date - buy_date)::INT AS days
         FROM fx_match""", "fx_match", extra=_LEDGER, ret_pct=6)


def _readjusted(v: Views) -> DataFrame:
    """Two loads: the bars and dividends up to a day, then all of them."""
    base = _scratch(v)
    bars = _landed(v, v.bars.select(*[c for c in v.bars.columns if not c.startswith("adj_")]), f"{base}/bars")
    days = [c for c in v.dividend.columns if c not in ("year_label", "cash_pay_date")]
    dividend = _landed(v, best_dividends(v.dividend_rows, "seq", days), f"{base}/dividend")
    reductions = _landed(v, reduction_events(v.reduction), f"{base}/reductions")
    known = dividend.where("announce_date < '1997-01-01'")
    readjust(v.spark, f"{base}/adjusted", bars.where("trade_date < '1997-01-01'"), dividend_events(known), reductions, buckets=4)
    readjust(v.spark, f"{base}/adjusted", bars, dividend_events(dividend), reductions, buckets=4)
    return read_adjusted(v.spark, f"{base}/adjusted")


query("d05_readjusted", _readjusted, _ADJUSTED, "fx_adjusted", **_ADJ_DIGITS)

# Three loads of monthly revenue: what the first lines of the orders add up to, then more of them, then all.
_LOADS = ((2, "1999-01-10"), (4, "1999-02-10"), (9, "1999-03-10"))


def _revised(v: Views) -> DataFrame:
    path = f"{_scratch(v)}/history"
    unit = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("bigint")
    for lines, day in _LOADS:
        load = v.ticks.where(F.col("l_linenumber") <= lines).groupBy("stock_id", F.trunc("d", "month").alias("revenue_month")).agg(F.sum(unit).alias("revenue"))
        rv.revise(v.spark, path, load, ("stock_id", "revenue_month"), F.lit(day).cast("date"))
    history = rv.read_history(v.spark, path)
    return union_all(*[
        rv.known_on(history, F.lit(day).cast("date")).select(F.lit(day).alias("as_of"), "stock_id", "revenue_month", "revenue")
        for day in ("1999-01-09", "1999-01-10", "1999-02-28", "1999-03-10")])


query("p09_revisions", _revised, " UNION ALL ".join(
    f"""SELECT '{day}' AS as_of, stock_id, date_trunc('month', d)::DATE AS revenue_month,
        sum(round(l_extendedprice * (1 - l_discount))::BIGINT)::BIGINT AS revenue FROM fx_ticks WHERE l_linenumber <= {n} GROUP BY 2, 3"""
    for day, n in (("1999-01-10", 2), ("1999-02-28", 4), ("1999-03-10", 9))), "fx_ticks")


def _checked(v: Views, path: str) -> dict[str, int]:
    listed = v.stock.where(F.col("market") == "上市").select("stock_id")
    return checked.checked_write(
        v.trades, path, ("stock_id", "trade_date"), {"shares": F.col("shares") > 5, "price": F.col("price") < 3000},
        {"security": ("stock_id", listed)}, ["id"])


def _report(v: Views) -> DataFrame:
    told = _checked(v, f"{_scratch(v)}/t")
    return v.spark.createDataFrame([(k, n) for k, n in told.items() if k != "version"], "name string, n bigint")


def _published(v: Views) -> DataFrame:
    path = f"{_scratch(v)}/t"
    _checked(v, path)
    good = sk.read_version(v.spark, path).select("id", F.lit("").alias("reason"))
    return good.unionByName(checked.quarantine(v.spark, path).select("id", F.col("_reason").alias("reason")))


_JUDGED = {"fx_judged": (("fx_trades", "fx_stock"), """SELECT *, CASE WHEN reason = '' AND row_number() OVER (PARTITION BY stock_id, trade_date, reason ORDER BY id) > 1
    THEN 'duplicate' ELSE reason END AS verdict FROM (SELECT t.*, CASE WHEN NOT shares > 5 THEN 'shares' WHEN NOT price < 3000 THEN 'price'
      WHEN stock_id NOT IN (SELECT stock_id FROM fx_stock WHERE market = '上市') THEN 'security' ELSE '' END AS reason FROM fx_trades t)""")}
query("q01_checked_report", _report, """SELECT 'rows' AS name, count(*) AS n FROM fx_judged UNION ALL
      SELECT CASE verdict WHEN '' THEN 'good' ELSE verdict END, count(*) FROM fx_judged GROUP BY 1""", "fx_judged", extra=_JUDGED)
query("q02_checked_rows", _published, "SELECT id, verdict AS reason FROM fx_judged", "fx_judged", extra=_JUDGED)
