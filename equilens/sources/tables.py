"""Master lists, per-security CSV datasets and table scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equilens.functions.calendar import MARKET_OTC, revenue_available, revenue_month, statement_available
from equilens.functions.parse import csv_cells, iso_date, parse_bigint, parse_num
from equilens.functions.windows import KEY, PART, TIME, trailing_calendar
from equilens.operators.fundamentals import NOT_ITEMS, best_dividends
from equilens.operators.relational import keep_first
from equilens.sinks.tables import read_fact
from equilens.sources.landed import files

IDEOGRAPHIC_SPACE = "　"
# Master-list headings, and the dataset columns of the per-security files.
MASTER_HEADINGS = {
    "股票代碼": KEY, "中文名稱": "name", "市場別": "market", "上市櫃日期": "list_date", "產業別": "industry",
    "證券類別": "security_type",
}
INST_FIELDS = {
    "foreign_net": "Foreign_Investor_net", "foreign_dealer_net": "Foreign_Dealer_Self_net",
    "trust_net": "Investment_Trust_net", "dealer_self_net": "Dealer_self_net",
    "dealer_hedge_net": "Dealer_Hedging_net",
}
MARGIN_FIELDS = {
    "margin_balance": "MarginPurchaseTodayBalance", "short_balance": "ShortSaleTodayBalance",
    "margin_buy": "MarginPurchaseBuy", "margin_sell": "MarginPurchaseSell", "short_sell": "ShortSaleSell",
    "short_buy": "ShortSaleBuy",
}


def classify_security(section: Column, cfi: Column) -> Column:
    """``etf`` by section title or CFI prefix, ``stock`` by CFI prefix, else NULL."""
    return F.when(section.contains("ETF") | cfi.startswith("CE"), "etf").when(cfi.startswith("ES"), "stock")


def read_security_master(spark: SparkSession, paths, want: str = "stock") -> DataFrame:
    """Tab-separated master lists: seven cells per line, section titles on lines without an ISIN.

    Titles label the lines below them, so one list is read in file order; a
    list has tens of thousands of lines.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    text = spark.read.text(listed, wholetext=True).select(
        F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")
    )
    cells = text.select("path", "line_no", F.transform(F.split("line", "\t"), lambda c: F.trim(c)).alias("c"))

    def at(i: int) -> Column:
        return F.coalesce(F.get("c", F.lit(i)), F.lit(""))

    in_order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when((at(1) == "") & (at(0) != ""), at(0))
    labelled = cells.withColumn("section", F.coalesce(F.last(title, ignorenulls=True).over(in_order), F.lit("")))
    code_name = F.split(at(0), IDEOGRAPHIC_SPACE, 2)
    rows = labelled.filter((at(1) != "") & (F.col("line_no") > 0)).select(
        F.trim(F.get(code_name, F.lit(0))).alias(KEY),
        F.coalesce(F.trim(F.get(code_name, F.lit(1))), F.lit("")).alias("name"), at(3).alias("market"),
        iso_date(at(2)).alias("list_date"), at(4).alias("industry"),
        classify_security(F.col("section"), at(5)).alias("security_type"), "path", "line_no",
    ).filter(F.col("security_type").isNotNull())
    if want != "all":
        rows = rows.filter(F.col("security_type") == want)
    return keep_first(rows, (KEY,), "path", "line_no").drop("path", "line_no")


def load_security_master(df: DataFrame) -> DataFrame:
    """Master list with its filed headings to the ``stock`` table."""
    named = df.select(*[F.trim(F.col(f"`{h}`")).alias(c) for h, c in MASTER_HEADINGS.items() if h in df.columns])
    kind = F.col("security_type") if "security_type" in named.columns else F.lit(None).cast("string")
    return named.select(
        KEY, "name", F.nullif("market", F.lit("")).alias("market"), iso_date(F.col("list_date")).alias("list_date"),
        F.nullif("industry", F.lit("")).alias("industry"),
        F.coalesce(F.nullif(kind, F.lit("")), F.lit("stock")).alias("security_type"),
    ).filter(F.coalesce(F.col(KEY), F.lit("")) != "")


def combine_master_json(spark: SparkSession, listed: str, otc: str) -> DataFrame:
    """Two JSON company lists with their board, four columns."""
    schema = "`公司代號` string, `公司簡稱` string, `產業別` string"

    def one(path: str, market: str) -> DataFrame:
        raw = spark.read.schema(schema).option("multiLine", "true").json(path)
        return raw.select(
            F.col("`公司代號`").alias(KEY), F.col("`公司簡稱`").alias("name"), F.lit(market).alias("market"),
            F.col("`產業別`").alias("industry"),
        )

    return one(listed, "上市").unionByName(one(otc, "上櫃"))


def read_statement_long(spark: SparkSession, path: str, statement: str) -> DataFrame:
    """API payloads ``{data: [{date, stock_id, type, value}]}`` to long rows."""
    raw = spark.read.schema(
        "data array<struct<date:string,stock_id:string,type:string,value:string>>"
    ).option("multiLine", "true").json(path)
    return raw.select(F.inline("data")).select(
        F.col("stock_id").alias(KEY), iso_date(F.col("date")).alias("date"), F.lit(statement).alias("statement"),
        "type", parse_num(F.col("value")).alias("value"),
    ).filter(F.col("date").isNotNull())


def _dataset(spark: SparkSession, path: str, suffix: str, columns: Sequence[str]) -> DataFrame:
    """Per-security CSVs ``<code><suffix>.csv``, each read by its own heading; absent headings and empty cells are
    NULL. Of equal headings in one file the first counts."""
    rows = headed_rows(spark, path, suffix)

    def named(c: str) -> Column:
        place = F.array_position("heading", F.lit(c)).cast("int")
        return F.nullif(F.when(place > 0, F.get("cells", place - 1)), F.lit("")).alias(c)

    return rows.select(KEY, *[named(c) for c in columns])


def headed_rows(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(stock_id, heading, line_no, cells) of per-security CSVs: each line with the heading of its file."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    name = F.url_decode(F.regexp_extract("path", rf"([^/]+){suffix}\.csv$", 1))
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    found = files(spark, path, f"*{suffix}.csv").select(name.alias(KEY), lines.alias("_lines")).filter(F.size("_lines") > 1)
    heading = F.transform(csv_cells(F.get("_lines", F.lit(0))), lambda c: F.trim(c))
    body = F.posexplode(F.slice("_lines", 2, F.size("_lines")))
    return found.select(KEY, heading.alias("heading"), body.alias("line_no", "_line")).select(
        KEY, "heading", "line_no", csv_cells(F.col("_line")).alias("cells"))


def load_statement(spark: SparkSession, path: str, suffix: str, statement: str) -> DataFrame:
    """Wide statement files ``<code><suffix>.csv``, with items of their own in each file, to ``financial_statement``."""
    rows = headed_rows(spark, path, suffix).filter(F.array_contains("heading", "date"))
    day = iso_date(F.get("cells", F.array_position("heading", F.lit("date")).cast("int") - 1))
    pairs = F.arrays_zip(F.col("heading").alias("item"), F.col("cells").alias("text"))
    items = F.filter(pairs, lambda p: p["item"].isNotNull() & ~p["item"].isin(*NOT_ITEMS))
    return rows.select(KEY, day.alias("period_date"), F.explode(items).alias("p")).select(
        KEY, "period_date", F.lit(statement).alias("statement"), "p.item", parse_num(F.col("p.text")).alias("value"),
        statement_available(F.col("period_date")).alias("available_date"),
    ).filter(F.col("period_date").isNotNull() & F.col("value").isNotNull())


def load_prices(spark: SparkSession, path: str, stock: DataFrame) -> DataFrame:
    """``<code>_adj.csv`` files to ``price_daily``; OTC volume and turnover are filed in thousands."""
    ohlc = ("open", "high", "low", "close", "adj_open", "adj_high", "adj_low", "adj_close")
    raw = _dataset(spark, path, "_adj", ("date", "volume", "amount", "cumfactor", *ohlc))
    boards = stock.select(KEY, F.when(F.col("market") == MARKET_OTC, 1000).otherwise(1).alias("_mult"))
    scaled = raw.join(boards, KEY, "left").withColumn("_mult", F.coalesce("_mult", F.lit(1)))
    return scaled.select(
        KEY, iso_date(F.col("date")).alias(TIME), *[parse_num(F.col(c)).alias(c) for c in ohlc[:4]],
        (parse_bigint(F.col("volume")) * F.col("_mult")).alias("volume"),
        (parse_bigint(F.col("amount")) * F.col("_mult")).alias("amount"), F.lit(None).cast("int").alias("trades"),
        *[parse_num(F.col(c)).alias(c) for c in ohlc[4:]], parse_num(F.col("cumfactor")).alias("adj_factor"),
    ).filter(F.col(TIME).isNotNull())


def read_index_dir(spark: SparkSession, root: str) -> DataFrame:
    """``<index>.csv`` files; the close is the ``price`` column, else ``close``."""
    raw = _dataset(spark, root, "", ("date", "price", "close"))
    return raw.select(
        F.col(KEY).alias("index_id"), iso_date(F.col("date")).alias(TIME),
        parse_num(F.coalesce(F.nullif("price", F.lit("")), "close")).alias("close"),
    ).filter(F.col(TIME).isNotNull())


def load_revenue(spark: SparkSession, path: str) -> DataFrame:
    """``<code>_revenue.csv`` files; the filing month stands in where year and month are missing."""
    raw = _dataset(spark, path, "_revenue", ("date", "revenue_year", "revenue_month", "revenue", "月增率(%)", "年增率(%)"))
    month = F.coalesce(revenue_month(F.col("revenue_year"), F.col("revenue_month")), iso_date(F.col("date")))
    return raw.select(
        KEY, month.alias("month"), parse_bigint(F.col("revenue")).alias("revenue"),
        parse_num(F.col("`月增率(%)`")).alias("mom_pct"), parse_num(F.col("`年增率(%)`")).alias("yoy_pct"),
    ).filter(F.col("month").isNotNull()).select(
        KEY, F.col("month").alias("revenue_month"), "revenue", "mom_pct", "yoy_pct",
        revenue_available(F.col("month")).alias("available_date"),
    )


def _sum_parts(*names: str) -> Column:
    return sum((F.coalesce(parse_num(F.col(n)), F.lit(0.0)) for n in names[1:]),
               F.coalesce(parse_num(F.col(names[0])), F.lit(0.0)))


def load_dividend(spark: SparkSession, path: str) -> DataFrame:
    """``<code>_dividend.csv`` files, the best row per announcement."""
    raw = _dataset(
        spark, path, "_dividend",
        ("AnnouncementDate", "year", "CashEarningsDistribution", "CashStatutorySurplus", "StockEarningsDistribution",
         "StockStatutorySurplus", "CashExDividendTradingDate", "StockExDividendTradingDate", "CashDividendPaymentDate"),
    )
    rows = raw.select(
        KEY, iso_date(F.col("AnnouncementDate")).alias("announce_date"), F.col("year").alias("year_label"),
        _sum_parts("CashEarningsDistribution", "CashStatutorySurplus").alias("cash_dividend"),
        _sum_parts("StockEarningsDistribution", "StockStatutorySurplus").alias("stock_dividend"),
        iso_date(F.col("CashExDividendTradingDate")).alias("ex_cash_date"),
        iso_date(F.col("StockExDividendTradingDate")).alias("ex_stock_date"),
        iso_date(F.col("CashDividendPaymentDate")).alias("cash_pay_date"),
        F.monotonically_increasing_id().alias("_seq"),
    ).filter(F.col("announce_date").isNotNull())
    return best_dividends(rows, "_seq").drop("_seq")


def load_capreduction(spark: SparkSession, path: str) -> DataFrame:
    """``<code>_capreduction.csv`` files."""
    raw = _dataset(
        spark, path, "_capreduction",
        ("date", "ClosingPriceonTheLastTradingDay", "PostReductionReferencePrice", "ReasonforCapitalReduction"),
    )
    return raw.select(
        KEY, iso_date(F.col("date")).alias("resume_date"),
        parse_num(F.col("ClosingPriceonTheLastTradingDay")).alias("pre_close"),
        parse_num(F.col("PostReductionReferencePrice")).alias("post_ref_price"),
        F.col("ReasonforCapitalReduction").alias("reason"),
    ).filter(F.col("resume_date").isNotNull())


def _load(spark, path, suffix, fields: dict[str, str], parsers=None) -> DataFrame:
    raw = _dataset(spark, path, suffix, ("date", *fields.values()))
    parsers = parsers or {}
    return raw.select(
        KEY, iso_date(F.col("date")).alias(TIME),
        *[parsers.get(c, parse_bigint)(F.col(f)).alias(c) for c, f in fields.items()],
    ).filter(F.col(TIME).isNotNull())


def load_inst(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, "_institutional", INST_FIELDS)


def load_margin(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, "_margin", MARGIN_FIELDS)


def load_shareholding(spark: SparkSession, path: str) -> DataFrame:
    fields = {
        "foreign_ratio": "ForeignInvestmentSharesRatio", "foreign_shares": "ForeignInvestmentShares",
        "shares_issued": "NumberOfSharesIssued",
    }
    return _load(spark, path, "_shareholding", fields, {"foreign_ratio": parse_num})


def load_per(spark: SparkSession, path: str) -> DataFrame:
    fields = {"per": "PER", "pbr": "PBR", "dividend_yield": "dividend_yield"}
    return _load(spark, path, "_per", fields, dict.fromkeys(fields, parse_num))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct codes from lists separated by commas, blanks or line ends."""
    words = spark.read.text(path).select(F.explode(F.split("value", r"[,\s]+")).alias(KEY))
    return words.filter(F.col(KEY) != "").distinct()


def scan_prices(spark: SparkSession, path: str, ids: Sequence[str] | None = None) -> DataFrame:
    """Price table, optionally only some codes; the filter reaches the files."""
    bars = spark.read.parquet(path)
    return bars if not ids else bars.filter(F.col(KEY).isin(*ids))


def scan_recent(spark: SparkSession, path: str, days: int, date_col: str = TIME) -> DataFrame:
    """Rows within ``days`` of the newest date of a stored fact.

    Where it is partitioned by year or month of that date, the newest date is looked up in the newest partition only,
    and the bound is repeated on the partition column, so old partitions are never opened.
    """
    recent = trailing_calendar(read_fact(spark, path, partitioned=True), date_col, days)
    return recent.drop(PART)


def scan_trades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
