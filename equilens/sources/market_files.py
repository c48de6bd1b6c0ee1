"""Exchange files to typed rows of the fact tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.functions.calendar import revenue_available
from equilens.functions.parse import (
    any_date, clean_code, is_security_code, parse_bigint, parse_num, roc_date, roc_month, signed_change, to_num,
    traded, ymd_date,
)
from equilens.functions.windows import KEY, TIME
from equilens.operators.relational import keep_first, keep_known, union_all
from equilens.session import materialize
from equilens.sources.landed import (
    cell, csv_rows, day_of, files, json_rows, sniff_market, sniff_text,
)

# Header cell that opens the section of single securities.
DAILY_SECTION = "證券代號"
MARGIN_SECTION = "代號"
# Target column -> cell position, and the smallest cell count of a data row.
INST_COLUMNS = ("foreign_net", "foreign_dealer_net", "trust_net", "dealer_self_net", "dealer_hedge_net")
INST_LISTED = (dict(zip(INST_COLUMNS, (4, 7, 10, 14, 17))), 19)
INST_OTC = (dict(zip(INST_COLUMNS, (4, 7, 13, 16, 19))), 20)
MARGIN_COLUMNS = ("margin_balance", "short_balance", "margin_buy", "margin_sell", "short_sell", "short_buy")
MARGIN_LISTED = (dict(zip(MARGIN_COLUMNS, (6, 12, 2, 3, 9, 8))), 13)
MARGIN_OTC = (dict(zip(MARGIN_COLUMNS, (6, 14, 3, 4, 11, 12))), 15)
REVENUE_FIELDS = {
    "ym": "資料年月",
    "code": "公司代號",
    "revenue": "營業收入-當月營收",
    "mom": "營業收入-上月比較增減(%)",
    "yoy": "營業收入-去年同月增減(%)",
}


def big5_text() -> Column:
    return F.decode(F.col("content"), "Big5")


def read_month_bars(spark: SparkSession, path: str) -> DataFrame:
    """Month files ``<code>_YYYYMM.csv`` of both markets; a repeated date keeps its first row.

    Units stay as filed; ``market`` tells listed (shares) from OTC (thousands).
    """
    name = r"([^/]+)_(\d{6})\.csv$"
    found = files(spark, path, "*_*.csv").filter(F.col("path").rlike(name))
    rows = csv_rows(
        found.withColumn(KEY, F.url_decode(F.regexp_extract("path", name, 1)))
        .withColumn("ym", F.regexp_extract("path", name, 2)).withColumn("market", sniff_market(F.col("content"))),
        sniff_text(F.col("content")),
    )
    typed = rows.filter(F.size("cells") >= 7).select(
        KEY, roc_date(cell(0)).alias(TIME),
        *[to_num(cell(i)).alias(c) for i, c in enumerate(("volume", "amount", "open", "high", "low", "close"), 1)],
        "market", "ym", "line_no",
    ).filter(F.col(TIME).isNotNull() & F.col("close").isNotNull())
    return keep_first(typed, (KEY, TIME), "ym", "line_no").drop("ym", "line_no")


def _dated(spark: SparkSession, path: str, as_of_date) -> DataFrame:
    return files(spark, path).withColumn(TIME, day_of(as_of_date))


# Each ``*_rows`` takes files (path, content, trade_date) and returns typed rows that keep the path of their file, so
# that a load can tell which files gave none; the ``read_*`` beside it reads a folder.

def daily_listed_rows(found: DataFrame) -> DataFrame:
    rows = csv_rows(found, big5_text(), DAILY_SECTION)
    return rows.filter((F.size("cells") >= 11) & is_security_code(cell(0)) & traded(cell(8))).select(
        clean_code(cell(0)).alias(KEY), TIME, F.trim(cell(1)).alias("name"),
        *[to_num(cell(i)).alias(c) for i, c in ((5, "open"), (6, "high"), (7, "low"), (8, "close"))],
        parse_bigint(cell(2)).alias("volume"), parse_bigint(cell(4)).alias("amount"),
        parse_bigint(cell(3)).cast("int").alias("trades"), signed_change(cell(9), cell(10)).alias("change"), "path",
    )


def read_daily_listed(spark: SparkSession, path: str, *, as_of_date=None) -> DataFrame:
    """All-market day file of the listed board: only rows below the section header, untraded ones dropped."""
    return daily_listed_rows(_dated(spark, path, as_of_date)).drop("path")


def daily_otc_rows(found: DataFrame) -> DataFrame:
    rows = json_rows(found)
    close = F.trim(F.replace(cell(2), F.lit(","), F.lit("")))
    typed = rows.filter((F.size("cells") > 9) & traded(close)).select(
        F.trim(cell(0)).alias(KEY), TIME,
        *[to_num(cell(i)).alias(c) for i, c in ((4, "open"), (5, "high"), (6, "low"), (2, "close"))],
        parse_bigint(cell(7)).alias("volume"), parse_bigint(cell(8)).alias("amount"),
        parse_bigint(cell(9)).cast("int").alias("trades"), F.trim(cell(3)).alias("change"), "path",
        (-F.col("line_no")).alias("_back"),
    )
    return keep_first(typed, (KEY, TIME), "_back").drop("_back")


def read_daily_otc(spark: SparkSession, path: str, *, as_of_date=None) -> DataFrame:
    """All-market day payload of the OTC board; a repeated code keeps its last row."""
    return daily_otc_rows(_dated(spark, path, as_of_date)).drop("path")


def _positional(rows: DataFrame, layout: tuple[dict[str, int], int], parse=parse_bigint, code: int = 0) -> DataFrame:
    columns, at_least = layout
    return rows.filter((F.size("cells") >= at_least) & is_security_code(cell(code))).select(
        clean_code(cell(code)).alias(KEY), TIME, *[parse(cell(i)).alias(c) for c, i in columns.items()], "path"
    )


def inst_listed_rows(found: DataFrame) -> DataFrame:
    return _positional(csv_rows(found, big5_text()), INST_LISTED)


def read_inst_listed(spark, path, *, as_of_date=None) -> DataFrame:
    """Institutional net buying, listed board."""
    return inst_listed_rows(_dated(spark, path, as_of_date)).drop("path")


def inst_otc_rows(found: DataFrame) -> DataFrame:
    return _positional(json_rows(found), INST_OTC)


def read_inst_otc(spark, path, *, as_of_date=None) -> DataFrame:
    """Institutional net buying, OTC board."""
    return inst_otc_rows(_dated(spark, path, as_of_date)).drop("path")


def margin_listed_rows(found: DataFrame) -> DataFrame:
    return _positional(csv_rows(found, big5_text(), MARGIN_SECTION), MARGIN_LISTED)


def read_margin_listed(spark, path, *, as_of_date=None) -> DataFrame:
    """Margin balances, listed board; the market summary above the section is skipped."""
    return margin_listed_rows(_dated(spark, path, as_of_date)).drop("path")


def margin_otc_rows(found: DataFrame) -> DataFrame:
    return _positional(json_rows(found), MARGIN_OTC)


def read_margin_otc(spark, path, *, as_of_date=None) -> DataFrame:
    """Margin balances, OTC board."""
    return margin_otc_rows(_dated(spark, path, as_of_date)).drop("path")


def _foreign(rows: DataFrame, code: int) -> DataFrame:
    return rows.filter((F.size("cells") >= 8) & is_security_code(cell(code))).select(
        clean_code(cell(code)).alias(KEY), TIME,
        parse_num(F.regexp_replace(cell(7), "%", "")).alias("foreign_ratio"),
        parse_bigint(cell(5)).alias("foreign_shares"), parse_bigint(cell(3)).alias("shares_issued"), "path",
    )


def foreign_listed_rows(found: DataFrame) -> DataFrame:
    return _foreign(csv_rows(found, big5_text()), 0)


def read_foreign_listed(spark, path, *, as_of_date=None) -> DataFrame:
    """Foreign holdings, listed board."""
    return foreign_listed_rows(_dated(spark, path, as_of_date)).drop("path")


def foreign_otc_rows(found: DataFrame) -> DataFrame:
    return _foreign(json_rows(found), 1)


def read_foreign_otc(spark, path, *, as_of_date=None) -> DataFrame:
    """Foreign holdings, OTC board (code in the second cell, ratio with a percent sign)."""
    return foreign_otc_rows(_dated(spark, path, as_of_date)).drop("path")


def valuation_listed_rows(found: DataFrame) -> DataFrame:
    return _positional(csv_rows(found, big5_text()), ({"per": 5, "pbr": 6, "dividend_yield": 3}, 7), parse_num)


def read_valuation_listed(spark, path, *, as_of_date=None) -> DataFrame:
    """Price-earnings, price-book and yield, listed board."""
    return valuation_listed_rows(_dated(spark, path, as_of_date)).drop("path")


def valuation_otc_rows(found: DataFrame) -> DataFrame:
    fields = ("Date", "SecuritiesCompanyCode", "PriceEarningRatio", "PriceBookRatio", "YieldRatio")
    schema = f"array<struct<{','.join(f'{f}:string' for f in fields)}>>"
    rows = found.select("path", TIME, F.inline(F.from_json(F.decode("content", "UTF-8"), schema)))
    code = F.col("SecuritiesCompanyCode")
    return rows.filter((any_date(F.col("Date")) == F.col(TIME)) & is_security_code(code)).select(
        clean_code(code).alias(KEY), TIME, parse_num(F.col("PriceEarningRatio")).alias("per"),
        parse_num(F.col("PriceBookRatio")).alias("pbr"), parse_num(F.col("YieldRatio")).alias("dividend_yield"), "path",
    )


def read_valuation_otc(spark, path, *, as_of_date=None) -> DataFrame:
    """The same for the OTC board, whose feed only has its newest day: rows of another date are dropped."""
    return valuation_otc_rows(_dated(spark, path, as_of_date)).drop("path")


def read_month_revenue(spark: SparkSession, paths: Sequence[str] | str, stock: DataFrame | None = None) -> DataFrame:
    """Monthly revenue lists of all boards; filed in thousands, returned in units."""
    names = REVENUE_FIELDS
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in names.values())).option("multiLine", "true").json(
        list(paths) if not isinstance(paths, str) else paths
    )
    month = roc_month(F.col(f"`{names['ym']}`"))
    rows = raw.select(
        F.trim(F.col(f"`{names['code']}`")).alias(KEY), month.alias("revenue_month"),
        (parse_bigint(F.col(f"`{names['revenue']}`")) * 1000).alias("revenue"),
        parse_num(F.col(f"`{names['mom']}`")).alias("mom_pct"), parse_num(F.col(f"`{names['yoy']}`")).alias("yoy_pct"),
        revenue_available(month).alias("available_date"),
    )
    return keep_known(rows.filter(F.col("revenue_month").isNotNull()), stock)


def read_holder_dist(spark: SparkSession, path: str, stock: DataFrame | None = None) -> DataFrame:
    """Weekly holder distribution; levels 1 to 15 (16 and 17 are totals)."""
    raw = spark.read.schema("d string, code string, level string, holders string, shares string, pct string").csv(
        path, header=True, enforceSchema=True
    )
    rows = raw.select(
        F.trim("code").alias(KEY), ymd_date(F.col("d")).alias("data_date"),
        F.trim("level").try_cast("smallint").alias("level"), parse_bigint(F.col("holders")).alias("holders"),
        parse_bigint(F.col("shares")).alias("shares"), parse_num(F.col("pct")).alias("pct"),
    )
    return keep_known(rows.filter(F.col("level").between(1, 15) & F.col("data_date").isNotNull()), stock)


def json_objects(found: DataFrame, wanted: Callable[[Column], Column]) -> DataFrame:
    """(path, at, fields): the objects of JSON texts (path, text) that are ``wanted``, at any depth, in their order.

    Each round takes one level apart: wanted objects are put aside, and their insides are not looked at; of the others
    the values that are objects or arrays make the next level. Values keep their text and the order they are written
    in; that a value is nested is told by its type, so a text that looks like JSON stays a text.
    """
    level = found.select("path", F.array().cast("array<int>").alias("at"), F.trim("text").alias("v"))
    done = []
    while True:
        opens = F.substring("v", 1, 1)
        read = lambda sign, kind: F.when(opens == sign, F.from_json("v", kind))
        level = level.withColumns({"fields": read("{", "map<string,string>"), "items": read("[", "array<string>")})
        level = materialize(level.withColumn("wanted", F.coalesce(wanted(F.col("fields")), F.lit(False))))
        done.append(level.where("wanted").select("path", "at", "fields"))
        kinds = F.transform(
            F.coalesce(F.map_values(read("{", "map<string,variant>")), read("[", "array<variant>")), F.schema_of_variant)
        values = F.arrays_zip(F.coalesce(F.map_values("fields"), "items").alias("v"), kinds.alias("kind"))
        inner = level.where("not wanted").select("path", "at", F.posexplode(values).alias("k", "x")).where(
            "x.kind like 'OBJECT%' or x.kind like 'ARRAY%'")
        level = inner.select("path", F.concat("at", F.array("k")).alias("at"), F.col("x.v").alias("v"))
        if level.isEmpty():
            return union_all(*done)


def read_etf_nav(spark: SparkSession, path: str, stock: DataFrame | None = None) -> DataFrame:
    """Fund values from JSON of unknown depth; the first record of a code and file wins.

    Any object with ``a`` and one of ``e``/``f`` is a record, wherever it sits and whatever else it holds.
    """
    has = lambda fields, key: F.map_contains_key(fields, key)
    found = files(spark, path).select("path", F.decode("content", "UTF-8").alias("text"))
    rows = json_objects(found, lambda o: has(o, "a") & (has(o, "e") | has(o, "f")))
    field = lambda name: F.col("fields")[name]
    code, day = F.trim(field("a")), ymd_date(field("i"))
    nav, units = parse_num(field("e")), parse_num(field("c"))
    typed = rows.select(
        code.alias(KEY), day.alias(TIME), nav.alias("nav"), parse_num(field("f")).alias("prev_nav"),
        units.alias("units"), (units * nav).alias("aum"), parse_num(field("g")).alias("nav_chg_pct"), "path", "at",
    ).filter((F.col(KEY) != "") & F.col(TIME).isNotNull())
    return keep_known(keep_first(typed, (KEY, "path"), "at").drop("path", "at"), stock)


def read_index_month(spark: SparkSession, path: str, index_id: str, otc: bool = False) -> DataFrame:
    """Index closes from month files: fifth cell of dated rows."""
    found = files(spark, path)
    rows = json_rows(found) if otc else csv_rows(found, big5_text())
    typed = rows.filter(F.size("cells") >= 5).select(
        F.lit(index_id).alias("index_id"), roc_date(cell(0)).alias(TIME), parse_num(cell(4)).alias("close")
    )
    return typed.filter(F.col(TIME).isNotNull() & F.col("close").isNotNull())

