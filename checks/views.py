"""The given tables seen as market tables: Spark frames and the same views in SQL.

A supplier plays a security, a line item a tick (and a trade), a week of ticks
a bar. Everything is derived from whole tables, so the number of securities,
bars and trades grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equilens.functions.calendar import revenue_available
from equilens.functions.windows import series
from equilens.operators.adjust import adjust_prices, dividend_events, reduction_events
from equilens.operators.fundamentals import best_dividends, build_quarterly, unpivot_statement
from equilens.operators.relational import union_all
from equilens.operators.stock_views import revenue_growth
from equilens.plans.snapshot import snapshot
from equilens.session import materialize, stored

LOOKBACK_DAYS = 4000
# Keeps means of prices off exact rounding halves, which engines break differently.
PRICE_TAIL = 0.0013
ID_BLOCK = 1 << 50
INST = ("foreign_net", "trust_net", "dealer_self_net")


def _code(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 12, "0").alias("stock_id")


def _bar_parts() -> list[Column]:
    # Ticks of a day are ordered by amount, then quantity; ticks equal in both have the same price.
    at = F.unix_date("d").cast("bigint") * (1 << 30) + F.col("cents") * 64 + F.col("l_quantity").cast("bigint")
    return [
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("l_quantity").cast("bigint").alias("volume"),
        F.sum("cents").alias("amount"), F.count(F.lit(1)).alias("trades"),
    ]


def _with_adjusted(raw: DataFrame) -> DataFrame:
    return raw.select("*", *[F.col(c).alias(f"adj_{c}") for c in ("open", "high", "low", "close")])


def _signed() -> Column:
    return F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("bigint")


def _inst_parts() -> list[Column]:
    line = F.col("l_linenumber")
    return [F.sum(F.when(cond, _signed())).alias(c) for c, cond in zip(INST, (line == 1, line == 2, line >= 3))]


def _with_unreported(nets: DataFrame) -> DataFrame:
    none = F.lit(None).cast("bigint")
    return nets.select("*", none.alias("foreign_dealer_net"), none.alias("dealer_hedge_net"))


def _balances(week: DataFrame) -> DataFrame:
    w = series()
    return week.select(
        "stock_id", "trade_date",
        (F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 100000).alias("margin_balance"),
        (F.row_number().over(w) + 1000).cast("bigint").alias("short_balance"),
    )


def _revenue_unit() -> Column:
    return F.round(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("bigint")


def _quarter_end(day: str) -> Column:
    return F.date_add(F.add_months(F.date_trunc("quarter", day).cast("date"), 3), -1)


def _statement_parts() -> list[Column]:
    e, disc = F.col("l_extendedprice"), F.col("l_discount")

    def total(x: Column) -> Column:
        return F.sum(F.round(x).cast("bigint"))

    return [
        total(e).alias("Revenue"), total(e * (1 - disc)).alias("GrossProfit"),
        total(e * (0.9 - disc)).alias("OperatingIncome"), total(e * (0.8 - disc)).alias("NetIncome"),
        F.count(F.lit(1)).alias("EPS"), total(e * 10).alias("TotalAssets"), total(e * 4).alias("Equity"),
        total(e * (5 + disc)).alias("Liabilities"),
    ]


def _by_security(sums: DataFrame) -> DataFrame:
    return materialize(sums.repartition("stock_id"))


class Views:
    """Frames over one data folder, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def stock(self) -> DataFrame:
        joined = self.table("supplier").join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        ).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(
            _code("s_suppkey"), F.col("s_name").alias("name"),
            F.when(F.col("n_regionkey") % 2 == 0, "上市").otherwise("上櫃").alias("market"),
            F.date_add(F.lit("1990-01-01").cast("date"), (F.col("s_suppkey") % 4000).cast("int")).alias("list_date"),
            F.col("n_name").alias("industry"),
            F.when(F.col("s_suppkey") % 5 == 0, "etf").otherwise("stock").alias("security_type"),
        )

    @cached_property
    def ticks(self) -> DataFrame:
        day = F.to_date("l_shipdate")
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        return self.table("lineitem").select(
            _code("l_suppkey"), day.alias("d"), F.date_trunc("week", "l_shipdate").cast("date").alias("trade_date"),
            (F.floor(cents / F.col("l_quantity")) / 100.0 + PRICE_TAIL).alias("price"), cents.alias("cents"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
        )

    @cached_property
    def bars(self) -> DataFrame:
        return _with_adjusted(self.ticks.groupBy("stock_id", "trade_date").agg(*_bar_parts()))

    @cached_property
    def dividend_rows(self) -> DataFrame:
        return self.ticks.filter(F.col("l_returnflag") == "R").select(
            "stock_id", F.col("d").alias("announce_date"), F.year("d").cast("string").alias("year_label"),
            ((F.col("l_orderkey") % 7) / 100.0).alias("cash_dividend"),
            ((F.col("l_orderkey") % 3) / 1000.0).alias("stock_dividend"),
            F.date_add("d", 3).alias("ex_cash_date"), F.date_add("d", 10).alias("ex_stock_date"),
            F.date_add("d", 30).alias("cash_pay_date"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("seq"),
        )

    @cached_property
    def dividend(self) -> DataFrame:
        return best_dividends(self.dividend_rows, "seq", [c for c in self.dividend_rows.columns if c != "seq"])

    @cached_property
    def reduction(self) -> DataFrame:
        return self.ticks.filter(F.col("l_returnflag") == "A").select(
            "stock_id", F.col("d").alias("resume_date"), F.col("price").alias("pre_close"),
            (F.col("price") * (1 + (F.col("l_orderkey") % 3 - 1) / 1000.0)).alias("post_ref_price"),
        )

    @cached_property
    def adjusted(self) -> DataFrame:
        return adjust_prices(self.bars, dividend_events(self.dividend), reduction_events(self.reduction))

    @cached_property
    def index(self) -> DataFrame:
        def mean(c: str) -> Column:
            return F.floor(F.sum(F.round(F.col(c) * 100).cast("bigint")) / F.count(F.lit(1))) / 100.0

        day = self.bars.groupBy("trade_date").agg(
            mean("close").alias("a"), mean("low").alias("b"), mean("high").alias("c")
        )
        return union_all(*[
            day.select(F.lit(i).alias("index_id"), "trade_date", F.col(c).alias("close"))
            for i, c in (("TAIEX", "a"), ("TPEx", "b"), ("TWSE", "c"))
        ])

    @cached_property
    def inst(self) -> DataFrame:
        return _with_unreported(self.ticks.groupBy("stock_id", "trade_date").agg(*_inst_parts()))

    @cached_property
    def margin(self) -> DataFrame:
        return _balances(self.ticks.groupBy("stock_id", "trade_date").agg(F.sum(_signed()).alias("q")))

    @cached_property
    def revenue_raw(self) -> DataFrame:
        return self.ticks.groupBy("stock_id", F.trunc("d", "month").alias("revenue_month")).agg(
            F.sum(_revenue_unit()).alias("revenue")
        )

    @cached_property
    def revenue(self) -> DataFrame:
        return revenue_growth(self.revenue_raw).select(
            "stock_id", "revenue_month", "revenue", F.col("mom").alias("mom_pct"), F.col("yoy").alias("yoy_pct"),
            revenue_available(F.col("revenue_month")).alias("available_date"),
        )

    @cached_property
    def statement_wide(self) -> DataFrame:
        """Eight items per (security, quarter), whole units."""
        return self.ticks.groupBy("stock_id", _quarter_end("d").alias("date")).agg(*_statement_parts())

    @cached_property
    def statement(self) -> DataFrame:
        income = ("Revenue", "GrossProfit", "OperatingIncome", "NetIncome", "EPS")
        balance = ("TotalAssets", "Equity", "Liabilities")
        return unpivot_statement(self.statement_wide.select("stock_id", "date", *income), "income").unionByName(
            unpivot_statement(self.statement_wide.select("stock_id", "date", *balance), "balance")
        )

    @cached_property
    def quarterly(self) -> DataFrame:
        return build_quarterly(self.statement)

    @cached_property
    def holder(self) -> DataFrame:
        sold = self.ticks.join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        dealt = sold.select(
            "stock_id", F.trunc("d", "month").alias("data_date"),
            (1 + F.col("o_custkey") % 15).cast("int").alias("level"), "l_quantity")
        # Dealt out by security and month, of which both the levels and their sum are made.
        cells = dealt.repartition("stock_id", "data_date").groupBy("stock_id", "data_date", "level").agg(
            F.count(F.lit(1)).alias("holders"), F.sum("l_quantity").cast("bigint").alias("shares"))
        month = F.sum("shares").over(Window.partitionBy("stock_id", "data_date"))
        return cells.withColumn("pct", F.round(F.col("shares") * 100.0 / month, 4))

    @cached_property
    def valuation(self) -> DataFrame:
        return self.bars.select(
            "stock_id", "trade_date", (F.floor(F.round(F.col("close") * 100) / 50) / 100.0).alias("per"),
            (F.floor(F.round(F.col("close") * 100) / 1000) / 100.0).alias("pbr"),
            (F.floor(F.col("low") / F.col("high") * 800) / 100.0).alias("dividend_yield"),
        )

    @cached_property
    def shareholding(self) -> DataFrame:
        return self.bars.select(
            "stock_id", "trade_date", (F.floor(F.col("low") / F.col("high") * 10000) / 100.0).alias("foreign_ratio"),
            F.col("volume").alias("foreign_shares"), (F.col("volume") * 10).alias("shares_issued"),
        )

    @cached_property
    def etf(self) -> DataFrame:
        funds = self.stock.filter(F.col("security_type") == "etf").select("stock_id")
        nav = F.round(F.col("close") * 0.98, 4)
        w = series()
        return self.bars.join(funds, "stock_id", "left_semi").select(
            "stock_id", "trade_date", nav.alias("nav"), F.lag(nav).over(w).alias("prev_nav"),
            F.col("volume").cast("double").alias("units"), F.round(nav * F.col("volume"), 2).alias("aum"),
            F.lit(None).cast("double").alias("nav_chg_pct"),
        )

    @cached_property
    def trades(self) -> DataFrame:
        text = F.concat_ws(
            "|", "l_orderkey", "l_linenumber", "l_partkey", "stock_id", F.col("l_quantity").cast("bigint"), "cents",
            F.col("d").cast("string"),
        )
        sell = F.col("l_linenumber") % 2 == 0
        return self.ticks.select(
            F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint").alias("id"), "stock_id",
            F.when(sell, "sell").otherwise("buy").alias("action"), F.col("d").alias("trade_date"),
            F.col("l_quantity").alias("shares"), "price", (F.col("l_extendedprice") * 0.001425).alias("fee"),
            F.when(sell, F.col("l_extendedprice") * 0.003).otherwise(0.0).alias("tax"),
        )

    @cached_property
    def news(self) -> DataFrame:
        at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("doc_id") % 365).cast("int"))
        return self.table("documents").select(
            F.col("doc_id").alias("news_id"), F.col("lang").alias("stock_id"), F.col("source").alias("title"),
            F.col("text").alias("content"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
            at.alias("published_at"),
        )

    @cached_property
    def embedding(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("news_id"), "embedding")

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        """Fact tables by name, as the snapshot takes them."""
        return {
            "stock": self.stock, "price_daily": self.bars, "market_index": self.index,
            "fundamentals_quarterly": self.quarterly, "monthly_revenue": self.revenue,
            "valuation_daily": self.valuation, "inst_trades": self.inst, "margin_trading": self.margin,
            "shareholding": self.shareholding, "shareholding_dist": self.holder,
        }

    @cached_property
    def loaded(self) -> Loaded:
        return Loaded(self.spark, self.dir, stored)

    @cached_property
    def snapshot(self) -> DataFrame:
        return snapshot(self.loaded.tables, lookback_days=LOOKBACK_DAYS, side_days=LOOKBACK_DAYS)


class Loaded(Views):
    """The same views for a query that reads most of them: ticks are read once by week and once by month.

    The sums are written down by ``keep``: by security, so that what is windowed or joined by it needs no further exchange,
    or, as ``loaded`` has it, as compressed columns, of which each view moves its own. They hold one row per security and
    week or month, however many ticks there are.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] = _by_security):
        super().__init__(spark, sf_dir)
        self.keep = keep

    @cached_property
    def weeks(self) -> DataFrame:
        return self.keep(self.ticks.groupBy("stock_id", "trade_date").agg(
            *_bar_parts(), *_inst_parts(), F.sum(_signed()).alias("q")))

    @cached_property
    def months(self) -> DataFrame:
        return self.keep(self.ticks.groupBy("stock_id", F.trunc("d", "month").alias("month")).agg(
            F.sum(_revenue_unit()).alias("earned"), *_statement_parts()))

    @cached_property
    def bars(self) -> DataFrame:
        return _with_adjusted(self.weeks.drop(*INST, "q"))

    @cached_property
    def inst(self) -> DataFrame:
        return _with_unreported(self.weeks.select("stock_id", "trade_date", *INST))

    @cached_property
    def margin(self) -> DataFrame:
        return _balances(self.weeks.select("stock_id", "trade_date", "q"))

    @cached_property
    def revenue_raw(self) -> DataFrame:
        return self.months.select("stock_id", F.col("month").alias("revenue_month"), F.col("earned").alias("revenue"))

    @cached_property
    def statement_wide(self) -> DataFrame:
        items = [c for c in self.months.columns if c not in ("stock_id", "month", "earned")]
        return self.months.groupBy("stock_id", _quarter_end("month").alias("date")).agg(*[F.sum(c).alias(c) for c in items])


# The same views for the comparison engine: name -> (views it reads, SQL).
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_stock": ((), """
        SELECT lpad(s_suppkey::VARCHAR, 12, '0') AS stock_id, s_name AS name,
               CASE WHEN n_regionkey % 2 = 0 THEN '上市' ELSE '上櫃' END AS market,
               (DATE '1990-01-01' + (s_suppkey % 4000)::INT)::DATE AS list_date, n_name AS industry,
               CASE WHEN s_suppkey % 5 = 0 THEN 'etf' ELSE 'stock' END AS security_type
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "fx_ticks": ((), """
        SELECT lpad(l_suppkey::VARCHAR, 12, '0') AS stock_id, l_shipdate::DATE AS d,
               date_trunc('week', l_shipdate)::DATE AS trade_date,
               floor(round(l_extendedprice * 100) / l_quantity) / 100.0::DOUBLE + 0.0013::DOUBLE AS price,
               round(l_extendedprice * 100)::BIGINT AS cents, l_orderkey, l_linenumber, l_partkey, l_quantity,
               l_extendedprice, l_discount, l_returnflag
        FROM lineitem"""),
    "fx_bars": (("fx_ticks",), """
        SELECT *, open AS adj_open, high AS adj_high, low AS adj_low, close AS adj_close FROM (
          SELECT stock_id, trade_date,
            arg_min(price, (d - DATE '1970-01-01')::BIGINT * 1073741824 + cents * 64 + l_quantity::BIGINT) AS open,
            max(price) AS high, min(price) AS low,
            arg_max(price, (d - DATE '1970-01-01')::BIGINT * 1073741824 + cents * 64 + l_quantity::BIGINT) AS close,
            sum(l_quantity)::BIGINT AS volume, sum(cents)::BIGINT AS amount, count(*)::BIGINT AS trades
          FROM fx_ticks GROUP BY 1, 2)"""),
    "fx_dividend_rows": (("fx_ticks",), """
        SELECT stock_id, d AS announce_date, year(d)::VARCHAR AS year_label, (l_orderkey % 7) / 100.0::DOUBLE AS cash_dividend,
               (l_orderkey % 3) / 1000.0::DOUBLE AS stock_dividend, (d + 3)::DATE AS ex_cash_date,
               (d + 10)::DATE AS ex_stock_date, (d + 30)::DATE AS cash_pay_date,
               l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
        FROM fx_ticks WHERE l_returnflag = 'R'"""),
    "fx_dividend": (("fx_dividend_rows",), """
        SELECT stock_id, announce_date, year_label, cash_dividend, stock_dividend, ex_cash_date, ex_stock_date,
               cash_pay_date
        FROM (SELECT *, row_number() OVER (PARTITION BY stock_id, announce_date ORDER BY
                cash_dividend + stock_dividend DESC, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k
              FROM fx_dividend_rows) WHERE k = 1"""),
    "fx_reduction": (("fx_ticks",), """
        SELECT stock_id, d AS resume_date, price AS pre_close,
               price * (1 + (l_orderkey % 3 - 1) / 1000.0::DOUBLE) AS post_ref_price
        FROM fx_ticks WHERE l_returnflag = 'A'"""),
    "fx_events": (("fx_dividend",), """
        SELECT stock_id, ex_date, sum(cash) AS cash, sum(stock) AS stock FROM (
          SELECT stock_id, ex_cash_date AS ex_date, cash_dividend AS cash, 0.0::DOUBLE AS stock FROM fx_dividend
          WHERE ex_cash_date IS NOT NULL AND cash_dividend > 0
          UNION ALL
          SELECT stock_id, ex_stock_date, 0.0::DOUBLE, stock_dividend FROM fx_dividend
          WHERE ex_stock_date IS NOT NULL AND stock_dividend > 0) GROUP BY 1, 2"""),
    "fx_cuts": (("fx_reduction",), """
        SELECT stock_id, resume_date AS ex_date, product(post_ref_price / pre_close) AS reduction
        FROM fx_reduction WHERE resume_date IS NOT NULL AND pre_close > 0 AND post_ref_price > 0 GROUP BY 1, 2"""),
    "fx_landed": (("fx_events", "fx_cuts", "fx_bars"), """
        SELECT stock_id, bar_date AS trade_date, product(ratio) AS ratio FROM (
          SELECT e.stock_id, (p.close - e.cash) / (p.close * (1 + e.stock / 10)) AS ratio,
                 (SELECT min(b.trade_date) FROM fx_bars b WHERE b.stock_id = e.stock_id AND b.trade_date >= e.ex_date) AS bar_date
          FROM fx_events e ASOF JOIN fx_bars p ON e.stock_id = p.stock_id AND e.ex_date > p.trade_date
          WHERE p.close > 0
          UNION ALL
          SELECT c.stock_id, c.reduction,
                 (SELECT min(b.trade_date) FROM fx_bars b WHERE b.stock_id = c.stock_id AND b.trade_date >= c.ex_date)
          FROM fx_cuts c) WHERE bar_date IS NOT NULL AND ratio > 0 GROUP BY 1, 2"""),
    "fx_adjusted": (("fx_bars", "fx_landed"), """
        SELECT stock_id, trade_date, open, high, low, close, volume, amount, trades,
               round(open * adj_factor, 4) AS adj_open, round(high * adj_factor, 4) AS adj_high,
               round(low * adj_factor, 4) AS adj_low, round(close * adj_factor, 4) AS adj_close, adj_factor
        FROM (SELECT b.*, coalesce(product(l.ratio) OVER (PARTITION BY b.stock_id ORDER BY b.trade_date
                       ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0) AS adj_factor
              FROM fx_bars b LEFT JOIN fx_landed l USING (stock_id, trade_date))"""),
    "fx_index": (("fx_bars",), """
        SELECT 'TAIEX' AS index_id, trade_date, floor(sum(round(close * 100)::BIGINT) / count(*)) / 100.0::DOUBLE AS close FROM fx_bars GROUP BY 2
        UNION ALL SELECT 'TPEx', trade_date, floor(sum(round(low * 100)::BIGINT) / count(*)) / 100.0::DOUBLE FROM fx_bars GROUP BY 2
        UNION ALL SELECT 'TWSE', trade_date, floor(sum(round(high * 100)::BIGINT) / count(*)) / 100.0::DOUBLE FROM fx_bars GROUP BY 2"""),
    "fx_inst": (("fx_ticks",), """
        SELECT stock_id, trade_date,
          sum(CASE WHEN l_linenumber = 1 THEN q END)::BIGINT AS foreign_net,
          sum(CASE WHEN l_linenumber = 2 THEN q END)::BIGINT AS trust_net,
          sum(CASE WHEN l_linenumber >= 3 THEN q END)::BIGINT AS dealer_self_net,
          NULL::BIGINT AS foreign_dealer_net, NULL::BIGINT AS dealer_hedge_net
        FROM (SELECT *, (CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)::BIGINT AS q FROM fx_ticks)
        GROUP BY 1, 2"""),
    "fx_margin": (("fx_ticks",), """
        SELECT stock_id, trade_date, (sum(q) OVER w + 100000)::BIGINT AS margin_balance,
               row_number() OVER w + 1000 AS short_balance
        FROM (SELECT stock_id, trade_date,
                     sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)::BIGINT AS q
              FROM fx_ticks GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY stock_id ORDER BY trade_date)"""),
    "fx_revenue": (("fx_ticks",), """
        SELECT *, (date_trunc('month', revenue_month) + INTERVAL 1 MONTH + INTERVAL 9 DAY)::DATE AS available_date FROM (
          SELECT stock_id, revenue_month, revenue,
            round((revenue::DOUBLE / nullif(lag(revenue) OVER w, 0) - 1) * 100, 2) AS mom_pct,
            round((revenue::DOUBLE / nullif(lag(revenue, 12) OVER w, 0) - 1) * 100, 2) AS yoy_pct
          FROM (SELECT stock_id, date_trunc('month', d)::DATE AS revenue_month,
                       sum(round(l_extendedprice * (1 - l_discount))::BIGINT)::BIGINT AS revenue
                FROM fx_ticks GROUP BY 1, 2)
          WINDOW w AS (PARTITION BY stock_id ORDER BY revenue_month))"""),
    "fx_statement_wide": (("fx_ticks",), """
        SELECT stock_id, (date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS date,
          sum(round(l_extendedprice)::BIGINT)::BIGINT AS "Revenue",
          sum(round(l_extendedprice * (1 - l_discount))::BIGINT)::BIGINT AS "GrossProfit",
          sum(round(l_extendedprice * (0.9::DOUBLE - l_discount))::BIGINT)::BIGINT AS "OperatingIncome",
          sum(round(l_extendedprice * (0.8::DOUBLE - l_discount))::BIGINT)::BIGINT AS "NetIncome",
          count(*)::BIGINT AS "EPS", sum(round(l_extendedprice * 10)::BIGINT)::BIGINT AS "TotalAssets",
          sum(round(l_extendedprice * 4)::BIGINT)::BIGINT AS "Equity",
          sum(round(l_extendedprice * (5 + l_discount))::BIGINT)::BIGINT AS "Liabilities"
        FROM fx_ticks GROUP BY 1, 2"""),
    "fx_statement": (("fx_statement_wide",), """
        SELECT stock_id, date AS period_date,
               CASE WHEN item IN ('TotalAssets', 'Equity', 'Liabilities') THEN 'balance' ELSE 'income' END AS statement,
               item, value::DOUBLE AS value,
               CASE month(date) WHEN 3 THEN make_date(year(date), 5, 15) WHEN 6 THEN make_date(year(date), 8, 14)
                    WHEN 9 THEN make_date(year(date), 11, 14) WHEN 12 THEN make_date(year(date) + 1, 3, 31) ELSE date END
                 AS available_date
        FROM fx_statement_wide UNPIVOT (value FOR item IN
          ("Revenue", "GrossProfit", "OperatingIncome", "NetIncome", "EPS", "TotalAssets", "Equity", "Liabilities"))"""),
    "fx_quarterly": (("fx_statement",), """
        SELECT *, round(gross_profit::DOUBLE / nullif(revenue, 0) * 100, 2) AS gross_margin,
          round(operating_income::DOUBLE / nullif(revenue, 0) * 100, 2) AS op_margin,
          round(net_income::DOUBLE / nullif(revenue, 0) * 100, 2) AS net_margin,
          round(net_income::DOUBLE / nullif(total_equity, 0) * 100, 2) AS roe,
          round(total_liabilities::DOUBLE / nullif(total_assets, 0) * 100, 2) AS debt_ratio
        FROM (SELECT stock_id, period_date, any_value(available_date) AS available_date,
          max(value) FILTER (item = 'Revenue')::BIGINT AS revenue,
          max(value) FILTER (item = 'GrossProfit')::BIGINT AS gross_profit,
          max(value) FILTER (item = 'OperatingIncome')::BIGINT AS operating_income, NULL::BIGINT AS pretax_income,
          max(value) FILTER (item = 'NetIncome')::BIGINT AS net_income, max(value) FILTER (item = 'EPS') AS eps,
          max(value) FILTER (item = 'TotalAssets')::BIGINT AS total_assets,
          max(value) FILTER (item = 'Equity')::BIGINT AS total_equity,
          max(value) FILTER (item = 'Liabilities')::BIGINT AS total_liabilities, NULL::BIGINT AS operating_cash_flow
          FROM fx_statement GROUP BY 1, 2)"""),
    "fx_holder": (("fx_ticks",), """
        SELECT *, round(shares * 100.0::DOUBLE / sum(shares) OVER (PARTITION BY stock_id, data_date), 4) AS pct FROM (
          SELECT stock_id, date_trunc('month', d)::DATE AS data_date, (1 + o_custkey % 15)::INT AS level,
                 count(*)::BIGINT AS holders, sum(l_quantity)::BIGINT AS shares
          FROM fx_ticks JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""),
    "fx_valuation": (("fx_bars",), """
        SELECT stock_id, trade_date, floor(round(close * 100) / 50) / 100.0::DOUBLE AS per,
               floor(round(close * 100) / 1000) / 100.0::DOUBLE AS pbr,
               floor(low / high * 800) / 100.0::DOUBLE AS dividend_yield FROM fx_bars"""),
    "fx_shareholding": (("fx_bars",), """
        SELECT stock_id, trade_date, floor(low / high * 10000) / 100.0::DOUBLE AS foreign_ratio, volume AS foreign_shares,
               volume * 10 AS shares_issued FROM fx_bars"""),
    "fx_etf": (("fx_bars", "fx_stock"), """
        SELECT stock_id, trade_date, round(close * 0.98::DOUBLE, 4) AS nav,
               lag(round(close * 0.98::DOUBLE, 4)) OVER (PARTITION BY stock_id ORDER BY trade_date) AS prev_nav,
               volume::DOUBLE AS units, round(round(close * 0.98::DOUBLE, 4) * volume, 2) AS aum, NULL::DOUBLE AS nav_chg_pct
        FROM fx_bars WHERE stock_id IN (SELECT stock_id FROM fx_stock WHERE security_type = 'etf')"""),
    "fx_trades": (("fx_ticks",), """
        SELECT ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, stock_id, l_quantity::BIGINT, cents,
                 d)), 1, 15))::BIGINT AS id, stock_id,
               CASE WHEN l_linenumber % 2 = 0 THEN 'sell' ELSE 'buy' END AS action, d AS trade_date,
               l_quantity AS shares, price, l_extendedprice * 0.001425::DOUBLE AS fee,
               CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice * 0.003::DOUBLE ELSE 0.0::DOUBLE END AS tax
        FROM fx_ticks"""),
    "fx_news": ((), """
        SELECT doc_id AS news_id, lang AS stock_id, source AS title, text AS content, 'doc/' || doc_id AS url,
               TIMESTAMP '2024-01-01' + to_days((doc_id % 365)::INT) AS published_at FROM documents"""),
    "fx_embed": ((), "SELECT vec_id AS news_id, embedding FROM embeddings"),
}


def with_views(names: tuple[str, ...], extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """``WITH`` clause holding the named views and everything they read, in order."""
    catalog = {**SQL, **(extra or {})}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for dep in catalog[name][0]:
                visit(dep)
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({catalog[n][1]})" for n in ordered) if ordered else ""
