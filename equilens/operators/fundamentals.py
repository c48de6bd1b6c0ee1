"""Statements: long to wide, wide to long, quarterly ratios, dividend rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.functions.calendar import statement_available
from equilens.functions.parse import parse_num
from equilens.functions.price import pct
from equilens.functions.windows import KEY
from equilens.operators.relational import keep_first

# Statement order (later overrides a same-named item), metric -> accepted item
# names in order of preference, and the columns that are not statement items.
STATEMENTS = ("income", "balance", "cashflow")
ITEMS = {
    "revenue": ("Revenue",),
    "gross_profit": ("GrossProfit",),
    "operating_income": ("OperatingIncome",),
    "pretax_income": ("PreTaxIncome",),
    "net_income": (
        "IncomeAfterTaxes",
        "NetIncome",
        "TotalConsolidatedProfitForThePeriod",
        "ProfitLossAttributableToOwnersOfParent",
    ),
    "eps": ("EPS",),
    "total_assets": ("TotalAssets",),
    "total_equity": ("Equity", "TotalEquity", "EquityAttributableToOwnersOfParent"),
    "total_liabilities": ("Liabilities", "TotalLiabilities"),
    "operating_cash_flow": ("CashFlowsProvidedFromOperatingActivities", "NetCashProvidedByOperatingActivities"),
}
NOT_ITEMS = ("date", "stock_id", "毛利率(%)", "營業利益率(%)", "-", "")
WHOLE = tuple(m for m in ITEMS if m != "eps")


def pivot_statement(long: DataFrame, items: Sequence[str], key: Sequence[str] = (KEY, "date")) -> DataFrame:
    """(date, type, value) rows to one column per listed item, first value present."""
    return long.groupBy(*key).pivot("type", list(items)).agg(F.first("value", ignorenulls=True))


def pivot_investor_net(flows: DataFrame, names: Sequence[str], key: Sequence[str] = (KEY, "date")) -> DataFrame:
    """(date, name, buy, sell) rows to one ``<name>_net`` column per listed investor."""
    net = flows.withColumn("_net", F.col("buy") - F.col("sell"))
    wide = net.groupBy(*key).pivot("name", list(names)).agg(F.sum("_net"))
    return wide.select(*key, *[F.col(f"`{n}`").alias(f"{n}_net") for n in names])


def unpivot_statement(wide: DataFrame, statement: str, date_col: str = "date") -> DataFrame:
    """Wide statement to (stock_id, period_date, statement, item, value, available_date), no empty values."""
    items = [c for c in wide.columns if c.strip() not in NOT_ITEMS and c not in (KEY, date_col)]
    long = wide.select(KEY, date_col, *[F.col(f"`{c}`").cast("string").alias(c) for c in items]).unpivot(
        [KEY, date_col], items, "item", "_text"
    )
    return long.select(
        KEY, F.col(date_col).cast("date").alias("period_date"), F.lit(statement).alias("statement"), "item",
        parse_num(F.col("_text")).alias("value"),
        statement_available(F.col(date_col).cast("date")).alias("available_date"),
    ).filter(F.col("period_date").isNotNull() & F.col("value").isNotNull())


def build_quarterly(statements: DataFrame) -> DataFrame:
    """Ten metrics and five ratios per (security, quarter) from the long table, in one aggregate.

    A same-named item of a later statement overrides an earlier one.
    """
    order = F.element_at(
        F.create_map(*[x for i, s in enumerate(STATEMENTS) for x in (F.lit(s), F.lit(i))]), F.col("statement")
    )
    ranked = statements.withColumn("_order", order).withColumn("value", F.col("value").cast("double"))

    def item(name: str):
        mine = (F.col("item") == name) & F.col("value").isNotNull()
        return F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col("_order")))

    metrics = [F.coalesce(*[item(n) for n in names]).alias(m) for m, names in ITEMS.items()]
    wide = ranked.groupBy(KEY, "period_date").agg(*metrics)
    col = F.col
    return wide.select(
        KEY, "period_date", statement_available(col("period_date")).alias("available_date"),
        *[(F.rint(col(m)).cast("bigint") if m in WHOLE else col(m)).alias(m) for m in ITEMS],
        pct(col("gross_profit"), col("revenue")).alias("gross_margin"),
        pct(col("operating_income"), col("revenue")).alias("op_margin"),
        pct(col("net_income"), col("revenue")).alias("net_margin"),
        pct(col("net_income"), col("total_equity")).alias("roe"),
        pct(col("total_liabilities"), col("total_assets")).alias("debt_ratio"),
    )


def best_dividends(rows: DataFrame, order_col: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Per announcement the row with the largest cash plus stock amount; ties keep the first."""
    total = F.col("cash_dividend").cast("double") + F.col("stock_dividend").cast("double")
    return keep_first(rows, (KEY, "announce_date"), (-total).alias("t"), F.col(order_col).alias("o"), keep=keep)


def holders_at_least(dist: DataFrame, level: int = 12) -> DataFrame:
    """Summed percentage of the holder levels from ``level`` up, per security and date."""
    return dist.filter(F.col("level") >= level).groupBy(KEY, "data_date").agg(
        F.sum(F.col("pct").cast("double")).alias("pct")
    )


def top_holders(dist: DataFrame, level: int = 15) -> DataFrame:
    """The highest holder level, largest percentage first."""
    return dist.filter(F.col("level") == level).orderBy(F.col("pct").desc_nulls_last(), KEY, "data_date")

