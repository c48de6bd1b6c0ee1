"""Declared schemas and primary keys of the tables (fixed values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "stock": "stock_id string, name string, market string, list_date date, industry string, security_type string",
    "etf_daily": (
        "stock_id string, trade_date date, nav decimal(38,10), prev_nav decimal(38,10), units decimal(38,10),"
        " aum decimal(38,10), nav_chg_pct decimal(38,10)"
    ),
    "price_daily": (
        "stock_id string, trade_date date, open decimal(12,4), high decimal(12,4), low decimal(12,4),"
        " close decimal(12,4), volume bigint, amount bigint, trades int, adj_open decimal(12,4),"
        " adj_high decimal(12,4), adj_low decimal(12,4), adj_close decimal(12,4), adj_factor decimal(16,10)"
    ),
    "market_index": "index_id string, trade_date date, close decimal(14,4)",
    "monthly_revenue": (
        "stock_id string, revenue_month date, revenue bigint, mom_pct decimal(18,2), yoy_pct decimal(18,2),"
        " available_date date"
    ),
    "financial_statement": (
        "stock_id string, period_date date, statement string, item string, value decimal(20,4), available_date date"
    ),
    "fundamentals_quarterly": (
        "stock_id string, period_date date, available_date date, revenue bigint, gross_profit bigint,"
        " operating_income bigint, pretax_income bigint, net_income bigint, eps decimal(10,2), total_assets bigint,"
        " total_equity bigint, total_liabilities bigint, operating_cash_flow bigint, gross_margin decimal(18,2),"
        " op_margin decimal(18,2), net_margin decimal(18,2), roe decimal(18,2), debt_ratio decimal(18,2)"
    ),
    "dividend": (
        "stock_id string, announce_date date, year_label string, cash_dividend decimal(10,6),"
        " stock_dividend decimal(10,6), ex_cash_date date, ex_stock_date date, cash_pay_date date"
    ),
    "capital_reduction": (
        "stock_id string, resume_date date, pre_close decimal(12,4), post_ref_price decimal(12,4), reason string"
    ),
    "inst_trades": (
        "stock_id string, trade_date date, foreign_net bigint, foreign_dealer_net bigint, trust_net bigint,"
        " dealer_self_net bigint, dealer_hedge_net bigint"
    ),
    "margin_trading": (
        "stock_id string, trade_date date, margin_balance bigint, short_balance bigint, margin_buy bigint,"
        " margin_sell bigint, short_sell bigint, short_buy bigint"
    ),
    "shareholding": (
        "stock_id string, trade_date date, foreign_ratio decimal(8,2), foreign_shares bigint, shares_issued bigint"
    ),
    "valuation_daily": (
        "stock_id string, trade_date date, per decimal(10,2), pbr decimal(10,2), dividend_yield decimal(8,2)"
    ),
    "shareholding_dist": (
        "stock_id string, data_date date, level smallint, holders bigint, shares bigint, pct decimal(8,4)"
    ),
    "news": (
        "news_id bigint, stock_id string, title string, content string, source string, url string,"
        " published_at timestamp"
    ),
    "news_embedding": "news_id bigint, model string, embedding array<float>",
    "trade_log": (
        "id bigint, stock_id string, action string, trade_date date, shares decimal(38,10), price decimal(38,10),"
        " fee decimal(38,10), tax decimal(38,10), note string, created_at timestamp"
    ),
}

PRIMARY_KEY = {
    "stock": ("stock_id",),
    "etf_daily": ("stock_id", "trade_date"),
    "price_daily": ("stock_id", "trade_date"),
    "market_index": ("index_id", "trade_date"),
    "monthly_revenue": ("stock_id", "revenue_month"),
    "financial_statement": ("stock_id", "period_date", "statement", "item"),
    "fundamentals_quarterly": ("stock_id", "period_date"),
    "dividend": ("stock_id", "announce_date"),
    "capital_reduction": ("stock_id", "resume_date"),
    "inst_trades": ("stock_id", "trade_date"),
    "margin_trading": ("stock_id", "trade_date"),
    "shareholding": ("stock_id", "trade_date"),
    "valuation_daily": ("stock_id", "trade_date"),
    "shareholding_dist": ("stock_id", "data_date", "level"),
    "news": ("news_id",),
    "news_embedding": ("news_id",),
    "trade_log": ("id",),
}

TABLES = {name: T.StructType.fromDDL(ddl) for name, ddl in _DDL.items()}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the declared columns in order, cast, and fill absent ones with NULL."""
    present = set(df.columns)

    def one(field: T.StructField) -> Column:
        source = F.col(field.name) if field.name in present else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[one(f) for f in TABLES[table].fields])
