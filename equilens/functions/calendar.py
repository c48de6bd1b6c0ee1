"""Calendar rules: when a figure becomes known, and which jobs a date calls for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earliest month with files, per market.
FLOOR_LISTED = "2010-01-01"
FLOOR_OTC = "1994-01-01"
MARKET_LISTED = "上市"
MARKET_OTC = "上櫃"


def first_of_month(d: Column) -> Column:
    return F.trunc(d, "month")


def revenue_available(month: Column) -> Column:
    """Monthly revenue is public on the 10th of the next month."""
    return F.date_add(F.add_months(first_of_month(month), 1), 9)


def revenue_month(year: Column, month: Column) -> Column:
    """First of the month from separate year and month cells; implausible ones are NULL."""
    y = F.trim(year.cast("string")).try_cast("int")
    m = F.trim(month.cast("string")).try_cast("int")
    return F.when((y > 1900) & m.between(1, 12), F.make_date(y, m, F.lit(1)))


def statement_available(period: Column) -> Column:
    """Publication deadline of a quarter-end statement; other months map to themselves."""
    y, m = F.year(period), F.month(period)
    return (
        F.when(m == 3, F.make_date(y, F.lit(5), F.lit(15)))
        .when(m == 6, F.make_date(y, F.lit(8), F.lit(14)))
        .when(m == 9, F.make_date(y, F.lit(11), F.lit(14)))
        .when(m == 12, F.make_date(y + 1, F.lit(3), F.lit(31)))
        .otherwise(period)
    )


def effective_start(list_date: Column, market: Column) -> Column:
    """First month to hold files for: listing month, not before the market's floor."""
    floor = F.when(market == MARKET_OTC, F.to_date(F.lit(FLOOR_OTC))).otherwise(F.to_date(F.lit(FLOOR_LISTED)))
    return F.greatest(F.coalesce(first_of_month(list_date), floor), floor)


def iso_week_label(d: Column) -> Column:
    """``2026W28``: ISO year and week."""
    return F.concat(
        F.date_part(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0")
    )


def publishable_quarter(d: Column) -> Column:
    """Quarter whose statements are being published on a date, else NULL."""
    y, m, dd = F.year(d), F.month(d), F.dayofmonth(d)
    return (
        F.when(m == 4, F.concat((y - 1).cast("string"), F.lit("Q4")))
        .when((m == 5) & (dd >= 16), F.concat(y.cast("string"), F.lit("Q1")))
        .when((m == 8) & (dd >= 15), F.concat(y.cast("string"), F.lit("Q2")))
        .when((m == 11) & (dd >= 15), F.concat(y.cast("string"), F.lit("Q3")))
    )


def in_revenue_window(d: Column) -> Column:
    return F.dayofmonth(d).between(11, 20)


def is_weekend(d: Column) -> Column:
    return F.dayofweek(d).isin(1, 7)


def in_dividend_season(d: Column) -> Column:
    """Weekends of May to August."""
    return F.month(d).between(5, 8) & is_weekend(d)
