"""Constraint and completeness checks; each returns its findings as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.functions.calendar import effective_start
from equilens.functions.windows import KEY, TIME


def duplicate_keys(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*pk).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def unknown_keys(df: DataFrame, stock: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct codes missing from the master."""
    return df.select(key).distinct().join(stock.select(key), key, "left_anti")


def trading_calendar(bars: DataFrame) -> DataFrame:
    """Distinct trading dates with their month."""
    return bars.select(TIME).distinct().withColumn("month", F.trunc(F.col(TIME), "month"))


def month_calendar(bars: DataFrame) -> DataFrame:
    """Trading days and the last of them per month."""
    return trading_calendar(bars).groupBy("month").agg(
        F.count(F.lit(1)).alias("trading_days"), F.max(TIME).alias("last_day")
    )


def newest_per_month(bars: DataFrame) -> DataFrame:
    return bars.groupBy(KEY, F.trunc(F.col(TIME), "month").alias("month")).agg(F.max(TIME).alias("max_date"))


def month_completeness(bars: DataFrame, stock: DataFrame, month, calendar: DataFrame | None = None) -> DataFrame:
    """Status of every security in one month against its last trading day."""
    days = (month_calendar(bars) if calendar is None else calendar).filter(F.col("month") == F.lit(month))
    last_day = days.select("last_day").scalar()
    held = newest_per_month(bars).filter(F.col("month") == F.lit(month))
    status = (
        F.when(F.col("max_date").isNull(), "missing")
        .when(F.col("max_date") >= last_day, "complete")
        .otherwise("short")
    )
    return stock.select(KEY).join(held.select(KEY, "max_date"), KEY, "left").select(
        KEY, "max_date", status.alias("status")
    )


def all_month_completeness(bars: DataFrame) -> DataFrame:
    """Status of every (security, month) a security has bars in, against the month's last trading day."""
    held = newest_per_month(bars)
    status = F.when(F.col("max_date") >= F.col("last_day"), "complete").otherwise("short")
    return held.join(month_calendar(bars), "month").select(KEY, "month", "max_date", status.alias("status"))


def completeness_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def backfill_plan(stock: DataFrame, bars: DataFrame, end_month, empty_log: DataFrame | None = None) -> DataFrame:
    """(security, month) pairs still to be fetched.

    Months run from the listing month (not before the market floor) to
    ``end_month``; present months and months logged as empty are left out.
    """
    start = effective_start(F.col("list_date"), F.col("market"))
    end = F.lit(end_month).cast("date")
    months = F.when(start <= end, F.sequence(start, end, F.expr("interval 1 month"))).otherwise(
        F.array().cast("array<date>")
    )
    grid = stock.select(KEY, F.explode(months).alias("month"))
    present = newest_per_month(bars).select(KEY, "month")
    todo = grid.join(present, [KEY, "month"], "left_anti")
    return todo if empty_log is None else todo.join(empty_log.select(KEY, "month"), [KEY, "month"], "left_anti")


def coverage(df: DataFrame, date_col: str, group: str) -> DataFrame:
    """Rows, distinct dates and date range per source."""
    per_date = df.groupBy(group, date_col).agg(F.count(F.lit(1)).alias("_n"))
    return per_date.groupBy(group).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("dates"), F.min(date_col).alias("first_date"),
        F.max(date_col).alias("last_date"),
    )
