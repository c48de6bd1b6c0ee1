"""Back-adjusted prices from dividends and capital reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.functions.price import dividend_ratio, positive
from equilens.functions.windows import KEY, TIME

OHLC = ("open", "high", "low", "close")


def dividend_events(
    dividends: DataFrame, *, cash=("cash_dividend",), stock=("stock_dividend",), missing_component: str = "drop"
) -> DataFrame:
    """Cash and stock amounts summed per (stock_id, ex_date).

    Amounts may come in several component columns. With ``drop`` a missing
    component voids the amount; with ``zero`` it counts as nothing. Only
    positive amounts with an ex-date become events.
    """

    def amount(parts):
        total = None
        for p in parts:
            v = F.col(p).cast("double")
            v = F.coalesce(v, F.lit(0.0)) if missing_component == "zero" else v
            total = v if total is None else total + v
        return total

    def leg(date_col: str, parts, name: str) -> DataFrame:
        other = "stock" if name == "cash" else "cash"
        return dividends.select(
            KEY, F.col(date_col).alias("ex_date"), amount(parts).alias(name), F.lit(0.0).alias(other)
        ).filter(F.col("ex_date").isNotNull() & (F.col(name) > 0))

    both = leg("ex_cash_date", cash, "cash").unionByName(leg("ex_stock_date", stock, "stock"))
    return both.groupBy(KEY, "ex_date").agg(F.sum("cash").alias("cash"), F.sum("stock").alias("stock"))


def valid_event() -> Column:
    """Capital reductions with a date and two positive prices."""
    return F.col("resume_date").isNotNull() & (F.col("pre_close") > 0) & (F.col("post_ref_price") > 0)


def reduction_events(reductions: DataFrame) -> DataFrame:
    """Reference price over previous close, multiplied per (stock_id, ex_date)."""
    pre, ref = F.col("pre_close").cast("double"), F.col("post_ref_price").cast("double")
    return (
        reductions.filter(valid_event())
        .groupBy(KEY, F.col("resume_date").alias("ex_date"))
        .agg(F.product(ref / pre).alias("reduction"))
    )


def adjust_prices(bars: DataFrame, dividends: DataFrame | None, reductions: DataFrame | None) -> DataFrame:
    """Bars plus ``adj_open..adj_close`` and ``adj_factor``.

    ``dividends`` has (stock_id, ex_date, cash, stock), ``reductions`` has
    (stock_id, ex_date, reduction), one row per date each. Events are placed on
    the bars' own time axis, before the bar of the same date. There the close
    of the last earlier bar is the reference, and an event's ratio reaches
    exactly the bars before the one it lands on, so the factor of a bar is the
    product of all later events. One shuffle on the security, no range join.
    """
    spark = bars.sparkSession
    day = f"{KEY} string, ex_date date"
    dividends = dividends if dividends is not None else spark.createDataFrame([], f"{day}, cash double, stock double")
    reductions = reductions if reductions is not None else spark.createDataFrame([], f"{day}, reduction double")

    carried = [c for c in bars.columns if c not in (KEY, TIME) and not c.startswith("adj_")]
    bar_rows = bars.select(KEY, F.col(TIME).alias("_t"), F.lit(1).alias("_kind"), F.struct(*carried).alias("_bar"))
    event_rows = dividends.select(KEY, F.col("ex_date").alias("_t"), F.lit(0).alias("_kind"), "cash", "stock")
    cut_rows = reductions.select(KEY, F.col("ex_date").alias("_t"), F.lit(0).alias("_kind"), "reduction")
    axis = bar_rows.unionByName(event_rows, allowMissingColumns=True).unionByName(cut_rows, allowMissingColumns=True)

    by_key = Window.partitionBy(KEY)
    w = by_key.orderBy("_t", "_kind")
    close = F.col("_bar")["close"].cast("double")
    axis = axis.select(
        "*",
        F.last(close, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev"),
        F.max(F.when(F.col("_kind") == 1, F.col("_t"))).over(
            w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ).alias("_last_bar"),
    )
    from_dividend = F.when(
        F.col("cash").isNotNull(), positive(dividend_ratio(F.col("_prev"), F.col("cash"), F.col("stock")))
    )
    lands = (F.col("_kind") == 0) & (F.col("_t") <= F.col("_last_bar"))
    axis = axis.withColumn("_ratio", F.when(lands, F.coalesce(from_dividend, positive(F.col("reduction")))))
    # Newest first: a growing frame, where one that shrinks from the left would be summed anew per row.
    newer = by_key.orderBy(F.col("_t").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    axis = axis.withColumn("adj_factor", F.coalesce(F.product("_ratio").over(newer), F.lit(1.0)))
    return axis.filter(F.col("_kind") == 1).select(
        KEY,
        F.col("_t").alias(TIME),
        *[F.col("_bar")[c].alias(c) for c in carried],
        *[F.round(F.col("_bar")[c].cast("double") * F.col("adj_factor"), 4).alias(f"adj_{c}") for c in OHLC],
        "adj_factor",
    )
