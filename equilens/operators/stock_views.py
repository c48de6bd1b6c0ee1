"""Per-security series for charts and detail pages, for all securities at once.

Pass ``ids`` to restrict them; the filter reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equilens.functions.price import growth, net_of, ratio
from equilens.functions.windows import KEY, TIME, at_least_one, last_n, latest_date, series
from equilens.operators.relational import close_on_or_latest, latest_row

UNITS = {"W": "week", "M": "month", "Q": "quarter"}
NET_PARTS = ("foreign_net", "foreign_dealer_net", "trust_net", "dealer_self_net", "dealer_hedge_net")


def only(df: DataFrame, ids: Sequence[str] | None) -> DataFrame:
    return df if not ids else df.filter(F.col(KEY).isin(*ids))


def _bucket(unit: str):
    return F.date_trunc(unit, F.col(TIME)).cast("date")


def resample_bars(bars: DataFrame, unit: str, adjusted: bool = True) -> DataFrame:
    """Bars per calendar bucket: first open, extremes, last close, summed volume."""
    p = "adj_" if adjusted else ""
    return bars.groupBy(KEY, _bucket(unit).alias("_bucket")).agg(
        F.min_by(f"{p}open", TIME).alias("open"), F.max(f"{p}high").alias("high"), F.min(f"{p}low").alias("low"),
        F.max_by(f"{p}close", TIME).alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("_bucket", TIME)


def prices(bars: DataFrame, tf: str = "D", n: int | None = 250, adjusted: bool = True, ids=None) -> DataFrame:
    """Newest ``n`` daily, weekly or monthly bars of every security, None for all."""
    source = only(bars, ids)
    if tf.upper() == "D":
        p = "adj_" if adjusted else ""
        shaped = source.select(KEY, TIME, *[F.col(p + x).alias(x) for x in ("open", "high", "low", "close")], "volume")
    elif tf.upper() in ("W", "M"):
        shaped = resample_bars(source, UNITS[tf.upper()], adjusted)
    else:
        raise ValueError("tf must be D, W or M")
    return last_n(shaped, n)


def chips(inst: DataFrame, margin: DataFrame, days: int | None = 60, ids=None) -> DataFrame:
    """Institutional nets and margin balances, newest ``days`` rows of each, None for all."""
    net = net_of(*[F.col(c) for c in NET_PARTS if c in inst.columns])
    nets = last_n(only(inst, ids), days).select(KEY, TIME, net.alias("inst_net"), "foreign_net", "trust_net")
    held = last_n(only(margin, ids), days).select(KEY, TIME, "margin_balance", "short_balance")
    return nets.join(held, [KEY, TIME], "full")


def period_end(margin: DataFrame, unit: str) -> DataFrame:
    """Last balances in each calendar bucket."""
    return margin.groupBy(KEY, _bucket(unit).alias("_bucket")).agg(
        F.max_by("margin_balance", TIME).alias("margin_balance"),
        F.max_by("short_balance", TIME).alias("short_balance"),
    ).withColumnRenamed("_bucket", TIME)


def margin_series(margin: DataFrame, tf: str = "D", n: int | None = 60, ids=None) -> DataFrame:
    """Balances, their changes and the short-to-margin percentage of the newest ``n`` rows, None for all."""
    source = only(margin, ids)
    if tf.upper() != "D":
        if tf.upper() not in UNITS:
            raise ValueError("tf must be D, W, M or Q")
        source = period_end(source, UNITS[tf.upper()])
    n = at_least_one(n)
    w = series()
    m, s = F.col("margin_balance"), F.col("short_balance")
    changed = last_n(source, None if n is None else n + 1).select(
        KEY, TIME, "margin_balance", "short_balance",
        (m - F.lag(m).over(w)).alias("margin_chg"), (s - F.lag(s).over(w)).alias("short_chg"),
        F.when(m > 0, F.round(s.cast("double") / m.cast("double") * 100, 4)).alias("short_margin_ratio"),
    )
    return last_n(changed, n)


def etf_latest(etf: DataFrame, bars: DataFrame, ids=None) -> DataFrame:
    """Newest fund value of every ETF with its close and premium in percent."""
    cols = [TIME, "nav", "prev_nav", "units", "aum", "nav_chg_pct"]
    newest = latest_row(only(etf, ids), cols)
    priced = close_on_or_latest(newest, bars.select(KEY, TIME, F.col("close").cast("double").alias("close")))
    c, nav = F.col("close"), F.col("nav").cast("double")
    return priced.select(
        KEY, *cols, "close",
        F.when((c != 0) & (nav != 0), F.round((c - nav) / nav * 100, 3)).alias("premium_discount"),
    )


def etf_history(etf: DataFrame, n: int = 60, ids=None) -> DataFrame:
    return last_n(only(etf, ids), n)


def ttm_dividends(dividends: DataFrame, bars: DataFrame, ids=None, days: int = 365) -> DataFrame:
    """Cash dividends of the last twelve months per security, and their yield on the newest close."""
    edge = F.date_sub(latest_date(bars), days)
    sums = only(dividends, ids).filter(F.col("ex_cash_date") >= edge).groupBy(KEY).agg(
        F.round(F.sum(F.col("cash_dividend").cast("double")), 4).alias("_cash"), F.count(F.lit(1)).alias("_n")
    )
    newest = latest_row(only(bars, ids), ["close"]).select(KEY, F.col("close").cast("double").alias("close"))
    cash = F.coalesce("_cash", F.lit(0.0))
    return newest.join(sums, KEY, "left").select(
        KEY, cash.alias("ttm_cash"), F.coalesce("_n", F.lit(0)).alias("ttm_count"),
        F.round(F.nullif(ratio(cash, F.col("close")), F.lit(0.0)) * 100, 2).alias("ttm_yield"),
    )


def dividend_history(dividends: DataFrame, n: int = 36, ids=None) -> DataFrame:
    """Newest ``n`` dividend rows per security by ex-date (else announcement), amounts to four decimals."""
    dated = only(dividends, ids).withColumn("_when", F.coalesce("ex_cash_date", "announce_date"))
    amounts = {c: F.round(F.col(c).cast("double"), 4) for c in ("cash_dividend", "stock_dividend")}
    return last_n(dated, n, time_col="_when").withColumns(amounts).drop("_when")


def revenue_history(revenue: DataFrame, n: int = 24, ids=None) -> DataFrame:
    return last_n(only(revenue, ids), n, time_col="revenue_month")


def quarterly_history(quarterly: DataFrame, n: int = 12, ids=None) -> DataFrame:
    return last_n(only(quarterly, ids), n, time_col="period_date")


def stock_detail(snapshot: DataFrame, stock_id: str) -> DataFrame:
    """The snapshot row of one security; empty when it is unknown."""
    return snapshot.filter(F.col(KEY) == stock_id)


def revenue_growth(revenue: DataFrame, time_col: str = "revenue_month") -> DataFrame:
    """Change to the previous month and to twelve rows earlier, in percent, gaps carried forward."""
    w = series(time_col=time_col)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(F.col("revenue").cast("double"), ignorenulls=True).over(so_far)
    carried = revenue.withColumn("_r", filled)
    r = F.col("_r")
    return carried.select(
        *revenue.columns,
        F.round(growth(r, F.lag(r, 1).over(w)) * 100, 2).alias("mom"),
        F.round(growth(r, F.lag(r, 12).over(w)) * 100, 2).alias("yoy"),
    )

