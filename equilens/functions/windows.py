"""Window helpers shared by all per-security series.

Every helper works inside one window ``(stock_id, trade_date)``, so Spark plans
one exchange and one sort for a whole chain of them. A window partition holds
one security's bars; (stock_id, trade_date) is unique, so it never exceeds the
number of trading dates, however many rows the table has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "stock_id"
TIME = "trade_date"


def series(key: str = KEY, time_col: str = TIME) -> WindowSpec:
    return Window.partitionBy(key).orderBy(time_col)


def newest_first(key: str = KEY, time_col: str = TIME) -> WindowSpec:
    return Window.partitionBy(key).orderBy(F.col(time_col).desc())


def with_age(df: DataFrame, key: str = KEY, time_col: str = TIME, name: str = "rn") -> DataFrame:
    """Trading-day rank, 1 = newest.

    Counted from the oldest bar, so that it shares the ascending sort with lags
    and rolling frames instead of asking for a second, descending one.
    """
    w = series(key, time_col)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(name, (F.count(F.lit(1)).over(whole) - F.row_number().over(w) + 1).cast("int"))


def at_least_one(n: int | None) -> int | None:
    """A wanted number of rows as it was given; None stands for all rows."""
    if n is not None and int(n) < 1:
        raise ValueError(f"a number of rows above 0 or None is needed, not {n}")
    return None if n is None else int(n)


def head(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows of an ordered frame, all of them for None."""
    n = at_least_one(n)
    return df if n is None else df.limit(n)


def last_n(df: DataFrame, n: int | None, key: str = KEY, time_col: str = TIME) -> DataFrame:
    """The newest ``n`` rows of every key, all of them for None."""
    n = at_least_one(n)
    if n is None:
        return df
    ranked = df.withColumn("_age", F.row_number().over(newest_first(key, time_col)))
    return ranked.filter(F.col("_age") <= n).drop("_age")


def rolling_full(agg, x: Column, n: int, w: WindowSpec, ending: int = 0) -> Column:
    """``agg`` over exactly ``n`` rows ending ``-ending`` rows back; NULL until complete."""
    frame = w.rowsBetween(ending - n + 1, ending)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def rolling_partial(agg, x: Column, n: int, w: WindowSpec) -> Column:
    """``agg`` over up to ``n`` rows ending at the current one."""
    return agg(x).over(w.rowsBetween(1 - n, 0))


def trailing_baseline(x: Column, n: int, w: WindowSpec) -> Column:
    """Mean of the previous ``n`` rows, the current one left out."""
    return F.avg(x).over(w.rowsBetween(-n, -1))


def prior_trend(close: Column, start: int, look: int, w: WindowSpec) -> Column:
    """Sign of the move over the ``look`` closes that end ``start`` rows back; 0 below two closes."""
    frame = w.rowsBetween(-(start + look - 1), -start)
    move = F.lag(close, start).over(w) - F.first(close).over(frame)
    return F.when(F.count(close).over(frame) < 2, 0).otherwise(F.signum(move).cast("int"))


PART = "part"  # partition column of stored facts
UNITS = {"year": "yyyy", "month": "yyyyMM"}


@dataclass(frozen=True)
class Part:
    """Partition of a stored fact: the year or the month of its column ``of``.

    A frame that keeps the partition column says so in that column's metadata, so a column of the caller's that is
    called ``part`` means nothing here.
    """

    unit: str
    of: str = TIME

    @property
    def value(self) -> Column:
        return F.date_format(self.of, UNITS[self.unit]).cast("int")

    def starting(self, day: Column) -> Column:
        """The partition that ``day`` falls into."""
        return F.date_format(day, UNITS[self.unit]).cast("int")

    def marked(self, df: DataFrame) -> DataFrame:
        return df.withMetadata(PART, {"partition": self.unit, "of": self.of})


def partition_of(df: DataFrame, col: str) -> Part | None:
    """The partition of ``df`` by ``col``, if its partition column is there and marked as that."""
    marks = df.schema[PART].metadata if PART in df.columns else {}
    return Part(marks["partition"], col) if marks.get("of") == col and marks.get("partition") in UNITS else None


def latest_date(df: DataFrame, col: str = TIME) -> Column:
    """Newest date of a table as a scalar subquery: no join, evaluated once.

    Of a stored fact with its partition column only the newest partition is read.
    """
    if partition_of(df, col):
        df = df.filter(F.col(PART) == df.agg(F.max(PART)).scalar())
    return df.agg(F.max(col)).scalar()


def trailing_calendar(df: DataFrame, date_col: str, days: int, newest: Column | None = None) -> DataFrame:
    """Rows within ``days`` calendar days of the newest date (exclusive lower bound).

    Of a stored fact with its partition column (``read_fact(partitioned=True)``), which is dropped, older partitions
    are not opened.
    """
    edge = F.date_sub(latest_date(df, date_col) if newest is None else newest, days)
    if part := partition_of(df, date_col):
        df = df.filter(F.col(PART) >= part.starting(edge)).drop(PART)
    return df.filter(F.col(date_col) > edge)
