"""Keyed combination of tables: overlay, dedupe, latest row, as-of and semi joins.

Duplicates are removed with ``max_by``/``min_by`` aggregates rather than ranked
windows: the aggregate combines before the shuffle, so any number of copies of
one key costs one row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.functions.windows import KEY, TIME, series


# Of these types, equal values are the same value, so a row's key is that of its group.
_PLAIN = {"string", "date", "boolean", "tinyint", "smallint", "int", "bigint"}
# Types of fixed width, of which a hash aggregate keeps single values.
_FIXED = _PLAIN - {"string"} | {"float", "double", "timestamp"}


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], best, keep: Sequence[str] | None) -> DataFrame:
    columns = df.columns if keep is None else list(keep)
    of_group = [c for c, kind in df.dtypes if c in keys and kind in _PLAIN]
    rest = [c for c in columns if c not in of_group] or columns
    kinds = dict(df.dtypes)
    by = order[0] if len(order) == 1 and isinstance(order[0], str) and order[0] in kinds else None
    if by and not df.schema[by].nullable and all(kinds[c] in _FIXED for c in (by, *rest)):
        # All columns see the same rows in the same sequence, so that rows equal in their order give one of them whole.
        return df.groupBy(*keys).agg(*[best(c, by).alias(c if c not in keys else f"_{c}") for c in rest]).select(
            *[(F.col(f"_{c}") if c in rest and c in keys else F.col(c)).alias(c) for c in columns])
    order = F.struct(*order)
    chosen = df.groupBy(*keys).agg(best(F.struct(*[F.col(c) for c in rest]), order).alias("_row"))
    return chosen.select(*[(F.col("_row")[c] if c in rest else F.col(c)).alias(c) for c in columns])


def keep_last(df: DataFrame, keys: Sequence[str], *order: str | Column, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order``; ``keep`` names the columns that are wanted."""
    return _pick(df, keys, order, F.max_by, keep)


def keep_first(df: DataFrame, keys: Sequence[str], *order: str | Column, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one with the smallest ``order``; ``keep`` names the columns that are wanted."""
    return _pick(df, keys, order, F.min_by, keep)


def one_version(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key; equal copies are merged, and different rows of one key are an error."""
    row = F.struct(*[F.col(c) for c in df.columns])
    both = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(row).alias("_row"), F.max(row).alias("_other"))
    clash = F.raise_error(F.concat(F.lit("several rows of one key and no order column: "), F.to_json("_row")))
    return both.filter(F.when(F.col("_row").eqNullSafe(F.col("_other")), F.lit(True)).otherwise(clash.cast("boolean"))).select(
        *[F.col("_row")[c].alias(c) for c in df.columns])


def latest_row(df: DataFrame, columns: Sequence[str], key: str = KEY, time_col: str = TIME) -> DataFrame:
    """Columns of every key's newest row; (key, time) is unique.

    One ``max_by`` per column: with fixed-width columns that stays a hash aggregate.
    """
    return df.groupBy(key).agg(*[F.max_by(c, time_col).alias(c) for c in columns])


def overlay(old: DataFrame, new: DataFrame, pk: Sequence[str], order_col: str | None = None) -> DataFrame:
    """Union by key where ``new`` wins; within ``new`` the greatest ``order_col`` wins."""
    rank = F.col(order_col) if order_col else F.lit(0)
    tagged_new = new.select(*old.columns, F.lit(1).alias("_batch"), rank.alias("_o"))
    tagged_old = old.select(
        *old.columns, F.lit(0).alias("_batch"), F.lit(None).cast(tagged_new.schema["_o"].dataType).alias("_o"))
    return keep_last(tagged_old.unionByName(tagged_new), pk, "_batch", "_o").drop("_batch", "_o")


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union of same-shape sources by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def distinct_codes(*frames: DataFrame, key: str = KEY) -> DataFrame:
    """Codes of all frames, each once, ascending."""
    return union_all(*[f.select(key) for f in frames]).distinct().orderBy(key)


def requested_and_known(requested: DataFrame, known: DataFrame, key: str = KEY) -> DataFrame:
    """Codes that are asked for and known, each once."""
    return requested.select(key).intersect(known.select(key))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows) of every table."""
    return union_all(*[t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, t in tables.items()])


def keep_known(df: DataFrame, stock: DataFrame | None, key: str = KEY) -> DataFrame:
    """Rows whose code is in the master; no master, no filter."""
    return df if stock is None else df.join(stock.select(key), key, "left_semi")


def point_in_time(df: DataFrame, known_col: str, as_of) -> DataFrame:
    """Rows already known on ``as_of`` (a date, text or Column); ``None`` keeps all."""
    if as_of is None:
        return df
    edge = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.filter(F.col(known_col) <= edge)


def _timeline(bars: DataFrame, other: DataFrame, other_time: str, other_first: bool, time_col: str):
    """Bars and other rows on one time axis, as two nullable structs."""
    b = bars.select(
        KEY, F.col(time_col).alias("_t"), F.lit(1 if other_first else 0).alias("_kind"),
        F.struct(*bars.columns).alias("_bar"),
        F.lit(None).cast(other.select(F.struct(*other.columns).alias("s")).schema["s"].dataType).alias("_other"),
    )
    o = other.select(
        KEY, F.col(other_time).alias("_t"), F.lit(0 if other_first else 1).alias("_kind"),
        F.lit(None).cast(b.schema["_bar"].dataType).alias("_bar"),
        F.struct(*other.columns).alias("_other"),
    )
    return b.unionByName(o), Window.partitionBy(KEY).orderBy("_t", "_kind")


def as_of_known(bars: DataFrame, facts: DataFrame, known_col: str, columns: Sequence[str], time_col: str = TIME):
    """Each bar with the newest fact known on its date (backward, inclusive).

    Bars and facts are ordered on one axis per security and the last fact is
    carried forward: one shuffle, no range join. Facts with the same known date
    are first reduced to the newest, so the partition is bounded by dates.
    """
    per_day = keep_last(facts.select(KEY, known_col, *columns), (KEY, known_col), *columns)
    axis, w = _timeline(bars, per_day, known_col, other_first=True, time_col=time_col)
    seen = F.last("_other", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        axis.withColumn("_seen", seen)
        .filter(F.col("_bar").isNotNull())
        .select(
            *[F.col("_bar")[c].alias(c) for c in bars.columns],
            F.col("_seen")[known_col].alias(known_col),
            *[F.col("_seen")[c].alias(c) for c in columns],
        )
    )


def around_events(events: DataFrame, bars: DataFrame, event_date: str = "ex_date") -> DataFrame:
    """Each event with the close strictly before it and the first bar on or after it."""
    slim = bars.select(KEY, TIME, "close")
    axis, w = _timeline(slim, events, event_date, other_first=True, time_col=TIME)
    before = F.last("_bar", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    newest_first = Window.partitionBy(KEY).orderBy(F.col("_t").desc(), F.col("_kind").desc())
    after = F.last("_bar", ignorenulls=True).over(newest_first.rowsBetween(Window.unboundedPreceding, -1))
    return (
        axis.withColumn("_before", before).withColumn("_after", after)
        .filter(F.col("_other").isNotNull())
        .select(
            *[F.col("_other")[c].alias(c) for c in events.columns],
            F.col("_before")["close"].alias("prev_close"),
            F.col("_after")[TIME].alias("bar_date"),
        )
    )


def close_on_or_latest(wanted: DataFrame, bars: DataFrame) -> DataFrame:
    """(stock_id, trade_date) rows with that day's close, else the security's newest close."""
    newest = latest_row(bars, ["close"]).withColumnRenamed("close", "_newest")
    same_day = bars.select(KEY, TIME, F.col("close").alias("_same"))
    return (
        wanted.join(same_day, [KEY, TIME], "left").join(newest, KEY, "left")
        .withColumn("close", F.coalesce("_same", "_newest")).drop("_same", "_newest")
    )
