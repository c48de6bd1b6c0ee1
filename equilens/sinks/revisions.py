"""Facts with all their revisions: what was known about a key on any day, after any later correction.

A history row holds its values from ``known_from`` until before ``known_to`` (null: still). The change points of a key,
its rows' starts and the updates', are put in order and equal neighbours merged, so a load that is repeated changes
nothing, and one that is late takes its place between those before and after it. A load that only confirms a value
leaves no trace, so a late value holds until the next change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equilens.functions.windows import KEY, PART, TIME, Part
from equilens.operators.relational import keep_last
from equilens.sinks.tables import by_month, exists, read_fact, touched_parts, write_fact

SPAN = ("known_from", "known_to")


def intervals(points: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Change points (key, values, ``known_from``), one per key and time, as rows with ``known_from`` and ``known_to``.

    A point whose values are those before it is no change. A window holds the revisions of one key.
    """
    values = [c for c in points.columns if c not in pk and c not in SPAN]
    w = Window.partitionBy(*pk).orderBy("known_from")
    now = F.struct(*values) if values else F.lit(True)
    marked = points.select(*pk, *values, "known_from", F.lag(F.struct(now.alias("v"))).over(w).alias("_before"), now.alias("_now"))
    changed = marked.where(F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col("_now")))
    return changed.select(*pk, *values, "known_from", F.lead("known_from").over(w).alias("known_to"))


def revised(history: DataFrame | None, updates: DataFrame, pk: Sequence[str], known: Column | str, order_col: str | None = None) -> DataFrame:
    """``history`` with the values that ``updates`` made known at ``known`` (a column or its name).

    Of several updates of a key and time the one of the greatest ``order_col`` counts. Keys that an update leaves out
    keep what is known of them.
    """
    at = F.col(known) if isinstance(known, str) else known
    dropped = {known, order_col} if isinstance(known, str) else {order_col}
    values = [c for c in updates.columns if c not in pk and c not in dropped]
    order = ["_new", "_o"] if order_col else ["_new"]
    points = updates.select(
        *pk, *values, at.alias("known_from"), F.lit(1).alias("_new"), *([F.col(order_col).alias("_o")] if order_col else []))
    if history is not None:
        old = history.select(*pk, *values, "known_from", F.lit(0).alias("_new"))
        points = old.unionByName(points, allowMissingColumns=True)
    return intervals(keep_last(points, [*pk, "known_from"], *order).drop("_new", "_o"), pk)


def known_on(history: DataFrame, day) -> DataFrame:
    """The values as they were known at the end of ``day`` (a date, a time or a Column), without the span."""
    edge = day if isinstance(day, Column) else F.lit(day)
    return history.where((F.col("known_from") <= edge) & (F.col("known_to").isNull() | (F.col("known_to") > edge))).drop(*SPAN)


def as_of(history: DataFrame, known_day, date_col: str, upto) -> DataFrame:
    """Both time axes: rows about dates up to ``upto``, as they were known on ``known_day``."""
    return known_on(history, known_day).where(F.col(date_col) <= (upto if isinstance(upto, Column) else F.lit(upto)))


def revise(
    spark: SparkSession, path: str, updates: DataFrame, pk: Sequence[str], known: Column | str, order_col: str | None = None,
    part: Part | None = None,
) -> None:
    """Add a load to the stored history. Only the partitions (months of a date in the key) of the load are rewritten."""
    part = part or by_month(pk[-1] if pk[-1] != KEY else TIME)
    if not exists(spark, path):
        write_fact(revised(None, updates, pk, known, order_col), path, part, (*pk, "known_from"))
        return
    stored = touched_parts(spark.read.parquet(path), updates, part).drop(PART)
    # Keys that the load does not name keep their rows as they are; only named ones pass through the window.
    named = updates.select(*pk).distinct()
    rest = stored.join(named, list(pk), "left_anti")
    mine = revised(stored.join(named, list(pk), "left_semi"), updates, pk, known, order_col)
    write_fact(rest.select(*mine.columns).unionByName(mine), path, part, (*pk, "known_from"))


def read_history(spark: SparkSession, path: str, partitioned: bool = False) -> DataFrame:
    return read_fact(spark, path, partitioned)
