"""Adjusted prices kept up to date: only what a load changes is computed and written again.

An event reaches all earlier bars of its security and no later ones. So a security whose stored bars and landed events
are what they were gets its new bars with a factor of 1, and any other one is adjusted anew from its first bar. What
they were is told by fingerprints, sums of row hashes that do not depend on order, kept per security beside the table.

The table lies in folders by a hash of the security and by month. A load rewrites the folders of the hash values that
hold a changed security, and elsewhere the months of the new bars.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.functions.windows import KEY, PART, TIME, Part
from equilens.operators.adjust import OHLC, adjust_prices
from equilens.session import materialize, shared_folder
from equilens.sinks.tables import ADJUSTED, exists, read_version, remove, write_version

STATE = f"{KEY} string, last_date date, bars long, bars_print decimal(38,0), events long, events_print decimal(38,0)"


def row_hash(df: DataFrame) -> Column:
    """Hash of a row whatever the order of its columns."""
    return F.xxhash64(*[x for c in sorted(df.columns) for x in (F.lit(c), F.col(c))]).cast("decimal(38,0)")


def _events(dividends: DataFrame | None, reductions: DataFrame | None, spark: SparkSession) -> DataFrame:
    none = spark.createDataFrame([], f"{KEY} string, ex_date date, _h decimal(38,0)")
    for frame in (dividends, reductions):
        if frame is not None:
            none = none.unionByName(frame.select(KEY, "ex_date", row_hash(frame).alias("_h")))
    return none


def changes(bars: DataFrame, dividends: DataFrame | None, reductions: DataFrame | None, state: DataFrame) -> DataFrame:
    """One row per security of ``bars`` or ``state``: its new state, the last date it was stored up to (``known``) and
    whether it must be adjusted anew (``dirty``): its stored bars or the events that land on its bars are others now.
    """
    spark = bars.sparkSession
    known = state.select(KEY, *[F.col(c).alias(f"_{c}") for c in ("last_date", "bars", "bars_print", "events", "events_print")])
    raw = bars.select(*[c for c in bars.columns if not c.startswith("adj_")])
    old = F.col(TIME) <= F.col("_last_date")
    sums = raw.select(KEY, TIME, row_hash(raw).alias("_h")).join(known.select(KEY, "_last_date"), KEY, "left").groupBy(KEY).agg(
        F.max(TIME).alias("last_date"), F.count(F.lit(1)).alias("bars"), F.sum("_h").alias("bars_print"),
        F.count(F.when(old, 1)).alias("old_bars"), F.sum(F.when(old, F.col("_h"))).alias("old_print"))
    landed = _events(dividends, reductions, spark).join(sums.select(KEY, "last_date"), KEY).where("ex_date <= last_date")
    landed = landed.groupBy(KEY).agg(F.count(F.lit(1)).alias("events"), F.sum("_h").alias("events_print"))
    both = sums.join(landed, KEY, "left").withColumn("events", F.coalesce("events", F.lit(0))).join(known, KEY, "full")
    same = [("old_bars", "_bars"), ("old_print", "_bars_print"), ("events", "_events"), ("events_print", "_events_print")]
    dirty = F.lit(False)
    for now, then in same:
        dirty = dirty | ~F.col(now).eqNullSafe(F.col(then))
    return both.select(
        KEY, "last_date", "bars", "bars_print", "events", "events_print", F.col("_last_date").alias("known"), dirty.alias("dirty"))


def readjust(
    spark: SparkSession, path: str, bars: DataFrame, dividends: DataFrame | None, reductions: DataFrame | None,
    buckets: int = 64, part: Part = Part("month"),
) -> DataFrame:
    """Bring the adjusted table at ``path`` up to ``bars`` and the events; returns the changed securities.

    ``bars`` is the whole bar table, of which (security, date) is the key. The result equals
    ``adjust_prices(bars, dividends, reductions)``. Fingerprints are written last, and a load that died is repeated
    without harm, since folders are replaced as a whole.
    """
    marks = f"{path.rstrip('/')}_fingerprints"
    state = read_version(spark, marks)
    state = spark.createDataFrame([], STATE) if state is None else state
    # In a file of its own, whose size is known: joins with it need not move the bars where it is small.
    aside = f"{shared_folder(spark).rstrip('/')}/changes-{uuid.uuid4().hex}"
    changes(bars, dividends, reductions, state).write.parquet(aside)
    told = spark.read.parquet(aside)
    dirty = told.where("dirty").select(KEY)
    bucket = F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int")
    touched = [r[0] for r in dirty.select(bucket.alias("b")).distinct().collect()]  # numbers below ``buckets``
    inside = F.col("bucket").isin(touched) if touched else F.lit(False)

    some = lambda df: None if df is None else df.join(dirty, KEY, "left_semi")
    # New bars of the others go with them: none of their events is landed again, so their factor is 1.
    fresh = bars.join(told.where("not dirty").select(KEY, "known"), KEY).where(F.col(TIME) > F.col("known"))
    wanted = bars.join(told.select(KEY, "dirty", "known"), KEY).where(F.col("dirty") | (F.col(TIME) > F.col("known"))).select(*bars.columns)
    placed = lambda df: df.select(*[c for c in ADJUSTED if not c.startswith("adj_")], "adj_factor", bucket.alias("bucket"), part.value.alias(PART))
    new = placed(adjust_prices(wanted, some(dividends), some(reductions)))
    before: list[tuple[int, int]] = []
    if exists(spark, path):
        stored = spark.read.parquet(path)
        before = [tuple(r) for r in stored.where(inside).select("bucket", PART).distinct().collect()]
        months = [r[0] for r in fresh.select(part.value.alias(PART)).distinct().collect()]
        beside = F.col(PART).isin(months) if months else F.lit(False)
        # A load that died after its write left its new bars here: they are replaced, not repeated.
        kept = stored.where(inside | beside).join(told.where("not dirty").select(KEY, "known"), KEY)
        new = new.unionByName(kept.where(~F.coalesce(F.col(TIME) > F.col("known"), F.lit(False))).select(*new.columns))
    # Adjusted prices follow from the factor, so they are computed where the rows are written and not moved.
    rows = new.hint("rebalance", "bucket", PART).withColumns(
        {f"adj_{c}": F.round(F.col(c).cast("double") * F.col("adj_factor"), 4) for c in OHLC}).select(*ADJUSTED, "bucket", PART)
    rows = rows.sortWithinPartitions("bucket", PART, KEY, TIME)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", PART).parquet(path)
    if before:
        left = {tuple(r) for r in spark.read.parquet(path).where(inside).join(told.where("last_date is not null").select(KEY), KEY, "left_semi")
                .select("bucket", PART).distinct().collect()}
        for b, p in set(before) - left:
            remove(spark, f"{path}/bucket={b}/{PART}={p}")
    write_version(told.where("last_date is not null").select(*[c.split()[0] for c in STATE.split(", ")]), marks)
    dirty = materialize(dirty)
    remove(spark, aside)
    return dirty


def read_adjusted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*ADJUSTED)
