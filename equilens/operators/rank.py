"""Percent rank that never sorts a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINEAR = 256.0  # up to here buckets have a fixed width, beyond it their width grows with the value


def percent_rank_spread(
    df: DataFrame, group: str, value: str, name: str = "pct_rank", bucket_width: float = 1.0 / 64
) -> DataFrame:
    """``percent_rank() over (partition by group order by value nulls first)``.

    A group may hold most of the rows (there are two security types), so the
    rank is put together from counts: equal values are counted before the
    shuffle, values are laid into buckets (of a fixed width near 0 and of a
    fixed share of the value farther out, some 160,000 in all, whose running
    total is a bounded window), and only the inside of one bucket is ordered.
    Missing values rank first, hence 0, and take part in the pool size; they
    need no rank and are kept out of the joins.
    """
    x = F.col(value).cast("double")
    far = F.floor(F.log2(F.abs(x) / LINEAR) / bucket_width) + int(LINEAR / bucket_width) + 1
    cut = F.when(F.abs(x) <= LINEAR, F.floor(x / bucket_width)).otherwise(F.signum(x) * far)
    per_value = (
        df.filter(F.col(value).isNotNull())
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", cut.cast("int"))
    )
    up_to_here = Window.partitionBy(group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = per_value.withColumn("_inside", F.coalesce(F.sum("_n").over(up_to_here), F.lit(0)))

    lower_buckets = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        per_value.groupBy(group, "_bucket")
        .agg(F.sum("_n").alias("_m"))
        .withColumn("_below", F.coalesce(F.sum("_m").over(lower_buckets), F.lit(0)))
        .select(F.col(group).alias("_bg"), F.col("_bucket").alias("_bb"), "_below")
    )
    pool = df.groupBy(F.col(group).alias("_pg")).agg(
        F.count(F.lit(1)).alias("_total"), F.count_if(F.col(value).isNull()).alias("_missing")
    )
    ranks = (
        inside.join(buckets, F.col(group).eqNullSafe(F.col("_bg")) & (F.col("_bucket") == F.col("_bb")))
        .join(pool, F.col(group).eqNullSafe(F.col("_pg")))
        .select(
            F.col(group).alias("_rg"),
            F.col(value).alias("_rv"),
            F.try_divide(
                (F.col("_missing") + F.col("_below") + F.col("_inside")).cast("double"),
                F.nullif(F.col("_total") - 1, F.lit(0)),
            ).alias("_rank"),
        )
    )
    known = (
        df.filter(F.col(value).isNotNull()).join(ranks, F.col(group).eqNullSafe(F.col("_rg")) & (F.col(value) == F.col("_rv")), "left")
        .withColumn(name, F.coalesce(F.col("_rank"), F.lit(0.0)))
        .drop("_rg", "_rv", "_rank")
    )
    return known.unionByName(df.filter(F.col(value).isNull()).withColumn(name, F.lit(0.0)))
