"""Support and resistance levels from clustered pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.functions.price import round_exact
from equilens.functions.windows import KEY, TIME, last_n, series, with_age

# Pivot half-width, cluster tolerance, distance to the close, labels.
PIVOT_BARS = 3
TOLERANCE = 0.02
ABOVE, BELOW = 1.005, 0.995
MIN_BARS = 20
LABELS = {"resistance": "壓力", "neckline": "頸線", "support": "近期支撐"}


def pivots(bars: DataFrame) -> DataFrame:
    """Bars with ``pivot_high`` / ``pivot_low``: extreme of the seven bars around; edges never qualify."""
    w = series().rowsBetween(-PIVOT_BARS, PIVOT_BARS)
    h, lo = F.col("adj_high").cast("double"), F.col("adj_low").cast("double")
    full = F.count(F.lit(1)).over(w) == 2 * PIVOT_BARS + 1
    return bars.select(
        "*",
        F.when(full & (h == F.max(h).over(w)), h).alias("pivot_high"),
        F.when(full & (lo == F.min(lo).over(w)), lo).alias("pivot_low"),
    )


def _clusters(values: Column) -> Column:
    """Ascending values grouped greedily: a value within 2% of the last group's mean joins it."""
    empty = F.array().cast("array<struct<total:double,n:int>>")

    def join_or_open(groups: Column, v: Column) -> Column:
        last = F.element_at(groups, -1)
        mean = last["total"] / last["n"]
        joined = F.struct((last["total"] + v).alias("total"), (last["n"] + 1).alias("n"))
        opened = F.struct(v.alias("total"), F.lit(1).alias("n"))
        kept = F.slice(groups, F.lit(1), F.size(groups) - 1)
        near = F.abs(v - mean) <= TOLERANCE * mean
        return F.when(near, F.concat(kept, F.array(joined))).otherwise(F.concat(groups, F.array(opened)))

    def step(groups: Column, v: Column) -> Column:
        first = F.array(F.struct(v.alias("total"), F.lit(1).alias("n")))
        return F.when(F.size(groups) == 0, first).otherwise(join_or_open(groups, v))

    return F.aggregate(F.array_sort(values), empty, step)


def level_clusters(bars: DataFrame, n: int | None = 120) -> DataFrame:
    """Clusters of the pivots in the newest ``n`` bars, None for all: side, price, touches, close."""
    marked = with_age(pivots(last_n(bars, n)))
    whole = marked.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("bars"),
        F.max_by(F.col("adj_close").cast("double"), F.col(TIME)).alias("close"),
        F.collect_list("pivot_high").alias("highs"),
        F.collect_list("pivot_low").alias("lows"),
    ).filter(F.col("bars") >= MIN_BARS)
    sides = F.array(
        F.struct(F.lit("high").alias("side"), _clusters(F.col("highs")).alias("groups")),
        F.struct(F.lit("low").alias("side"), _clusters(F.col("lows")).alias("groups")),
    )
    return (
        whole.select(KEY, "close", F.explode(sides).alias("s"))
        .select(KEY, "close", "s.side", F.explode("s.groups").alias("g"))
        .select(KEY, "close", "side", round_exact(F.col("g.total") / F.col("g.n"), 2).alias("price"),
                F.col("g.n").alias("touches"))
    )


def levels(bars: DataFrame, n: int = 120) -> DataFrame:
    """Resistance, neckline and nearest support of every security.

    Most touches first, then the nearest. The nearest support is left out where
    it is within 2% of the neckline. At most 2 x 800 pivots per security.
    """
    gap = F.abs(F.col("price") - F.col("close"))
    usable = level_clusters(bars, n).filter(
        ((F.col("side") == "high") & (F.col("price") > F.col("close") * ABOVE))
        | ((F.col("side") == "low") & (F.col("price") < F.col("close") * BELOW))
    ).withColumn("gap", gap)
    by_side = Window.partitionBy(KEY, "side")
    ranked = usable.select(
        "*",
        F.row_number().over(by_side.orderBy(F.col("touches").desc(), "gap")).alias("by_touch"),
        F.row_number().over(by_side.orderBy("gap", F.col("touches").desc())).alias("by_gap"),
    )
    neck = F.max(F.when(F.col("by_touch") == 1, F.col("price"))).over(by_side)
    tested = F.col("by_touch") == 1
    near = (F.col("side") == "low") & (F.col("by_gap") == 1) & (F.abs(F.col("price") - neck) > TOLERANCE * neck)
    kinds = F.array(
        F.when(tested & (F.col("side") == "high"), F.lit("resistance")),
        F.when(tested & (F.col("side") == "low"), F.lit("neckline")),
        F.when(near, F.lit("support")),
    )
    named = ranked.withColumn("_kinds", F.filter(kinds, lambda k: k.isNotNull())).withColumn("type", F.explode("_kinds"))
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return named.select(KEY, "type", label[F.col("type")].alias("label"), "price", "touches")
