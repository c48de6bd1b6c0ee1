"""Shared by the vector operators: usable vectors, one per id, and tiles of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def one_per_id(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>): repeated ids count once, with the smallest of their usable vectors; an id
    without a usable vector keeps null. Null ids are left out."""
    double = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null").select("vec_id", F.when(usable(double), double).alias("embedding"))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def tiled(rows: DataFrame, key: Column, blocks: int, *columns: str) -> DataFrame:
    """Rows dealt to ``blocks`` blocks by a hash of ``key`` and copied to every tile (i, j), i <= j, of their block;
    ``block`` tells on which side they stand."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *columns)
