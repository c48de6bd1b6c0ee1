"""A filter of stored keys beside an append-once table, so that appends read keys only where one may repeat.

Each hash folder has a Bloom filter of its keys: bitmaps of 32,768 bits, as many as the folder's keys ask for. A key
whose bits are not all set is new. Only folders in which some key hits are read, and there the anti join decides, so a
false hit changes nothing. The filter is written before the rows: a load that dies between leaves keys that hit falsely.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.functions.windows import PART
from equilens.operators.relational import keep_first
from equilens.sinks.tables import _fs, exists, write_fact

BLOCK = 1 << 15
HASHES = 4
BITS = 16  # of the filter per key
FILTER = f"{PART} int, blocks int, block int, keys long, bits binary"


def _bits(pk: Sequence[str], blocks: Column) -> list[Column]:
    """(block, bit) of a key: all its bits lie in one block."""
    block = F.pmod(F.xxhash64(F.lit("block"), *pk), blocks).cast("int")
    return [F.struct(block.alias("block"), F.pmod(F.xxhash64(F.lit(k), *pk), F.lit(BLOCK)).alias("bit")) for k in range(HASHES)]


def _bitmaps(keys: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Bitmaps of keys (part, blocks, key columns)."""
    at = keys.select(PART, "blocks", F.explode(F.array(*_bits(pk, F.col("blocks")))).alias("x"))
    return at.groupBy(PART, "blocks", F.col("x.block").alias("block")).agg(F.bitmap_construct_agg("x.bit").alias("bits"))


def holds_rows(spark: SparkSession, path: str) -> bool:
    """Whether the table has folders of rows, and not only a filter."""
    fs, p = _fs(spark, path)
    return fs.exists(p) and any(f.getPath().getName().startswith(f"{PART}=") for f in fs.listStatus(p))


def read_filter(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_keys") if exists(spark, f"{path}/_keys") else spark.createDataFrame([], FILTER)


def possible(rows: DataFrame, stored: DataFrame, pk: Sequence[str]) -> DataFrame:
    """``rows`` (with their folder as ``part``) and ``hit``: whether the key may be stored already."""
    shape = stored.select(PART, "blocks").distinct()
    placed = rows.join(shape, PART, "left").withColumn("_x", F.array(*_bits(pk, F.col("blocks"))))
    placed = placed.withColumn("block", F.col("_x")[0]["block"])
    met = placed.join(stored.select(PART, "block", "bits"), [PART, "block"], "left")

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))

    hit = F.lit(True)
    for k in range(HASHES):
        hit = hit & is_set(F.col("_x")[k]["bit"])
    return met.withColumn("hit", hit).drop("_x", "block", "blocks", "bits")


def append_once(spark: SparkSession, path: str, incoming: DataFrame, pk: Sequence[str], part: Column, order: Column) -> list[int]:
    """Append the rows whose key is not stored yet, of equal keys the first by ``order``; returns the folders read.

    ``part`` is the folder of a key, a hash of it below a fixed number. A folder's filter is built anew from its keys
    when it holds more of them than its blocks were made for.
    """
    held = holds_rows(spark, path)
    if held and not exists(spark, f"{path}/_keys"):  # a table from before there were filters
        _grow(spark, path, read_filter(spark, path), spark.read.parquet(path).select(PART, *pk), pk)
    once = keep_first(incoming, pk, order).withColumn(PART, part).persist()
    try:
        stored = read_filter(spark, path)
        told = possible(once, stored, pk).persist()
        read = sorted(r[0] for r in told.where("hit").select(PART).distinct().collect())
        new = told.drop("hit")
        if read and held:
            keys = spark.read.parquet(path).where(F.col(PART).isin(read)).select(PART, *pk)
            same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in (PART, *pk)]
            new = new.join(keys.select(*[F.col(c).alias(f"_s_{c}") for c in (PART, *pk)]), same, "left_anti")
        new = new.persist()
        _grow(spark, path, stored, new.select(PART, *pk), pk)
        write_fact(new.drop(PART), path, part, pk, mode="append")
        for df in (new, told):
            df.unpersist()
        return read
    finally:
        once.unpersist()


def _grow(spark: SparkSession, path: str, stored: DataFrame, fresh: DataFrame, pk: Sequence[str]) -> None:
    """Add keys to the filter. Only the folders that get keys are written."""
    held = stored.groupBy(PART).agg(F.max("blocks").alias("blocks"), F.max("keys").alias("held"))
    sizes = fresh.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).join(held, PART, "left")
    keys = F.col("n") + F.coalesce("held", F.lit(0))
    needed = F.ceil(keys * (2 * BITS) / BLOCK).cast("int")  # room for as many keys again
    full = F.col("blocks").isNull() | (keys * BITS > F.col("blocks") * BLOCK)
    sizes = sizes.select(PART, keys.alias("keys"), F.when(full, needed).otherwise(F.col("blocks")).alias("blocks"),
                         (full & F.col("blocks").isNotNull()).alias("anew")).persist()
    anew = [r[0] for r in sizes.where("anew").select(PART).collect()]
    added = fresh
    if anew and holds_rows(spark, path):
        added = added.unionByName(spark.read.parquet(path).where(F.col(PART).isin(anew)).select(PART, *pk))
    bits = _bitmaps(added.join(sizes.select(PART, "blocks"), PART), pk)
    kept = stored.where(~F.col(PART).isin(anew) if anew else F.lit(True)).join(sizes.select(PART), PART, "left_semi")
    bits = bits.unionByName(kept.select(PART, "blocks", "block", "bits")).groupBy(PART, "blocks", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    out = bits.join(sizes.select(PART, "keys"), PART).select(*[c.split()[0] for c in FILTER.split(", ")])
    out.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{path}/_keys")
    sizes.unpersist()


def merge_files(spark: SparkSession, path: str, pk: Sequence[str], part: Column, most: int = 16) -> list[int]:
    """Write the folders that more than ``most`` appends have left files in anew; returns them."""
    files = spark.read.parquet(path).select(PART, F.input_file_name().alias("f")).distinct().groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    crowded = sorted(r[0] for r in files.where(F.col("n") > most).collect())
    if crowded:
        write_fact(spark.read.parquet(path).where(F.col(PART).isin(crowded)).drop(PART), path, part, pk)
    return crowded
