"""Exact duplicates by two passes over a Bloom filter, with DataFrame functions only.

The first pass counts the cells of the filter that rows fall into; cell numbers travel, not rows, and each task adds
up its own before. Cells that several rows fall into become bitmaps. The second pass holds every row against them: a
row with a cell of its own has no equal and passes straight through. Only the others are shuffled and grouped by
their digest. Rows that hit by chance come out as groups of one, so the filter decides cost, never results.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.llm.common import cut, shared_folder

BLOCK = 1 << 15  # bits of one bitmap of Spark's bitmap functions


@dataclass(frozen=True)
class Bloom:
    """``bits`` of the filter per row, of which each row has ``hashes``, all in one block of 32,768 bits. A round of the
    second pass broadcasts ``round_blocks`` of these at most (4 KB each) and tests the rows that fall into them."""

    bits: int = 16
    hashes: int = 2
    round_blocks: int = 1 << 15

    def blocks(self, rows: int) -> int:
        return max(1, -(-rows * self.bits // BLOCK))

    def block(self, digest: Column, blocks: int) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(blocks))

    def cells(self, digest: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(BLOCK)) for k in range(1, self.hashes + 1)]


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def repeated_cells(rows: DataFrame, blocks: int, bloom: Bloom) -> DataFrame:
    """(block, bits): bitmaps of the cells that more than one of ``rows`` fall into; blocks without any are left out."""
    digest = F.col("digest")
    cells = rows.select(bloom.block(digest, blocks).alias("block"), F.explode(F.array_distinct(F.array(*bloom.cells(digest)))).alias("cell"))
    several = cells.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return several.groupBy("block").agg(F.bitmap_construct_agg("cell").alias("bits"))


def tested(rows: DataFrame, bloom: Bloom) -> DataFrame:
    """``rows`` with ``hit``: whether every cell of the row's digest is shared with another row.

    The rounds are written one after the other to the shared folder, so each broadcast is bounded whatever the table.
    """
    blocks = bloom.blocks(rows.count())
    bitmaps = cut(repeated_cells(rows, blocks, bloom))
    digest = F.col("digest")

    def set_in(bits: Column, cell: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.floor(cell / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, (cell % 8).cast("int")) == 1, F.lit(False))

    placed = rows.withColumn("block", bloom.block(digest, blocks))
    path = f"{shared_folder(rows.sparkSession).rstrip('/')}/tested-{uuid.uuid4().hex}"
    for low in range(0, blocks, bloom.round_blocks):
        mine = F.col("block").between(low, low + bloom.round_blocks - 1)
        found = placed.where(mine).join(F.broadcast(bitmaps.where(mine)), "block", "left")
        every = F.lit(True)
        for cell in bloom.cells(digest):
            every = every & set_in(F.col("bits"), cell)
        found.withColumn("hit", every).drop("block", "bits").write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def grouped(rows: DataFrame, bloom: Bloom, heavy: int = 4096) -> DataFrame:
    """``rows`` (doc_id, row, digest) with ``keep``, the (absent, doc_id, row) that stays of its group, and group_size.

    Groups are counted with partial sums per task. Those that hold more than one of ``heavy`` of all shuffled rows, so
    fewer than ``heavy`` of them, meet their rows by a broadcast; each other group is small against a task.
    """
    rows = tested(rows, bloom)
    hits = rows.where("hit").drop("hit")
    place = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    groups = cut(hits.groupBy("digest").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("group_size")))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    large = F.col("group_size") * heavy > total
    with_large = hits.join(F.broadcast(groups.where(large)), "digest", "left")
    columns = [*rows.drop("hit").columns, "keep", "group_size"]
    rest = with_large.where("keep is null").select(*hits.columns).join(groups.where(~large), "digest")
    alone = rows.where("not hit").withColumns({"keep": place, "group_size": F.lit(1).cast("long")})
    return alone.select(*columns).unionByName(with_large.where("keep is not null").select(*columns)).unionByName(rest.select(*columns))


def marked(docs: DataFrame, bloom: Bloom = Bloom()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are; null counts as empty, and empty texts are equal. Of equal texts
    the row with the smallest doc_id stays, null ids coming last; of rows that repeat that id too, the first one read.
    So exactly one row of a group is kept, and ``group_size`` counts rows. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest_of(F.col("text")).alias("digest"))
    return grouped(cut(rows), bloom).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, bloom: Bloom = Bloom()) -> DataFrame:
    """The rows of ``docs`` that stay, one per text, columns as they are.

    Rows that repeat both id and text of the one that stays are told apart by a hash of their columns.
    """
    marks = marked(docs, bloom).groupBy("doc_id", F.unhex("text_sha256").alias("digest")).agg(
        F.max("kept").alias("stays"), F.count(F.lit(1)).alias("copies"))
    touched = marks.where("not stays or copies > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "stays")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_of"), digest_of(F.col("text")).alias("_its"))
    same = F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_its") == F.col("_digest"))
    met = rows.join(touched, same, "left")
    once = met.where("stays").groupBy("_of", "_its").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return met.where("stays is null").select("_row.*").unionByName(once.select("_row.*"))
