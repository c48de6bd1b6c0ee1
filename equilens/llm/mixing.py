"""Mixing sources to target weights, with DataFrame functions only.

The words of each source lie on an axis that is cut into blocks of a fixed length. Every output shard draws a
multinomial number of slots per source; the j-th slot of a source takes the block at a pseudorandom permutation of
j, one permutation per pass over the source, and blocks are joined by that index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.llm.common import WORD, cut, n_words


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources by code point, null last; ``share`` of all words is taken; a source gives
    ``cap`` times its words at most. Blocks hold ``block_words`` words, less for a source that would have fewer than
    ``min_blocks`` of them. A shard has ``shard_slots`` slots. Equal seeds give equal mixes. ``chunk_rows`` and
    ``task_slots`` are the documents and slots of a task."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    block_words: int = 128
    min_blocks: int = 256
    shard_slots: int = 4096
    seed: int = 20
    chunk_rows: int = 50_000
    task_slots: int = 200_000
    cells: int = 4096


def permuted(i: Column, n: Column, key: Column, rounds: int = 12) -> Column:
    """Image of ``i`` under a keyed permutation of 0..n-1: in each round i and k - i change places, or not, by a
    hashed bit that both share (swap-or-not), so every round is a bijection for any n."""
    keys = F.transform(
        F.sequence(F.lit(1), F.lit(rounds)),
        lambda r: F.struct(F.pmod(F.xxhash64(key, r), n).alias("k"), F.xxhash64(key, -r).alias("salt")),
    )

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(r["k"] - x, n)
        return F.when(F.xxhash64(r["salt"], F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(keys, i.cast("long"), swap)


def items(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, copy): one row per document; repeated rows are told apart by ``copy``."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    counted = sized.groupBy("doc_id", "source", "size").agg(F.count("*").cast("int").alias("n"))
    return counted.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))


def source_targets(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: rank, weight, source_size, target, block length, blocks and slots.

    Targets stand in proportion to the weights under a common level; a source whose cap lies below its share stops
    there. The level is found at the first source, by cap per weight, that does not reach its cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("rank") - 1) % len(mix.weights) + 1)
    s = s.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(mix.cap))
    order, everything = Window.orderBy(F.col("most") / F.col("weight"), "rank"), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * mix.share
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("at", level).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("most") > F.col("at") * F.col("weight"), F.struct("place", "at"))).over(everything)
    s = s.withColumn("target", F.least("most", F.coalesce(first["at"] * F.col("weight"), F.col("most"))))
    length = F.greatest(F.lit(1), F.least(F.lit(mix.block_words), F.expr(f"source_size div {mix.min_blocks}")))
    s = s.withColumn("length", length.cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")))
    drawn = F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size"))).cast("long")
    slots = F.least(drawn, F.col("blocks") * mix.cap)
    return s.withColumn("slots", F.coalesce(slots, F.lit(0)).cast("long")).drop("at", "place", "most")


def draws(sources: DataFrame, mix: Mix) -> DataFrame:
    """(shard, rank, slot, block): what every shard takes, in whole blocks.

    Each slot of a shard falls on a source with probability slots / all slots, so counts per shard are multinomial.
    Draws of a source beyond its slots are re-drawn as the missing draws of sources that fell short; so totals are
    exact and no block is taken more than ``cap`` times.
    """
    spark = sources.sparkSession
    s = sources.where("slots > 0").select("rank", "slots", "blocks")
    total = s.agg(F.sum("slots")).first()[0] or 0
    by_rank = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    cell = max(1, -(-total // mix.cells))
    s = s.withColumn("low", F.coalesce(F.sum("slots").over(by_rank), F.lit(0)))
    cells = s.select(
        "rank", "low", (F.col("low") + F.col("slots")).alias("high"),
        F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(low + slots - 1) div {cell}"))).alias("cell"))
    drawn = spark.range(total).select(
        F.expr(f"id div {mix.shard_slots}").alias("shard"),
        F.pmod(F.xxhash64(F.lit(mix.seed), F.col("id")), F.lit(max(1, total))).alias("at"))
    drawn = drawn.withColumn("cell", F.expr(f"at div {cell}")).join(cells, "cell").where("at >= low and at < high")
    counts = cut(drawn.groupBy("shard", "rank").agg(F.count("*").alias("n")))

    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.join(s.select("rank", "slots"), "rank").withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # A row here becomes up to a shard of slots, so rows are dealt out by the slots to come, not by their own size.
    parts = max(1, total // mix.task_slots)
    kept = counts.where("start < slots").repartition(parts, "shard", "rank").select(
        "shard", "rank", F.explode(F.sequence("start", F.least(F.col("start") + F.col("n"), F.col("slots")) - 1)).alias("slot"))

    totals = s.select("rank", "slots").join(counts.groupBy("rank").agg(F.sum("n").alias("n")), "rank", "left").select(
        "rank", "slots", F.coalesce("n", F.lit(0)).alias("n"))
    totals = totals.withColumn("over", F.greatest(F.col("n") - F.col("slots"), F.lit(0))).withColumn(
        "short", F.greatest(F.col("slots") - F.col("n"), F.lit(0)))
    totals = totals.withColumn("over_from", F.coalesce(F.sum("over").over(by_rank), F.lit(0))).withColumn(
        "short_from", F.coalesce(F.sum("short").over(by_rank), F.lit(0)))
    surplus = counts.where("start + n > slots").join(totals.select("rank", "over_from"), "rank").select(
        "shard", F.explode(F.sequence(F.greatest("start", "slots"), F.col("start") + F.col("n") - 1)).alias("j"), "slots", "over_from"
    ).select("shard", (F.col("over_from") + F.col("j") - F.col("slots")).alias("unit"))
    missing = totals.where("short > 0").select(
        "rank", "n", F.posexplode(F.sequence("short_from", F.col("short_from") + F.col("short") - 1)).alias("k", "unit")
    ).select("rank", (F.col("n") + F.col("k")).alias("slot"), "unit")
    redrawn = surplus.join(missing, "unit").select("shard", "rank", "slot")

    taken = kept.union(redrawn).join(s.select("rank", "blocks"), "rank")
    key = F.xxhash64(F.lit(mix.seed), F.col("rank"), F.expr("slot div blocks"))
    return taken.select("shard", "rank", "slot", permuted(F.expr("slot % blocks"), F.col("blocks"), key).alias("block"))


def pieces(rows: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """The part of each document in each block: item columns, rank, block, first (word of the document) and words.

    Start positions come from two levels of running sums, inside chunks of about ``chunk_rows`` documents and over
    the chunks of a source, so no window holds a whole source.
    """
    rows = rows.where("size > 0")
    chunks = -(-rows.count() // mix.chunk_rows) or 1
    known = sources.select(F.col("source").alias("its"), "rank", "length")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", "copy"), F.lit(chunks)))
    inside = Window.partitionBy("rank", "chunk").orderBy("doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("rank", "chunk").agg(F.sum("size").alias("total"))
    sums = sums.select("rank", "chunk", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("base"))
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["rank", "chunk"])
    rows = rows.withColumn("start", F.col("start") + F.col("base"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.expr("start div length"), F.expr("(start + size - 1) div length"))))
    low = F.greatest("start", F.col("block") * F.col("length"))
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length"))
    return rows.select(
        "doc_id", "source", "size", "copy", "rank", "block", (low - F.col("start")).alias("first"), (high - low).alias("words"))


def taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per document: doc_id, source, copy, size, source_size, target and the words that the mix takes of it.

    Documents without words (null or blank text) have size 0 and give nothing; repeated rows and null ids are
    documents of their own; a null source is a source, the last one. An empty table gives an empty result.
    """
    rows = cut(items(docs))
    sources = cut(source_targets(rows, mix))
    times = draws(sources, mix).groupBy("rank", "block").agg(F.count("*").alias("times"))
    part = pieces(rows, sources, mix).join(times, ["rank", "block"])
    part = part.groupBy("doc_id", "source", "size", "copy").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    known = sources.select(F.col("source").alias("its"), "source_size", "target")
    part = part.withColumnsRenamed({c: f"p_{c}" for c in ("doc_id", "source", "size", "copy")})
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in ("doc_id", "source", "size", "copy")]
    return rows.join(known, F.col("source").eqNullSafe(F.col("its"))).join(part, same, "left").select(
        "doc_id", "source", "copy", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_blocks(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: (shard, source, slot, block, words), one row per drawn block of a shard, words in order."""
    rows = cut(items(docs))
    sources = cut(source_targets(rows, mix))
    text = docs.select(
        F.col("doc_id").alias("d"), F.col("source").alias("s"), F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("all"),
    ).withColumn("n", F.size("all").cast("long")).groupBy("d", "s", "n").agg(F.min("all").alias("all"))
    part = pieces(rows, sources, mix)
    part = part.join(text, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n")))
    part = part.select("rank", "block", F.struct(
        "doc_id", "copy", F.expr("slice(all, int(first + 1), int(words))").alias("words")).alias("part"))
    blocks = part.groupBy("rank", "block").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    blocks = blocks.select("rank", "block", F.flatten(F.transform("parts", lambda p: p["words"])).alias("words"))
    return draws(sources, mix).join(blocks, ["rank", "block"]).join(sources.select("rank", "source"), "rank").select(
        "shard", "source", "slot", "block", "words")


def resampled(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents as the mix takes them: each row 0 to ``cap`` times, its words taken over its words, where the
    fraction becomes one more copy or none by a hash of the id. Columns stay as they are."""
    part = taken(docs, mix).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    rate = F.try_divide("taken", F.col("size") * F.col("rows"))
    up = F.pmod(F.xxhash64(F.lit(mix.seed), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    part = part.where("size > 0").select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"),
        F.floor(rate + up).cast("int").alias("_times")).where("_times > 0")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_of"), n_words(F.col("text")).alias("_size"))
    same = F.col("_id").eqNullSafe(F.col("_d")) & F.col("_of").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n"))
    return rows.join(part, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
