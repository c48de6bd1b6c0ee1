"""Shared helpers: words, folds, cut lineage, labelled rows, exact sums, connected components."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, of: int) -> Column:
    """Fold number of a document: crc32 of its id as text, modulo ``of``. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)), F.lit(0)).cast("int")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what one Arrow batch holds, by rows and by bytes, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one is made only where it is unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="equilens-llm-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there; survives the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def label_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int) -> tuple[DataFrame, float]:
    """Bounded sample (doc_id, text, y) for fitting, and the share of label 1 among all usable labels.

    Labels of the held-out fold, null ids and null labels take no part; of several labels of one id the largest
    counts. Each class gives at most ``max_rows`` ids, a pseudorandom choice by id, so the id table that is broadcast
    has at most twice that many rows. Of repeated rows of an id one is fitted on, that of the smallest text; rows
    without text are not. Of a text above ``max_chars`` characters the fit sees the first ones; scores see all.
    """
    known = known_labels(labels, label)
    share = known.agg(F.avg(F.col("y").cast("double"))).first()[0]
    order = [F.xxhash64(F.lit(label), "_id"), F.col("_id")]
    ids = known.where("y = 0").orderBy(*order).limit(max_rows).union(known.where("y = 1").orderBy(*order).limit(max_rows))
    rows = docs.select("doc_id", F.left("text", F.lit(max_chars)).alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return rows.select("doc_id", "text", "y"), 0.5 if share is None else share


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(_id, y) of all usable labels: those of the held-out fold, null ids and null labels take no part; of several
    labels of one id the largest counts."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    return usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))


def labelled_share(labels: DataFrame, label: str) -> float:
    """Share of label 1 among all usable labels; a half without any."""
    share = known_labels(labels, label).agg(F.avg(F.col("y").cast("double"))).first()[0]
    return 0.5 if share is None else share


def labelled(docs: DataFrame, known: DataFrame, bits: int = 16, most_blocks: int = 1 << 12) -> DataFrame:
    """Every row with text and a usable label as (doc_id, text, y): all that a fit may learn from, nothing left out.
    Repeated rows of an id all count. ``known`` is a written table (``Loop.keep``).

    Few texts are moved: the ids meet their labels first and set bits of three bitmaps, of the labels 0 and 1 and of
    none, ``bits`` for each row, in ``most_blocks`` triples of 12 KB at most, which are broadcast. Where all ids of a
    cell agree, that is the label of each. Texts of the other cells are joined with ``known``; with more rows than the
    bitmaps have room for, these are more.
    """
    known = known.where("y in (0, 1)")
    ids = docs.select("doc_id").where("doc_id is not null")
    blocks = min(most_blocks, max(1, -(-ids.count() * bits // BLOCK)))
    block, cell = places("doc_id", blocks)
    found = ids.join(known, F.col("doc_id") == F.col("_id"), "left")
    cells = found.select(block.alias("_block"), cell.alias("cell"), "y").repartition("_block")
    of = {"_zero": F.col("y") == 0, "_one": F.col("y") == 1, "_none": F.col("y").isNull()}
    maps = cut(cells.groupBy("_block").agg(*(F.bitmap_construct_agg(F.when(which, F.col("cell"))).alias(name) for name, which in of.items())))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(maps), block == F.col("_block"))
    zero, one, none = (is_set(name, cell) for name in of)
    sure = rows.where((zero != one) & ~none).select("doc_id", "text", one.cast("int").alias("y"))
    doubtful = rows.where((zero & one) | ((zero | one) & none)).select("doc_id", "text")
    return sure.unionByName(doubtful.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y"))


def labelled_measures(docs: DataFrame, known: DataFrame, measure: Callable, schema: str, *more: Column) -> DataFrame:
    """What ``measure`` gives for the rows of ``labelled``, and their ``y``: texts are measured where they are read, and
    only the measures, ``schema``, meet the labels. ``measure`` takes batches of (doc_id, text, *more) and keeps ``doc_id``."""
    known = known.where("y in (0, 1)")
    rows = likely(docs.select("doc_id", "text").where("text is not null"), known)
    measured = rows.select("*", *more).mapInArrow(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")
    return measured.join(known, F.col("doc_id") == F.col("_id")).drop("doc_id", "_id")


BLOCK = 1 << 15  # bits of one bitmap of Spark's bitmap functions


def places(doc_id: str, blocks: int) -> tuple[Column, Column]:
    """Bitmap and cell in it of an id; a null id has none."""
    at = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(blocks * BLOCK))
    at = F.when(F.col(doc_id).isNotNull(), at)
    return F.floor(at / BLOCK), F.pmod(at, F.lit(BLOCK))


def is_set(bits: str, cell: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(cell / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(cell, F.lit(8)).cast("int")) == 1


def likely(docs: DataFrame, known: DataFrame, bits: int = 16, most_blocks: int = 1 << 12) -> DataFrame:
    """The rows of ``docs`` whose id may be in ``known``: all that are, and few others, none of them moved.

    Ids set bits of bitmaps, ``bits`` for each id, in ``most_blocks`` bitmaps of 4 KB at most, which are broadcast. More
    ids than that let more other rows through, which the join with ``known`` that has to follow drops.
    """
    blocks = min(most_blocks, max(1, -(-known.count() * bits // BLOCK)))
    block, cell = places("_id", blocks)
    maps = known.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(cell).alias("_bits"))
    block, cell = places("doc_id", blocks)
    met = docs.join(F.broadcast(maps), block == F.col("_block"))
    return met.where(is_set("_bits", cell)).select(*docs.columns)


EXACT = 1 << 30


def exact_sums(rows: DataFrame, terms: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sums of the ``size`` columns that ``terms`` gives for the rows of a batch, taken in tasks.

    Terms are rounded to multiples of 2^-30 and added as whole numbers, so the sums do not depend on how rows are
    dealt. One row per task comes back.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            if batch.num_rows:
                units = np.rint(terms(batch) * EXACT)
                if np.abs(units).max() < 2**62 / batch.num_rows:
                    units = units.astype(np.int64).sum(0).tolist()
                else:
                    units = [sum(map(int, column)) for column in units.T]
                total = [a + b for a, b in zip(total, units, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([[str(t) for t in total]], pa.list_(pa.string()))], ["sums"])

    parts = [r[0] for r in rows.mapInArrow(add, "sums array<string>").collect()]
    return np.array([sum(int(p[i]) for p in parts) / EXACT for i in range(size)])


def logistic_over(rows: DataFrame, features: Callable[[pa.RecordBatch], np.ndarray], y: int, size: int, ridge: float = 0.1,
                  rounds: int = 50) -> np.ndarray:
    """``logistic`` over a table: each Newton step is one pass; column ``y`` of a batch is the label."""
    b = np.zeros(size)
    for _ in range(rounds):
        at = b.copy()

        def terms(batch: pa.RecordBatch, at: np.ndarray = at) -> np.ndarray:
            x = features(batch)
            q = 1 / (1 + np.exp(-np.clip((x * at).sum(1), -500, 500)))
            error = np.asarray(batch.column(y), float) - q
            second = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1) * (q * (1 - q))[:, None]
            return np.c_[x * error[:, None], second]

        sums = exact_sums(rows, terms, size + size * size)
        step = np.linalg.solve(sums[size:].reshape(size, size) + ridge * np.eye(size), sums[:size] - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton steps; the first column of ``x`` is the constant."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds if len(y) else 0):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        b += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - q) - ridge * b)
    return b


def odds(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return math.log(p / (1 - p))


def released(df: DataFrame) -> DataFrame:
    """``df``, a table that is cut off from its plan, after the shuffle files of finished steps have been let go.

    Spark removes them when the driver collects its garbage, which may be much later than the next step. The driver's
    heap gives back what plans and broadcasts of finished steps took, so that it does not grow with their number.
    """
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


class Loop:
    """Tables written to the shared folder while a loop runs, and removed after it.

    A table that is read back has the size of its files. Checkpoints keep the estimates of the plan they come from,
    and a join multiplies those of its sides, so estimates would double their digits with every round of a loop.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, 0
        self.folder = f"{shared_folder(spark).rstrip('/')}/loop-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def end(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (a, b): the smallest id reachable.

    Every round hooks each id onto its smallest neighbour, follows the hooks to their roots by doubling, and
    contracts the edges to the roots; at least half of the ids that still have edges vanish per round. Self-loops,
    repeated and reversed edges are harmless; without edges the result is empty.
    """
    loop = Loop(edges.sparkSession)

    def clean(e: DataFrame) -> DataFrame:
        return loop.keep(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    edges, maps = clean(edges), []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = loop.keep(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("to")))
        while True:
            up = hook.select(F.col("id").alias("to"), F.col("to").alias("top"))
            deeper = hook.join(up, "to").select("id", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("moved"))
            deeper = loop.keep(deeper)
            hook = deeper.select("id", "to")
            if deeper.where("moved").isEmpty():
                break
        maps.append(hook)
        ends = edges.join(hook.withColumnRenamed("id", "a"), "a").select(F.col("to").alias("a"), "b")
        edges = released(clean(ends.join(hook.withColumnRenamed("id", "b"), "b").select("a", F.col("to").alias("b"))))
    if maps:
        top = maps[-1].select("id", F.col("to").alias("component"))
        for hook in reversed(maps[:-1]):
            root = top.select(F.col("id").alias("to"), "component")
            top = loop.keep(hook.join(root, "to", "left").select("id", F.coalesce("component", "to").alias("component")))
    else:
        top = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    top = released(cut(top))
    loop.end()
    return top
