"""Ranked lexical search, term at a time with limited accumulators.

Documents are read once into a table of their distinct query terms. Blocks of documents meet blocks of items; in such
a block the postings of each term carry their share of the score and its maximum. An item's terms are taken rarest
first. As soon as the terms that are left cannot lift a new document to the k-th partial score, no more accumulators
are created, and the existing ones are only brought up to their exact scores. The best of all blocks are merged.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equilens.llm.common import cut

# Letters, digits and whatever lies beyond ASCII make terms; in UTF-8 the latter are the bytes from 128 on.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FILTER_BITS = 1 << 22


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(KEPT).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct; rows that repeat an item's id add their terms to it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                terms = sorted(set(terms_of(text)))
                ids += [i] * len(terms)
                found += [t.decode() for t in terms]
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.int64()), "term": pa.array(found, pa.string())})

    columns = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(read, "item_id long, term string").distinct()


def term_filter(terms: DataFrame) -> bytes:
    """One bit per crc32 of a term, 512 KB whatever their number: it spares documents' other terms the way, no more."""
    place = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER_BITS))
    blocks = terms.select(F.floor(place / (1 << 15)).cast("int").alias("block"), (place % (1 << 15)).alias("bit"))
    bits = bytearray(FILTER_BITS // 8)
    for row in blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits[row.block << 12:(row.block + 1) << 12] = row.bits
    return bytes(bits)


def index(docs: DataFrame, wanted: bytes) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its number of terms, and of the terms that may be asked
    for, joined by spaces, how often each occurs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[bytes, bool] = {}
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                out: tuple[list, ...] = ([], [], [], [])
                for i, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    terms = terms_of(text)
                    if not terms:
                        continue
                    counts = Counter(terms)
                    if len(asked) > 500_000:
                        asked.clear()
                    for t in [t for t in counts if t not in asked]:
                        place = zlib.crc32(t) % FILTER_BITS
                        asked[t] = bool(wanted[place >> 3] >> (place & 7) & 1)
                    chosen = [t for t in counts if asked[t]]
                    for column, value in zip(out, (i, len(terms), b" ".join(chosen).decode(), [counts[t] for t in chosen]), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n", "terms", "tfs"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(read, "doc_id long, n long, terms string, tfs array<long>")


class Postings:
    """The postings of a block of documents for a set of terms, each with its share of the score."""

    def __init__(self, docs: pa.Table, vocabulary: pa.Array, weights: np.ndarray):
        ids = docs["doc_id"].combine_chunks()
        absent = ids.is_null().to_numpy(zero_copy_only=False)
        value = ids.fill_null(0).to_numpy()
        order = np.lexsort((value, absent))
        docs = docs.take(pa.array(order))
        self.ids = docs["doc_id"].combine_chunks()  # ascending, null last, so that ties go to the smaller place
        tfs = docs["tfs"].combine_chunks()
        sizes = pc.list_value_length(tfs).to_numpy()
        # A document with no term that may be asked for has an empty text, which splits into one empty term.
        some = pc.greater(pc.list_value_length(tfs), 0)
        terms = pc.split_pattern(docs["terms"].combine_chunks().filter(some), " ").flatten()
        found = pc.index_in(terms, value_set=vocabulary)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        code = found.fill_null(0).to_numpy()[known]
        doc = np.repeat(np.arange(len(order)), sizes)[known]
        tf, m = tfs.flatten().to_numpy()[known], docs["m"].to_numpy()
        by_term = np.argsort(code, kind="stable")
        code, doc, tf = code[by_term], doc[by_term], tf[by_term]
        self.doc, self.share = doc, weights[code] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        self.edges = np.searchsorted(code, np.arange(len(vocabulary) + 1))
        self.most = np.zeros(len(vocabulary), np.int64)
        np.maximum.at(self.most, code, self.share)

    def top(self, terms: np.ndarray, k: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents for ``terms``, given rarest first; ``score`` is zeroed scratch."""
        left = np.cumsum(self.most[terms][::-1])[::-1]
        growing = True
        for t, rest in zip(terms, left, strict=True):
            docs, share = self.doc[self.edges[t]:self.edges[t + 1]], self.share[self.edges[t]:self.edges[t + 1]]
            if growing:
                # A document without an accumulator reaches ``rest`` at most; an equal score may still win by its id.
                partial = score[score > 0]
                growing = len(partial) < k or np.partition(partial, -k)[-k] <= rest
            if not growing:
                alive = score[docs] > 0
                docs, share = docs[alive], share[alive]
            score[docs] += share
        held = np.flatnonzero(score > 0)
        best = held[np.lexsort((held, -score[held]))[:k]]
        return best, score[best]


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, block_postings: int = 1_500_000, block_terms: int = 50_000,
) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the ``k`` documents of highest score above 0, ties to smaller doc_id.

    Null and empty texts have no terms: such items get no rows, such documents are found by none and not counted. A
    null doc_id ranks behind all others of its score; a null item_id is an item. Repeated rows of documents are
    documents of their own, repeated item ids one item with the terms of all. Empty tables give an empty result.
    """
    asked = cut(item_terms(items))
    read = cut(index(docs, term_filter(asked)).withColumn("row", F.monotonically_increasing_id()))
    stats = read.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l"), F.sum(F.size("tfs")).alias("p")).first()
    blocks = max(1, -(-(stats.p or 0) // block_postings))
    df = read.where("terms <> ''").select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(stats.n) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = cut(asked.join(df, "term").select("item_id", "term", weight.alias("w")))
    item_blocks = max(1, -(-weighed.count() // block_terms))

    # 90 * n * N may pass 64 bits before the division.
    longer = F.expr(f"cast(90 * n as decimal(25)) * cast({stats.n} as decimal(12)) div {max(1, stats.l)}")
    rows = read.where("terms <> ''").select(
        "doc_id", (10 + longer).cast("long").alias("m"), "terms", "tfs", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("j"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))))
    terms = weighed.withColumn("i", F.pmod(F.xxhash64("item_id"), F.lit(item_blocks)).cast("int"))
    terms = terms.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def best(items: pa.Table, docs: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(items) and len(docs):
            items = items.sort_by([("item_id", "ascending"), ("w", "descending"), ("term", "ascending")])
            names = items["term"].combine_chunks().dictionary_encode()
            code = names.indices.to_numpy()
            weights = np.zeros(len(names.dictionary), np.int64)
            weights[code] = items["w"].to_numpy()
            postings = Postings(docs, names.dictionary, weights)
            ids = items["item_id"].to_pylist()
            starts = [0, *(p for p in range(1, len(ids)) if ids[p] != ids[p - 1]), len(ids)]
            score = np.zeros(len(docs), np.int64)
            for low, high in zip(starts, starts[1:]):
                score[:] = 0
                places, scores = postings.top(code[low:high], k, score)
                out[0] += [ids[low]] * len(places)
                out[1] += postings.ids.take(pa.array(places)).to_pylist()
                out[2] += scores.tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["item_id", "doc_id", "score"])

    found = terms.groupBy("i", "j").cogroup(rows.groupBy("i", "j")).applyInArrow(best, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
