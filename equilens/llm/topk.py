"""Exact top-k by integer inner product over a bit-sliced index.

Every component is an attribute whose values, less their minimum, are stored as bit slices over the rows of a block.
A query adds the slices of its attributes, shifted by the bits of its own components, with carry-save adders on whole
bitmaps; the sum's slices then select the top rows from the most significant downward. Rows that tie at the boundary
are settled by their ids, and the scores of the selected rows are integer inner products.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equilens.llm.common import cut
from equilens.llm.vectors import one_per_id


class BitSlices:
    """Slices of integer vectors, row r in bit r; ``ids`` ascend, so the first set bit is the smallest id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        rows = len(ids)
        self.full = self.packed(np.ones((1, rows), bool))[0]
        above = (self.x - self.x.min(0)).T
        bits = [int(v).bit_length() for v in above.max(1)]
        self.attribute = np.repeat(np.arange(len(bits)), bits)
        self.bit = np.concatenate([np.arange(b) for b in bits]).astype(np.int64) if sum(bits) else np.zeros(0, np.int64)
        self.slices = self.packed(((above[self.attribute] >> self.bit[:, None]) & 1).astype(bool))

    @staticmethod
    def packed(rows: np.ndarray) -> np.ndarray:
        bits = np.packbits(rows, axis=1, bitorder="little")
        return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)

    def sums(self, query: np.ndarray) -> dict[int, np.ndarray]:
        """Bitmaps of the weighted sum by bit, up to a constant: a negative weight adds the complement of a slice."""
        size, negative = np.abs(query)[self.attribute], (query < 0)[self.attribute]
        piles: defaultdict[int, list[np.ndarray]] = defaultdict(list)
        for k in range(int(size.max(initial=0)).bit_length()):
            chosen = np.flatnonzero((size >> k) & 1)
            for b in np.unique(self.bit[chosen]):
                these = chosen[self.bit[chosen] == b]
                pile = self.slices[these]
                pile[negative[these]] ^= self.full
                piles[k + int(b)].append(pile)
        out: dict[int, np.ndarray] = {}
        weight = min(piles, default=0)
        while any(w >= weight for w in piles):
            pile = np.concatenate(piles.pop(weight)) if weight in piles else np.zeros((0, len(self.full)), np.uint64)
            while len(pile) >= 2:
                n = len(pile) // 3
                if n:
                    a, b, c = pile[:n], pile[n:2 * n], pile[2 * n:3 * n]
                    either = a ^ b
                    carry, pile = (a & b) | (c & either), np.concatenate([either ^ c, pile[3 * n:]])
                else:
                    carry, pile = pile[:1] & pile[1:], pile[:1] ^ pile[1:]
                piles[weight + 1].append(carry)
            if len(pile):
                out[weight] = pile[0]
            weight += 1
        return out

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k best rows without those of id ``own``, and their scores."""
        count = lambda m: int(np.bitwise_count(m).sum())
        open_, sure = self.full.copy(), np.zeros_like(self.full)
        low, high = np.searchsorted(self.ids, [own, own + 1])
        for r in range(low, high):
            open_[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        k = min(k, count(open_))
        sums = self.sums(query)
        for w in sorted(sums, reverse=True):
            more = sure | (open_ & sums[w])
            n = count(more)
            if n > k:
                open_ &= sums[w]
            else:
                sure = more
                open_ &= ~sums[w]
                if n == k:
                    break
        places = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        chosen = places(sure)
        if len(chosen) < k:
            chosen = np.concatenate([chosen, places(open_)[: k - len(chosen)]])
        return chosen, self.x[chosen] @ query


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * component) of every usable vector."""
    rows = one_per_id(vectors).where("embedding is not null")
    return rows.select("vec_id", F.transform("embedding", lambda v: F.floor(v * float(scale)).cast("long")).alias("x"))


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, block_rows: int = 32_768, block_queries: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every``, the k highest inner products with other rows.

    Ties go to the smaller vec_id. Fewer than k other rows: all of them. Null vectors and those with null or
    non-finite components take no part, nor do null ids; repeated ids count once, with their smallest usable vector;
    vectors meet vectors of their length only. Blocks of queries meet blocks of rows, so a task holds one of each.
    """
    rows = cut(quantised(vectors, scale).withColumn("length", F.size("x")))
    n = rows.count()
    row_blocks = max(1, -(-n // block_rows))
    query_blocks = max(1, -(-n // (every * block_queries)))
    block = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    index = rows.withColumn("i", block(1, row_blocks)).withColumn("j", each(query_blocks))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("j", block(2, query_blocks)).withColumn("i", each(row_blocks))

    def vectors_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("vec_id").to_numpy()
        return ids, table.column("x").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)

    def best(queries: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if len(queries) and len(block):
            slices = BitSlices(*vectors_of(block))
            for own, q in zip(*vectors_of(queries), strict=True):
                chosen, score = slices.top(q, k, int(own))
                for column, values in zip(out, (np.full(len(chosen), own), slices.ids[chosen], score), strict=True):
                    column.append(values)
        joined = [np.concatenate([np.zeros(0, np.int64), *c]) for c in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), joined, strict=True)))

    found = asked.groupBy("length", "i", "j").cogroup(index.groupBy("length", "i", "j")).applyInArrow(
        best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
