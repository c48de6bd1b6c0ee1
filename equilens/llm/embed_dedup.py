"""Near-duplicate vectors by int8 tile products with error bounds.

Unit vectors are quantised to int8 with a scale and an error norm of their own. In every tile of two blocks the
integer products, exact in float32, bound each cosine from both sides; only pairs whose interval holds the threshold
are recomputed in double precision. A tile returns counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.llm.common import components, cut
from equilens.llm.vectors import one_per_id, tiled

ROUNDING = 1e-12


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, int8 values, scales and upper bounds of the error norms."""
    top = np.abs(x).max(1, keepdims=True)
    unit = x / top
    unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - scale[:, None] * q) ** 2).sum(1)) * (1 + 1e-9) + ROUNDING
    return unit, q, scale, error


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of all places after joining a[k] with b[k]; ``parent`` holds roots before."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def tile_links(x: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, stripe: int = 512):
    """Links between the rows ``left`` and ``right`` of ``x`` (equal arrays: inside one block).

    Returns the summed weights of the partners of each row and the root of each row in the tile's forest.
    """
    unit, q, scale, error = quantised(x)
    number = np.float32 if x.shape[1] <= 1024 else np.float64
    inside = left is right
    partners, root = np.zeros(len(x), np.int64), np.arange(len(x))
    right_q = q[right].astype(number).T
    for s in range(0, len(left), stripe):
        a = left[s:s + stripe]
        near = (q[a].astype(number) @ right_q).astype(np.float64)
        near *= scale[a, None] * scale[None, right]
        slack = error[a, None] + error[None, right] * (1 + error[a, None]) + ROUNDING
        linked = near >= least + slack
        open_a, open_b = np.nonzero((near >= least - slack) & ~linked)
        for t in range(0, len(open_a), 1 << 18):
            ka, kb = open_a[t:t + (1 << 18)], open_b[t:t + (1 << 18)]
            exact = np.einsum("ij,ij->i", unit[a[ka]], unit[right[kb]])
            sure = exact >= least
            linked[ka[sure], kb[sure]] = True
        if inside:
            linked[np.arange(len(a)), s + np.arange(len(a))] = False
        partners[a] += linked @ weight[right]
        if not inside:
            partners[right] += weight[a] @ linked
        ka, kb = np.nonzero(linked)
        if len(ka):
            root = hook(root, a[ka], right[kb])
    return partners, root


def linked(vectors: DataFrame, least: float = 0.95, block_rows: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, links being cosines of ``least`` or more.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of
    different lengths. Repeated ids count once with their smallest usable vector; rows with a null id are left out.
    Equal vectors are one class in the tiles and weigh as many as they are. All pairs of blocks are compared: the
    work grows with the square of the number of different vectors.
    """
    rows = cut(one_per_id(vectors))
    live = rows.where(F.exists("embedding", lambda x: x != 0))
    classes = cut(live.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    blocks = max(1, -(-classes.count() // block_rows))

    def compare(table: pa.Table) -> pa.Table:
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        x = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block = table.column("block").to_numpy()
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        partners, root = tile_links(x, n, left, right, least)
        some, moved = np.flatnonzero(partners), np.flatnonzero(root != np.arange(len(ids)))
        none = np.zeros(len(moved), np.int64)
        return pa.table({
            "id": np.concatenate([ids[some], ids[moved]]), "root": np.concatenate([ids[some], ids[root[moved]]]),
            "n": np.concatenate([partners[some], none])})

    dealt = tiled(classes.withColumn("length", F.size("embedding")), F.col("id"), blocks, "length", "id", "n", "embedding")
    found = cut(dealt.groupBy("length", "i", "j").applyInArrow(compare, "id long, root long, n long"))
    counts = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("more"))
    parts = components(found.where("n = 0").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, "id", "left").join(parts, "id", "left").select(
        F.col("embedding").alias("its"), (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    return rows.join(known, F.col("embedding") == F.col("its"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))
