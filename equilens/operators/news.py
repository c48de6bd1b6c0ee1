"""News retrieval by vector similarity and context assembly."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from equilens.functions.price import cosine_distance
from equilens.operators.relational import keep_first, point_in_time


def with_embedding(news: DataFrame, embedding: DataFrame) -> DataFrame:
    """News that have a vector, one to one by id."""
    return news.join(embedding.select("news_id", "embedding"), "news_id")


def with_distance(rows: DataFrame, vector: Column) -> DataFrame:
    """Rows with ``dist`` to one vector, a constant or a scalar subquery."""
    bound = rows.withColumn("_vector", vector)
    return bound.withColumn("dist", cosine_distance(F.col("embedding"), F.col("_vector"))).drop("_vector")


def retrieve(
    news: DataFrame, query: Sequence[float] | Column, k: int = 3, stock_id: str | None = None, as_of=None
) -> DataFrame:
    """The ``k`` nearest news by cosine distance, after the key and time filters.

    The query vector is a constant, so there is no join, and the k best are
    kept per partition before they meet.
    """
    pool = news if stock_id is None else news.filter(F.col("stock_id") == stock_id)
    pool = point_in_time(pool, "published_at", as_of)
    vector = query if isinstance(query, Column) else F.array(*[F.lit(float(v)) for v in query])
    scored = with_distance(pool, vector)
    return scored.orderBy(F.col("dist").asc_nulls_last(), "news_id").limit(int(k))


def nearest(asked: pa.Table, pool: pa.Table, k: int) -> pa.Table:
    """(query_id, news_id, dist): for every row of ``asked`` (query_id, vector, wanted) its ``k`` nearest rows of ``pool``
    (news_id, stock_id, embedding), ordered as by Spark: NaN behind numbers, null behind NaN, then by id. Products are
    summed in the order of the components, as ``cosine_distance`` does, so equal vectors have equal distances."""
    pool = pool.take(pc.sort_indices(pool.column("news_id")))
    stock = np.array(pool.column("stock_id").to_pylist(), object)
    sides = [matrices(t.column(c)) for t, c in ((asked, "vector"), (pool, "embedding"))]
    wanted = asked.column("wanted").to_pylist()
    at, hits, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]

    def keep(query: int, dist: np.ndarray) -> None:
        """``dist`` to all of the pool, masked where null."""
        open_ = np.arange(len(stock)) if wanted[query] is None else np.flatnonzero(stock == wanted[query])
        none, value = np.ma.getmaskarray(dist)[open_], dist.data[open_]
        value = np.where(none, np.nan, value)
        if len(open_) > k and not np.isnan(edge := np.partition(value, k - 1)[k - 1]):
            open_, none, value = (x[kept] for kept in (value <= edge,) for x in (open_, none, value))
        order = np.lexsort((value, none))[:k]
        at.append(np.full(len(order), query))
        hits.append(open_[order])
        far.append(np.ma.array(value[order], mask=none[order]))

    done = np.zeros(len(wanted), bool)
    for length, (queries, q) in sides[0].items():
        rows, x = sides[1].get(length, (np.zeros(0, np.int64), np.zeros((0, length))))
        x = np.ascontiguousarray(x.T)
        norm = np.sqrt(in_order(x, x))
        for k0 in range(0, len(queries), 16):
            these = q[k0:k0 + 16].T
            with np.errstate(all="ignore"):
                over = np.sqrt(in_order(these, these))[:, None] * norm
                dist = 1 - in_order(these[:, :, None], x[:, None, :]) / over
            for query, d, o in zip(queries[k0:k0 + 16], dist, over, strict=True):
                whole = np.ma.masked_all(len(stock))
                whole[rows] = np.ma.array(d, mask=o == 0)
                keep(query, whole)
                done[query] = True
    for query in np.flatnonzero(~done):
        keep(query, np.ma.masked_all(len(stock)))
    far = np.ma.concatenate(far)
    return pa.table({
        "query_id": asked.column("query_id").take(pa.array(np.concatenate(at))), "news_id": pool.column("news_id").take(pa.array(np.concatenate(hits))),
        "dist": pa.array(far.data, mask=np.ma.getmaskarray(far))})


def matrices(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the places and components of vectors that are not null and have no null component."""
    column = vectors.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    out = {}
    for length in np.unique(lengths[lengths >= 0]).tolist():
        places = np.flatnonzero(lengths == length)
        flat = column.take(pa.array(places)).flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(places), length).all(1)
        parts = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(places), length)
        out[length] = places[known], parts[known]
    return out


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of products along the first axis, one component after the other."""
    total = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def retrieve_many(
    news: DataFrame, embedding: DataFrame, questions: DataFrame, k: int = 3, as_of=None, block_rows: int = 4096, block_questions: int = 1024,
) -> DataFrame:
    """(query_id, rank) and the ``k`` nearest news for each of ``questions`` (query_id, vector, optional stock_id).

    Blocks of questions meet blocks of ids and vectors, so a task holds one of each, however many there are; a block
    gives ``k`` rows per question to the ranking, and texts are fetched for the hits only.
    """
    asked = questions if "stock_id" in questions.columns else questions.withColumn("stock_id", F.lit(None).cast("string"))
    asked = asked.select("query_id", "vector", F.col("stock_id").alias("wanted"))
    slim = point_in_time(news.select("news_id", "stock_id", "published_at"), "published_at", as_of)
    pool = with_embedding(slim, embedding).select("news_id", "stock_id", "embedding")
    blocks = lambda rows, size: rows.agg(F.expr(f"int((count(*) + {int(size) - 1}) div {int(size)})").alias("n")).scalar()
    block = lambda of, *key: F.pmod(F.xxhash64(*key), F.greatest(of, F.lit(1))).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.greatest(of, F.lit(1)) - 1))
    row_blocks, question_blocks = blocks(embedding, block_rows), blocks(asked, block_questions)
    left = asked.withColumn("j", block(question_blocks, "query_id", "vector")).withColumn("i", each(row_blocks))
    right = pool.withColumn("i", block(row_blocks, "news_id")).withColumn("j", each(question_blocks))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(
        lambda a, b: nearest(a, b, max(1, int(k))),
        StructType([asked.schema["query_id"], pool.schema["news_id"], StructField("dist", DoubleType())]))
    order = Window.partitionBy("query_id").orderBy(F.col("dist").asc_nulls_last(), "news_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= int(k))
    return best.join(news, "news_id").select("query_id", "rank", "dist", *news.columns)


def build_context(hits: DataFrame) -> DataFrame:
    """Retrieved rows as one numbered text block. It holds all of them: ask ``retrieve`` for as many as fit a prompt."""
    ordered = F.array_sort(F.collect_list(F.struct("dist", "news_id", "published_at", "title", "content")))
    numbered = F.transform(
        ordered,
        lambda h, i: F.concat(
            F.lit("[來源"), (i + 1).cast("string"), F.lit("｜"),
            F.coalesce(F.date_format(h["published_at"], "yyyy-MM-dd"), F.lit("")), F.lit("] "),
            F.coalesce(h["title"], F.lit("")), F.lit("\n"), F.coalesce(h["content"], F.lit("")),
        ),
    )
    return hits.agg(F.array_join(numbered, "\n\n").alias("context"))


def recent(news: DataFrame, days: int = 90, now: Column | None = None) -> DataFrame:
    """News of the last ``days`` days; undated ones are kept."""
    edge = (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(int(days)))
    at = F.col("published_at")
    return news.filter(at.isNull() | (at >= edge))


def fresh_news(incoming: DataFrame, stored: DataFrame, order_col: str) -> DataFrame:
    """Incoming rows whose (stock_id, url) is not stored, the first of each kept."""
    once = keep_first(incoming, ("stock_id", "url"), order_col)
    return once.join(stored.select("stock_id", "url"), ["stock_id", "url"], "left_anti").select(*incoming.columns)
