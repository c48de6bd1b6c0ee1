"""Quality by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equilens.llm.common import Loop, cut, exact_sums, fold, known_labels, labelled_measures, labelled_share, logistic, logistic_over, odds, small_batches

KINDS = ("upper", "lower", "digit", "plain", "symbol", "space", "newline", "other")


@dataclass(frozen=True)
class Fit:
    """All labelled rows are fitted on, whole. A class covariance is drawn by ``pooled`` towards the common one and by ``round`` towards a multiple of the identity. A
    text of ``few`` words is taken half-way to the mean document, a longer one less."""

    pooled: float = 0.05
    round: float = 0.02
    few: float = 8.0


def kinds() -> np.ndarray:
    """Kind of each byte, by its place in ``KINDS``; bytes of letters beyond ASCII and control bytes are other."""
    table = np.full(256, 7)
    for k, chars in enumerate((
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"-()?", b"!#$%&*+/<=>@[\\]^_`{|}~", b" \t", b"\n",
    )):
        table[np.frombuffer(chars, np.uint8)] = k
    return table


def statistics(text: str | None, table: np.ndarray) -> tuple[list[float], int]:
    """Transformed statistics of a whole text and its number of words; shares enter as logarithms."""
    raw = (text or "").encode("utf-8", "replace")
    share = np.bincount(table[np.frombuffer(raw, np.uint8)], minlength=len(KINDS)) / max(1, len(raw))
    words = raw.lower().split()
    n = len(words)
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    threes = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 0.0
    log = lambda x: float(np.log(x + 1e-3))
    return [
        float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        *(log(share[KINDS.index(k)]) for k in ("upper", "digit", "plain", "symbol", "space", "newline", "other")),
        log(again), log(threes), log(float((lengths <= 3).mean())),
        float(np.log1p(len(set(words))) / np.log(2 + n)), float(np.log1p(n)), float(np.log1p(n / max(1, len(lines)))),
    ], n


N_STATISTICS = 15


class Discriminant:
    """Means and inverse Cholesky factors of both classes, computed once, when the model is fitted."""

    def __init__(self, x: np.ndarray, words: np.ndarray, y: np.ndarray, share: float, fit: Fit):
        self.few = fit.few
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
        self.classes: list[tuple[np.ndarray, np.ndarray, float]] = []
        self.line = np.array([odds(share), 0.0])
        if not len(y) or y.min() == y.max():
            return
        z = self.standard(x, words)
        p = z.shape[1]
        own = [np.cov(z[y == k].T) if (y == k).sum() > 1 else np.zeros((p, p)) for k in (0, 1)]
        self.shape([z[y == k].mean(0) for k in (0, 1)], own, [float((y == k).mean()) for k in (0, 1)], fit)
        d = self.difference(z)
        self.line = logistic(np.c_[np.ones(len(d)), d], y, ridge=0.01)
        self.line[0] += odds(share) - odds(float(y.mean()))

    def shape(self, means: list[np.ndarray], own: list[np.ndarray], weights: list[float], fit: Fit) -> None:
        """Classes from their means, covariances and shares."""
        p = len(means[0])
        common = sum(c * w for c, w in zip(own, weights, strict=True))
        for k in (0, 1):
            cov = (1 - fit.pooled) * own[k] + fit.pooled * common
            cov = (1 - fit.round) * cov + fit.round * max(np.trace(cov) / p, 1e-6) * np.eye(p)
            factor = np.linalg.cholesky(cov)
            self.classes.append((means[k], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))

    def standard(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale * (words / (words + self.few))[:, None]

    def difference(self, z: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, held within bounds, in tens."""
        logs = []
        for mean, inverse, half_log_det in self.classes:
            u = ((z - mean)[:, None, :] * inverse).sum(2)  # row by row, so that a score does not depend on its batch
            logs.append(-0.5 * (u * u).sum(1) - half_log_det)
        return np.clip(logs[1] - logs[0], -30, 30) / 10

    def scores(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), 1 / (1 + np.exp(-self.line[0])))
        return 1 / (1 + np.exp(-(self.line[0] + self.line[1] * self.difference(self.standard(x, words)))))


def matrix(texts: list, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = [statistics(t, table) for t in texts]
    return np.array([r[0] for r in rows]).reshape(-1, N_STATISTICS), np.array([r[1] for r in rows], float)


def trained(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Discriminant:
    """The discriminant of all labelled rows. Their statistics are measured where texts are read and written once; means,
    covariances and the calibration are sums over them. Without labels of both classes, every score is the share of
    label 1."""
    table, p = kinds(), N_STATISTICS

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, words = matrix(batch.column(1).to_pylist(), table)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(words)], ["doc_id", "x", "words"])

    loop = Loop(docs.sparkSession)
    rows = cut(labelled_measures(docs, loop.keep(known_labels(labels, "quality")), measure, "x array<double>, words double"))
    loop.end()
    values = lambda batch: np.asarray(batch.column(0).flatten(), float).reshape(-1, p)

    def first(batch: pa.RecordBatch) -> np.ndarray:
        x = values(batch)
        return np.c_[np.ones(len(x)), np.asarray(batch.column(2), float), x, x * x]

    sums = exact_sums(rows, first, 2 + 2 * p)
    n, ones = sums[0], sums[1]
    model = Discriminant(np.zeros((0, p)), np.zeros(0), np.zeros(0), labelled_share(labels, "quality"), fit)
    if not 0 < ones < n:
        return model
    model.mean = sums[2:2 + p] / n
    model.scale = np.sqrt(np.maximum(sums[2 + p:] / n - model.mean**2, 0)) + 1e-6
    bare = lambda batch: model.standard(values(batch), np.asarray(batch.column(1), float))

    def second(batch: pa.RecordBatch) -> np.ndarray:
        z = bare(batch)
        both = np.c_[z, (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)]
        one = np.asarray(batch.column(2), float)[:, None]
        return np.c_[both * (1 - one), both * one]

    size = p + p * p
    sums = exact_sums(rows, second, 2 * size)
    means, own = [], []
    for k, count in enumerate((n - ones, ones)):
        part = sums[k * size:(k + 1) * size]
        means.append(part[:p] / count)
        spread = part[p:].reshape(p, p) - count * np.outer(means[k], means[k])
        own.append(spread / (count - 1) if count > 1 else np.zeros((p, p)))
    model.shape(means, own, [1 - ones / n, ones / n], fit)

    def compared(batch: pa.RecordBatch) -> np.ndarray:
        d = model.difference(bare(batch))
        return np.c_[np.ones(len(d)), d]

    prior = model.line[0]
    model.line = logistic_over(rows, compared, 2, 2, ridge=0.01)
    model.line[0] += prior - odds(ones / n)
    return model


def scored(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """All columns of ``docs`` as the struct ``row``, and ``score`` in 0 to 1, higher where the quality is likelier good.

    Whole texts are measured. A null or blank text counts as the mean document; repeated rows score alike; an empty
    table gives no rows. Ids, languages, sources and labels never enter a score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(trained(docs, labels, fit))
    table = kinds()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.scores(*matrix(batch.column(1).to_pylist(), table))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return rows.mapInArrow(score, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    slim = scored(docs.select("doc_id", "text"), labels, fit)
    return slim.select(
        "row.doc_id", (fold(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
