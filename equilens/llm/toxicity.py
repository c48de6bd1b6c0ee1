"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model of the letters of its words. Highest-order counts and the middle
continuation counts are the class's own; the lowest orders are continuation counts that both classes share, so an
expression that neither class knows gets the same probability from both. A document is compared by its log-likelihood
difference per word and per square root of words.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equilens.llm.common import Loop, cut, exact_sums, fold, known_labels, labelled, labelled_measures, labelled_share, logistic_over, odds, released, small_batches

LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Fit:
    """All labelled rows are fitted on, whole; ``order`` is the length of the longest letter context plus one, orders up
    to ``shared`` are pooled, ``folds`` parts of the rows are scored by models of the others to calibrate."""

    order: int = 5
    shared: int = 2
    discount: float = 0.75
    folds: int = 3


def spelled(word: str, order: int) -> str:
    return "<" * (order - 1) + word + ">"


def grams_of(words: Counter, order: int) -> Counter:
    """N-grams of the letters of counted words."""
    seen: Counter = Counter()
    for word, times in words.items():
        s = spelled(word, order)
        for i in range(len(s) - order + 1):
            seen[s[i:i + order]] += times
    return seen


class Models:
    """Both class models as tables over letter n-grams: probabilities of n-grams that either class has seen, and
    back-off weights of contexts."""

    def __init__(self, words: tuple[Counter, Counter], fit: Fit):
        self.count((grams_of(words[0], fit.order), grams_of(words[1], fit.order)), fit)

    @classmethod
    def counted(cls, grams: tuple[Counter, Counter], fit: Fit) -> Models:
        """Models of n-grams of the highest order that have been counted already."""
        models = cls.__new__(cls)
        models.count(grams, fit)
        return models

    def count(self, grams: tuple[Counter, Counter], fit: Fit) -> None:
        n = fit.order
        by_order = {n: list(grams)}
        for o in range(n - 1, 0, -1):
            lower = [Counter(), Counter()]
            for side, above in zip(lower, by_order[o + 1], strict=True):
                for gram in above:
                    side[gram[1:]] += 1
            by_order[o] = [lower[0] + lower[1]] * 2 if o <= fit.shared else lower
        self.order = n
        self.floor = 1 / (len(by_order[1][0]) + 1)
        self.known: dict[str, tuple[float, float]] = {}
        self.weight: dict[str, tuple[float, float]] = {}
        for o in range(1, n + 1):
            totals: list[dict[str, list[int]]] = [{}, {}]
            for side, seen in zip(totals, by_order[o], strict=True):
                for gram, times in seen.items():
                    t = side.setdefault(gram[:-1], [0, 0])
                    t[0] += times
                    t[1] += 1
            back = {
                c: tuple(fit.discount * t[c][1] / t[c][0] if c in t else 1.0 for t in totals)
                for c in totals[0].keys() | totals[1].keys()
            }
            for gram in by_order[o][0].keys() | by_order[o][1].keys():
                low, gamma = self.chances(gram[1:]), back[gram[:-1]]
                self.known[gram] = tuple(
                    max(by_order[o][k].get(gram, 0) - fit.discount, 0) / totals[k][gram[:-1]][0] + gamma[k] * low[k]
                    if gram[:-1] in totals[k] else low[k]
                    for k in (0, 1)
                )
            self.weight.update({f"{o}{c}": g for c, g in back.items()})

    def state(self) -> tuple:
        return self.order, self.floor, self.known, self.weight

    @classmethod
    def of(cls, state: tuple) -> Models:
        models = cls.__new__(cls)
        models.order, models.floor, models.known, models.weight = state
        return models

    def chances(self, gram: str) -> tuple[float, float]:
        if not gram:
            return self.floor, self.floor
        if (p := self.known.get(gram)) is not None:
            return p
        low, gamma = self.chances(gram[1:]), self.weight.get(f"{len(gram)}{gram[:-1]}", (1.0, 1.0))
        return gamma[0] * low[0], gamma[1] * low[1]


class Scorer:
    """Log-likelihood differences of texts; keeps those of recent words and n-grams, up to ``most`` of each."""

    def __init__(self, models: Models, most: int = 200_000):
        self.models, self.most = models, most
        self.words: dict[str, float] = {}
        self.grams: dict[str, float] = {}

    def word(self, word: str) -> float:
        n, grams, total = self.models.order, self.grams, 0.0
        s = spelled(word, n)
        for i in range(len(s) - n + 1):
            gram = s[i:i + n]
            d = grams.get(gram)
            if d is None:
                if len(grams) >= self.most:
                    grams.clear()
                p = self.models.chances(gram)
                d = grams[gram] = math.log(p[1] / p[0])
            total += d
        return total

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Constant, difference per word, difference per square root of words; no words: no difference."""
        total, n, known = 0.0, 0, self.words
        for m in LETTERS.finditer((text or "").lower()):
            w = m[0]
            d = known.get(w)
            if d is None:
                if len(known) >= self.most:
                    known.clear()
                d = known[w] = self.word(w)
            total += d
            n += 1
        return (1.0, total / n, total / math.sqrt(n)) if n else (1.0, 0.0, 0.0)


def gram_counts(rows: DataFrame, fit: Fit) -> DataFrame:
    """(gram, y, part, times) over all rows (part, text, y): each task counts its words, then Spark adds the n-grams up."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[int, int], Counter] = {}

        def out() -> pa.RecordBatch:
            found = [(g, y, part, n) for (y, part), seen in words.items() for g, n in grams_of(seen, fit.order).items()]
            words.clear()
            columns = list(zip(*found, strict=True)) if found else [(), (), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                ["gram", "y", "part", "times"])

        for batch in batches:
            for part, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words.setdefault((y, part), Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, words.values())) > 200_000:
                yield out()
        yield out()

    counted = rows.mapInArrow(grams, "gram string, y int, part int, times long")
    return counted.groupBy("gram", "y", "part").agg(F.sum("times").alias("times"))


def pack(models: Models) -> bytes:
    return zlib.compress(pickle.dumps(models.state()), 1)


def unpacked(packed: bytes) -> Models:
    return Models.of(pickle.loads(zlib.decompress(packed)))


def trained(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> bytes:
    """Models and calibration of all labelled rows, packed.

    N-grams are counted and out-of-fold features measured where texts are read, but for few texts. One
    task holds the table of distinct n-grams, which is the model; the driver passes models on packed. Scores are
    calibrated to the shares of the labelled rows, so a rare class is not passed over. Without labels of both classes,
    every score is the share of label 1.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(fit.folds)).cast("int")
    loop = Loop(spark)
    known = loop.keep(known_labels(labels, "toxic"))
    rows = labelled(docs, known).select(part.alias("part"), "text", "y")

    def learn(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        parts = [(Counter(), Counter()) for _ in range(fit.folds)]
        for gram, y, at, times in zip(got["gram"], got["y"], got["part"], got["times"], strict=True):
            parts[at][y][gram] += times
        whole = tuple(sum((p[side] for p in parts), Counter()) for side in (0, 1))
        models = [Models.counted((whole[0] - p[0], whole[1] - p[1]), fit) for p in parts]
        packed = [pack(m) for m in (*models, Models.counted(whole, fit))]
        return pa.table({"at": pa.array(range(len(packed)), pa.int32()), "model": pa.array(packed, pa.binary())})

    got = {r[0]: bytes(r[1]) for r in gram_counts(rows, fit).groupBy().applyInArrow(learn, "at int, model binary").collect()}
    whole = got.pop(fit.folds, None) or pack(Models((Counter(), Counter()), fit))
    if not got:
        loop.end()
        return pickle.dumps((whole, [odds(labelled_share(labels, "toxic")), 0.0, 0.0]))
    released(rows)  # the texts that were dealt out for counting
    states = spark.sparkContext.broadcast([got.pop(i) for i in range(fit.folds)])
    kept: dict[int, Scorer] = {}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = []
            for at, text in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at not in kept:
                    kept[at] = Scorer(unpacked(states.value[at]))
                x.append(kept[at].features(text)[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    measured = cut(labelled_measures(docs, known, measure, "x array<double>", part.alias("part")))
    states.destroy()
    loop.end()
    values = lambda batch: np.asarray(batch.column(0).flatten(), float).reshape(-1, 2)

    def first(batch: pa.RecordBatch) -> np.ndarray:
        x = values(batch)
        return np.c_[np.ones(len(x)), np.asarray(batch.column(1), float), x, x * x]

    sums = exact_sums(measured, first, 6)
    n, ones = sums[0], sums[1]
    if not 0 < ones < n:
        return pickle.dumps((whole, [odds(labelled_share(labels, "toxic")), 0.0, 0.0]))
    scale = np.array([1.0, *(np.sqrt(np.maximum(sums[4:] / n - (sums[2:4] / n) ** 2, 0)) + 1e-9)])
    b = logistic_over(measured, lambda batch: np.c_[np.ones(batch.num_rows), values(batch)] / scale, 1, 3) / scale
    return pickle.dumps((whole, b.tolist()))


def scored(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """All columns of ``docs`` as the struct ``row``, and ``score`` in 0 to 1, higher where toxic is likelier.

    Whole texts are scored. A null or wordless text gets the calibrated score of no evidence; repeated rows score
    alike; an empty table gives no rows. Ids, languages, sources and labels never enter a score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(trained(docs, labels, fit))
    kept: dict = {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, b = kept["model"] if "model" in kept else kept.setdefault("model", pickle.loads(model.value))
        scorer = kept["scorer"] if "scorer" in kept else kept.setdefault("scorer", Scorer(unpacked(state)))
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            s = 1 / (1 + np.exp(-np.clip(x @ np.array(b), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["row", "score"])

    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return rows.mapInArrow(score, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, fit: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    slim = scored(docs.select("doc_id", "text"), labels, fit)
    return slim.select(
        "row.doc_id", (fold(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
