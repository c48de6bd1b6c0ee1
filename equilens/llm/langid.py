"""Language identification by cross-parsing entropy.

For each language a suffix automaton knows all substrings of labelled text. A document is cut greedily into the
longest phrases that the automaton knows; phrases times the logarithm of the text length, per character, estimate the
cross entropy, and the language with the least wins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equilens.llm.common import fold

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class Fit:
    """Each language is learned from ``docs`` labelled texts at most, a pseudorandom choice by id: first among those of
    ``shortest`` to ``longest`` characters, then among the others, of long ones the first ``longest``. Of these texts
    ``chars`` normalised characters are kept, fewer where more than ``all_chars`` / ``chars`` languages share the
    memory. ``letters`` is the number of different characters kept per language."""

    docs: int = 60
    shortest: int = 20
    longest: int = 4000
    chars: int = 30_000
    all_chars: int = 800_000
    letters: int = 250


def plain(text: str | None) -> str:
    """Lower-case letters with single blanks between words."""
    return " ".join(LETTERS.findall((text or "").lower()))


def automaton(codes: list[int], letters: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``codes`` as a table of states by letters. State 1 is the start and 0
    stands for no transition; code 0 separates texts and is never followed."""
    step: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in codes:
        if c == 0:
            last = 1
            continue
        if c in step[last] and length[step[last][c]] == length[last] + 1:
            last = step[last][c]
            continue
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = twin
                if c in step[last] and step[last][c] == twin and length[twin] == length[last] + 1:
                    cur = twin
                else:
                    link[cur] = twin
        last = cur
    table = np.zeros((len(step), letters), np.int32)
    for s, out in enumerate(step):
        for c, t in out.items():
            table[s, c] = t
    return table


class Languages:
    """Automata of all languages, each over its own alphabet; ``names`` are in order, so ties go to the first."""

    def __init__(self, texts: dict[str, list[str]], fit: Fit):
        self.names = sorted(texts)
        keep = min(fit.chars, fit.all_chars // max(1, len(texts)))
        cut: dict[str, list[str]] = {}
        for name in self.names:
            left, cut[name] = keep, []
            for t in texts[name]:
                if left <= 0:
                    break
                cut[name].append(t[:left])
                left -= len(t)
        alphabets = []
        for name in self.names:
            seen = Counter(c for t in cut[name] for c in t)
            alphabets.append(sorted(sorted(seen, key=lambda c: (-seen[c], c))[: fit.letters]))
        # A character has one code in all, and by that one code in each language; 0 is a character that it has not seen.
        every = sorted(set().union(*alphabets))
        self.codes = np.zeros(0x110000, np.uint16 if len(every) < 1 << 16 else np.int32)
        self.codes[[ord(c) for c in every]] = np.arange(1, len(every) + 1)
        self.local = np.zeros((len(self.names), len(every) + 1), np.int64)
        tables, bits = [], []
        for k, name in enumerate(self.names):
            self.local[k, self.codes[[ord(c) for c in alphabets[k]]]] = np.arange(1, len(alphabets[k]) + 1)
            codes = [int(c) for t in cut[name] for c in [*self.local[k, self.coded(t)], 0]]
            tables.append(automaton(codes, len(alphabets[k]) + 1))
            bits.append(math.log2(max(2, len(codes))))
        sizes = np.array([t.size for t in tables], np.int64)
        self.letters = np.array([[t.shape[1]] for t in tables], np.int64).reshape(-1, 1)
        self.base = (sizes.cumsum() - sizes).reshape(-1, 1)
        self.known = np.concatenate([np.zeros(0, np.int32), *[t.ravel() for t in tables]])
        self.bits = np.array(bits)

    def coded(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits per character of each text under each language; texts are normalised and not empty.

        Texts are parsed side by side, one character of each at a time, in all languages at once.
        """
        coded = [self.coded(t) for t in texts]
        size = np.array([len(c) for c in coded])
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate(coded)
        begin = (size.cumsum() - size)[order]
        live = np.searchsorted(-size[order], -np.arange(size.max()), side="left").tolist()
        state = np.ones((len(self.names), len(texts)), np.int64)
        phrases = np.zeros_like(state)
        for i, n in enumerate(live):
            c = self.local[:, flat[begin[:n] + i]]
            s = state[:, :n]
            to = self.known[self.base + s * self.letters + c].astype(np.int64)
            lost = to == 0
            phrases[:, :n] += lost | (s == 1)
            if lost.any():
                # The phrase has ended: the next one begins with this character, unless no text of the language has it.
                again = self.known[(self.base + self.letters + c)[lost]]
                to[lost] = np.where(again == 0, 1, again)
            state[:, :n] = to
        out = np.empty((len(texts), len(self.names)))
        out[order] = (phrases * self.bits[:, None]).T
        return out / size[:, None]


def by_size(batch: pa.RecordBatch, chars: int = 32_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``chars`` bytes of text. A part takes as many steps as its longest text has letters, so
    it should be large against that."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(float)).cumsum()
    low = 0
    while low < len(batch):
        before = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, before + chars, side="right")))
        yield batch.slice(low, high - low)
        low = high


def trained(docs: DataFrame, fit: Fit = Fit(), of: int = 3, out: int = 1) -> Languages:
    """Automata from a bounded sample of labelled rows outside the held-out fold."""
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), of) != out))
    fits = F.char_length("text").between(fit.shortest, fit.longest)
    rows = rows.select("doc_id", "lang", (~fits).alias("other"), F.left("text", F.lit(fit.longest)).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("other", F.xxhash64("doc_id"), "doc_id", "text"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= fit.docs).select("lang", "nth", "text").orderBy("lang", "nth")
    texts: dict[str, list[str]] = {}
    for lang, text in zip(*(rows.toArrow().column(c).to_pylist() for c in ("lang", "text")), strict=True):
        if t := plain(text):
            texts.setdefault(lang, []).append(t)
    return Languages(texts, fit)


def identified(docs: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; whole texts are parsed.

    ``score`` is the lead over the second language, as a share of its entropy (1 with a single language). A null text,
    one without letters, and every text where nothing could be learned is ``und`` with score 0. Ties go to the first
    name; repeated rows get equal answers; an empty table gives no rows. Languages, sources and ids never enter a
    prediction.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trained(docs, fit))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in (part for whole in batches for part in by_size(whole)):
            texts = [plain(t) for t in batch.column(1).to_pylist()]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if t] if known.names else []
            if some:
                bits = known.entropies([texts[i] for i in some])
                best = bits.argmin(1)
                for i, b in zip(some, best, strict=True):
                    pred[i] = known.names[b]
                low = np.sort(bits, 1)
                score[some] = 1 - low[:, 0] / low[:, 1] if low.shape[1] > 1 else 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text")
    found = rows.mapInArrow(predict, T.StructType([
        rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
