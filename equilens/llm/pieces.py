"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

A merge-type (BPE) model joins neighbouring pieces by an agenda, best score first and leftmost on ties. With dropout,
a candidate merge is skipped when a keyed hash of its place falls below a rate; every occurrence of a word in a
document has a variant of its own, so segmentations vary, yet the same seed gives the same pieces everywhere.

Pieces of such a model hold the blank mark only at their start, and characters that it does not know become byte
pieces that never join; so a text falls apart before every run of blanks and around such characters. These units are
joined on their own: short ones side by side in arrays, long ones by a heap. Both take the same merges.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equilens.llm.common import small_batches

MARK = "▁"
STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Dropout:
    """Merges are skipped at ``rate``; ``seed`` and the variant of an occurrence, one of ``variants``, key the hash."""

    rate: float = 0.1
    seed: int = 9
    variants: int = 8


def stirred(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Model:
    """Pieces, scores and byte pieces of a merge-type SentencePiece model with byte fallback."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if len(self.byte) != 256 or any(MARK in self.text[i].lstrip(MARK) for i in plain):
            raise ValueError("a model with all byte pieces and with blanks only at the start of pieces is needed")
        self.id = {self.text[i]: i for i in plain}
        raw = [b"" for _ in range(n)]
        for i in plain:
            raw[i] = self.text[i].replace(MARK, " ").encode()
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.byte_count = np.fromiter(map(len, raw), np.int64, n)
        self.byte_start = self.byte_count.cumsum() - self.byte_count
        known = "".join(re.escape(c) for c in self.id if len(c) == 1 and c != MARK)
        self.unit = re.compile(f"{MARK}*[{known}]+|{MARK}+|[^{known}{MARK}]")
        # Merges: every cut of a piece into two pieces; better scores get smaller ranks.
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        merges = [
            (self.id[p[:k]] << 32 | self.id[p[k:]], rank[i], i)
            for i in plain for p in [self.text[i]] for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id
        ]
        merges.sort()
        self.pairs = np.array([m[0] for m in merges] or [-1], np.int64)
        self.ranks = np.array([m[1] for m in merges] or [0], np.int64)
        self.made = np.array([m[2] for m in merges] or [0], np.int64)
        self.by_pair = {m[0]: (m[1], m[2]) for m in merges}

    def symbols(self, unit: str) -> tuple[int, ...]:
        """First symbols of a unit: a piece for each known character, bytes for others, below zero as ~id."""
        known, out = self.id, []
        for c in unit:
            if (i := known.get(c)) is not None:
                out.append(i)
            else:
                out.extend(~self.byte[b] for b in c.encode("utf-8", "surrogatepass"))
        return tuple(out)


def skipped(key, start, middle, end, rate: float):
    """Whether the merge of start..middle with middle..end is skipped; arrays of uint64 or single values."""
    x = stirred(key + STEP * (start + np.uint64(1)))
    x = stirred(x + STEP * (middle + np.uint64(1)))
    x = stirred(x + STEP * (end + np.uint64(1)))
    return (x >> np.uint64(11)) < np.uint64(int(rate * (1 << 53)))


def by_heap(model: Model, symbols: tuple[int, ...], key: int, rate: float) -> list[int]:
    """Pieces of one unit by an agenda of candidate merges."""
    piece, n = list(symbols), len(symbols)
    left, right, end = [i - 1 for i in range(n)], [i + 1 for i in range(n)], [i + 1 for i in range(n)]
    agenda: list[tuple[int, int, int, int]] = []
    key_ = np.uint64(key)

    def offer(i: int) -> None:
        j = right[i]
        if j < n and piece[i] >= 0 and piece[j] >= 0 and (m := model.by_pair.get(piece[i] << 32 | piece[j])):
            with np.errstate(over="ignore"):
                drop = rate > 0 and bool(skipped(key_, np.uint64(i), np.uint64(j), np.uint64(end[j]), rate))
            if not drop:
                heapq.heappush(agenda, (m[0], i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    dead = [False] * n
    while agenda:
        rank, i, j, stop = heapq.heappop(agenda)
        if dead[i] or right[i] != j or end[j] != stop or model.by_pair.get(piece[i] << 32 | piece[j], (-1,))[0] != rank:
            continue
        piece[i], end[i], right[i], dead[j] = model.by_pair[piece[i] << 32 | piece[j]][1], stop, right[j], True
        if right[j] < n:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [p if p >= 0 else ~p for i, p in enumerate(piece) if not dead[i]]


def side_by_side(model: Model, symbols: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of units of one length, a row each: in each round every unit takes its best merge that is left.

    Returns the pieces by the place where they start and a mask of the places where one does.
    """
    rows, width = symbols.shape
    piece = symbols.astype(np.int64)
    right = np.broadcast_to(np.arange(1, width + 2), (rows, width + 1)).copy()
    left = np.broadcast_to(np.arange(-1, width), (rows, width + 1)).copy()
    alive = np.ones((rows, width), bool)
    none = np.int32(2**31 - 1)
    best = np.full((rows, width), none, np.int32)

    def judge(r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Ranks of the merges of the pieces at i and j in rows r, ``none`` where there is none or it is skipped."""
        pair = (piece[r, i] << 32) | piece[r, j]
        at = np.minimum(np.searchsorted(model.pairs, pair), len(model.pairs) - 1)
        hit = np.flatnonzero(model.pairs[at] == pair)
        if rate > 0 and len(hit):
            rh, ih, jh = r[hit], i[hit], j[hit]
            hit = hit[~skipped(keys[rh], ih.astype(np.uint64), jh.astype(np.uint64), right[rh, jh].astype(np.uint64), rate)]
        out = np.full(len(r), none, np.int32)
        out[hit] = model.ranks[at[hit]]
        return out

    r, i = np.divmod(np.arange(rows * (width - 1)), width - 1)
    best[r, i] = judge(r, i, i + 1)
    live = np.arange(rows)
    while len(live):
        i = best[live].argmin(1)
        on = best[live, i] < none
        live, i = live[on], i[on]
        j = right[live, i]
        stop = right[live, j]
        pair = (piece[live, i] << 32) | piece[live, j]
        piece[live, i] = model.made[np.searchsorted(model.pairs, pair)]
        alive[live, j], best[live, j] = False, none
        right[live, i], left[live, stop] = stop, i
        best[live, i] = none
        more = np.flatnonzero(stop < width)
        best[live[more], i[more]] = judge(live[more], i[more], stop[more])
        before = left[live, i]
        more = np.flatnonzero(before >= 0)
        best[live[more], before[more]] = judge(live[more], before[more], i[more])
    return piece, alive


def spread(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the runs that start at ``offsets`` and have ``counts`` members, one run after the other."""
    ends = counts.cumsum()
    return np.repeat(offsets - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes batches of texts; equal units of one variant are joined once per batch."""

    def __init__(self, model: Model, dropout: Dropout, longest: int = 40):
        self.model, self.dropout, self.longest = model, dropout, longest
        self.base = int(stirred(np.array([dropout.seed], np.uint64))[0])
        self.of_char = np.full(0x110000, -1, np.int32)
        for text, i in model.id.items():
            if len(text) == 1:
                self.of_char[ord(text)] = i
        self.mark = [model.byte[b] for b in MARK.encode()]

    def key(self, symbols: tuple[int, ...], variant: int) -> int:
        """Key of a unit's merges: from the seed, the variant and the unit's symbols."""
        h = self.base ^ (variant + 1)
        for s in symbols:
            h = (h * 0x100000001B3 ^ (s & 0xFFFFFFFF)) & 0xFFFFFFFFFFFFFFFF
        return h

    def pieces(self, units: list[str], unit: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of units[unit[k]] in variant[k], as one array with the start and number of each."""
        rate = self.dropout.rate
        size = np.fromiter(map(len, units), np.int64, len(units))
        coded = self.of_char[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = size.cumsum() - size
        odd = np.zeros(len(units), bool)
        odd[np.repeat(np.arange(len(units)), size)[coded < 0]] = True
        odd |= (size > self.longest) | (size == 0)
        start, count, flat, used = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64), [], 0
        for width in np.unique(size[~odd]).tolist():
            these = np.flatnonzero((size[unit] == width) & ~odd[unit])
            for s in range(0, len(these), 50_000):
                part = these[s:s + 50_000]
                symbols = coded[begin[unit[part]][:, None] + np.arange(width)]
                if width == 1:
                    piece, alive = symbols, np.ones(symbols.shape, bool)
                else:
                    keys = np.uint64(self.base) ^ (variant[part] + 1).astype(np.uint64)
                    for column in symbols.T:
                        keys = keys * np.uint64(0x100000001B3) ^ column.astype(np.uint64)
                    piece, alive = side_by_side(self.model, symbols, keys, rate)
                count[part] = alive.sum(1)
                start[part] = used + count[part].cumsum() - count[part]
                flat.append(piece[alive])
                used += len(flat[-1])
        for k in np.flatnonzero(odd[unit]).tolist():
            symbols = self.model.symbols(units[unit[k]])
            ids = by_heap(self.model, symbols, self.key(symbols, int(variant[k])), rate) if symbols else self.mark
            start[k], count[k] = used, len(ids)
            flat.append(np.array(ids, np.int64))
            used += len(ids)
        return np.concatenate([np.zeros(0, np.int64), *flat]), start, count

    def encode(self, texts: list[str], salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts in one array and the ends of each text's, beginning with 0.

        A blank mark in a text itself is an empty unit here, which stands for its byte pieces.
        """
        found: dict[str, int] = {}
        ids: list[int] = []
        sizes, units = [], self.model.unit.findall
        for text in texts:
            before = len(ids)
            for k, part in enumerate(text.split(MARK) if text else []):
                if k:
                    ids.append(found.setdefault("", len(found)))
                marked = part.replace(" ", MARK) if k else MARK + part.replace(" ", MARK)
                ids += [found.setdefault(u, len(found)) for u in units(marked)]
            sizes.append(len(ids) - before)
        sizes = np.array(sizes, np.int64)
        at = np.array(ids, np.int64)
        variants = self.dropout.variants if self.dropout.rate > 0 else 1
        nth = np.arange(len(at)) - np.repeat(sizes.cumsum() - sizes, sizes)
        variant = (stirred(nth.astype(np.uint64) * STEP + np.repeat(salts, sizes)) % np.uint64(variants)).astype(np.int64)
        both, place = np.unique(at * variants + variant, return_inverse=True)
        flat, start, count = self.pieces(list(found), both // variants, both % variants)
        ends = np.concatenate([[0], count[place].cumsum()])[np.concatenate([[0], sizes.cumsum()])]
        return flat[spread(start[place], count[place])], ends


def decoded(model: Model, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """Texts of the pieces between the ends: blanks for marks, bytes put together, the blank at the start taken off."""
    raw = model.bytes[spread(model.byte_start[ids], model.byte_count[ids])].tobytes()
    at = np.concatenate([[0], model.byte_count[ids].cumsum()])[ends].tolist()
    return [raw[a + 1:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def load(spark, path: str):
    """The model file, read once on the driver and sent to tasks; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str, dropout: Dropout = Dropout()) -> DataFrame:
    """All columns of ``docs`` as the struct ``row``, with ``piece_ids`` (null for a null text, empty for an empty one).

    The variants of a document follow from the seed and its whole text, so repeated rows get equal pieces whatever
    their partition; an empty table gives no rows.
    """
    small_batches(docs.sparkSession, 1000)
    proto = load(docs.sparkSession, path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Model(proto.value), dropout)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, ends = encoder.encode([t or "" for t in texts], batch.column(2).to_numpy().view(np.uint64))
            null = pa.array([t is None for t in texts])
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=null)
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["row", "piece_ids"])

    rows = docs.select(F.struct("*").alias("row"), "text", F.xxhash64("text").alias("salt"))
    return rows.mapInArrow(each, T.StructType([rows.schema["row"], T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]))


def with_text(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` with the text of ``piece_ids`` as ``decoded``; null stays null."""
    small_batches(coded.sparkSession, 1000)
    proto = load(coded.sparkSession, path)
    names = coded.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(proto.value)
        for batch in batches:
            lists = batch.column(len(names))
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            texts = decoded(model, lists.flatten().to_numpy().astype(np.int64), ends)
            texts = [t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*names, "decoded"])

    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())])
    return coded.select("*", F.col("piece_ids").alias("_ids")).mapInArrow(each, schema)
