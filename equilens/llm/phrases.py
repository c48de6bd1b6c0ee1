"""Phrase collocations from counts in burstable tries.

A task keeps one trie per language. Its leaves are hash containers of word-id sequences, which burst into a node of
containers by the next bits of the ids when they grow large. Above a bound of entries whole containers, largest first,
leave the task as sorted runs of phrases with their counts, cut into partitions by a hash of the phrase. Runs of a
partition are merged in one task, where counts are complete. A phrase meets as many entries as there are runs,
whatever its frequency; a partition by first words only would put all that follows a frequent pair in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.llm.common import cut

# A-Z become lower case, tabs spaces, and what ends a piece becomes a full stop, which no word can hold.
TEXT = bytes(46 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Words(dict):
    """Ids of words by first occurrence; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})
        self.names = [b"."]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number


class Node(dict):
    """Children by the next digit of the word ids: nodes, or plain dicts as containers."""


def groups_of(heads: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of every stretch of equal values."""
    edges = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1], [True]])).tolist()
    values = heads[edges[:-1]].tolist()
    yield from zip(values, edges, edges[1:])


class HatTrie:
    """Counts of packed word ids of ``width`` bits. It begins as one hash container; one that holds more than ``burst``
    keys bursts into a node of containers by the next eight bits, so only what is frequent lies deeper."""

    def __init__(self, width: int, burst: int):
        self.width, self.burst, self.root, self.entries = width, burst, {}, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of distinct ascending keys."""
        if len(keys):
            self.root = self._add(self.root, self.width, keys, counts)

    def _add(self, child: dict, left: int, keys: np.ndarray, counts: np.ndarray) -> dict:
        """``left`` bits of the keys do not lead to ``child`` yet. Returns what stands in its place then."""
        if type(child) is Node:
            below = max(0, left - 8)
            for digit, low, high in groups_of((keys >> below) & ((1 << (left - below)) - 1)):
                child[digit] = self._add(child.get(digit) or {}, below, keys[low:high], counts[low:high])
            return child
        self.entries -= len(child)
        if child:
            held = child.get
            for key, n in zip(keys.tolist(), counts.tolist()):
                child[key] = held(key, 0) + n
        else:
            child = dict(zip(keys.tolist(), counts.tolist()))
        if len(child) <= self.burst or not left:
            self.entries += len(child)
            return child
        keys, counts = self._arrays(child)
        order = np.argsort(keys)
        return self._add(Node(), left, keys[order], counts[order])

    @staticmethod
    def _arrays(container: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(container, np.int64, len(container)), np.fromiter(container.values(), np.int64, len(container))

    def taken(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of whole containers, largest first, until at most ``keep`` entries are left here."""
        found: list[tuple[int, Node | None, int]] = []

        def walk(child: dict, parent: Node | None, digit: int) -> None:
            if type(child) is Node:
                for d, grandchild in child.items():
                    walk(grandchild, child, d)
            else:
                found.append((len(child), parent, digit))

        walk(self.root, None, 0)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for size, parent, digit in sorted(found, key=lambda f: -f[0]):
            if self.entries <= keep:
                break
            parts.append(self._arrays(self.root if parent is None else parent.pop(digit)))
            self.entries -= size
            if parent is None:
                self.root = {}
        if not self.entries:
            self.root = {}
        return np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])


def windows(ids: np.ndarray, length: int, bits: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first ``starts`` words, it and the words after it in its piece, at most ``length``, as packed
    keys with their counts."""
    key, inside, alive = np.zeros(len(ids), np.int64), ids, ids != 0
    for step in range(length):
        inside = np.where(alive, np.append(ids[step:], np.zeros(min(step, len(ids)), ids.dtype)), 0)
        alive = inside != 0
        key = (key << bits) | inside
    return np.unique(key[:starts][ids[:starts] != 0], return_counts=True)


def spans(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes that end where a piece ends."""
    low = 0
    while low < len(data):
        high = data.find(b".", low + size) + 1 or len(data)
        yield data[low:high]
        low = high


def run_rows(lang: str, keys: np.ndarray, counts: np.ndarray, words: Words, hashes: np.ndarray, length: int, bits: int, parts: int):
    """Rows (part, lang, words, phrases, counts): per number of words and partition one run, sorted by words."""
    one = (1 << bits) - 1
    ids = [(keys >> (bits * (length - 1 - i))) & one for i in range(length)]
    used = np.unique(np.concatenate([np.unique(i) for i in ids]))
    used = used[used > 0]
    used = used[sorted(range(len(used)), key=lambda i: words.names[used[i]])]
    rank = np.zeros(len(words.names), np.int64)
    rank[used] = np.arange(1, len(used) + 1)
    names = np.array([b"", *map(words.names.__getitem__, used.tolist())], object)
    mixed = np.concatenate([np.zeros(1, np.uint64), hashes[used]])
    ranked = np.zeros(len(keys), np.int64)
    for i in ids:
        ranked = (ranked << bits) | rank[i]
    order = np.argsort(ranked)
    ranked, counts = ranked[order], counts[order]
    seed = np.uint64(zlib.crc32(lang.encode("utf-8", "surrogatepass")))
    for n in range(1, length + 1):
        head = ranked >> (bits * (length - n))
        whole = (head & one) != 0
        head, single = head[whole], counts[whole]
        if not len(head):
            break
        first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        head, total = head[first], np.add.reduceat(single, first)
        columns = [(head >> (bits * (n - 1 - i))) & one for i in range(n)]
        mix = np.full(len(head), seed, np.uint64)
        for column in columns:
            mix = (mix ^ mixed[column]) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(29)
        part = mix % np.uint64(parts)
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        total = total[order].astype(np.int32 if total.max() < 1 << 31 else np.int64)
        parted = [names[c[order]] for c in columns]
        for p, low, high in groups_of(part[order].astype(np.int64)):
            phrases = b"\n".join(parted[0][low:high] if n == 1 else map(b" ".join, zip(*(c[low:high] for c in parted))))
            yield p, lang, n, phrases.decode("utf-8", "surrogatepass"), total[low:high].tobytes()


RUN = "part long, lang string, words int, phrases string, counts binary"
COUNTED = "lang string, words int, phrase string, f long"


def phrase_counts(
    docs: DataFrame, longest: int = 3, least: int = 10, most_entries: int = 1_000_000, burst: int = 32_768,
    part_chars: int = 4_000_000, span: int = 2_000_000,
) -> DataFrame:
    """(lang, words, phrase, f): how often each phrase of up to ``longest`` words occurs within pieces, if ``least``
    times or more; and rows of 0 words whose f add up to all words of their language.

    A task holds ``most_entries`` trie entries at most before it spills half of them; a merge holds the runs of about
    ``part_chars`` characters of text. Both decide cost only.
    """
    chars = docs.agg(F.sum(F.char_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(1, -(-chars // part_chars))
    bits = 63 // longest
    step = 1 << (bits - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tries, hashes = Words(), {}, np.zeros(0, np.uint64)

        def spilled(keep: int) -> Iterator[pa.RecordBatch]:
            nonlocal hashes
            fresh = [zlib.crc32(w) | zlib.adler32(w) << 32 for w in words.names[len(hashes):]]
            hashes = np.concatenate([hashes, np.array(fresh, np.uint64)])
            for lang, trie in tries.items():
                keys, counts = trie.taken(keep * trie.entries // most_entries if keep else 0)
                rows = run_rows(lang, keys, counts, words, hashes, longest, bits, parts) if len(keys) else iter(())
                while some := list(islice(rows, 500)):
                    columns = zip(*some)
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "lang", "words", "phrases", "counts"])

        for batch in (whole.slice(low, 500) for whole in batches for low in range(0, len(whole), 500)):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text:
                    texts.setdefault("und" if lang is None else lang, []).append(text.encode("utf-8", "surrogatepass"))
            for lang, held in texts.items():
                trie = tries.setdefault(lang, HatTrie(longest * bits, burst))
                for data in spans(b".".join(held).translate(TEXT), span):
                    found = data.replace(b".", b" . ").split()
                    # A piece may be as long as its text, so ids are given to parts that must fit into the bits of one.
                    for low in range(0, len(found), step):
                        part = found[low:low + step + longest - 1]
                        ids = np.fromiter(map(words.__getitem__, part), np.int64, len(part))
                        if len(words.names) > 1 << bits:
                            yield from spilled(0)
                            words, hashes = Words(), np.zeros(0, np.uint64)
                            ids = np.fromiter(map(words.__getitem__, part), np.int64, len(part))
                        trie.add(*windows(ids, longest, bits, step))
                    if sum(t.entries for t in tries.values()) > most_entries:
                        yield from spilled(most_entries // 2)
        yield from spilled(0)

    def merge(runs: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        runs = runs.sort_by([("lang", "ascending"), ("words", "ascending")])
        langs, sizes = runs["lang"].to_pylist(), runs["words"].to_pylist()
        edges = [0, *(i for i in range(1, len(langs)) if (langs[i], sizes[i]) != (langs[i - 1], sizes[i - 1])), len(langs)]
        for low, high in zip(edges, edges[1:]):
            run = runs.slice(low, high - low)
            phrases = pc.split_pattern(run["phrases"].combine_chunks(), "\n").flatten().dictionary_encode()
            # A run has four bytes a count, eight where one needs them.
            sizes_of = pc.count_substring(run["phrases"], "\n").to_pylist()
            n = np.concatenate([np.frombuffer(c, np.int32 if len(c) == 4 * (k + 1) else np.int64)
                                for c, k in zip(run["counts"].to_pylist(), sizes_of, strict=True)]).astype(np.int64)
            total = np.zeros(len(phrases.dictionary), np.int64)
            np.add.at(total, phrases.indices.to_numpy(), n)
            often = np.flatnonzero(total >= least)
            out[0] += [langs[low]] * len(often)
            out[1] += [sizes[low]] * len(often)
            out[2] += phrases.dictionary.take(pa.array(often)).to_pylist()
            out[3] += total[often].tolist()
            if sizes[low] == 1:
                for column, value in zip(out, (langs[low], 0, None, int(n.sum())), strict=True):
                    column.append(value)
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["lang", "words", "phrase", "f"])

    columns = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(count, RUN).groupBy("part").applyInArrow(merge, COUNTED)


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, contained: int = 50, **shape: int,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut of the lowest score 1000000 * a * a / (l * r) rounded
    down, the leftmost of equal ones, and ``n`` the words of the language. A phrase below ``least`` is no candidate, and
    none that lies inside a longer candidate with ``contained`` percent of its count or more is returned. Equal scores
    are ordered by ``a``, then by phrase in byte order. A null language is ``und``; null and empty texts have no words;
    repeated rows count again; an empty table gives an empty result. Counts beyond 10^15 are an error.
    """
    return scored(cut(phrase_counts(docs, longest, least, **shape)), top, contained)


def scored(counts: DataFrame, top: int, contained: int) -> DataFrame:
    """The ranked phrases of complete counts, as ``phrase_counts`` gives them."""
    n = counts.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = counts.where("words > 0")
    found = known.where("words > 1").withColumnRenamed("f", "a")

    at = found.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    at = at.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    side = lambda part, name: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    at = at.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    exact: Column = F.expr("cast(1000000 as decimal(7)) * (cast(a as decimal(15)) * cast(a as decimal(15))) div (cast(l as decimal(15)) * cast(r as decimal(15)))")
    lowest = at.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), n -> transform(sequence(0, words - n),"
        " i -> array_join(slice(split(phrase, ' '), i + 1, n), ' '))))")
    around = found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))
