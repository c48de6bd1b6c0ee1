"""Exact Jaccard join of word n-gram sets with prefix trees.

Sets are ordered by one global order, common n-grams last. Two sets that are similar enough share an n-gram among the
first of both (their prefixes), so documents meet in the lists of shared prefix n-grams. Groups of candidates are
stored in a trie of their ordered sets; a probe walks it once, shares the overlap of common paths and leaves subtrees
whose sizes and remaining lengths can't reach the overlap that is needed.

Equal sets are one class, lists with the same members are one list, and members that are linked already are never
compared again, so a large group of copies costs a few links for each member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equilens.llm.common import components, cut, released, small_batches


@dataclass(frozen=True)
class Join:
    """Sets of ``n`` words link when 100 * intersection >= ``percent`` * union.

    The global order puts n-grams last that occur ``often`` times in a pseudorandom sample of ``sample`` documents, of
    those the ``common`` most frequent at most; it decides speed only. ``group`` bounds the members of a trie and
    ``block`` those of a tile of a list, ``family`` the rows of lists in a task. Sketches have ``buckets`` counters of one byte. ``bits`` is the size of the
    filter that keeps most texts out of the shuffle when sets are read again; it decides speed only.
    """

    n: int = 5
    percent: int = 75
    sample: int = 8_000
    often: int = 2
    common: int = 1 << 20
    group: int = 200
    block: int = 1024
    buckets: int = 512
    family: int = 50_000
    bits: int = 1 << 24


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Shingles:
    """Hashed n-gram sets of texts; remembers word hashes, up to ``most`` of them."""

    def __init__(self, n: int, most: int = 500_000):
        self.n, self.most = n, most
        self.words: dict[bytes, int] = {}

    def hashes(self, text: bytes | None) -> np.ndarray:
        """Sorted 63-bit hashes of the set: A-Z lower-cased, words between ASCII blanks; fewer than n words: one
        n-gram of them all; none: empty."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.int64)
        known = self.words
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        span = min(self.n, len(h))
        x = np.full(len(h) - span + 1, np.uint64(span))
        for k in range(span):
            x = mixed(x * np.uint64(0xD6E8FEB86659FD93) + h[k:k + len(x)])
        x = np.sort((x >> np.uint64(1)).astype(np.int64))
        return x[np.concatenate([[True], x[1:] != x[:-1]])]


def ordered(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The set in the global order, as ascending numbers: rare n-grams are negative, common ones come after them."""
    if not len(common):
        return hashes - np.int64(2**62) - np.int64(2**62)
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    often = common[at] == hashes
    rare = hashes[~often] - np.int64(2**62) - np.int64(2**62)
    return np.concatenate([rare, hashes[often]])


def needed(a, b, percent: int):
    """Least overlap of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


class Trie:
    """Ordered sets as a path-compressed tree. A node is [edge, children, members, smallest size, largest size]."""

    def __init__(self, percent: int):
        self.percent = percent
        self.root: list = [np.zeros(0, np.int64), {}, [], 1 << 60, 0]

    def add(self, member: int, s: np.ndarray) -> None:
        node, at = self.root, 0
        while True:
            node[3], node[4] = min(node[3], len(s)), max(node[4], len(s))
            if at == len(s):
                node[2].append(member)
                return
            child = node[1].get(first := int(s[at]))
            if child is None:
                node[1][first] = [s[at:], {}, [member], len(s), len(s)]
                return
            edge, rest = child[0], s[at:]
            k = min(len(edge), len(rest))
            apart = np.flatnonzero(edge[:k] != rest[:k])
            same = int(apart[0]) if len(apart) else k
            if same < len(edge):
                lower = [edge[same:], *child[1:]]
                child[:] = [edge[:same], {int(edge[same]): lower}, [], child[3], child[4]]
            node, at = child, at + same

    def links(self, s: np.ndarray, skip) -> Iterator[int]:
        """Members that link with ``s``, but for those that ``skip`` names when they are reached."""
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, depth, at, overlap = stack.pop()
            edge = node[0]
            if len(edge):
                place = at + np.searchsorted(s[at:], edge)
                inside = place < len(s)
                overlap += int((s[place[inside]] == edge[inside]).sum())
                at = int(np.searchsorted(s, edge[-1], side="right"))
                depth += len(edge)
            if overlap + min(len(s) - at, node[4] - depth) < needed(len(s), node[3], self.percent):
                continue
            if overlap >= needed(len(s), depth, self.percent):
                yield from (m for m in node[2] if not skip(m))
            stack.extend((child, depth, at, overlap) for child in node[1].values())


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the same members as all links among ``sets`` do."""
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    trie, found = Trie(percent), []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        for m in trie.links(sets[i], lambda m, i=i: top(m) == top(i)):
            if top(m) != top(i):
                root[top(m)] = top(i)
                found.append((m, i))
        trie.add(i, sets[i])
    return found


def class_id(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def common_shingles(docs: DataFrame, join: Join) -> np.ndarray:
    """Sorted hashes of the most frequent n-grams of a bounded sample of documents, ``join.common`` at most."""
    rows = docs.count()
    part = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int(min(1.0, join.sample / max(1, rows)) * (1 << 20))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(join.n)
        for batch in batches:
            sets = [shingles.hashes(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["token"])

    seen = docs.where(part).select(F.col("text").cast("binary")).mapInArrow(each, "token long")
    often = seen.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= join.often)
    top = often.orderBy(F.desc("n"), "token").limit(join.common).select("token")
    return np.sort(top.toArrow().column(0).to_numpy())


def sketch(hashes: np.ndarray, buckets: int) -> bytes:
    """Number of n-grams by bucket, 255 standing for that many or more."""
    at = (mixed(hashes.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=buckets), 255).astype(np.uint8).tobytes()


def can_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """False where sets of such sketches and sizes can't link, and the most that they can overlap, as a share of the
    smaller: the sum of smaller counts is never below the overlap, but where both counters are full it is unknown."""
    least = needed(size_a.astype(np.int64), size_b.astype(np.int64), percent)
    small, both = np.minimum(size_a, size_b), np.minimum(a, b)
    most = np.where((both == 255).any(-1), small, np.minimum(both.sum(-1, dtype=np.int64), small))
    return most >= least, most / np.maximum(size_a, size_b)


def profiles(docs: DataFrame, join: Join, common) -> DataFrame:
    """(doc_id, n_shingles, key, id, sketch, prefix): ``key`` is a 16-byte digest of the set, equal for equal sets, and
    ``id`` its head as a number; they are null for an empty set.

    ``prefix`` has the n-grams that any set which links must share one of, at the first row of each class in a task,
    else null. It keeps 39 bits of each: a chance meeting costs a comparison and changes no result.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(join.n), set()
        for batch in batches:
            sets = [shingles.hashes(t) for t in batch.column(1).to_pylist()]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            ids = [class_id(k) if k else None for k in keys]
            prefixes = []
            for s, i, known in zip(sets, ids, batch.column(0).is_valid().to_pylist(), strict=True):
                first = known and i is not None and i not in seen
                if first:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(i)
                prefixes.append(ordered(s, common.value)[: len(s) - -(-join.percent * len(s) // 100) + 1] >> 24 if first else None)
            lengths = [0 if x is None else len(x) for x in prefixes]
            flat = np.concatenate([np.zeros(0, np.int64), *(x for x in prefixes if x is not None)])
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat), mask=pa.array([x is None for x in prefixes]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(ids, pa.int64()),
                pa.array([sketch(s, join.buckets) if len(s) else None for s in sets], pa.binary()), lists,
            ], ["doc_id", "n_shingles", "key", "id", "sketch", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_shingles long, key binary, id long, sketch binary, prefix array<long>")


def ordered_sets(docs: DataFrame, join: Join, common) -> DataFrame:
    """(doc_id, id, tokens): the whole ordered set of each row, repeated rows once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(join.n)
        for batch in batches:
            sets = [shingles.hashes(t) for t in batch.column(1).to_pylist()]
            ids = [class_id(hashlib.blake2b(s.tobytes(), digest_size=16).digest()) for s in sets]
            lists = [ordered(s, common.value) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in lists])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *lists])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "id", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary"))
    return rows.mapInArrow(each, "doc_id long, id long, tokens array<long>").dropDuplicates(["id", "doc_id"])


def only(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``wanted``,
    and, by chance, others: more of them the more ids there are, so an exact join must follow. A bitmap of hashed ids,
    ``bits`` / 8 bytes whatever the number of ids and so safe to broadcast, drops the rest, so that their texts are not
    shuffled.
    """
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    words = F.expr("_at div 32768").alias("_word")
    marks = wanted.select(at.alias("_at")).groupBy(words).agg(F.bitmap_construct_agg(F.expr("_at % 32768")).alias("_map"))
    near = docs.withColumn("_at", at).withColumn("_word", words).join(F.broadcast(marks), "_word")
    near = near.where("(int(conv(hex(substring(_map, int(_at % 32768 div 8) + 1, 1)), 16, 10)) div shiftleft(1, int(_at % 8))) % 2 = 1")
    return near.select(*docs.columns)


def possible(pairs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """Pairs (hub, id) that sizes and sketches don't rule out."""
    side = lambda name: classes.select(
        F.col("id").alias(name), F.col("size").alias(f"{name}_size"), F.col("sketch").alias(f"{name}_sketch"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            counts = [np.frombuffer(b"".join(get(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("hub_sketch", "id_sketch")]
            kept, _ = can_link(*counts, get("hub_size").to_numpy(), get("id_size").to_numpy(), join.percent)
            yield pa.RecordBatch.from_arrays([get("hub"), get("id")], ["hub", "id"]).filter(pa.array(kept))

    return pairs.join(side("hub"), "hub").join(side("id"), "id").mapInArrow(each, "hub long, id long")


def stars(pairs: DataFrame, join: Join) -> DataFrame:
    """Groups (hub, part, id) of pairs (hub, id): each hub with its ids, in parts of about ``join.group``."""
    size = pairs.groupBy("hub").agg(F.count("*").alias("m"))
    parts = pairs.join(size, "hub").select("hub", F.pmod(F.xxhash64("id"), F.expr(f"int(m div {join.group}) + 1")).alias("part"), "id")
    return parts.union(parts.select("hub", "part", F.col("hub").alias("id")).distinct())


def clusters(pairs: DataFrame, join: Join) -> DataFrame:
    """Groups (hub, part, id) in which all pairs meet: whole components of the pairs where they are small enough, so
    that a set is sent once, and stars for the others."""
    whole = components(pairs.select(F.col("hub").alias("a"), F.col("id").alias("b")))
    large = whole.groupBy("component").agg(F.count("*").alias("m")).where(F.col("m") > 2 * join.group).select("component")
    small = whole.join(large, "component", "left_anti").select(F.col("component").alias("hub"), F.lit(0).alias("part"), "id")
    rest = whole.join(large, "component", "left_semi").select("id")
    return small.union(stars(pairs.join(rest, "id", "left_semi"), join).select("hub", F.col("part").cast("int"), "id"))


def with_sets(groups: DataFrame, docs: DataFrame, classes: DataFrame, join: Join, common) -> DataFrame:
    """(hub, part, id, tokens): one row for each member of each group, with its set. Sets are matched by class and first
    document, so that other copies of a class, where they pass the bitmap, spread over the tasks and end there."""
    groups = cut(groups)
    wanted = classes.join(groups.select("id").distinct(), "id", "left_semi").select("id", F.col("first").alias("doc_id"))
    wanted = cut(wanted)
    sets = ordered_sets(only(docs, wanted.select("doc_id").distinct(), join.bits), join, common)
    return groups.join(wanted, "id").join(sets, ["id", "doc_id"]).select("hub", "part", "id", "tokens")


def verified(groups: DataFrame, docs: DataFrame, classes: DataFrame, join: Join, common) -> DataFrame:
    """Links (a, b) that join the members of each group as all links among them do, found in a trie of their sets."""

    def link(table: pa.Table) -> pa.Table:
        column = table.column("tokens").combine_chunks()
        at, flat = column.offsets.to_numpy(), column.values.to_numpy()
        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
        found = forest([flat[at[k]:at[k + 1]] for k in first], join.percent)
        a, b = (np.array([f[k] for f in found], int) for k in (0, 1))
        return pa.table({"a": ids[a], "b": ids[b]})

    links = with_sets(groups, docs, classes, join, common).groupBy("hub", "part").applyInArrow(link, "a long, b long")
    return released(cut(links))


def best_of(part: np.ndarray, u: np.ndarray, v: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the pairs that score highest for a component at one of their ends, one for each component."""
    ends = np.concatenate([part[u], part[v]])
    place = np.tile(np.arange(len(u)), 2)
    order = np.lexsort((-np.tile(score, 2), ends))
    first = np.concatenate([[True], ends[order][1:] != ends[order][:-1]]) if len(order) else np.zeros(0, bool)
    return np.unique(place[order][first])


def open_pairs(lists: DataFrame, classes: DataFrame, join: Join, best: bool) -> DataFrame:
    """Pairs (hub, id) of different components that share a list and whose sketches leave a link possible, with the
    components of both and the ``score`` that their sketches allow; with ``best``, a task returns only the likeliest
    pair of each component, so no more pairs than members.

    Long lists are compared in tiles of ``join.block`` members a side. Lists with the same smallest component, which
    for copies of one text are many lists of nearly the same members, meet in one task (or in several, by their
    number of rows), where every pair is looked at once.
    """
    family = lists.groupBy("low").agg(F.expr(f"int(count(*) div {join.family}) + 1").alias("shares"))
    lists = lists.join(family, "low").withColumn("share", F.pmod(F.xxhash64("token"), F.col("shares")).cast("int"))
    blocks = lists.groupBy("token").agg(F.expr(f"int((count(*) - 1) div {join.block}) + 1").alias("blocks"))
    rows = lists.join(blocks, "token").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(classes.select("id", "sketch"), "id")
    rows = rows.select(
        "low", "share", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "token", "block", "id", "size", "part", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        token, block = table.column("token").to_numpy(), table.column("block").to_numpy()
        ids, first, member = np.unique(table.column("id").to_numpy(), return_index=True, return_inverse=True)
        part, size = (table.column(c).to_numpy()[first] for c in ("part", "size"))
        counts = np.frombuffer(b"".join(table.column("sketch").take(pa.array(first)).to_pylist()), np.uint8).reshape(len(ids), -1)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        order = np.argsort(token, kind="stable")
        pairs, more, held = np.zeros(0, np.int64), [], 0
        for rows_of_list in np.split(order, np.flatnonzero(np.diff(token[order])) + 1):
            left, right = (np.sort(member[rows_of_list[block[rows_of_list] == k]]) for k in (i, j))
            for at in range(0, len(left), 64):
                a, b = (x.ravel() for x in np.meshgrid(left[at:at + 64], right, indexing="ij"))
                a, b = np.minimum(a, b), np.maximum(a, b)
                open_ = (part[a] != part[b]) & (
                    100 * np.minimum(size[a], size[b]).astype(np.int64) >= join.percent * np.maximum(size[a], size[b]))
                more.append(a[open_] * len(ids) + b[open_])
                held += len(more[-1])
                if held > 1 << 20:
                    pairs, more, held = np.unique(np.concatenate([pairs, *more])), [], 0
        pairs = np.unique(np.concatenate([pairs, *more]))
        out = [[np.zeros(0, np.int64)] * 4 + [np.zeros(0)]]
        for k in range(0, len(pairs), 4096):
            u, v = np.divmod(pairs[k:k + 4096], len(ids))
            kept, score = can_link(counts[u], counts[v], size[u], size[v], join.percent)
            u, v, score = u[kept], v[kept], score[kept]
            if best:
                kept = best_of(part, u, v, score)
                u, v, score = u[kept], v[kept], score[kept]
            out.append([ids[u], ids[v], part[u], part[v], score])
        names = ("hub", "id", "hub_part", "id_part", "score")
        return pa.table({name: np.concatenate(columns) for name, columns in zip(names, zip(*out, strict=True), strict=True)})

    schema = "hub long, id long, hub_part long, id_part long, score double"
    return rows.groupBy("low", "share", "i", "j").applyInArrow(compare, schema).distinct()


def most_likely(pairs: DataFrame) -> DataFrame:
    """For each component the pair (hub, id) to another one that its sketches rate highest."""
    ends = pairs.select(F.col("hub_part").alias("part"), "hub", "id", "score").union(pairs.select("id_part", "hub", "id", "score"))
    best = ends.groupBy("part").agg(F.max_by(F.struct("hub", "id"), F.struct("score", "hub", "id")).alias("p"))
    return best.select("p.*").distinct()


def unsettled(lists: DataFrame, part: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components of ``part`` (id, component), with their ``part`` and the
    smallest one of the list as ``low``. Components are laid beside the lists by id: one shuffle and no new rows."""
    token = Window.partitionBy("token")
    known = part.select(F.lit(None).cast("long").alias("token"), "id", F.lit(None).cast("int").alias("size"), "component")
    both = lists.select("token", "id", "size", F.lit(None).cast("long").alias("component")).union(known)
    rest = both.withColumn("part", F.coalesce(F.max("component").over(Window.partitionBy("id")), "id")).where("size is not null")
    rest = rest.withColumns({"low": F.min("part").over(token), "high": F.max("part").over(token)}).where("low < high")
    return cut(rest.select("token", "id", "size", "part", "low"))


def linked(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, links being Jaccard similarities of ``percent`` or more.

    Whole texts are compared. A null, empty or blank text has an empty set and links with nothing; a text of fewer
    words than ``n`` is one n-gram; rows with a null id link with nothing and have a null component; repeated rows
    are copies of each other; an empty table gives no rows. N-grams are 63-bit hashes of 64-bit word hashes, sets are
    told apart by 128-bit digests, of which classes are named by 64 bits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    common = spark.sparkContext.broadcast(common_shingles(docs, join))
    known = released(cut(profiles(docs, join, common)))

    by_size = Window.partitionBy("token").orderBy("size", "id")
    size = F.col("n_shingles").cast("int").alias("size")
    shared = known.where("prefix is not null").select(F.explode("prefix").alias("token"), "id", size)
    shared = shared.withColumn("before", F.lag("id").over(by_size))
    shared = shared.where("before is null or before <> id").withColumns({
        "smaller": F.lag("size").over(by_size), "larger": F.lead("size").over(by_size)})
    # Of a list, those members stay that have a neighbour in size with which they may link.
    fits = f"100 * smaller >= {join.percent} * size or 100 * size >= {join.percent} * larger"
    shared = released(cut(shared.where(fits).select("token", "id", "size")))
    mark = shared.groupBy("token").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    chosen = mark.groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token")
    lists = released(cut(shared.join(chosen, "token", "left_semi")))

    classes = known.where("key is not null and doc_id is not null").groupBy("key", "id").agg(
        F.min("doc_id").alias("first"), F.min("n_shingles").cast("int").alias("size"), F.min("sketch").alias("sketch"))
    classes = released(cut(classes.drop("key")))

    token = Window.partitionBy("token")
    hub = lists.withColumn("hub", F.min("id").over(token)).where("id <> hub")
    hub = hub.groupBy("id", "hub").agg(F.count("*").alias("times"))
    best = hub.groupBy("id").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub"))
    pairs = released(cut(possible(best.select("hub", "id"), classes, join)))
    links = verified(stars(pairs, join), docs, classes, join, common)
    part = components(links)

    # Most components are joined by their likeliest pair; only what stays apart after that is compared pair by pair.
    likely = released(cut(most_likely(open_pairs(unsettled(lists, part), classes, join, best=True))))
    links = links.union(verified(stars(likely, join), docs, classes, join, common))
    rest = released(cut(open_pairs(unsettled(lists, components(links)), classes, join, best=False).select("hub", "id").distinct()))
    links = links.union(verified(clusters(rest, join), docs, classes, join, common))
    part = components(links).withColumnRenamed("id", "member")

    joined = classes.join(part, F.col("id") == F.col("member"), "left").select("first", "id", F.coalesce("component", "id").alias("part"))
    named = joined.groupBy("part").agg(F.min("first").alias("component_id")).join(joined, "part").select("id", "component_id")
    rows = known.withColumn("id", F.when(F.col("doc_id").isNotNull(), F.col("id")))
    return rows.join(named, "id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """Rows of ``docs`` of which one per group of similar documents stays, that of the smallest id; of repeated rows
    of one id one stays, and rows with a null id all do."""
    kept = linked(docs, join).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id")
    one = rows.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.select("row.*").union(rows.where("doc_id is null").select("row.*"))
