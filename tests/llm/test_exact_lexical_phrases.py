import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from equilens.llm import exact_dedup, lexical, phrases
from equilens.llm.queries import QUERIES

# Columns that the operators use inside themselves, and names that need quoting.
SCHEMA = ("doc_id long, text string, lang string, source string, row long, digest string, hit string, block int, n string,"
          " rank int, term string, `url-hash` string, _row string, keep string")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 7, "x", "y", 3, "n", 1, "t", "u", "r", "k") for i, t, g in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, term string, w int")


def corpus(n=240, seed=5):
    rng = random.Random(seed)
    vocabulary = [w + x for w in ("la", "Do", "été", "x9", "ß") for x in ("", "n", "Ta", "中")]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]

    def text():
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 60))
        return "".join(w + rng.choice([" ", "  ", "\t", ". ", "\n", ", ", " ", " "]) for w in words)

    rows = [(i, text(), rng.choice(["en", "fr", None, ""])) for i in range(n)]
    rows += [(n, None, "en"), (n + 1, "", "en"), (n + 2, " \t\n", None), (n + 3, ".;!", "fr"), (n + 4, "la Don " * 3000, "en")]
    rows += [(n + 10 + k, "La  don\nlan", "en") for k in range(60)] + [(5, "La don\tlan", "fr")] * 2 + [(None, "la Don été", None), (None, rows[3][1], "en")]
    return rows + rows[:4]


# -- exact duplicates --------------------------------------------------------

def brute_marks(rows):
    groups = defaultdict(list)
    key = lambda t: hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()
    for i, t, _ in rows:
        groups[key(t)].append(i)
    out = []
    for digest, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), k == 0, digest) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bloom", [exact_dedup.Bloom(), exact_dedup.Bloom(bits=1, hashes=1), exact_dedup.Bloom(bits=4000, round_blocks=7)])
def test_marks_equal_brute_force(spark, bloom):
    rows = corpus()
    got = exact_dedup.marked(frame(spark, rows), bloom)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_marks(rows)


def test_filter_lets_unequal_rows_pass(spark):
    rows = frame(spark, [(i, f"text {i // 2 if i < 20 else i}", "en") for i in range(2000)])
    tested = exact_dedup.tested(rows.select("doc_id", exact_dedup.digest_of(rows.text).alias("digest")), exact_dedup.Bloom())
    hits = {r.doc_id for r in tested.where("hit").collect()}
    assert set(range(20)) <= hits and len(hits) < 200


def test_rows_that_stay(spark):
    rows = corpus()
    got = exact_dedup.deduplicated(frame(spark, rows))
    assert got.schema.names == frame(spark, rows).schema.names
    assert sorted(r.text_sha256 for r in exact_dedup.marked(got).collect()) == sorted({m[4] for m in brute_marks(rows)})
    want = sorted((m[0] for m in brute_marks(rows) if m[3]), key=str)
    assert sorted((r.doc_id for r in got.collect()), key=str) == want
    assert exact_dedup.deduplicated(frame(spark, [])).count() == 0 and exact_dedup.marked(frame(spark, [])).count() == 0


def test_one_group_of_all_rows(spark):
    got = exact_dedup.marked(frame(spark, [(i, "same", "en") for i in range(500, 0, -1)]))
    assert {(r.keep_id, r.group_size) for r in got.collect()} == {(1, 500)} and got.where("kept").count() == 1


# -- lexical search ----------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(rows, asked, k):
    docs = [(i, Counter(plain_terms(t))) for i, t, _ in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    count, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    queries = defaultdict(set)
    for i, t in asked:
        queries[i] |= set(plain_terms(t))
    out = []
    for q, terms in queries.items():
        found = []
        for i, c, n in docs:
            m = 10 + 90 * n * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        found.sort()
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:k])]
    return sorted(out, key=str)


ASKED = [(1, "La don"), (2, "été ÉTÉ x9; ta"), (3, None), (4, "..."), (5, "unseen"), (6, "la lan laTa Do Don DoTa ß x9n 中"), (6, "ßn"), (None, "Don")]


@pytest.mark.parametrize("shape", [{}, {"block_postings": 300, "block_terms": 4}, {"k": 3, "block_postings": 100}, {"k": 1000}])
def test_search_equals_brute_force(spark, shape):
    rows = corpus()
    got = lexical.search(frame(spark, rows), items(spark, ASKED), **shape)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(rows, ASKED, shape.get("k", 10))


def test_search_of_nothing(spark):
    some, none = frame(spark, [(1, "la", "en")]), frame(spark, [])
    assert lexical.search(none, items(spark, ASKED)).count() == 0
    assert lexical.search(some, items(spark, [])).count() == 0
    assert lexical.search(frame(spark, [(1, None, "en"), (2, "..", "en")]), items(spark, ASKED)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6))
def test_limited_accumulators_keep_the_best(seed, k):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    n, v = int(rng.integers(1, 40)), int(rng.integers(1, 12))
    names = [f"t{j}" for j in range(v)]
    tfs = [rng.choice([0, 0, 0, 1, 2, 5], v) for _ in range(n)]
    weights = np.sort(rng.integers(0, 50, v))[::-1].astype(np.int64)
    ids = rng.permutation(100)[:n]
    docs = pa.table({
        "doc_id": pa.array(ids, pa.int64()), "m": pa.array(rng.integers(10, 30, n), pa.int64()),
        "terms": [" ".join(names[j] for j in range(v) if t[j]) for t in tfs],
        "tfs": pa.array([[int(x) for x in t if x] for t in tfs], pa.list_(pa.int64()))})
    postings = lexical.Postings(docs, pa.array(names), weights)
    places, scores = postings.top(np.arange(v), k, np.zeros(n, np.int64))
    m = docs["m"].to_pylist()
    want = []
    for d in range(n):
        score = sum(int(weights[j]) * (10**9 * int(tfs[d][j]) // (1000 * int(tfs[d][j]) + 8 * m[d])) for j in range(v) if tfs[d][j])
        if score > 0:
            want.append((-score, int(ids[d])))
    assert [(-int(s), postings.ids[int(p)].as_py()) for p, s in zip(places, scores)] == sorted(want)[:k]


# -- phrases -----------------------------------------------------------------

def brute_phrases(rows, longest, least, top, contained):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for j in range(i + 1, min(len(words), i + longest) + 1):
                    f[lang][tuple(words[i:j])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * a >= contained * counts[p[i:i + size]]:
                        dropped.add(p[i:i + size])
        rows_of = []
        for p, a in found.items():
            if p not in dropped:
                score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows_of.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        rows_of.sort()
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(rows_of[:top])]
    return sorted(out)


@pytest.mark.parametrize("shape", [
    {}, {"longest": 4, "least": 3, "most_entries": 50, "burst": 3, "part_chars": 500, "span": 100},
    {"longest": 2, "least": 2, "top": 5}, {"longest": 3, "least": 2, "most_entries": 200, "burst": 2, "contained": 80},
])
def test_phrases_equal_brute_force(spark, shape):
    rows = corpus()
    got = phrases.collocations(frame(spark, rows), **shape)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, **{"longest": 3, "least": 10, "top": 2000, "contained": 50} | {k: v for k, v in shape.items() if k in ("longest", "least", "top")} | ({"contained": 80} if "contained" in shape else {}))
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_phrases_of_nothing(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "", "en"), (3, "one", "en")])).count() == 0


def test_a_piece_of_more_words_than_ids(spark):
    # Six words leave 10 bits for an id, so parts of 512 words must not lose the phrases across their borders.
    text = " ".join(f"w{i % 1500} x" for i in range(4500))
    rows = [(1, text, "en")]
    got = phrases.collocations(frame(spark, rows), longest=6, least=3, span=50)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 6, 3, 2000, 50)


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**9
    counts = spark.createDataFrame([("en", 0, None, 5 * big), ("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)], phrases.COUNTED)
    row = phrases.scored(counts, 2000, 50).first()
    assert row.score == 10**6 * (big - 1) ** 2 // (big * (big + 1)) and (row.a, row.l, row.r, row.n) == (big - 1, big, big + 1, 5 * big)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 4), st.integers(1, 9))
def test_trie_counts_whatever_it_spills(seed, length, burst):
    rng = np.random.default_rng(seed)
    bits = 63 // length
    trie, want, got = phrases.HatTrie(length * bits, burst), Counter(), Counter()
    for _ in range(6):
        ids = rng.choice([0, 1, 1, 2, 3, 4, 900], int(rng.integers(0, 60)))
        keys, counts = phrases.windows(ids, length, bits, len(ids))
        trie.add(keys, counts)
        for k, n in zip(keys.tolist(), counts.tolist()):
            want[k] += n
        if rng.random() < 0.4:
            keep = int(rng.integers(0, 20))
            keys, counts = trie.taken(keep)
            assert len(set(keys.tolist())) == len(keys) and trie.entries <= keep
            got.update(dict(zip(keys.tolist(), counts.tolist())))
    keys, counts = trie.taken(0)
    got.update(dict(zip(keys.tolist(), counts.tolist())))
    assert got == want and trie.entries == 0 and not trie.root


def test_registered():
    assert {"op11_phrases", "op12_exact_dedup", "op13_lexical"} <= set(QUERIES)
