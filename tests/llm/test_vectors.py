import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from equilens.llm import embed_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string, length int, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2, 3) for i, v in rows], SCHEMA)


def near(rng, base, s):
    return [float(np.float32(x + rng.gauss(0, s))) for x in base]


def rows_of(seed=3, n=300, d=8):
    rng = random.Random(seed)
    bases = [[rng.gauss(0, 0.3) for _ in range(d)] for _ in range(12)]
    rows = [(i, near(rng, rng.choice(bases), rng.choice([0.02, 0.08, 0.5]))) for i in range(n)]
    rows += [(n + k, rows[5][1]) for k in range(40)]  # equal vectors
    rows += [(n + 50, [2.0 * x for x in rows[5][1]]), (n + 51, [0.0] * d), (n + 52, None), (n + 53, [float("nan")] * d),
             (n + 54, [float("inf")] + [1.0] * (d - 1)), (n + 55, [None] + [1.0] * (d - 1)), (n + 56, []), (n + 57, [1.0, 0.0]), (n + 58, [1.0, 0.0])]
    return rows


def good(v):
    return v and all(x is not None and np.isfinite(x) for x in v)


def brute_links(rows, least):
    ids = [i for i, _ in rows]
    live = {i: np.array(v, float) for i, v in rows if good(v) and any(v)}
    links = {i: set() for i in ids}
    for a, x in live.items():
        for b, y in live.items():
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a].add(b)
    part = {}
    for i in sorted(ids):
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in part:
                part[j] = i
                stack += links[j]
    return {i: (len(links[i]), part[i], part[i] == i) for i in ids}


@pytest.mark.parametrize("block", [8192, 60])
def test_links_equal_brute_force(spark, block):
    rows = rows_of()
    got = embed_dedup.linked(frame(spark, rows + rows[:3] + [(None, rows[0][1])]), 0.95, block)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == brute_links(rows, 0.95)
    assert embed_dedup.linked(frame(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.5, 0.9, 0.99]))
def test_tile_intervals_hold(seed, least):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 6)) * rng.choice([1e-6, 1, 1e6], (40, 1))
    x[20:] = x[:20] + rng.normal(size=(20, 6)) * np.abs(x[:20]) * 0.1
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cos = u @ u.T
    np.fill_diagonal(cos, -1)
    sure = np.abs(cos - least) > 1e-9
    w = rng.integers(1, 4, 40)
    every = np.arange(40)
    partners, root = embed_dedup.tile_links(x, w, every, every, least, stripe=7)
    if sure.all():
        assert (partners == (cos >= least) @ w).all()
    halves, _ = embed_dedup.tile_links(x, w, every[:20], every[20:], least, stripe=7)
    if sure.all():
        assert (halves[:20] == (cos[:20, 20:] >= least) @ w[20:]).all() and (halves[20:] == (cos[20:, :20] >= least) @ w[:20]).all()
    assert (root <= every).all() and (root[root] == root).all()


def brute_top(rows, every, k):
    live = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v in rows if good(v)}
    out = {}
    for q, x in live.items():
        if q % every == 0:
            found = sorted((-int(x @ y), i) for i, y in live.items() if i != q and len(x) == len(y))[:k]
            out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("blocks", [(32_768, 1024), (50, 3)])
def test_top_k_equals_brute_force(spark, blocks):
    rows = rows_of(d=5)
    got = topk.search(frame(spark, rows + rows[:3] + [(None, rows[0][1])]), every=20, k=20, block_rows=blocks[0], block_queries=blocks[1])
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()} == brute_top(rows, 20, 20)


def test_top_k_of_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 5.0]), (20, [1e6, -1e6])]
    got = topk.search(frame(spark, rows))
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()} == brute_top(rows, 20, 20)
    assert topk.search(frame(spark, [(0, [1.0])])).count() == 0
    assert topk.search(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_slices_add_and_select(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(1, 200)), int(rng.integers(1, 6))
    x = rng.integers(-rng.integers(1, 70), rng.integers(1, 70), (n, d))
    ids = rng.permutation(1000)[:n]
    s = topk.BitSlices(ids, x)
    q = rng.integers(-9, 9, d)
    k = int(rng.integers(1, 25))
    places, score = s.top(q, k, int(ids[0]))
    want = sorted((-int(v @ q), int(i)) for i, v in zip(ids, x, strict=True) if i != ids[0])[:k]
    assert sorted((-int(a), int(s.ids[p])) for p, a in zip(places, score, strict=True)) == want
