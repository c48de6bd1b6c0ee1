"""Retrieval for many questions against brute force."""

import contextlib
import io
import math
import random

from equilens.operators.news import retrieve_many


def distance(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    dot = lambda x, y: sum((p * q for p, q in zip(x, y, strict=True)), 0.0)
    over = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return 1 - dot(a, b) / over if over else None


def test_retrieve_many_in_blocks(spark):
    rng = random.Random(5)
    vector = lambda: [rng.choice([-1.5, -0.5, 0.25, 1.0]) for _ in range(6)]
    vectors = {i: vector() for i in range(90)}
    vectors |= {i: vectors[i % 7] for i in range(90, 130)}
    vectors |= {130: None, 131: [1.0, None, 1.0, 1.0, 1.0, 1.0], 132: [0.0] * 6, 133: [1.0, 2.0], 134: [math.nan] * 6, 135: []}
    stock = {i: None if i % 11 == 0 else f"s{i % 3}" for i in vectors}
    asked = [(i, vectors[i], (None, "s1", "none")[i % 3]) for i in range(0, 136, 2)] + [(500, vector(), "s2"), (None, vector(), None)]
    news = spark.createDataFrame([(i, stock[i], None, f"t{i}") for i in vectors], "news_id long, stock_id string, published_at timestamp, title string")
    embedding = spark.createDataFrame(list(vectors.items()), "news_id long, embedding array<double>")
    questions = spark.createDataFrame(asked, "query_id long, vector array<double>, stock_id string")

    def place(d, i):
        return (2, 0.0, i) if d is None else (1, 0.0, i) if math.isnan(d) else (0, d, i)

    for k in (1, 4, 200):
        want = {}
        for q, v, s in asked:
            found = sorted(place(distance(vectors[i], v), i) for i in vectors if s is None or stock[i] == s)[:k]
            want |= {(q, r): (i, kind, d) for r, (kind, d, i) in enumerate(found, 1)}
        for sizes in ((7, 5), (4096, 1024)):
            out = retrieve_many(news, embedding, questions, k, None, *sizes)
            got = {(r.query_id, r["rank"]): (r.news_id, *place(r.dist, 0)[:2]) for r in out.collect()}
            assert got == want, (k, sizes)
    assert retrieve_many(news, embedding, questions, 0).count() == 0
    assert retrieve_many(news, embedding, questions.limit(0), 3).count() == retrieve_many(news.limit(0), embedding, questions, 3).count() == 0


def test_questions_do_not_travel_as_one_array(spark):
    news = spark.range(50).selectExpr("id as news_id", "'s' as stock_id", "timestamp'2024-01-01' as published_at")
    embedding = spark.range(50).selectExpr("id as news_id", "array(double(id), 1d) as embedding")
    out = retrieve_many(news, embedding, embedding.selectExpr("news_id as query_id", "embedding as vector"), 2)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        out.explain("extended")
    assert "collect_list" not in plan.getvalue() and out.count() == 100
