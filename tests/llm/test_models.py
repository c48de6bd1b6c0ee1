import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.llm import langid, quality, toxicity
from equilens.llm.common import components, fold, label_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    words = {"en": "the of and stone water light river over under house".split(), "xx": "blo kri zuf tram pol dest vik omu ars".split()}
    docs, labels = [], []
    for i in range(n):
        lang = "en" if i % 2 else "xx"
        text = [rng.choice(words[lang]) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randint(20, 120))]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["vilest", "wretchq", "scumbag"]) + rng.choice(["", "er", "o"])
        body = " ".join(text)
        if bad:
            body = " ".join(w.upper() + "$$$ ###" for w in text)
        docs.append((i, body, lang))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame([(i, t, g, "s", 1, 0.5, "r") for i, t, g in docs], DOCS), spark.createDataFrame(labels, LABELS))


ODD = [(10_001, None, None), (10_002, "", "en"), (10_003, " \n\t ", "en"), (None, "the stone", "en"), (10_004, "the water " * 40_000, "en"),
       (10_005, "123 $$$ ...", "en"), (10_006, "éßж 😀", None)]


@pytest.mark.parametrize(("score", "label", "threshold"), [(toxicity.toxicity, 2, 0.5), (quality.quality, 1, 0.3)])
def test_classifier_on_held_out_rows(spark, score, label, threshold):
    docs, labels = corpus()
    noise = [(None, 1, 1), (3, None, None), (999_999, 1, 0), labels[4]]
    d, y = frames(spark, docs + ODD + docs[:1], labels + noise)
    got = score(d, y).collect()
    assert len(got) == len(docs) + len(ODD) + 1
    truth = {r[0]: r[label] for r in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    again = {r.doc_id: r.score for r in score(d.repartition(7), y).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


@pytest.mark.parametrize("op", [toxicity.toxicity, quality.quality])
def test_classifier_without_labels_or_rows(spark, op):
    docs, labels = corpus(n=30)
    d, none = frames(spark, docs, [])
    assert {r.score for r in op(d, none).collect()} == {0.5}
    one_class = spark.createDataFrame([(i, 1, 1) for i in range(30)], LABELS)
    assert all(0 <= r.score <= 1 for r in op(d, one_class).collect())
    empty, y = frames(spark, [], labels)
    assert op(empty, y).count() == 0


def test_held_out_labels_never_matter(spark):
    docs, labels = corpus(n=150)
    other = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    for op in (toxicity.toxicity, quality.quality):
        a, b = ({r.doc_id: r.score for r in op(*frames(spark, docs, y)).collect()} for y in (labels, other))
        assert a == b


def test_kneser_ney_chances_are_a_distribution():
    from collections import Counter

    m = toxicity.Models((Counter({"abc": 3, "abd": 1, "b": 2}), Counter({"abc": 1, "zz": 2})), toxicity.Fit())
    letters = [g for g in m.known if len(g) == 1]
    for context in ("", "<<<<", "<<ab", "abcd", "q"):
        for k in (0, 1):
            total = sum(m.chances(context + c)[k] for c in letters)
            assert 0.5 < total <= 1 + 1e-9


def test_discriminant_is_the_density_difference():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (300, quality.N_STATISTICS)), rng.normal(1, 2, (300, quality.N_STATISTICS))]
    y, words = np.r_[np.zeros(300), np.ones(300)], np.full(600, 1e9)
    fit = quality.Fit(pooled=0.0, round=0.0)
    m = quality.Discriminant(x, words, y, 0.5, fit)
    z = m.standard(x, words)
    want = []
    for k in (1, 0):
        mean, cov = z[y == k].mean(0), np.cov(z[y == k].T)
        e = z - mean
        want.append(-0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(cov), e) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(m.difference(z), np.clip(want[0] - want[1], -30, 30) / 10)


def test_automaton_knows_all_substrings():
    rng = random.Random(4)
    texts = [[rng.randint(1, 3) for _ in range(60)] for _ in range(3)]
    table = langid.automaton([c for t in texts for c in [*t, 0]], 4)
    known = {tuple(t[i:j]) for t in texts for i in range(60) for j in range(i + 1, min(60, i + 7) + 1)}

    def follows(s):
        state = 1
        for c in s:
            state = table[state, c]
            if not state:
                return False
        return True

    assert all(follows(s) for s in known)
    for _ in range(3000):
        s = tuple(rng.randint(1, 3) for _ in range(6))
        assert follows(s) == (s in known)
    assert len(table) <= 2 * sum(map(len, texts)) + 2


def test_phrases_equal_a_plain_parse():
    fit = langid.Fit()
    texts = {"a": ["banana bandana and ananas"], "b": ["kiwi wiki kaki taki"]}
    m = langid.Languages(texts, fit)
    probes = ["bananas and kiwis", "q", "taki taki ban" * 90, "xyz kaki", "é wiki é"]
    together = m.entropies(probes)
    for i, probe in enumerate(probes):
        for k, name in enumerate(m.names):
            n, rest = 0, probe
            while rest:
                size = next((j for j in range(len(rest), 0, -1) if rest[:j] in texts[name][0]), 1)
                rest, n = rest[size:], n + 1
            assert together[i, k] == pytest.approx(n * math.log2(len(texts[name][0]) + 1) / len(probe))
        assert m.entropies([probe])[0] == pytest.approx(together[i])


def test_languages_of_short_or_long_texts_only(spark):
    rng = random.Random(3)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    en, fr, ja = "the of and stone water light".split(), "le la et pierre eau lumière".split(), [chr(0x4E00 + i) for i in range(400)]
    rows = [(i, text(en, 50), "en") for i in range(60)] + [(100 + i, text(fr, 1200), "fr") for i in range(60)] + [(200 + i, text(ja, 4), "ja") for i in range(60)]
    got = langid.identified(frames(spark, rows, [(1, 1, 1)])[0]).collect()
    truth = {i: g for i, _, g in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 175


def test_names_that_need_quotes(spark):
    docs, labels = corpus(n=40)
    d, y = frames(spark, docs, labels)
    odd = d.withColumns({"url-hash": F.lit(1), "a b": F.struct(F.lit(2).alias("x-y"))})
    for op in (toxicity.scored, quality.scored):
        got = op(odd, y).select("row.*", "score")
        assert got.columns[-3:] == ["url-hash", "a b", "score"] and got.count() == 40 and got.select("`a b`.`x-y`").first()[0] == 2


def test_sample_takes_one_row_of_an_id(spark):
    docs, labels = corpus(n=60)
    d, y = frames(spark, docs + docs[:5] * 50 + [(1, "z" * 300, "en"), (2, None, "en")], labels)
    sample, share = label_sample(d, y, "toxic", 20, 100)
    got = sample.collect()
    assert len({r.doc_id for r in got}) == len(got) <= 40 and max(len(r.text) for r in got) == 100 and 0 < share < 1


def test_languages_on_held_out_rows(spark):
    docs, _ = corpus()
    d, _ = frames(spark, docs + ODD + docs[:1], [(1, 1, 1)])
    got = langid.identified(d).collect()
    assert len(got) == len(docs) + len(ODD) + 1
    truth = {i: g for i, _, g in docs}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (10_001, 10_002, 10_003, 10_005))
    assert by_id[10_004].lang_pred == "en" and by_id[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identified(d.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identified(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_components_on_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 299), (299, 300), (301, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(40)} | {299: 299, 300: 299, 301: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fold(spark):
    got = spark.createDataFrame([(0,), (123,), (None,)], "i long").select(fold(F.col("i"), 5)).collect()
    assert [r[0] for r in got] == [zlib.crc32(b"0") % 5, zlib.crc32(b"123") % 5, 0]


@pytest.mark.parametrize("op", [toxicity.toxicity, quality.quality])
def test_every_labelled_row_and_the_end_of_its_text_is_learnt_from(spark, op, monkeypatch):
    """What only the end of long texts tells the classes apart by must count, and no row may be left out."""
    import equilens.llm.common as common

    monkeypatch.setattr(common, "label_sample", None)
    assert not {"max_rows", "max_chars"} & set((toxicity.Fit() if op is toxicity.toxicity else quality.Fit()).__dict__)
    same, docs, labels = "stone water light " * 4000, [], []
    for i in range(40):
        docs.append((i, same + ("vilest WRETCHQ scumbag $$$ ### " * 300 if i % 2 else "river house meadow " * 300), "en"))
        labels.append((i, i % 2, i % 2))
    got = op(*frames(spark, docs, labels)).collect()
    one, zero = ([r.score for r in got if r.doc_id % 2 == k] for k in (1, 0))
    assert min(one) > max(zero)


def test_sums_do_not_depend_on_how_rows_are_dealt(spark):
    from equilens.llm.common import exact_sums

    rng = random.Random(7)
    df = spark.createDataFrame([(rng.uniform(-1, 1) * 10 ** rng.randint(0, 6),) for _ in range(500)], "v double")
    sums = [exact_sums(df.repartition(n), lambda b: np.asarray(b.column(0), float)[:, None], 1)[0] for n in (1, 3, 8)]
    assert sums[0] == sums[1] == sums[2] == pytest.approx(sum(r.v for r in df.collect()), abs=1e-4)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_texts_are_measured_before_they_meet_labels(spark, module, monkeypatch):
    """Measures travel to the labels, not texts, when the table of labels is too large to be broadcast."""
    plans, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        module.trained(*frames(spark, *corpus(n=60)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < plans[0].index("SortMergeJoin") < plans[0].index("MapInArrow")


def test_rows_that_are_likely_labelled_are_all_that_are_and_few_others(spark):
    from equilens.llm.common import likely

    rng = random.Random(3)
    ids = rng.sample(range(-10**12, 10**12), 20_000)
    docs = spark.createDataFrame([(i, "t") for i in [*ids, *ids[:50], None]], "doc_id long, text string")
    known = spark.createDataFrame([(i, 1) for i in ids[:5_000]], "_id long, y int")
    for blocks, most in ((1 << 12, 0.1), (1, 0.2)):
        got = [r.doc_id for r in likely(docs, known, most_blocks=blocks).collect()]
        assert set(ids[:5_000]) <= set(got) and len(got) - 5_050 <= most * 15_000 and got.count(ids[0]) == 2
    assert likely(docs, known.limit(0)).count() == 0
    as_text = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert set(map(str, ids[:5_000])) <= {r.doc_id for r in likely(as_text, known).collect()}


@pytest.mark.parametrize(("bits", "blocks"), [(16, 1 << 12), (1, 1)])
def test_labels_reach_every_text_whether_it_is_moved_or_not(spark, bits, blocks):
    """Cells that many ids share leave their texts to the join; nothing is lost, doubled or given another's label."""
    from equilens.llm.common import known_labels, labelled

    rng = random.Random(5)
    ids = rng.sample(range(-10**12, 10**12), 20_000)
    docs = [(i, f"t{i}") for i in ids] + [(ids[0], "again"), (ids[1], None), (None, "t")]
    labels = [(i, 1, rng.choice([0, 1, None])) for i in ids[:9_000]] + [(ids[0], 1, 1), (None, 1, 1), (5, 1, 1)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    known = known_labels(y, "toxic").localCheckpoint()
    want = d.where("text is not null").join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
    got = labelled(d, known, bits, blocks)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 4_000
