import random
import textwrap

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from equilens.llm import licenses, ngram_join, pieces
from equilens.llm.queries import PIECE_MODEL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, token string, size int, row int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "t", 3, 4) for i, t in rows], DOCS)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    links = {i: [] for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links[a].append(b)
                links[b].append(a)
    part = {}
    for i in sorted(sets):
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in part:
                part[j] = i
                stack += links[j]
    return {i: (len(sets[i]), part[i]) for i in sets}


def copies(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(2000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = text(60), []
    for g in range(25):
        base = text(rng.randint(5, 200))
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if g % 4 == 0:
                w = w + passage
            rows.append(" ".join(w))
    rows += ["a b c", "A  B\tc", "a b c d", "", None, " \n ", "É b c", "é b c", " ".join(text(20_000))]
    rows += [rows[0]] * 30
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("join", [ngram_join.Join(), ngram_join.Join(sample=0), ngram_join.Join(group=2, block=3, often=2, buckets=8)])
def test_join_equals_brute_force(spark, join):
    rows = copies()
    got = ngram_join.linked(docs(spark, rows).repartition(5), join).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_join_of_odd_rows(spark):
    text = "one two three four five six seven"
    got = ngram_join.linked(docs(spark, [(None, text), (4, text), (2, text), (2, text), (9, None)]))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or -1) for r in got.collect()) == [
        (False, 2, 3, 2), (False, 2, 3, 2), (False, 4, 3, 2), (False, 9, 0, 9), (True, 0, 3, -1)]
    assert ngram_join.linked(docs(spark, [])).count() == 0
    out = ngram_join.deduplicated(docs(spark, [(None, text), (4, text), (2, text), (2, text), (9, None)]))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "9", "None"] and out.columns == docs(spark, []).columns


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_trie_finds_all_links(seed):
    rng = random.Random(seed)
    base = rng.sample(range(200), 30)
    sets = []
    for _ in range(25):
        s = set(base[: rng.randint(1, 30)]) ^ set(rng.sample(range(200), rng.randint(0, 6)))
        if s:
            sets.append(np.array(sorted(s), np.int64))
    trie, found, want = ngram_join.Trie(75), set(), set()
    for i, s in enumerate(sets):
        found |= {(m, i) for m in trie.links(s, lambda m: False)}
        trie.add(i, s)
        for j in range(i):
            both = len(set(s.tolist()) & set(sets[j].tolist()))
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                want.add((j, i))
    assert found == want


@pytest.fixture(scope="module")
def model():
    with open(PIECE_MODEL, "rb") as f:
        return pieces.Model(f.read())


TEXTS = ["", " ", "  a  b", "▁", "a▁b ▁ c", "\x00mark x", "日本語テキスト 中文", "x" * 500, "a" * 23 + " " + "é" * 60, "\n\n\t tab", "emoji 😀😀 end ",
         "The quick brown fox jumps over the lazy dog. " * 50, "antidisestablishmentarianism" * 9]


def coded(model, texts, **dropout):
    encoder = pieces.Encoder(model, pieces.Dropout(**dropout))
    ids, ends = encoder.encode(texts, np.arange(len(texts), dtype=np.uint64))
    return ids, ends, [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def test_pieces_without_dropout_are_the_library_s(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    _, _, lists = coded(model, TEXTS, rate=0.0)
    assert all(sp.encode(t) == p for t, p in zip(TEXTS, lists, strict=True) if "▁" not in t)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(), max_size=5), st.sampled_from([0.0, 0.1, 0.6, 1.0]), st.integers(0, 5))
def test_pieces_decode_without_loss(model, texts, rate, seed):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, ends, _ = coded(model, texts, rate=rate, seed=seed)
    assert pieces.decoded(model, ids, ends) == texts


def test_dropout_varies_and_repeats(model):
    ids, ends, lists = coded(model, TEXTS, rate=0.3)
    assert coded(model, TEXTS, rate=0.3)[2] == lists
    assert coded(model, TEXTS, rate=0.3, seed=1)[2] != lists
    assert len(lists[11]) > len(coded(model, TEXTS, rate=0.0)[2][11])
    line = len(coded(model, TEXTS[11:12], rate=0.0)[2][0]) // 50
    assert len({tuple(lists[11][k:k + line]) for k in range(0, len(lists[11]), line)}) > 10
    assert all(len(p) == len(t) + 1 for t, p in zip(TEXTS[7:8], coded(model, TEXTS[7:8], rate=1.0)[2], strict=True))


def test_arrays_merge_as_the_heap_does(model):
    encoder = pieces.Encoder(model, pieces.Dropout(rate=0.4))
    units = sorted({u for t in TEXTS for u in model.unit.findall("▁" + t.replace(" ", "▁"))})
    flat, start, count = encoder.pieces(units, np.arange(len(units)), np.full(len(units), 2))
    for k, u in enumerate(units):
        s = model.symbols(u)
        assert pieces.by_heap(model, s, encoder.key(s, 2), 0.4) == flat[start[k]:start[k] + count[k]].tolist()


def test_encoded_rows(spark):
    rows = [*enumerate(TEXTS), (50, None), (51, TEXTS[11]), (None, "a b")]
    got = pieces.with_text(pieces.encoded(docs(spark, rows).repartition(3), PIECE_MODEL), PIECE_MODEL).collect()
    assert len(got) == len(rows) and all(r.decoded == r.row.text for r in got)
    by_id = {r.row.doc_id: r.piece_ids for r in got}
    assert by_id[50] is None and by_id[0] == [] and by_id[51] == by_id[11]
    assert pieces.encoded(docs(spark, []), PIECE_MODEL).count() == 0


MIT = licenses.TEMPLATES[2][1]


def test_licenses_in_texts(spark):
    rows = [
        (1, "Some prose here.\nReleased under the MIT License.\nMore prose follows."), (2, None), (3, ""), (4, "No such thing in here at all."),
        (5, "Header\n" + MIT.replace("copy, modify", "copy, alter") + "\nfooter"), (6, "This permission slip is about a school trip to the river."),
        (7, "word " * 30_000 + "Licensed under CC BY-NC 4.0. " + "word " * 10), (8, "Licensed under the Apache License, Version 2.0."),
        (None, "This work is licensed under the GNU General Public License, version 3."), (8, "Licensed under the Apache License, Version 2.0."),
    ]
    got = licenses.licenses(docs(spark, rows)).collect()
    sure = sorted((str(r.doc_id), r.license, r.n_differences) for r in got if r.confirmed)
    assert sure == [("1", "MIT", 0), ("5", "MIT", 2), ("7", "CC-BY-NC-4.0", 0), ("8", "Apache-2.0", 0), ("8", "Apache-2.0", 0), ("None", "GPL-3.0", 0)]
    text = dict(rows)
    for r in got:
        if r.doc_id is not None and r.confirmed:
            assert text[r.doc_id][r.start:r.end].strip() == text[r.doc_id][r.start:r.end]
    five = next(r for r in got if r.doc_id == 5 and r.confirmed)
    assert sorted(five.differences) == ["+alter", "-modify"] and 0 < five.reduction < 1
    assert licenses.licenses(docs(spark, [])).count() == 0


def notices(text):
    return [(r["license"], text[r["start"]:r["end"]]) for r in licenses.Scanner(licenses.TEMPLATES, licenses.Scan()).scan_text(text) if r["confirmed"]]


def test_one_set_of_each_class_meets_a_group(spark):
    rows = copies()
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [rows[0]] * 20
    join = ngram_join.Join(bits=8)  # a full bitmap: all rows pass it
    table = docs(spark, rows).repartition(5)
    common = spark.sparkContext.broadcast(np.zeros(0, np.int64))
    known = ngram_join.profiles(table, join, common).where("key is not null and doc_id is not null")
    classes = known.groupBy("id").agg(F.min("doc_id").alias("first")).cache()
    groups = classes.select((F.col("id") % 3).alias("hub"), F.lit(0).alias("part"), "id")
    met = ngram_join.with_sets(groups, table, classes, join, common).select("id").collect()
    assert len(met) == len({r.id for r in met}) == classes.count() < len(rows) - 60


def test_join_of_int_ids_equals_that_of_long_ids(spark):
    rows = copies(seed=6)
    want = brute(rows)
    for join in (ngram_join.Join(), ngram_join.Join(bits=8)):
        got = ngram_join.linked(docs(spark, rows).withColumn("doc_id", F.col("doc_id").cast("int")), join).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_several_licenses_in_a_block(spark):
    mit, apache, gpl = "Released under the MIT License", "Licensed under the Apache License, Version 2.0", licenses.TEMPLATES[5][1].rstrip(".")
    assert notices(f"{mit}. {apache}.") == [("MIT", mit), ("Apache-2.0", apache)]
    assert notices(f"{apache} or, at your choice:\n{mit}. {gpl}.") == [("Apache-2.0", apache), ("MIT", mit), ("GPL-3.0", gpl)]
    assert notices(f"{mit}. " * 30) == [("MIT", mit)] * 30
    every = [(name, t) for name, t in licenses.TEMPLATES if len(t) < 80]
    assert [n for n, _ in notices(" ".join(t for _, t in every))] == [name for name, _ in every]
    got = licenses.licenses(docs(spark, [(1, f"Prose. {mit}. {apache}. Prose.")])).where("confirmed").collect()
    assert sorted((r.license, r.n_differences) for r in got) == [("Apache-2.0", 0), ("MIT", 0)]


def test_near_licenses_are_told_apart():
    names = lambda text: [n for n, _ in notices(text)]
    for name, t in licenses.TEMPLATES:
        assert names(f"Some prose stands here.\n{t}\nMore prose.") == [name], t
        assert names("\n".join(f"# {line}" for line in textwrap.wrap(t, 50))) == [name], t
    short = "This work is licensed under the GNU {}General Public License, version {}."
    got = {(k, v): names(short.format(k, v)) for k in ("", "Lesser ", "Affero ", "Library ") for v in ("1", "2", "2.1", "3", "3.0", "3.1", "4")}
    assert {k: v for k, v in got.items() if v} == {
        ("", "2"): ["GPL-2.0"], ("", "3"): ["GPL-3.0"], ("", "3.0"): ["GPL-3.0"], ("Lesser ", "2.1"): ["LGPL-2.1"], ("Lesser ", "3"): ["LGPL-3.0"],
        ("Lesser ", "3.0"): ["LGPL-3.0"], ("Affero ", "3"): ["AGPL-3.0"], ("Affero ", "3.0"): ["AGPL-3.0"], ("Library ", "2"): ["LGPL-2.0"]}
    assert names(licenses.GNU.format("GNU Lesser General Public License", "4")) == names(licenses.GNU.format("GNU Affero General Public License", "2")) == []
    assert names(licenses.GNU.format("GNU Lesser General Public License", "2.1").replace("This program", "This library")) == ["LGPL-2.1"]
    assert names("Licensed under the Apache License, Version 1.0.") == names("Licensed under CC BY 3.0.") == names("Licensed under CC BY-NC 3.0.") == []
    assert names("Licensed under the Apache License v2.0") == ["Apache-2.0"]
    head, one, two = licenses.BSD.split(" Redistributions ")
    one, two = f"Redistributions {one}", f"Redistributions {two}"
    holder = licenses.BSD_NAMES.replace("copyright holder", "Example Company")
    for mark in ("1.", "2.", "3.", "4."), ("(1)", "(2)", "(3)", "(4)"), "****":
        listed = lambda *c, mark=mark: "\n".join([head, *(f"{m} {x}" for m, x in zip(mark, c, strict=False))])
        assert names(listed(one, two)) == ["BSD-2-Clause"] and names(listed(one, two, holder)) == ["BSD-3-Clause"]
        assert names(listed(one, two, licenses.BSD_ADVERTISING, holder)) == ["BSD-4-Clause"]
    assert names(head) == []


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("sto", "wa", "lig", "ri", "ho", "un") for b in ("ne", "ter", "ht", "ver", "use", "der", "ly", "th")]
    rows, labels = [], []
    for i in range(240):
        w = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        toxic, bad = i % 6 == 1, i % 8 == 3
        if toxic:
            for _ in range(5):
                w[rng.randrange(len(w))] = "scumbag"
        t = " ".join(x.upper() + "$$$ ###" if bad else x for x in w)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000 + i, rows[i * 6][1], "en", "s1", 1) for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    good = {i for i, q, t in labels if q}
    clean = {i for i, q, t in labels if q and not t}
    assert len(kept[0] & set(range(240)) ^ good) <= 6
    assert len(kept[1] & set(range(240)) ^ clean) <= 8
    assert not {i for i in kept[2] if i >= 1000} or len(kept[2]) <= len(kept[1])
    first = {}
    for i, t, *_ in sorted(rows):
        first.setdefault(t, i)
    assert kept[2] <= set(first.values()) and kept[3] <= kept[2] and kept[4] == kept[3]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.count() == docs.count() and corpus_pipeline.ORACLE_SQL is None
    model = pieces.Model(open(PIECE_MODEL, "rb").read())
    text = dict((r[0], r[1]) for r in rows)
    for r in docs.collect():
        ids = np.array(r.piece_ids, np.int64)
        assert pieces.decoded(model, ids, np.array([0, len(ids)])) == [text[r.doc_id]]


def test_pieces_of_rows_with_odd_names(spark):
    from equilens.llm.queries import PIECE_MODEL

    rows = spark.createDataFrame([(1, "one two", 3)], "doc_id long, text string, `url-hash` int")
    coded = pieces.encoded(rows, PIECE_MODEL)
    back = pieces.with_text(coded.withColumnRenamed("row", "a row"), PIECE_MODEL)
    assert back.select("`a row`.`url-hash`", "decoded").first() == (3, "one two")
