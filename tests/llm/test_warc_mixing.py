import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from equilens.llm import mixing, warc
from equilens.llm.queries import op1_warc

PAGES = "page_id long, url string, html string, size int, payload string"
LONG = "<p>" + "wörd " * 40_000


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES)


def test_round_trip_marks_copies_and_keeps_odd_rows(spark):
    big, small = "<html>" + "a" * 200, "tiny"
    rows = [(5, "http://a/\r\nb", big), (3, None, big), (9, "u", big), (4, "u", small), (6, "u", small), (7, None, None), (8, "u", ""),
            (None, "u", big), (10, "u", LONG), (11, "u", "é\x00😀" * 60)]
    got = {r.record_id: r for r in warc.round_trip(pages(spark, rows).repartition(3)).collect()}
    assert len(got) == len(rows) and all(r.error is None for r in got.values())
    kind = {k.strip("<>").removeprefix("urn:page:"): (r.warc_type, r.refers_to) for k, r in got.items()}
    assert kind["3"] == ("response", None)
    assert {kind[k] for k in ("5", "9", "")} == {("revisit", "<urn:page:3>")}
    assert all(kind[k][0] == "response" for k in ("4", "6", "7", "8", "10", "11"))
    for page_id, _, html in rows:
        r = got[f"<urn:page:{'' if page_id is None else page_id}>"]
        raw = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert got["<urn:page:5>"].target_uri == "http://a/%0D%0Ab"


def test_empty_table_and_repeated_rows(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
    twice = pages(spark, [(1, "u", "x" * 200)] * 2)
    assert [r.warc_type for r in warc.round_trip(twice).collect()] == ["response"] * 2


def archive(*records, dictionary=b""):
    out = []
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    if dictionary:
        out.append(struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary)
    return b"".join(out + [packer.compress(r) for r in records])


def record(i=1, block=b"abc"):
    return warc.record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:x:{i}>"), ("WARC-Date", "2024-01-01T00:00:00Z")], block)


def test_frames_with_plain_and_packed_dictionary_and_skippable_frames():
    samples = [record(i, b"some block of text %d " % i * 9) for i in range(300)]
    raw = warc.trained(samples, 4096)
    assert raw
    plain = archive(*samples[:5], dictionary=raw)
    packed = zstandard.ZstdCompressor().compress(raw)
    body = archive(*samples[:5], dictionary=raw)[8 + len(raw):]
    for data in (plain, struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + warc.EMPTY_FRAME + body + warc.EMPTY_FRAME):
        assert [f for _, f in warc.frames(memoryview(data))] == samples[:5]


def test_damage_is_named():
    good = archive(record(1), record(2))
    for data, text in ((good[:-5], "cut short"), (good + b"xyz", "after the last frame"), (good + b"x" * 20, "no frame begins"),
                       (struct.pack("<II", warc.DICTIONARY_MAGIC, 99), "dictionary frame")):
        last = list(warc.frames(memoryview(data)))[-1][1]
        assert isinstance(last, warc.Damaged) and text in str(last)
    base = record(1)
    for bad in (base.replace(b"WARC/1.1", b"WARC/9"), base.replace(b"Content-Length: 3", b"Content-Length: 4"),
                base.replace(b"WARC-Date: 2024-01-01T00:00:00Z\r\n", b""), base.replace(b"WARC-Type: ", b"WARC-Type "), base[:-4]):
        with pytest.raises(warc.Damaged):
            warc.parsed(bad)
    assert warc.parsed(base)["payload"] == b"abc"
    digest = base.replace(b"Content-Length", b"WARC-Block-Digest: sha256:00\r\nContent-Length")
    with pytest.raises(warc.Damaged, match="differs"):
        warc.parsed(digest)


def test_op1_equals_brute_force(spark, tmp_path):
    rows = [(i, f"u{i}", "page %d " % (i % 3) * 30) for i in range(20)] + [(30, None, None)]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.record_type, r.refers_to) for r in op1_warc(spark, str(tmp_path)).collect()}
    want = {i: ("response", None) if i < 3 else ("revisit", i % 3) for i in range(20)} | {30: ("response", None)}
    assert got == want


DOCS = "doc_id long, text string, lang string, source string, rank int, size string, taken int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 7, "x", 1) for i, t, s in rows], DOCS)


def levels(sizes: dict, share=1.5, cap=2, weights=(5, 2, 1)):
    """Targets by resharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, fixed, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        target |= {s: left * weight[s] / total for s in free}
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            fixed.add(s)


def test_mix_meets_targets_and_caps(spark):
    rows = [(i, "w " * (i % 97), ["a", "b", "c", "d", None, ""][i * i % 7 % 6]) for i in range(3000)]
    rows += [(5000, None, "a"), (5001, " \n\t", "b"), (5002, "word " * 30_000, "c"), (None, "x y", "d"), (7, "w w w", "a"), (7, "w w w", "a")]
    got = mixing.taken(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = levels(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 0.02 * want[s] + 5
    again = mixing.taken(docs(spark, rows).repartition(5))
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))


def test_mix_of_few_words_and_of_none(spark):
    assert mixing.taken(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.taken(docs(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]
    one = mixing.taken(docs(spark, [(1, "a b c d e f g h", "s")])).first()
    assert (one.size, one.source_size, one.target) == (8, 8, 12.0) and one.taken == 12


def test_blocks_hold_the_words_of_the_mix(spark):
    rows = [(i, " ".join(f"s{i % 2}w{i}x{k}" for k in range(40)), f"s{i % 2}") for i in range(60)]
    mix = mixing.Mix(block_words=16, min_blocks=8, shard_slots=64)
    blocks = mixing.mixed_blocks(docs(spark, rows), mix).collect()
    assert all(len(b.words) <= 16 and all(w.startswith(b.source) for w in b.words) for b in blocks)
    by_word = {}
    for b in blocks:
        for w in b.words:
            by_word[w] = by_word.get(w, 0) + 1
    taken = {r.doc_id: r.taken for r in mixing.taken(docs(spark, rows), mix).collect()}
    assert max(by_word.values()) <= 2
    assert sum(taken.values()) == sum(by_word.values())
    assert taken[3] == sum(n for w, n in by_word.items() if w.startswith("s1w3x"))
    assert len({b.shard for b in blocks}) == -(-len(blocks) // 64)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100, 257):
        p = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p"))
        assert sorted(r.p for r in p.collect()) == list(range(n))


def test_resampled_keeps_columns(spark):
    rows = [(i, "w " * 50, ["a", "b"][i % 2]) for i in range(400)] + [(900, None, "a")]
    out = mixing.resampled(docs(spark, rows))
    assert out.columns == docs(spark, []).columns
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(400, abs=30) and n["b"] == pytest.approx(200, abs=30)
