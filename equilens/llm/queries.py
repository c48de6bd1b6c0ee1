"""The registered queries of this subpackage and the SQL they are compared to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.llm import (
    embed_dedup, exact_dedup, langid, lexical, licenses, mixing, ngram_join, phrases, pieces, quality, topk, toxicity, warc,
)

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    damaged = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("damaged record: "), F.col("error"))))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    return read.withColumn("checked", F.coalesce(damaged.cast("string"), F.lit("ok"))).select(
        F.nullif(page("record_id"), F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        F.when(F.col("checked") == "ok", F.col("warc_type")).alias("record_type"),
        F.nullif(page("refers_to"), F.lit("")).cast("long").alias("refers_to"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * e::DOUBLE) FOR e IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.linked(table(spark, sf_dir, "embeddings"), least=0.95)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    coded = pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    back = pieces.with_text(coded, model)
    return back.select(
        "row.doc_id", "piece_ids", F.coalesce(F.size("piece_ids"), F.lit(0)).alias("n_pieces"),
        F.col("decoded").eqNullSafe(F.col("row.text")).alias("lossless"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), g AS (
  SELECT lang, unnest(flatten([[list_aggregate(words[i:i + k - 1], 'string_agg', ' ') FOR i IN range(1, len(words) - k + 2)]
           FOR k IN [1, 2, 3]])) AS phrase FROM w WHERE len(words) > 0
), f AS (
  SELECT lang, phrase, len(string_split(phrase, ' ')) AS words, count(*)::BIGINT AS f FROM g GROUP BY 1, 2
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY 1
), c AS (
  SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS s FROM f WHERE words > 1 AND f >= 10
), k AS (
  SELECT lang, phrase, a, words, unnest(range(1, words)) AS k, s FROM c
), x AS (
  SELECT k.lang, k.phrase, k.a, k, l.f AS l, r.f AS r,
         ((1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(s[1:k], ' ')
         JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(s[k + 1:], ' ')
), b AS (
  SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS phrase FROM c WHERE words = 3) GROUP BY 1, 2
), o AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
  FROM b JOIN n USING (lang) LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT * FROM o WHERE rank <= 2000
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.marked(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM d WINDOW w AS (PARTITION BY text_sha256)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), s AS (
  SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), p AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf, any_value(n) AS n
  FROM (SELECT doc_id, unnest(terms) AS term, len(terms)::BIGINT AS n FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY 1), s
), f AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY 1, 2
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM f WHERE score > 0 QUALIFY rank <= 10
"""


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_mixing, op3_toxicity, op4_quality, op5_topk, op6_embed_dedup, op7_ngram_join, op8_langid, op9_pieces,
    op10_licenses, op11_phrases, op12_exact_dedup, op13_lexical)}
ORACLE = {
    "op1_warc": OP1_SQL, "op5_topk": OP5_SQL, "op11_phrases": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_lexical": OP13_SQL}
