"""From raw documents to pieces: quality, toxicity, near duplicates, mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.llm import mixing, ngram_join, pieces, quality, toxicity
from equilens.llm.common import shared_folder
from equilens.llm.queries import PIECE_MODEL, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    return quality.scored(docs, table(spark, sf_dir, "labels")).where("score >= 0.3").select("row.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).where("score < 0.5").select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.75 or more, that of the smallest id."""
    return ngram_join.deduplicated(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so that sources come near their target weights."""
    return mixing.resampled(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    """Pieces of every document of the mix, which decode to its text."""
    coded = pieces.encoded(docs, model)
    return coded.select("row.doc_id", "row.lang", "row.source", "piece_ids", F.coalesce(F.size("piece_ids"), F.lit(0)).alias("n_pieces"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing_sources", mixing_sources),
    ("sentencepiece", sentencepiece),
]

# Classifiers are fitted and pieces come from a model file, neither of which SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
