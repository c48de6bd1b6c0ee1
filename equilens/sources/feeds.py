"""News feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.functions.parse import parse_rfc822, strip_tags

DEFAULT_SOURCE = "Google News"
_ITEM = "title string, link string, pubDate string, source struct<_VALUE:string,_url:string>, description string"


def read_rss(spark: SparkSession, path: str, stock_id: str | None = None) -> DataFrame:
    """Feed items with a title and a link; the text falls back to the title."""
    items = spark.read.format("xml").option("rowTag", "item").schema(_ITEM).load(path)
    title, link = F.trim("title"), F.trim("link")
    text = F.trim(strip_tags(F.coalesce("description", F.lit(""))))
    return items.filter((F.coalesce(title, F.lit("")) != "") & (F.coalesce(link, F.lit("")) != "")).select(
        F.lit(stock_id).cast("string").alias("stock_id"), title.alias("title"),
        F.when(text == "", title).otherwise(text).alias("content"),
        F.coalesce(F.nullif(F.trim("source._VALUE"), F.lit("")), F.lit(DEFAULT_SOURCE)).alias("source"),
        link.alias("url"), parse_rfc822(F.col("pubDate")).alias("published_at"),
    )
