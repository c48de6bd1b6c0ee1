"""Reading landed files as lines and table payloads.

A landed file is one market's day or one security's month: it is small, and a
load reads very many of them, so files are the unit of parallelism. Reading a
file whole is what makes per-file encodings and header sections possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.functions.calendar import MARKET_LISTED, MARKET_OTC
from equilens.functions.parse import TABLE_PAYLOAD, clean_code, csv_cells, first_csv_cell, table_rows

UTF8_BOM = "EFBBBF"


def has_bom(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 3)) == UTF8_BOM


def sniff_text(content: Column) -> Column:
    """UTF-8 after a byte-order mark, else Big5 (needs ``spark.sql.legacy.javaCharsets``)."""
    utf8 = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    return F.when(has_bom(content), utf8).otherwise(F.decode(content, "Big5"))


def sniff_market(content: Column) -> Column:
    """OTC files carry the byte-order mark, listed ones do not."""
    return F.when(has_bom(content), MARKET_OTC).otherwise(MARKET_LISTED)


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, content`` of every file under ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


def date_in_path(path: Column) -> Column:
    """Last ``yyyymmdd`` or ``yyyy-mm-dd`` in a path that stands on its own and is a date; random file names have neither."""
    found = F.regexp_extract_all(path, F.lit(r"(?<![0-9A-Za-z])(\d{4}-?\d{2}-?\d{2})(?![0-9A-Za-z-])"), 1)
    days = F.transform(found, lambda x: F.try_to_date(F.regexp_replace(x, "-", ""), "yyyyMMdd"))
    return F.element_at(F.concat(F.array(F.lit(None).cast("date")), F.filter(days, lambda d: d.isNotNull())), -1)


def day_of(as_of_date) -> Column:
    """The given date, else the one in the file's path."""
    return date_in_path(F.col("path")) if as_of_date is None else F.lit(as_of_date).cast("date")


def csv_rows(source: DataFrame, text: Column, after: str | None = None) -> DataFrame:
    """One row per CSV line with its ``cells``; ``after`` keeps only lines below that header row."""
    lines = F.split(text, r"\r?\n")
    whole = source.withColumn("_lines", lines).drop("content")
    if after is not None:
        # Only a line that holds the text can begin with it.
        heads = F.transform(F.col("_lines"), lambda x: F.when(F.contains(x, F.lit(after)), clean_code(first_csv_cell(x))))
        whole = whole.withColumn("_at", F.array_position(heads, after).cast("int")).filter(F.col("_at") > 0)
        whole = whole.withColumn("_lines", F.slice("_lines", F.col("_at") + 1, F.size("_lines"))).drop("_at")
    kept = [c for c in whole.columns if c != "_lines"]
    exploded = whole.select(*kept, F.posexplode("_lines").alias("line_no", "_line")).filter(F.trim("_line") != "")
    # A line is taken apart by a generator, through which filters on the cells are not pushed: each would parse it anew.
    return exploded.select(*kept, "line_no", F.explode(F.array(csv_cells(F.col("_line")))).alias("cells"))


def json_rows(source: DataFrame) -> DataFrame:
    """One row per array of a table payload, as ``cells``."""
    kept = [c for c in source.columns if c != "content"]
    # A column of its own, since the payload is looked at several times and parsed once.
    parsed = source.select(*kept, F.from_json(F.decode("content", "UTF-8"), TABLE_PAYLOAD).alias("_payload"))
    return parsed.select(*kept, F.posexplode(table_rows(F.col("_payload"))).alias("line_no", "cells"))


def cell(i: int) -> Column:
    return F.get(F.col("cells"), F.lit(i))
