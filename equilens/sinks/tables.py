"""Keyed tables on plain parquet: partition overwrite for facts, versions for small tables.

A fact table is partitioned by a value computed from its rows, and an upsert
rewrites only the partitions its updates touch. A small table (master, screen,
snapshot) is written whole into a new version folder; readers take the newest
version that finished, so a lost job leaves the previous one in place.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.functions.windows import KEY, PART, TIME, Part
from equilens.operators.relational import keep_last, one_version, overlay


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and bool(fs.listStatus(p))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


# -- facts ------------------------------------------------------------------

def by_year(col: str = TIME) -> Part:
    return Part("year", col)


def by_month(col: str = TIME) -> Part:
    return Part("month", col)


def _value(part: Part | Column) -> Column:
    return part.value if isinstance(part, Part) else part


def _noted(spark: SparkSession, path: str) -> Part | None:
    """How the stored table is partitioned, from the note beside its folders; None for other partitions than dates."""
    fs, note = _fs(spark, f"{path}/_partition.json")
    if not fs.exists(note):
        return None
    stream = fs.open(note)
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Part(said["unit"], said["of"])


def _note(spark: SparkSession, path: str, part: Part) -> None:
    fs, note = _fs(spark, f"{path}/_partition.json")
    if not fs.exists(note):
        out = fs.create(note, True)
        out.write(bytearray(json.dumps({"unit": part.unit, "of": part.of}).encode()))
        out.close()


def write_fact(df: DataFrame, path: str, part: Part | Column, sort: Sequence[str] = (KEY, TIME), mode: str = "overwrite"):
    """Write partitioned by ``part``, rows sorted inside files.

    Rebalancing gathers a partition's rows into files of the advisory size:
    small ones are merged, and one that is large, or held by one security, is
    split over tasks. A table keeps the partition it was first written with.
    """
    noted = _noted(df.sparkSession, path)
    if noted and noted != part:
        raise ValueError(f"{path} is partitioned by {noted}, not by {part}")
    out = df.withColumn(PART, _value(part)).hint("rebalance", PART)
    out.sortWithinPartitions(PART, *sort).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(
        PART
    ).parquet(path)
    if isinstance(part, Part):
        _note(df.sparkSession, path, part)


def read_fact(spark: SparkSession, path: str, partitioned: bool = False) -> DataFrame:
    """A stored fact; ``partitioned`` keeps the partition column, by which plans over recent days leave old ones closed."""
    table = spark.read.parquet(path)
    if not partitioned:
        return table.drop(PART)
    noted = _noted(spark, path)
    return noted.marked(table) if noted else table


def upsert(
    spark: SparkSession, path: str, updates: DataFrame, pk: Sequence[str], *, part: Part | Column | None = None,
    order_col: str | None = None,
) -> None:
    """Insert or replace by key; of several updates of a key the greatest ``order_col`` wins.

    Without ``order_col`` different updates of one key are an error. Rows that
    are nothing but their key are inserted where they are new. Only the
    partitions that the updates touch are read and rewritten: their values, one
    per month, are looked up first and become a filter on the folders. A stored
    table keeps its partition, a new one gets months. A partition comes from a
    date in the key, so a key never moves between partitions.
    """
    if part is None:
        part = _noted(spark, path) or by_month(pk[-1] if pk[-1] != KEY else TIME)
    columns = [c for c in updates.columns if c != order_col]
    if set(columns) == set(pk):
        insert_only(spark, path, updates.select(*columns), pk, part=part)
        return
    once = keep_last(updates, pk, order_col, keep=columns) if order_col else one_version(updates, pk)
    if not exists(spark, path):
        write_fact(once, path, part, pk)
        return
    affected = touched_parts(spark.read.parquet(path), updates, part).select(*columns)
    write_fact(overlay(affected, once, pk), path, part, pk)


def touched_parts(stored: DataFrame, rows: DataFrame, part: Part | Column) -> DataFrame:
    """The partitions of ``stored`` that ``rows`` fall into; their values are literals, so other folders stay closed."""
    kind = stored.schema[PART].dataType
    values = [r[0] for r in rows.select(_value(part).cast(kind).alias(PART)).distinct().collect()]
    return stored.filter(F.col(PART).isin(values) if values else F.lit(False))


def insert_only(spark: SparkSession, path: str, rows: DataFrame, pk: Sequence[str], *, part: Part | Column) -> None:
    """Insert keys that are not stored yet; for tables that have nothing but their key."""
    new = rows.dropDuplicates(list(pk))
    if exists(spark, path):
        new = new.join(touched_parts(spark.read.parquet(path), rows, part).select(*pk), list(pk), "left_anti")
    write_fact(new, path, part, pk, mode="append")


def merge_day_into_month(spark: SparkSession, path: str, day: DataFrame, order_col: str | None = None) -> None:
    """Add or replace one day's bars in the month partitions."""
    upsert(spark, path, day, (KEY, TIME), part=by_month(), order_col=order_col)


def merge_index(spark: SparkSession, path: str, month: DataFrame) -> None:
    """Add or replace index closes."""
    upsert(spark, path, month, ("index_id", TIME), part=by_year())


def incremental(df: DataFrame, since, date_col: str | None, key: str = KEY) -> DataFrame:
    """Rows on or after ``since``; tables without a date only lose blank keys."""
    named = df.filter(F.coalesce(F.col(key), F.lit("")) != "")
    return named if since is None or date_col is None else named.filter(F.col(date_col) >= F.lit(since))


# -- small tables -----------------------------------------------------------

def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    done = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(marker):
            done.append(int(name.split("=")[1]))
    return sorted(done)


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """Newest finished version, or None."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None


def write_version(df: DataFrame, path: str) -> int:
    """Write a new version and return its number; it counts once the job has committed."""
    found = _versions(df.sparkSession, path)
    number = found[-1] + 1 if found else 1
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def refresh_snapshot(snapshot: DataFrame, path: str) -> int:
    """Store a rebuilt snapshot as the newest version."""
    return write_version(snapshot, path)


def upsert_small(spark: SparkSession, path: str, updates: DataFrame, pk: Sequence[str], order_col=None) -> int:
    stored = read_version(spark, path)
    if stored is None:
        columns = [c for c in updates.columns if c != order_col]
        fresh = keep_last(updates, pk, order_col).select(*columns) if order_col else one_version(updates, pk)
        return write_version(fresh, path)
    return write_version(overlay(stored, updates if order_col else one_version(updates, pk), pk, order_col), path)


def replace_keys(spark: SparkSession, path: str, df: DataFrame, key: str = KEY) -> int:
    """Drop all stored rows of the keys in ``df`` and insert ``df``."""
    stored = read_version(spark, path)
    kept = df if stored is None else stored.join(df.select(key).distinct(), key, "left_anti").select(*df.columns).unionByName(df)
    return write_version(kept, path)


# -- trade log --------------------------------------------------------------

def check_trades(trades: DataFrame, stock: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a ``reason``); the action is trimmed and lower-cased."""
    shaped = trades.withColumns({KEY: F.trim(KEY), "action": F.lower(F.trim("action"))})
    known = shaped.join(stock.select(KEY, F.lit(True).alias("_known")), KEY, "left")
    reason = (
        F.when(~F.coalesce(F.col("action").isin("buy", "sell"), F.lit(False)), "action")
        .when(F.col("_known").isNull(), "unknown security")
        .when(~F.coalesce(F.col("shares") > 0, F.lit(False)), "shares")
        .when(~F.coalesce(F.col("price") >= 0, F.lit(False)), "price")
    )
    judged = known.withColumn("reason", reason)
    accepted = judged.filter(F.col("reason").isNull()).select(*trades.columns)
    return accepted, judged.filter(F.col("reason").isNotNull()).select(*trades.columns, "reason")


def append_trades(spark: SparkSession, path: str, trades: DataFrame, stock: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append the valid trades to the log; returns (accepted, rejected)."""
    accepted, rejected = check_trades(trades, stock)
    write_fact(accepted, path, by_month(), (KEY, TIME, "id"), mode="append")
    return accepted, rejected


def delete_trades(spark: SparkSession, path: str, ids: Sequence[int] | DataFrame) -> None:
    """Remove trades by id, given as a list or as a frame with ``id``; only the months that hold one are rewritten."""
    stored = spark.read.parquet(path)
    gone = ids.select("id").distinct() if isinstance(ids, DataFrame) else spark.createDataFrame([(int(i),) for i in ids], "id long")
    # One row per month that loses a trade: how many rows it has and loses.
    months = stored.select("part", "id").join(gone.withColumn("_gone", F.lit(1)), "id", "left").groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.count("_gone").alias("lost")).filter("lost > 0").collect()
    kept = stored.filter(F.col("part").isin([r["part"] for r in months]) if months else F.lit(False)).join(gone, "id", "left_anti")
    write_fact(kept.select(*[c for c in stored.columns if c != "part"]), path, by_month(), (KEY, TIME, "id"))
    for value in [r["part"] for r in months if r["n"] == r["lost"]]:
        remove(spark, f"{path}/part={value}")


# -- other outputs ----------------------------------------------------------

def archive_raw(files: DataFrame, path: str, ingest_date, source: str) -> None:
    """Keep payloads as landed, per day and source; a day without files leaves nothing."""
    stamped = files.withColumns({"ingest_date": F.lit(ingest_date).cast("date"), "source": F.lit(source)})
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "ingest_date", "source"
    ).parquet(path)


ADJUSTED = (
    KEY, TIME, "open", "high", "low", "close", "volume", "amount", "adj_open", "adj_high", "adj_low", "adj_close",
    "adj_factor",
)


def write_adjusted(df: DataFrame, path: str) -> None:
    """Adjusted bars by year, sorted by security inside files."""
    write_fact(df.select(*ADJUSTED), path, by_year())


def write_nav_snapshot(df: DataFrame, path: str) -> None:
    """Fund values as CSV, one folder per data day."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(TIME).csv(path, header=True)


def by_url(buckets: int = 64) -> Column:
    """Partition of a news item, a hash of its key: items without a date have one too, and it never changes."""
    return F.pmod(F.xxhash64("stock_id", "url"), F.lit(buckets)).cast("int")


def append_news(spark: SparkSession, path: str, incoming: DataFrame, order_col: str | Column) -> list[int]:
    """Append items whose url is new for their security, of several the first by ``order_col``.

    A filter of stored keys beside the table tells which folders may hold a repeated one; only their key columns are
    read. Returns the folders that were.
    """
    from equilens.sinks.keyfilter import append_once

    order = F.col(order_col) if isinstance(order_col, str) else order_col
    return append_once(spark, path, incoming, ("stock_id", "url"), by_url(), order)


def dry_run_profile(df: DataFrame) -> DataFrame:
    """Row count and one sample row (as JSON), nothing written."""
    sample = F.to_json(F.struct(*df.columns))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(sample).alias("sample"))


def write_codes(df: DataFrame, path: str, key: str = KEY) -> None:
    df.select(F.col(key).cast("string")).write.mode("overwrite").text(path)


# Export columns, headings and formats.
EXPORT = (
    ("stock_id", "代碼", ""), ("name", "名稱", ""), ("industry", "產業", ""), ("security_type", "類別", ""),
    ("rs_rating", "RS評等", ""), ("ret_3m", "近3月%", "pct"), ("ret_12_1", "12-1動能%", "pct"), ("roe", "ROE", ""),
    ("per", "PER", ""), ("dividend_yield", "殖利率%", ""), ("rev_yoy", "營收YoY%", ""),
    ("inst_net_20d", "法人20日(股)", ""), ("big1000_pct", "千張大戶%", ""), ("vpa_accum_20d", "承接", ""),
    ("vpa_distrib_20d", "出貨", ""), ("above_ma60", "站季線", "bool"), ("trend_template", "趨勢範本", "bool"),
    ("vcp", "VCP", "bool"), ("mf_accumulate", "主力承接", "bool"), ("mf_distribute", "主力出貨", "bool"),
    ("close", "收盤", ""), ("last_patterns", "K棒型態", "list"),
)


def export_screen(df: DataFrame) -> DataFrame:
    """Screen rows as the 22 text columns of the export."""

    def text(col: str, fmt: str) -> Column:
        if fmt == "pct":
            value = F.round(F.col(col) * 100, 2).cast("decimal(20,2)").cast("string")
        elif fmt == "bool":
            value = F.when(F.col(col), "是")
        elif fmt == "list":
            value = F.array_join(F.transform(F.col(col), lambda p: p["name"]), "、")
        else:
            value = F.col(col).cast("string")
        return F.coalesce(value, F.lit(""))

    return df.select(*[text(c, fmt).alias(heading) for c, heading, fmt in EXPORT])


def write_export(df: DataFrame, path: str) -> None:
    """Screen rows as one quoted CSV file with a byte-order mark; the caller's limit bounds them."""
    shaped = export_screen(df)
    first = shaped.columns[0]
    shaped.withColumnRenamed(first, "﻿" + first).coalesce(1).write.mode("overwrite").option(
        "emptyValue", ""
    ).csv(path, header=True)
