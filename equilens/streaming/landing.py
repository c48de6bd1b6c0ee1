"""From landed raw files to tables in one stream: the parser is picked per file, and what gives no rows is kept aside."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from equilens.functions.windows import KEY, TIME
from equilens.operators.relational import union_all
from equilens.session import materialize
from equilens.sinks.tables import by_month, upsert
from equilens.sources import market_files as mf
from equilens.sources.landed import date_in_path


@dataclass(frozen=True)
class Route:
    """The table that a kind of file feeds and the parser of such files (path, content, trade_date)."""

    table: str
    rows: Callable[[DataFrame], DataFrame]


ROUTES = {
    "daily_listed": Route("price_daily", lambda found: mf.daily_listed_rows(found).drop("name")),
    "daily_otc": Route("price_daily", mf.daily_otc_rows),
    "inst_listed": Route("inst_trades", mf.inst_listed_rows),
    "inst_otc": Route("inst_trades", mf.inst_otc_rows),
    "margin_listed": Route("margin_trading", mf.margin_listed_rows),
    "margin_otc": Route("margin_trading", mf.margin_otc_rows),
    "foreign_listed": Route("shareholding", mf.foreign_listed_rows),
    "foreign_otc": Route("shareholding", mf.foreign_otc_rows),
    "valuation_listed": Route("valuation_daily", mf.valuation_listed_rows),
    "valuation_otc": Route("valuation_daily", mf.valuation_otc_rows),
}


def kind_of(path: Column, kinds: list[str]) -> Column:
    """The kind that names a file or its folder, the one nearest to the end of the path; null where none does."""
    return F.nullif(F.regexp_extract(path, rf"^(?:.*/)?({'|'.join(kinds)})[/_.\-]", 1), F.lit(""))


def arriving_files(spark: SparkSession, source_dir: str, files_per_trigger: int = 200) -> DataFrame:
    """Raw files as they land, at any depth below a folder; a micro-batch holds the contents of so many files. Files of
    no bytes are skipped by Spark and so are neither loaded nor rejected."""
    schema = "path string not null, modificationTime timestamp not null, length long not null, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", str(files_per_trigger)).load(source_dir)


def _numbered(found: DataFrame) -> DataFrame:
    """Files of a micro-batch (path) with their place among them, the latest last: names only, and so many as
    ``maxFilesPerTrigger`` allows."""
    place = F.row_number().over(Window.orderBy("modificationTime", "path"))
    return F.broadcast(found.select("path", place.alias("arrived")))


def load_files(batch: DataFrame, tables: str, routes: dict[str, Route] = ROUTES) -> DataFrame:
    """Upsert what the files (path, modificationTime, content) hold into the tables below ``tables``, by security and
    day; returns the files that gave no row, with the reason. Of two files with the same row the later one wins.

    ``batch`` is read several times, so it should be persisted. A table's parsed rows are let go once it is written; which
    files they came from is kept, so that no file is parsed twice.
    """
    spark = batch.sparkSession
    found = batch.select("path", "modificationTime", "content").withColumns(
        {"kind": kind_of(F.col("path"), list(routes)), TIME: date_in_path(F.col("path"))})
    kinds = sorted(r.kind for r in found.where(f"kind is not null and {TIME} is not null").select("kind").distinct().collect())
    arrived = _numbered(found)
    by_table: dict[str, list[str]] = {}
    for kind in kinds:
        by_table.setdefault(routes[kind].table, []).append(kind)
    known = [found.select("path").limit(0)]
    for table, of in by_table.items():
        # One number per file of the micro-batch: the parsed rows need not move to meet them.
        rows = union_all(*[
            routes[kind].rows(found.where((F.col("kind") == kind) & F.col(TIME).isNotNull()).select("path", "content", TIME))
            for kind in of]).join(arrived, "path").persist()
        try:
            upsert(spark, f"{tables}/{table}", rows.drop("path"), (KEY, TIME), part=by_month(), order_col="arrived")
            known.append(materialize(rows.select("path").distinct()))
        finally:
            rows.unpersist()
    reason = (
        F.when(F.col("kind").isNull(), "no parser for its name")
        .when(F.col(TIME).isNull(), "no date in its path")
        .otherwise("no row that its parser knows"))
    rejected = found.join(F.broadcast(union_all(*known)), "path", "left_anti")
    return rejected.select("path", "kind", reason.alias("reason"), "modificationTime", "content")


def start_landing(
    files: DataFrame, tables: str, rejected: str, checkpoint: str, routes: dict[str, Route] = ROUTES,
) -> StreamingQuery:
    """Load every micro-batch of ``arriving_files``. A batch that is run again gives the same tables and replaces its own
    folder of rejected files; files of a day may land in any order and in any batches."""

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            load_files(batch, tables, routes).write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        finally:
            batch.unpersist()

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
