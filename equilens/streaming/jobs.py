"""Structured Streaming versions of the recurring loads.

Each job reads what has arrived, then stops (``availableNow``); a scheduler
may start it as often as it likes. State that must survive is in the
checkpoint folder or in the target table, never only in memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from equilens.functions.windows import KEY, TIME
from equilens.operators.ledger import open_shares
from equilens.sinks.tables import append_news, by_month, check_trades, exists, read_fact, touched_parts, upsert


def arriving(spark: SparkSession, source_dir: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """Files landing in a folder; the schema is declared, never inferred."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(source_dir)


def start_upsert(
    stream: DataFrame, path: str, checkpoint: str, pk: Sequence[str], part: Column, order_col: str | None = None
) -> StreamingQuery:
    """Upsert every micro-batch; running a batch again gives the same table, late files are just later batches."""

    def apply(batch: DataFrame, _: int) -> None:
        upsert(batch.sparkSession, path, batch, pk, part=part, order_col=order_col)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()


def bars_from_events(
    events: DataFrame, width: str = "7 days", late: str = "1 day", key: str = "event_type", time_col: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Open, high, low, close, sum and count per key and time window of a live feed.

    Works on a batch frame too. Rows later than the watermark are dropped.
    """
    marked = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    at = F.struct(time_col, value)
    return marked.groupBy(F.window(time_col, width).alias("_w"), F.col(key)).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, at).alias("close"), F.sum(value).alias("volume"), F.count(F.lit(1)).alias("trades"),
    ).select(key, F.col("_w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "trades")


def start_bars(events: DataFrame, path: str, checkpoint: str, **shape) -> StreamingQuery:
    """Write finished windows; a window is finished once the watermark has passed it."""
    return bars_from_events(events, **shape).writeStream.outputMode("append").format("parquet").option(
        "path", path
    ).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_news_dedupe(news: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the first item of each (stock_id, url), undated and late ones too.

    Every micro-batch is held against the stored keys, as the batch load does,
    so nothing is forgotten after a while and a repeated batch adds nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        append_news(batch.sparkSession, path, batch, F.coalesce(F.unix_micros("published_at"), F.lit(1 << 62)))

    return news.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()


def start_ledger(
    trades: DataFrame, log_path: str, days_path: str, checkpoint: str, stock: DataFrame, rejects_path: str | None = None,
) -> StreamingQuery:
    """Keep the trade log and its day sums up to date.

    Valid trades are upserted by id, then the sums of the touched days are
    rebuilt from the log, so a repeated batch changes nothing. Open positions
    follow from the day sums (``current_positions``); nothing is kept per
    security in a task, however much of the log one security holds. Only the
    months of the batch are read. Rejected trades go to ``rejects_path``
    (beside the log by default) with their reason, one folder per batch, so a
    repeated batch replaces its own.
    """
    rejects = rejects_path or f"{log_path.rstrip('/')}_rejected"

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            keep(batch, number)
        finally:
            batch.unpersist()

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        accepted, rejected = check_trades(batch, stock)
        rejected.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        upsert(spark, log_path, accepted, (KEY, TIME, "id"), part=by_month())
        touched = accepted.select(KEY, TIME).distinct()
        if not exists(spark, log_path):
            return
        log = touched_parts(spark.read.parquet(log_path), accepted, by_month())
        side = F.col("shares").cast("decimal(18,6)")
        sums = log.join(touched, [KEY, TIME], "left_semi").groupBy(KEY, TIME).agg(
            F.coalesce(F.sum(F.when(F.col("action") == "buy", side)), F.lit(0).cast("decimal(28,6)")).alias("bought"),
            F.coalesce(F.sum(F.when(F.col("action") == "sell", side)), F.lit(0).cast("decimal(28,6)")).alias("sold"),
        )
        upsert(spark, days_path, sums, (KEY, TIME), part=by_month())

    return trades.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()


def current_positions(spark: SparkSession, days_path: str) -> DataFrame:
    """Open shares per security from the day sums the stream maintains."""
    return open_shares(read_fact(spark, days_path))

