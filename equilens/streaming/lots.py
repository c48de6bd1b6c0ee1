"""First-in-first-out matching of a live trade feed; the open lots are the only state.

Per security the lots stand in a map under running numbers, with the numbers of the oldest and the next one beside it,
so a sell reads and removes the lots that it uses and no others. What a security trades in one micro-batch is ordered
in one task, as first-in-first-out demands; ``maxFilesPerTrigger`` on the source bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from equilens.functions.windows import KEY
from equilens.operators.ledger import SHARES, priced
from equilens.sinks.tables import check_trades

LOT = f"id long, trade_date date, price double, fee double, q {SHARES}, open {SHARES}"
OUT = (
    f"kind string, stock_id string, buy_id long, sell_id long, qty {SHARES}, buy_date date, buy_price double,"
    f" sell_date date, sell_price double, b_q {SHARES}, b_cost double, s_q {SHARES}, s_cost double,"
    " id long, action string, trade_date date, price double, fee double, tax double"
)
FIELDS = [part.split()[0] for part in OUT.split(", ")]
OUT_ROW = Row(*FIELDS)


def row(**values) -> Row:
    """A row of the output; what is not given is null."""
    return OUT_ROW(*map(values.get, FIELDS))


class OpenLots(StatefulProcessor):
    """Matches (``kind`` match) and trades that come before one already processed (``kind`` late), which change nothing.

    The order is that of the batch form: day, buys before sells, id. A trade that arrives twice is late the second
    time. Shares sold with nothing held are dropped.

    Every state call is a round trip to the store, so lots bought in a micro-batch stay in the task until it ends, a
    stored lot is read when a sell first reaches it, and only lots that are still open are written.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "oldest long, next long, trade_date date, side int, id long")
        self.lots = handle.getMapState("lots", "at long", LOT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        ends = self.ends.get() if self.ends.exists() else None
        oldest, upcoming, done = (ends[0], ends[1], (ends[2], ends[3], ends[4])) if ends else (0, 0, None)
        first, stored = oldest, upcoming  # lots from ``first`` up to ``stored`` are in the store
        bought: dict[int, tuple] = {}
        head, left_of_head = None, None  # the oldest lot, once a sell has reached it, and what is open of it
        place = lambda t: (t.trade_date, 0 if t.action == "buy" else 1, t.id)
        for t in sorted(rows, key=place):
            if done is not None and place(t) <= done:
                yield row(kind="late", stock_id=t.stock_id, id=t.id, action=t.action, trade_date=t.trade_date, qty=t.q, price=t.price,
                          fee=t.fee, tax=t.tax)
                continue
            done = place(t)
            if t.action == "buy":
                bought[upcoming] = (t.id, t.trade_date, t.price, t.fee, t.q, t.q)
                upcoming += 1
                continue
            left: Decimal = t.q
            while left > 0 and oldest < upcoming:
                if head is None:
                    head = self.lots.getValue((oldest,)) if oldest < stored else bought.pop(oldest)
                    left_of_head = head[5]
                i, day, price, fee, q, _ = head
                used = min(left, left_of_head)
                yield row(kind="match", stock_id=t.stock_id, buy_id=i, sell_id=t.id, qty=used, buy_date=day, buy_price=price,
                          sell_date=t.trade_date, sell_price=t.price, b_q=q, b_cost=fee, s_q=t.q, s_cost=t.fee + t.tax)
                left -= used
                left_of_head -= used
                if not left_of_head:
                    head = None
                    oldest += 1
        for at in range(first, min(oldest, stored)):
            self.lots.removeKey((at,))
        if head is not None:
            self.lots.updateValue((oldest,), (*head[:5], left_of_head))
        for at, lot in bought.items():
            self.lots.updateValue((at,), lot)
        if done is not None:
            self.ends.update((oldest, upcoming, *done))

    def close(self) -> None:
        pass


def start_matches(trades: DataFrame, path: str, checkpoint: str, stock: DataFrame) -> StreamingQuery:
    """Match the valid trades of the feed as they come; a micro-batch that is run again replaces its own folder.

    Needs the RocksDB state store (``configure`` sets it). Invalid trades are the business of ``start_ledger``.
    """
    accepted, _ = check_trades(trades, stock)
    money = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("fee", "tax")}
    shaped = accepted.select(
        KEY, F.col("id").cast("long").alias("id"), "action", "trade_date", F.col("shares").cast(SHARES).alias("q"),
        F.col("price").cast("double").alias("price"), *[x.alias(c) for c, x in money.items()])
    out = shaped.where("q > 0").groupBy(KEY).transformWithState(
        statefulProcessor=OpenLots(), outputStructType=OUT, outputMode="Append", timeMode="None")

    def write(batch: DataFrame, number: int) -> None:
        # One write, since a second look at the batch would run the processor again.
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={number}")

    return out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.schema(f"{OUT}, batch long").option("basePath", path).parquet(path)
    return rows.where(F.col("kind") == kind)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """The matches that the stream has written, as ``ledger.matches`` returns them."""
    return priced(_written(spark, path, "match").select(
        KEY, "buy_id", "sell_id", F.col("qty").cast("double").alias("qty"), "buy_date", "buy_price", "sell_date", "sell_price",
        F.col("b_cost").alias("_b_cost"), F.col("b_q").cast("double").alias("_b_q"),
        F.col("s_cost").alias("_s_cost"), F.col("s_q").cast("double").alias("_s_q")))


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """The trades that came too late to be matched, for a rebuild from the log (``ledger.matches``)."""
    return _written(spark, path, "late").select(
        "id", KEY, "action", "trade_date", F.col("qty").cast("double").alias("shares"), "price", "fee", "tax")
