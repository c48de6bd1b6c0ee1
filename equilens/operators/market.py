"""Market-wide views: breadth, sectors, money flow, movers, index quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.functions.price import growth, ratio
from equilens.functions.windows import KEY, TIME, head, series, trailing_calendar, with_age

# Index ids, the fallback, and the turnover floor for movers.
INDEX_IDS = ("TAIEX", "TWSE", "TPEx")
DEFAULT_INDEX = "TAIEX"
MOVERS_MIN_AMOUNT = 20_000_000


def latest_bars(bars: DataFrame, days: int = 15) -> DataFrame:
    """Newest bar of every security within ``days``: change on adjusted close, previous amount."""
    w = series()
    recent = trailing_calendar(bars, TIME, days).select(
        KEY, TIME, F.col("close").cast("double").alias("close"), F.col("amount"),
        growth(F.col("adj_close"), F.lag("adj_close").over(w)).alias("chg"),
        F.lag("amount").over(w).alias("prev_amount"),
    )
    return with_age(recent).filter(F.col("rn") == 1).drop("rn")


def daily_change(bars: DataFrame) -> DataFrame:
    """Bars with the change of the adjusted close to the previous bar."""
    return bars.withColumn("chg", growth(F.col("adj_close"), F.lag("adj_close").over(series())))


def breadth(bars: DataFrame, days: int = 15) -> DataFrame:
    """Securities up, down and flat, total turnover and the newest date."""
    return latest_bars(bars, days).agg(
        F.max(TIME).alias("as_of"),
        F.count_if(F.col("chg") > 0).alias("up"),
        F.count_if(F.col("chg") < 0).alias("down"),
        F.count_if(F.col("chg") == 0).alias("flat"),
        F.sum("amount").alias("total_amount"),
    )


def on_market(market: str) -> Column:
    """Listed boards share a prefix; the OTC board is matched exactly."""
    return F.col("market").like("上市%") if market == "上市" else F.col("market") == market


def sectors(bars: DataFrame, stock: DataFrame, market: str = "上市", days: int = 15) -> DataFrame:
    """Equal-weight change per industry, with its best member (ties: smallest code)."""
    moved = latest_bars(bars, days).filter(F.col("chg").isNotNull())
    listed = stock.filter(on_market(market) & F.col("industry").isNotNull()).select(KEY, "name", "industry")
    best = F.min_by(F.struct(F.col(KEY).alias("id"), "name"), F.struct((-F.col("chg")).alias("c"), F.col(KEY)))
    return (
        moved.join(listed, KEY)
        .groupBy("industry")
        .agg(
            F.round(F.avg(F.col("chg") * 100), 2).alias("avg_pct"), F.count(F.lit(1)).alias("n"),
            best.alias("_top"), F.round(F.max("chg") * 100, 2).alias("top_pct"),
        )
        .select("industry", "avg_pct", "n", F.col("_top.id").alias("top_id"), F.col("_top.name").alias("top_name"),
                "top_pct")
        .orderBy(F.col("avg_pct").desc_nulls_first(), "industry")
    )


def money_flow(bars: DataFrame, stock: DataFrame, market: str = "上市", days: int = 15) -> DataFrame:
    """Industry share of turnover on the newest bar and its change in points."""
    listed = stock.filter(on_market(market) & F.col("industry").isNotNull()).select(KEY, "industry")
    per_industry = (
        latest_bars(bars, days).join(listed, KEY).groupBy("industry")
        .agg(F.sum("amount").alias("today"), F.sum("prev_amount").alias("prev"))
    )
    totals = per_industry.agg(F.struct(F.sum("today").alias("today"), F.sum("prev").alias("prev"))).scalar()
    share, before = (ratio(F.col(c), totals[c]) for c in ("today", "prev"))
    return per_industry.select(
        "industry", F.round(share * 100, 2).alias("share_pct"), F.round((share - before) * 100, 2).alias("chg_pct")
    ).orderBy(F.col("share_pct").desc_nulls_first(), "industry")


def movers(
    bars: DataFrame, stock: DataFrame, kind: str = "gainers", limit: int | None = 15, days: int = 15,
    min_amount: float = MOVERS_MIN_AMOUNT,
) -> DataFrame:
    """Top gainers, losers or most active among liquid securities; ``limit=None`` returns all."""
    order = {
        "losers": F.col("chg").asc_nulls_last(),
        "active": F.col("amount").desc_nulls_last(),
    }.get(kind, F.col("chg").desc_nulls_first())
    liquid = latest_bars(bars, days).filter((F.col("amount") >= min_amount) & F.col("chg").isNotNull())
    ranked = liquid.join(stock.select(KEY, "name", "industry"), KEY).orderBy(order, KEY)
    return head(ranked, limit).select(
        KEY, "name", "industry", F.round(F.col("chg") * 100, 2).alias("chg_pct"), "close", "amount")


def index_quotes(index: DataFrame) -> DataFrame:
    """Newest close of every index with its change and percent change."""
    w = series("index_id")
    c = F.col("close").cast("double")
    return (
        with_age(index.select("index_id", TIME, c.alias("close"), F.lag(c).over(w).alias("_prev")), "index_id")
        .filter(F.col("rn") == 1)
        .select("index_id", TIME, "close", F.when(F.col("_prev") != 0, F.col("close") - F.col("_prev")).alias("change"),
                (growth(F.col("close"), F.col("_prev")) * 100).alias("pct"))
    )


def market_overview(bars: DataFrame, index: DataFrame, days: int = 15, ids=("TAIEX", "TPEx")) -> DataFrame:
    """Breadth plus one quote struct per headline index, one row."""
    quotes = index_quotes(index.filter(F.col("index_id").isin(*ids)))
    folded = quotes.agg(
        *[
            F.max(F.when(F.col("index_id") == i, F.struct(F.col(TIME).alias("date"), "close", "change", "pct"))).alias(
                i.lower()
            )
            for i in ids
        ]
    )
    return breadth(bars, days).select("*", *[folded.select(i.lower()).scalar().alias(i.lower()) for i in ids])


def index_series(index: DataFrame, index_id: str = DEFAULT_INDEX, days: int | None = 120) -> DataFrame:
    """Newest ``days`` closes of one index, None for all, oldest first."""
    wanted = index_id if index_id in INDEX_IDS else DEFAULT_INDEX
    rows = head(index.filter(F.col("index_id") == wanted).orderBy(F.col(TIME).desc()), days)
    return rows.select(TIME, "close").orderBy(TIME)


def index_ratio(index: DataFrame, index_id: str, ranks: tuple[int, int] = (1, 126)) -> Column:
    """Growth factor of an index between two bar ranks, as a scalar subquery."""
    legs = with_age(index.filter(F.col("index_id") == index_id), "index_id").agg(
        *[F.max(F.when(F.col("rn") == k, F.col("close").cast("double"))).alias(f"i{k}") for k in ranks]
    )
    a, b = (F.col(f"i{k}") for k in ranks)
    return legs.select(ratio(a, b).alias("r")).scalar()

