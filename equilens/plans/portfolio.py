"""Open holdings with diagnosis, and the portfolio summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.functions.windows import KEY, TIME
from equilens.operators.candles import last_patterns
from equilens.operators.ledger import DEFAULT_ID_BLOCK, matches, positions
from equilens.operators.levels import levels
from equilens.plans.diagnose import diagnose
from equilens.session import materialize

OTHER_INDUSTRY = "其他"


def holdings(
    trades: DataFrame, snapshot: DataFrame, bars: DataFrame, level_bars: int = 120,
    id_block: int = DEFAULT_ID_BLOCK,
) -> DataFrame:
    """One row per security with open shares: value, profit, score, levels and last patterns.

    Snapshot, levels and patterns are computed for all holdings at once and
    joined by code; a holding without a snapshot row keeps its cost and is
    rated ``watch``.
    """
    return _enriched(materialize(_held(positions(trades, id_block))), snapshot, bars, level_bars)


def _held(book: DataFrame) -> DataFrame:
    return book.filter(F.col("net_shares") > 1e-9)


def _enriched(book: DataFrame, snapshot: DataFrame, bars: DataFrame, level_bars: int) -> DataFrame:
    """Holdings from their positions, which are read three times."""
    held_bars = bars.join(book.select(KEY), KEY, "left_semi")
    rated = diagnose(snapshot).select(
        KEY, "name", "industry", "close", "as_of_date", "score", "level", "facets", "reasons", "rs_rating",
        "vpa_accum_20d", "vpa_distrib_20d", "mf_accumulate", "mf_distribute",
    )
    marks = levels(held_bars, level_bars).groupBy(KEY).agg(
        *[F.max(F.when(F.col("type") == t, F.col("price"))).alias(f"_{t}") for t in
          ("resistance", "neckline", "support")]
    )
    joined = (
        book.join(rated, KEY, "left").join(marks, KEY, "left").join(last_patterns(held_bars).drop(TIME), KEY, "left")
    )
    close, shares, cost = F.col("close").cast("double"), F.col("net_shares"), F.col("avg_cost")
    return joined.select(
        KEY, F.coalesce("name", KEY).alias("name"), "industry", shares.alias("shares"), cost.alias("cost"),
        close.alias("close"), (shares * close).alias("market_value"), (shares * cost).alias("cost_value"),
        (shares * close - shares * cost).alias("unrealized"),
        (F.try_divide(close, F.nullif(cost, F.lit(0.0))) - 1).alias("unrealized_pct"),
        F.col("realized_pnl").alias("realized"), "score", F.coalesce("level", F.lit("watch")).alias("level"),
        "facets", F.coalesce("reasons", F.array().cast("array<struct<text:string,dir:string>>")).alias("reasons"),
        "rs_rating", "vpa_accum_20d", "vpa_distrib_20d",
        F.coalesce("mf_accumulate", F.lit(False)).alias("mf_accumulate"),
        F.coalesce("mf_distribute", F.lit(False)).alias("mf_distribute"),
        F.coalesce(F.nullif("_support", F.lit(0.0)), "_neckline").alias("support"),
        F.col("_resistance").alias("resistance"), "last_patterns", "as_of_date",
    )


def trades_listing(trades: DataFrame, stock: DataFrame) -> DataFrame:
    """The trade log with names, newest first; a code without a name stands for itself."""
    named = trades.join(stock.select(KEY, "name"), KEY, "left").withColumn("name", F.coalesce("name", KEY))
    return named.orderBy(F.col(TIME).desc(), F.col("id").desc())


def realized(trades: DataFrame, stock: DataFrame, id_block: int = DEFAULT_ID_BLOCK) -> DataFrame:
    """Matched round trips with the security's name, newest sale first."""
    named = matches(trades, id_block).join(stock.select(KEY, "name"), KEY, "left")
    return named.withColumn("name", F.coalesce("name", KEY)).orderBy(
        F.col("sell_date").desc(), KEY, "sell_id", "buy_id"
    )


def realized_stats(matched: DataFrame) -> DataFrame:
    """Total realised profit, number of round trips and the share of winners."""
    win = F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0))
    return matched.agg(
        F.coalesce(F.sum("pnl"), F.lit(0)).alias("realized_total"), F.count(F.lit(1)).alias("closed_n"),
        F.round(win * 100, 1).alias("win_rate"),
    )


def _realized_by_security(matched: DataFrame) -> DataFrame:
    """What ``_realized_of`` needs of the round trips, one row per security."""
    return matched.groupBy(KEY).agg(
        F.sum("pnl").alias("_pnl"), F.count(F.lit(1)).alias("_closed"), F.count_if(F.col("pnl") > 0).alias("_won"))


def _realized_of(by_security: DataFrame) -> DataFrame:
    """``realized_stats`` from the sums per security."""
    closed = F.coalesce(F.sum("_closed"), F.lit(0))
    win = F.try_divide(F.sum("_won").cast("double"), F.sum("_closed").cast("double"))
    return by_security.agg(
        F.coalesce(F.sum("_pnl"), F.lit(0)).alias("realized_total"), closed.alias("closed_n"),
        F.round(win * 100, 1).alias("win_rate"),
    )


def top_industry(items: DataFrame) -> DataFrame:
    """Industry with the largest market value and its share in percent (ties: name)."""
    valued = items.filter(F.coalesce(F.col("market_value"), F.lit(0.0)) != 0)
    sums = valued.groupBy(F.coalesce("industry", F.lit(OTHER_INDUSTRY)).alias("industry")).agg(
        F.sum("market_value").alias("v")
    )
    best = F.min_by("industry", F.struct((-F.col("v")).alias("v"), "industry"))
    return sums.agg(
        best.alias("top_industry"),
        F.round(F.try_divide(F.max("v"), F.nullif(F.sum("v"), F.lit(0.0))) * 100, 1).alias("top_industry_share"),
    )


def summary(items: DataFrame, matched: DataFrame) -> DataFrame:
    """One row of portfolio totals.

    Cost counts every holding, value only the priced ones; the unrealised
    total is their plain difference.
    """
    return _totals(items, realized_stats(matched))


def _totals(items: DataFrame, realized_row: DataFrame) -> DataFrame:
    level = F.col("level")
    totals = items.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("market_value"), F.lit(0.0)).alias("_mv"),
        F.coalesce(F.sum("cost_value"), F.lit(0.0)).alias("_cv"),
        *[F.count_if(level == x).alias(f"{x}_n") for x in ("strong", "watch", "reduce")],
        F.rint(F.avg("rs_rating")).cast("int").alias("avg_rs"),
        F.count_if("mf_accumulate").alias("accum_n"), F.count_if("mf_distribute").alias("distrib_n"),
        F.max("as_of_date").alias("as_of"),
    )
    stats, best = (one_row.select(F.struct("*")).scalar() for one_row in (realized_row, top_industry(items)))
    one = totals.select(
        "*",
        *[stats[c].alias(c) for c in ("realized_total", "closed_n", "win_rate")],
        *[best[c].alias(c) for c in ("top_industry", "top_industry_share")],
    )
    mv, cv = F.col("_mv"), F.col("_cv")
    unreal = F.when(cv != 0, mv - cv)
    return one.select(
        "n", F.nullif(mv, F.lit(0.0)).alias("total_value"), F.nullif(cv, F.lit(0.0)).alias("total_cost"),
        unreal.alias("unrealized"), F.try_divide(unreal, cv).alias("unrealized_pct"),
        "realized_total", (F.col("realized_total") + F.coalesce(unreal, F.lit(0.0))).alias("total_pnl"),
        "closed_n", "win_rate", "strong_n", "watch_n", "reduce_n", "avg_rs", "accum_n", "distrib_n",
        "top_industry", "top_industry_share", "as_of",
    )


def portfolio(
    trades: DataFrame, snapshot: DataFrame, bars: DataFrame, level_bars: int = 120, id_block: int = DEFAULT_ID_BLOCK,
    summarized: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """(holdings, summary). Holdings feed both, so they are written once; without a summary no round trips are matched.

    Positions and round trips are written together, one row per security: in one plan they share the shuffle of the trade
    log. Only securities that were traded have either.
    """
    if not summarized:
        return materialize(holdings(trades, snapshot, bars, level_bars, id_block)), None
    book = materialize(positions(trades, id_block).join(_realized_by_security(matches(trades, id_block)), KEY, "left"))
    items = materialize(_enriched(_held(book).drop("_pnl", "_closed", "_won"), snapshot, bars, level_bars))
    return items, _totals(items, _realized_of(book))
