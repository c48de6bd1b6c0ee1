"""FIFO matching of buys and sells for every security at once.

Matching is positional. On an axis counting shares, each buy owns the stretch
between the shares bought before and after it, and each effective sell the
stretch between the shares sold before and after it; a sell consumes a lot
exactly where the two stretches overlap. Shares sold with nothing held are
dropped: with ``S`` the running bought-minus-sold sum and ``M`` its running
minimum (at most 0), ``-M`` shares have been dropped so far.

Securities of up to ``ROWS_IN_ORDER`` trades are walked in order: one shuffle by
security gives the running sums and, sorted again by the axis, the matches.

A security may hold any share of the log, so no window here spans more trades of
one than that. Running sums of the larger ones are put together from three
levels, each a bounded window: days of a security (at most one row per calendar
day), blocks of ids inside one day and side, and the rows of one block. Their
matching is cut into bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.functions.price import round_exact
from equilens.operators.relational import union_all

SHARES = "decimal(28,12)"  # shares are exact to the twelfth decimal
UNIT = 10**12  # the axis counts in units of 10^-12 shares, as whole decimals; a security may trade up to 9 * 10^18 shares
AXIS = "decimal(38,0)"
DEFAULT_ID_BLOCK = 1 << 20
ROWS_PER_BIN = 1024
ROWS_IN_ORDER = 1 << 16  # securities of more trades are cut into blocks and bins
LONG = 9 * 10**18
DAY = ("stock_id", "trade_date")
BLOCK = ("stock_id", "trade_date", "_side", "_block")
WHOLE = ("stock_id", "_parts")


def _units() -> Column:
    return (F.col("shares").cast(SHARES) * F.lit(UNIT).cast("decimal(13,0)")).cast("decimal(28,0)")


def _shares(units: Column) -> Column:
    """Axis units, not below 0, as shares: whole shares and the rest apart, so that whole numbers stay whole."""

    def split(x: Column, one: Column) -> Column:
        return F.call_function("div", x, one).cast("double") + F.pmod(x, one).cast("double") / float(UNIT)

    small = split(units.cast("bigint"), F.lit(UNIT).cast("bigint"))
    return F.when(units <= LONG, small).otherwise(split(units, F.lit(UNIT).cast("decimal(13,0)")))


def _crowded(trades: DataFrame) -> DataFrame:
    """Securities of more than ``ROWS_IN_ORDER`` trades, in how many parts they would go. At most the log over that."""
    traded = trades.filter(_units() > 0).groupBy("stock_id").agg(F.count(F.lit(1)).alias("_n"))
    return F.broadcast(traded.filter(F.col("_n") > ROWS_IN_ORDER).select(
        "stock_id", F.ceil(F.col("_n") / F.lit(ROWS_IN_ORDER)).alias("_parts")))


def _prepared(trades: DataFrame, id_block: int) -> DataFrame:
    money = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("fee", "tax")}
    side = F.when(F.col("action") == "buy", 0).otherwise(1)
    return trades.select(
        "stock_id", "trade_date", F.col("id").cast("bigint").alias("id"), side.alias("_side"),
        F.expr(f"cast(id as bigint) div {int(id_block)}").alias("_block"),
        _units().alias("q"), F.col("price").cast("double").alias("price"),
        money["fee"].alias("fee"), money["tax"].alias("tax"),
    ).filter(F.col("q") > 0)


def _sum_if(cond: Column, x: str = "q") -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(x))), F.lit(0)).cast(AXIS)


def _days(rows: DataFrame) -> DataFrame:
    """Per (security, day): shares bought and sold before it, the running minimum before it, totals."""
    per_day = rows.groupBy(*DAY).agg(
        _sum_if(F.col("_side") == 0).alias("bought"), _sum_if(F.col("_side") == 1).alias("sold"),
        F.count(F.lit(1)).alias("rows"),
    )
    w = Window.partitionBy("stock_id").orderBy("trade_date")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast(AXIS)
    walked = per_day.select(
        "*",
        F.coalesce(F.sum("bought").over(before), zero).alias("bought_before"),
        F.coalesce(F.sum("sold").over(before), zero).alias("sold_before"),
        F.sum(F.col("bought") - F.col("sold")).over(upto).alias("balance"),
        F.sum("bought").over(whole).alias("all_bought"),
        F.sum("sold").over(whole).alias("all_sold"),
        F.sum("rows").over(whole).alias("all_rows"),
    )
    return walked.select(
        "*",
        F.least(F.coalesce(F.min("balance").over(before), zero), zero).alias("low_before"),
        F.least(F.min("balance").over(whole), zero).alias("low_ever"),
    )


def _in_order(trades: DataFrame) -> DataFrame:
    """Trades of the securities that are not crowded, with their stretch as in ``_in_blocks``.

    A sell's balance is the lowest of its day so far, since buys of a day come first.
    """
    rows = _prepared(trades, DEFAULT_ID_BLOCK).drop("_block").join(_crowded(trades), "stock_id", "left").withColumn(
        "_parts", F.coalesce("_parts", F.lit(1))).filter((F.col("_parts") == 1) & F.col("stock_id").isNotNull())
    zero = F.lit(0).cast(AXIS)
    w = Window.partitionBy(*WHOLE).orderBy("trade_date", "_side", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    is_buy, q = F.col("_side") == 0, F.col("q")
    summed = rows.select(
        "*", F.coalesce(F.sum(F.when(is_buy, q)).over(upto), zero).alias("_bought"),
        F.coalesce(F.sum(F.when(~is_buy, q)).over(upto), zero).alias("_sold"),
    ).withColumn("_balance", F.col("_bought") - F.col("_sold"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    walked = summed.select(
        "*", F.least(F.min("_balance").over(upto), zero).alias("_low"),
        F.least(F.min("_balance").over(w.rowsBetween(Window.unboundedPreceding, -1)), zero).alias("_low_before"),
        F.max("_sold").over(whole).alias("_all_sold"), F.least(F.min("_balance").over(whole), zero).alias("_low_ever"),
    )
    known = F.col("trade_date").isNotNull() & F.col("id").isNotNull()
    return walked.filter(known).select(
        *WHOLE, "trade_date", "id", is_buy.alias("is_buy"), "q", "price", "fee", "tax",
        F.when(is_buy, F.col("_bought")).otherwise(F.col("_sold")).alias("cum"),
        F.when(is_buy, F.col("_bought") - q).otherwise(F.col("_sold") - q + F.col("_low_before")).alias("lo"),
        F.when(is_buy, F.col("_bought")).otherwise(F.col("_sold") + F.col("_low")).alias("hi"),
        (F.col("_all_sold") + F.col("_low_ever")).alias("axis_end"),
    )


def _in_blocks(trades: DataFrame, id_block: int) -> DataFrame:
    """Trades of crowded securities with their stretch ``[lo, hi)``, the end of the effective sells and the bin width,
    in axis units."""
    rows = _prepared(trades, id_block).join(_crowded(trades), "stock_id", "left_semi")
    inside_day = Window.partitionBy("stock_id", "trade_date", "_side").orderBy("_block")
    blocks = rows.groupBy(*BLOCK).agg(F.sum("q").alias("_sum")).select(
        *BLOCK,
        F.coalesce(F.sum("_sum").over(inside_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(AXIS).alias("_offset"),
    )
    bases = blocks.join(_days(rows), list(DAY))

    inside_block = Window.partitionBy(*BLOCK).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("_run", F.sum("q").over(inside_block))
    placed = running.join(bases, list(BLOCK))

    q = F.col("q")
    buy_hi = F.col("bought_before") + F.col("_offset") + F.col("_run")
    raw_hi = F.col("sold_before") + F.col("_offset") + F.col("_run")
    # Buys of a day come before its sells, so a sell sees the whole day's buys.
    balance = F.col("bought_before") + F.col("bought") - raw_hi
    dropped = -F.least(F.col("low_before"), balance)
    dropped_before = -F.least(F.col("low_before"), balance + q)
    is_buy = F.col("_side") == 0
    rows_per_bin = F.ceil(F.col("all_rows") / F.lit(ROWS_PER_BIN))
    width = (F.greatest(F.col("all_bought"), F.col("all_sold")).cast("double") / rows_per_bin).cast(AXIS) + 1
    return placed.select(
        "stock_id", "trade_date", "id", is_buy.alias("is_buy"), "q", "price", "fee", "tax",
        F.when(is_buy, buy_hi).otherwise(raw_hi).alias("cum"),
        F.when(is_buy, buy_hi - q).otherwise(raw_hi - q - dropped_before).alias("lo"),
        F.when(is_buy, buy_hi).otherwise(raw_hi - dropped).alias("hi"),
        (F.col("all_sold") + F.col("low_ever")).alias("axis_end"), width.alias("bin"),
    )


def cumulative(trades: DataFrame, id_block: int = DEFAULT_ID_BLOCK) -> DataFrame:
    """Every trade with the shares bought (or sold) up to and including it.

    ``id`` must be unique; ``id_block`` is the width of the id ranges that are
    summed separately (serial ids: the number of rows a task may sort; hashed
    ids: scaled up).
    """
    return union_all(*[
        axis.select(
            "stock_id", "trade_date", "id", F.when(F.col("is_buy"), "buy").otherwise("sell").alias("action"),
            _shares(F.col("q")).alias("shares"), "price", "fee", "tax", _shares(F.col("cum")).alias("cum_shares"),
        ) for axis in (_in_order(trades), _in_blocks(trades, id_block))
    ])


def matches(trades: DataFrame, id_block: int = DEFAULT_ID_BLOCK) -> DataFrame:
    """One row per (buy, sell) pair with the matched shares and its profit.

    The starts of lots and sells are ordered together: between two neighbouring
    starts exactly one lot and one sell are current. No pair of trades is ever
    enumerated. The axes of crowded securities are cut at bin borders first.

    Equal bins hold about ``ROWS_PER_BIN`` trades each while lot sizes are
    alike. Where one huge lot leaves very many small ones in few bins, those
    bins are cut again by the number of trades counted in them.
    """
    whole = _open_axis(_in_order(trades)).withColumns({"_pos": F.col("lo"), "_edge": F.greatest("hi", "axis_end")})
    return priced(union_all(
        _paired(whole, WHOLE, WHOLE),
        _paired(_binned(_open_axis(_in_blocks(trades, id_block))), ("stock_id", "_bin", "_part"), ("stock_id",)),
    ))


def _open_axis(axis: DataFrame) -> DataFrame:
    """What is to be matched: lots beyond the last effective sell stay open."""
    return axis.filter(F.col("hi") > F.col("lo")).filter(~F.col("is_buy") | (F.col("lo") < F.col("axis_end")))


def _binned(axis: DataFrame) -> DataFrame:
    """Trades once for every part of a bin that they reach into, from ``_pos``; the part ends at ``_edge``."""
    binned = axis.withColumn("_bin", F.explode(F.expr("sequence(lo div bin, (hi - 1) div bin)")))
    load = binned.groupBy("stock_id", "_bin").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_BIN).alias("_parts"))
    from_bin = F.greatest(F.col("lo"), F.col("_bin") * F.col("bin"))
    to_bin = F.least(F.col("hi"), (F.col("_bin") + 1) * F.col("bin"))
    placed = binned.join(load, ["stock_id", "_bin"]).withColumns({
        "_from": from_bin, "_to": to_bin, "_start": F.col("_bin") * F.col("bin"),
        "_step": F.ceil(F.col("bin") / F.col("_parts")).cast("bigint"),
    })
    parts = placed.withColumn(
        "_part", F.explode(F.expr("sequence((_from - _start) div _step, (_to - 1 - _start) div _step)"))
    )
    part_start = F.col("_start") + F.col("_part") * F.col("_step")
    edge = F.least(part_start + F.col("_step"), F.col("_start") + F.col("bin"))
    return parts.withColumns({"_edge": edge, "_pos": F.greatest(F.col("_from"), part_start)})


def _paired(cut: DataFrame, cell: tuple[str, ...], owner: tuple[str, ...]) -> DataFrame:
    """Pairs current at a time in a ``cell``, with the shares matched; a pair may come from several cells of an ``owner``."""
    attrs = F.struct("id", "trade_date", "q", "price", (F.col("fee") + F.col("tax")).alias("cost"), "fee", "hi")
    is_buy = F.col("is_buy")
    w = Window.partitionBy(*cell).orderBy("_pos", "is_buy")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sides = cut.select(
        *dict.fromkeys((*cell, *owner)), "_pos", "_edge", "is_buy",
        F.when(is_buy, attrs).alias("_buy"), F.when(~is_buy, attrs).alias("_sell"),
    )
    current = sides.select(
        *owner, "_pos",
        F.last("_buy", ignorenulls=True).over(upto).alias("b"),
        F.last("_sell", ignorenulls=True).over(upto).alias("s"),
        F.coalesce(F.lead("_pos").over(w), F.col("_edge")).alias("_next"),
    )
    piece = F.least(F.col("_next"), F.col("b.hi"), F.col("s.hi")) - F.col("_pos")
    pieces = current.filter(F.col("b").isNotNull() & F.col("s").isNotNull()).withColumn("_piece", piece)
    # Pieces of a pair cut by a bin border meet again here; the rest is fixed-width and equal within a pair.
    carried = {
        "buy_date": "b.trade_date", "buy_price": "b.price", "_b_cost": "b.fee", "_b_q": "b.q",
        "sell_date": "s.trade_date", "sell_price": "s.price", "_s_cost": "s.cost", "_s_q": "s.q",
    }
    whole = (
        pieces.filter(F.col("_piece") > 0)
        .groupBy(*owner, F.col("b.id").alias("buy_id"), F.col("s.id").alias("sell_id"))
        .agg(F.sum("_piece").alias("qty"), *[F.first(c).alias(n) for n, c in carried.items()])
    )
    return whole.select(
        "stock_id", "buy_id", "sell_id", *[_shares(F.col(c)).alias(c) for c in ("qty", "_b_q", "_s_q")],
        *[c for c in carried if c not in ("_b_q", "_s_q")])


def priced(pairs: DataFrame) -> DataFrame:
    """Matched pairs with their profit: the part of both trades' costs that falls on the matched shares is taken off."""
    qty, buy, sell = F.col("qty"), F.col("buy_price"), F.col("sell_price")
    gain = (sell - buy) * qty - (F.col("_s_cost") / F.col("_s_q") + F.col("_b_cost") / F.col("_b_q")) * qty
    return pairs.select(
        "stock_id", "buy_id", "sell_id", F.round("qty", 3).alias("shares"), "buy_date", "buy_price", "sell_date",
        "sell_price", gain.alias("pnl_exact"), F.rint(gain).cast("bigint").alias("pnl"),
        (F.try_divide(sell, F.nullif(buy, F.lit(0.0))) - 1).alias("ret_pct"),
        F.date_diff("sell_date", "buy_date").alias("days"),
    )


def positions(trades: DataFrame, id_block: int = DEFAULT_ID_BLOCK) -> DataFrame:
    """Per security: open shares, average cost without fees, realised profit, totals traded.

    Every effective share that was sold is matched, so the profit needs no
    pairs: it is what sells earn on their stretch of the axis less what the
    consumed part of the lots cost.
    """
    return union_all(_book(_in_order(trades), WHOLE), _book(_in_blocks(trades, id_block), ("stock_id",)))


def _book(axis: DataFrame, owner: tuple[str, ...]) -> DataFrame:
    left = F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.col("axis_end")), F.lit(0).cast(AXIS))
    held = F.when(F.col("is_buy"), _shares(left)).otherwise(0.0)
    traded = _shares(F.col("q"))
    per_share = F.when(F.col("is_buy"), F.col("price") + F.col("fee") / traded).otherwise(
        F.col("price") - (F.col("fee") + F.col("tax")) / traded)
    consumed = _shares(F.least("hi", "axis_end") - F.least("lo", "axis_end"))
    earned = F.when(F.col("is_buy"), -consumed).otherwise(_shares(F.col("hi") - F.col("lo"))) * per_share
    book = axis.groupBy(*owner).agg(
        _shares(F.sum(F.when(F.col("is_buy"), left).otherwise(F.lit(0).cast(AXIS)))).alias("_net"), F.sum(held * F.col("price")).alias("_cost"),
        _shares(_sum_if(F.col("is_buy"))).alias("_b"), _shares(_sum_if(~F.col("is_buy"))).alias("_s"), F.sum(earned).alias("_r"),
    )
    return book.select(
        "stock_id", F.round("_net", 3).alias("net_shares"),
        F.when(F.col("_net") > 1e-9, round_exact(F.col("_cost") / F.col("_net"), 4)).alias("avg_cost"),
        F.rint(F.coalesce("_r", F.lit(0.0))).cast("bigint").alias("realized_pnl"),
        F.round("_b", 3).alias("buy_shares"), F.round("_s", 3).alias("sell_shares"),
    )


def open_shares(day_sums: DataFrame) -> DataFrame:
    """Open shares from (stock_id, trade_date, bought, sold) sums alone.

    Day sums are enough because buys of a day precede its sells; they can be
    kept up to date by a stream and stay one row per security and day.
    """
    w = Window.partitionBy("stock_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    walk = day_sums.withColumn("balance", F.sum(F.col("bought") - F.col("sold")).over(w))
    return walk.groupBy("stock_id").agg(
        (F.sum(F.col("bought") - F.col("sold")) - F.least(F.min("balance"), F.lit(0))).cast("double").alias("net_shares")
    )
