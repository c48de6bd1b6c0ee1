"""Window, aggregate, join and market-view queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from checks.registry import query
from checks.views import Views
from equilens.functions.calendar import (
    effective_start, in_dividend_season, in_revenue_window, is_weekend, iso_week_label, publishable_quarter,
    revenue_available, statement_available,
)
from equilens.functions.price import clamp, dividend_ratio, net_of, pct
from equilens.functions.windows import last_n, prior_trend, series, trailing_baseline, trailing_calendar, with_age
from equilens.operators import market as mk
from equilens.operators import quality as ql
from equilens.operators import stock_views as sv
from equilens.operators import technical as tc
from equilens.operators.adjust import dividend_events, reduction_events
from equilens.operators.candles import anatomy
from equilens.operators.indicators import chart_overlays, macd_kdj
from equilens.operators.levels import level_clusters, levels, pivots
from equilens.operators.relational import (
    around_events, as_of_known, close_on_or_latest, distinct_codes, keep_first, keep_known, keep_last, latest_row,
    overlay, point_in_time, requested_and_known, table_counts, union_all,
)
from equilens.operators.vpa import with_baseline

W = "PARTITION BY stock_id ORDER BY trade_date"

# -- windows ------------------------------------------------------------------

query("w01_trading_day_rank", lambda v: with_age(v.bars).select("stock_id", "trade_date", "rn"),
      "SELECT stock_id, trade_date, (row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC))::INT AS rn FROM fx_bars",
      "fx_bars")
query("w02_daily_change", lambda v: mk.daily_change(v.bars).select("stock_id", "trade_date", "chg"),
      f"SELECT stock_id, trade_date, adj_close / nullif(lag(adj_close) OVER ({W}), 0) - 1 AS chg FROM fx_bars",
      "fx_bars", chg=6)


def _baseline(v: Views):
    w = series()
    return v.bars.select(
        "stock_id", "trade_date", trailing_baseline(F.col("volume"), 20, w).alias("vavg"),
        trailing_baseline(F.col("adj_high") - F.col("adj_low"), 20, w).alias("savg"), F.lag("adj_close").over(w).alias("pc"),
    )


query("w03_trailing_baseline", _baseline,
      f"""SELECT stock_id, trade_date, avg(volume) OVER p AS vavg, avg(adj_high - adj_low) OVER p AS savg,
          lag(adj_close) OVER ({W}) AS pc FROM fx_bars WINDOW p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
      "fx_bars", vavg=6, savg=6, pc=6)
query("w05_back_adjust_factor", lambda v: v.adjusted.select("stock_id", "trade_date", "adj_factor"),
      "SELECT stock_id, trade_date, adj_factor FROM fx_adjusted", "fx_adjusted", adj_factor=8)

_MA = f"""SELECT *,
  CASE WHEN count(close) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS ma20,
  CASE WHEN count(close) OVER (w ROWS 59 PRECEDING) = 60 THEN avg(close) OVER (w ROWS 59 PRECEDING) END AS ma60,
  CASE WHEN count(close) OVER (w ROWS 119 PRECEDING) = 120 THEN avg(close) OVER (w ROWS 119 PRECEDING) END AS ma120,
  CASE WHEN count(volume) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(volume) OVER (w ROWS 19 PRECEDING) END AS vma20,
  CASE WHEN count(close) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) = 60
       THEN max(close) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS ceiling,
  CASE WHEN count(close) OVER (w ROWS 19 PRECEDING) = 20 THEN max(close) OVER (w ROWS 19 PRECEDING) END AS top20,
  lag(close) OVER w AS prev
  FROM fx_bars WINDOW w AS ({W})"""
_FLAGS = f"""SELECT stock_id, trade_date, close,
  coalesce(ma20 > ma60 AND ma60 > ma120 AND close > ma20, false) AS bull_ma,
  coalesce((greatest(ma20, ma60, ma120) - least(ma20, ma60, ma120)) / close < 0.03, false) AS ma_squeeze,
  coalesce(close > prev AND volume > vma20, false) AS vol_price_up,
  coalesce(close >= top20 AND volume < vma20, false) AS bear_divergence,
  coalesce(ma20 > ma60 AND lag(ma20) OVER w <= lag(ma60) OVER w, false) AS golden_cross,
  coalesce(ma20 < ma60 AND lag(ma20) OVER w >= lag(ma60) OVER w, false) AS death_cross,
  coalesce(close > ceiling AND volume > 1.5 * vma20, false) AS breakout
  FROM fx_ma WINDOW w AS ({W})"""
TECH = {"fx_ma": (("fx_bars",), _MA), "fx_flags": (("fx_ma",), _FLAGS)}

query("w06_full_window_ma", lambda v: tc.moving_averages(v.bars).select("stock_id", "trade_date", "ma20", "ma60", "ma120", "vma20"),
      "SELECT stock_id, trade_date, ma20, ma60, ma120, vma20 FROM fx_ma", "fx_ma", extra=TECH,
      ma20=6, ma60=6, ma120=6, vma20=6)
for _name, _cols in {
    "w07_ma_crosses": ("golden_cross", "death_cross"), "w08_ma_squeeze": ("ma_squeeze",),
    "w09_volume_breakout": ("breakout",), "w10_price_up_volume_up": ("vol_price_up",),
    "w11_bearish_divergence": ("bear_divergence",), "w12_bull_alignment": ("bull_ma",),
}.items():
    query(_name, lambda v, c=_cols: tc.technical_flags(v.bars).select("stock_id", "trade_date", *c),
          f"SELECT stock_id, trade_date, {', '.join(_cols)} FROM fx_flags", "fx_flags", extra=TECH)
query("d06_technical_flags", lambda v: tc.technical_flags(v.bars).select("stock_id", "trade_date", *tc.FLAGS),
      f"SELECT stock_id, trade_date, {', '.join(tc.FLAGS)} FROM fx_flags", "fx_flags", extra=TECH)
_LABELS = ", ".join(f"CASE WHEN {k} THEN '{t}' END" for k, t in tc.LABELS.items())
query("d38_fired_labels_latest", lambda v: tc.scan_signals(v.bars),
      f"""SELECT stock_id, trade_date, close, concat_ws('、', {_LABELS}) AS labels FROM (
            SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) AS k FROM fx_flags)
          WHERE k = 1 AND concat_ws('、', {_LABELS}) <> ''""", "fx_flags", extra=TECH, close=4)
query("t09_label_history_tail", lambda v: tc.scan_signals(v.bars, 20),
      f"""SELECT stock_id, trade_date, close, concat_ws('、', {_LABELS}) AS labels FROM (
            SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) AS k FROM fx_flags)
          WHERE k <= 20 AND concat_ws('、', {_LABELS}) <> ''""", "fx_flags", extra=TECH, close=4)

_MARGIN_SQL = """SELECT * EXCLUDE (k) FROM (SELECT stock_id, trade_date, margin_balance, short_balance,
    margin_balance - lag(margin_balance) OVER w AS margin_chg, short_balance - lag(short_balance) OVER w AS short_chg,
    CASE WHEN margin_balance > 0 THEN short_balance::DOUBLE / margin_balance::DOUBLE * 100 END AS short_margin_ratio,
    row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) AS k
  FROM {src} WINDOW w AS (PARTITION BY stock_id ORDER BY trade_date)) WHERE k <= 60"""
query("w13_balance_deltas", lambda v: sv.margin_series(v.margin, "D", 60), _MARGIN_SQL.format(src="fx_margin"),
      "fx_margin", short_margin_ratio=4)
for _tf, _unit in (("W", "week"), ("M", "month"), ("Q", "quarter")):
    query(f"d46_margin_{_unit}", lambda v, t=_tf: sv.margin_series(v.margin, t, 60),
          _MARGIN_SQL.format(src=f"""(SELECT stock_id, date_trunc('{_unit}', trade_date)::DATE AS trade_date,
            arg_max(margin_balance, trade_date) AS margin_balance, arg_max(short_balance, trade_date) AS short_balance
            FROM fx_margin GROUP BY 1, 2)"""), "fx_margin", short_margin_ratio=4)
query("w14_revenue_growth", lambda v: v.revenue, "SELECT * FROM fx_revenue", "fx_revenue", mom_pct=2, yoy_pct=2)


def _trend(v: Views):
    w, c = series(), F.col("adj_close")
    return v.bars.select("stock_id", "trade_date", prior_trend(c, 1, 5, w).alias("t1"), prior_trend(c, 3, 5, w).alias("t3"),
                         prior_trend(c, 1, 10, w).alias("t10"))


def _trend_sql(start: int, look: int, name: str) -> str:
    f = f"({W} ROWS BETWEEN {start + look - 1} PRECEDING AND {start} PRECEDING)"
    return (f"CASE WHEN count(adj_close) OVER {f} < 2 THEN 0 ELSE sign(lag(adj_close, {start}) OVER ({W}) - "
            f"first_value(adj_close) OVER {f})::INT END AS {name}")


query("w16_prior_trend", _trend,
      f"SELECT stock_id, trade_date, {_trend_sql(1, 5, 't1')}, {_trend_sql(3, 5, 't3')}, {_trend_sql(1, 10, 't10')} FROM fx_bars",
      "fx_bars")
query("w17_pivots", lambda v: pivots(v.bars).select("stock_id", "trade_date", "pivot_high", "pivot_low"),
      f"""SELECT stock_id, trade_date,
          CASE WHEN count(*) OVER f = 7 AND adj_high = max(adj_high) OVER f THEN adj_high END AS pivot_high,
          CASE WHEN count(*) OVER f = 7 AND adj_low = min(adj_low) OVER f THEN adj_low END AS pivot_low
          FROM fx_bars WINDOW f AS ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""", "fx_bars", pivot_high=6, pivot_low=6)
query("w19_last_n_bars", lambda v: last_n(v.bars, 250).select("stock_id", "trade_date", "close"),
      "SELECT stock_id, trade_date, close FROM fx_bars QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 250",
      "fx_bars", close=6)
query("w20_last_12_bars", lambda v: last_n(v.bars, 12).select("stock_id", "trade_date", "adj_open", "adj_close"),
      "SELECT stock_id, trade_date, adj_open, adj_close FROM fx_bars QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 12",
      "fx_bars", adj_open=6, adj_close=6)
_OVERLAY = ", ".join(
    f"CASE WHEN count(*) OVER (w ROWS {n - 1} PRECEDING) = {n} THEN avg({x}) OVER (w ROWS {n - 1} PRECEDING) END AS {p}{n}"
    for p, x, sizes in (("ma", "adj_close", (5, 10, 20, 60, 120, 240)), ("vol_ma", "volume", (5, 20))) for n in sizes)
query("w21_chart_overlays",
      lambda v: chart_overlays(v.bars).select(
          "stock_id", "trade_date", *[f"ma{n}" for n in (5, 10, 20, 60, 120, 240)], "vol_ma5", "vol_ma20"),
      f"SELECT stock_id, trade_date, {_OVERLAY} FROM fx_bars WINDOW w AS ({W})", "fx_bars",
      **{f"ma{n}": 6 for n in (5, 10, 20, 60, 120, 240)}, vol_ma5=6, vol_ma20=6)
_RECURSIVE = {
    "fx_num": (("fx_bars",), f"""SELECT stock_id, trade_date, adj_close AS c, row_number() OVER ({W}) AS i,
        avg(adj_close) OVER ({W} ROWS 11 PRECEDING) AS a12, avg(adj_close) OVER ({W} ROWS 25 PRECEDING) AS a26,
        (adj_close - min(adj_low) OVER k) / CASE WHEN max(adj_high) OVER k = min(adj_low) OVER k THEN 1.0::DOUBLE
           ELSE max(adj_high) OVER k - min(adj_low) OVER k END * 100 AS rsv
        FROM fx_bars WINDOW k AS ({W} ROWS 8 PRECEDING)"""),
}
_RECURSIVE |= {
    "ema": (("fx_num",), """
        SELECT stock_id, trade_date, i, CASE WHEN i = 12 THEN a12 END AS e12, CASE WHEN i = 26 THEN a26 END AS e26,
               CASE WHEN i = 9 THEN (2 * 50.0::DOUBLE + rsv) / 3 END AS k,
               CASE WHEN i = 9 THEN (2 * 50.0::DOUBLE + (2 * 50.0::DOUBLE + rsv) / 3) / 3 END AS d
        FROM fx_num WHERE i = 1
        UNION ALL
        SELECT n.stock_id, n.trade_date, n.i,
          CASE WHEN n.i = 12 THEN n.a12 WHEN n.i > 12 THEN e.e12 * 11 / 13 + n.c * 2 / 13 END,
          CASE WHEN n.i = 26 THEN n.a26 WHEN n.i > 26 THEN e.e26 * 25 / 27 + n.c * 2 / 27 END,
          CASE WHEN n.i >= 9 THEN (2 * coalesce(e.k, 50.0::DOUBLE) + n.rsv) / 3 END,
          CASE WHEN n.i >= 9 THEN (2 * coalesce(e.d, 50.0::DOUBLE) + (2 * coalesce(e.k, 50.0::DOUBLE) + n.rsv) / 3) / 3 END
        FROM ema e JOIN fx_num n ON n.stock_id = e.stock_id AND n.i = e.i + 1"""),
    "dif": (("ema",), """SELECT *, e12 - e26 AS dif, avg(e12 - e26) OVER (PARTITION BY stock_id ORDER BY i ROWS 8 PRECEDING) AS a9 FROM ema"""),
    "dea": (("dif",), """
        SELECT stock_id, i, NULL::DOUBLE AS dea FROM dif WHERE i = 33
        UNION ALL
        SELECT f.stock_id, f.i, CASE WHEN f.i = 34 THEN f.a9 ELSE s.dea * 8 / 10 + f.dif * 2 / 10 END
        FROM dea s JOIN dif f ON f.stock_id = s.stock_id AND f.i = s.i + 1"""),
}
query("w22_macd_kdj", lambda v: macd_kdj(v.bars),
      """SELECT stock_id, trade_date, dif, dea, (dif - dea) * 2 AS macd, k, d, 3 * k - 2 * d AS j
      FROM dif LEFT JOIN dea USING (stock_id, i)""", "dif", "dea",
      extra=_RECURSIVE, dif=4, dea=4, macd=4, k=4, d=4, j=4)

# -- joins, set operations, dedupe ------------------------------------------------

_SEQ = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"


def _tick_seq():
    return ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


query("j02_trailing_calendar", lambda v: trailing_calendar(v.bars, "trade_date", 60).select("stock_id", "trade_date", "close"),
      "SELECT stock_id, trade_date, close FROM fx_bars WHERE trade_date > (SELECT max(trade_date) FROM fx_bars) - 60",
      "fx_bars", close=6)
query("p04_trailing_400_days", lambda v: trailing_calendar(v.bars, "trade_date", 400).groupBy("stock_id").agg(
          F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first_date")),
      """SELECT stock_id, count(*) AS n, min(trade_date) AS first_date FROM fx_bars
         WHERE trade_date > (SELECT max(trade_date) FROM fx_bars) - 400 GROUP BY 1""", "fx_bars")
query("j03_keep_known", lambda v: keep_known(v.bars, v.stock.filter(F.col("market") == "上市")).select("stock_id", "trade_date", "volume"),
      "SELECT stock_id, trade_date, volume FROM fx_bars WHERE stock_id IN (SELECT stock_id FROM fx_stock WHERE market = '上市')",
      "fx_bars", "fx_stock")
query("j04_prev_close_of_event",
      lambda v: around_events(dividend_events(v.dividend), v.bars).filter("prev_close is not null").select("stock_id", "ex_date", "prev_close"),
      """SELECT e.stock_id, e.ex_date, b.close AS prev_close FROM fx_events e ASOF JOIN fx_bars b
         ON e.stock_id = b.stock_id AND e.ex_date > b.trade_date""", "fx_events", "fx_bars", prev_close=6)
query("j05_landing_bar_of_event",
      lambda v: around_events(dividend_events(v.dividend), v.bars).filter("bar_date is not null").select("stock_id", "ex_date", "bar_date"),
      """SELECT e.stock_id, e.ex_date, b.trade_date AS bar_date FROM fx_events e ASOF JOIN fx_bars b
         ON e.stock_id = b.stock_id AND e.ex_date <= b.trade_date""", "fx_events", "fx_bars")
query("j09_close_on_or_latest",
      lambda v: close_on_or_latest(
          v.etf.select("stock_id", F.date_add("trade_date", (F.day("trade_date") % 2).cast("int")).alias("trade_date"), "nav"), v.bars
      ).select("stock_id", "trade_date", "nav", "close"),
      """SELECT e.stock_id, e.d AS trade_date, e.nav, coalesce(b.close, l.close) AS close
         FROM (SELECT *, (trade_date + (day(trade_date) % 2)::INT)::DATE AS d FROM fx_etf) e
         LEFT JOIN fx_bars b ON b.stock_id = e.stock_id AND b.trade_date = e.d
         LEFT JOIN (SELECT stock_id, arg_max(close, trade_date) AS close FROM fx_bars GROUP BY 1) l ON l.stock_id = e.stock_id""",
      "fx_etf", "fx_bars", nav=4, close=6)
query("j11_bars_with_stock",
      lambda v: mk.latest_bars(v.bars).join(v.stock, "stock_id").select("stock_id", "name", "industry", "market", "chg"),
      """SELECT stock_id, name, industry, market, chg FROM fx_latest JOIN fx_stock USING (stock_id)""", "fx_latest", "fx_stock",
      extra={"fx_latest": (("fx_bars",), f"""SELECT * FROM (SELECT stock_id, trade_date, close, amount,
        adj_close / nullif(lag(adj_close) OVER ({W}), 0) - 1 AS chg, lag(amount) OVER ({W}) AS prev_amount,
        row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) AS k FROM fx_bars
        WHERE trade_date > (SELECT max(trade_date) FROM fx_bars) - 15) WHERE k = 1""")}, chg=6)
query("j12_statement_known_at_bar",
      lambda v: as_of_known(v.bars.select("stock_id", "trade_date", "close"), v.quarterly, "available_date", ["period_date", "roe"])
      .select("stock_id", "trade_date", "period_date", "available_date", "roe"),
      """SELECT b.stock_id, b.trade_date, q.period_date, q.available_date, q.roe
         FROM fx_bars b ASOF LEFT JOIN fx_quarterly q ON b.stock_id = q.stock_id AND b.trade_date >= q.available_date""",
      "fx_bars", "fx_quarterly", roe=2)
query("p09_point_in_time", lambda v: point_in_time(v.quarterly, "available_date", "1999-06-30").select("stock_id", "period_date", "roe"),
      "SELECT stock_id, period_date, roe FROM fx_quarterly WHERE available_date <= DATE '1999-06-30'", "fx_quarterly", roe=2)
query("g28_keep_first_tick_of_day", lambda v: keep_first(v.ticks.select("stock_id", "d", "price", *_tick_seq()), ("stock_id", "d"), *_tick_seq())
      .select("stock_id", "d", "price"),
      f"SELECT stock_id, d, price FROM fx_ticks QUALIFY row_number() OVER (PARTITION BY stock_id, d ORDER BY {_SEQ}) = 1",
      "fx_ticks", price=6)
query("k01_upsert_last_wins", lambda v: keep_last(v.ticks.select("stock_id", "d", "price", *_tick_seq()), ("stock_id", "d"), *_tick_seq())
      .select("stock_id", "d", "price"),
      f"""SELECT stock_id, d, price FROM fx_ticks QUALIFY row_number() OVER (PARTITION BY stock_id, d ORDER BY
          l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) = 1""",
      "fx_ticks", price=6)
query("g30_latest_row", lambda v: latest_row(v.valuation, ["per", "pbr", "dividend_yield"]),
      """SELECT stock_id, per, pbr, dividend_yield FROM fx_valuation
         QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) = 1""", "fx_valuation",
      per=2, pbr=2, dividend_yield=2)
query("u01_union_markets",
      lambda v: union_all(*[v.bars.join(v.stock.filter(F.col("market") == m), "stock_id", "left_semi")
                            .select("stock_id", "trade_date", "volume", F.lit(m).alias("market")) for m in ("上市", "上櫃")]),
      "SELECT stock_id, trade_date, volume, market FROM fx_bars JOIN fx_stock USING (stock_id)", "fx_bars", "fx_stock")
query("u03_keyed_overlay",
      lambda v: overlay(
          v.bars.select("stock_id", "trade_date", "volume"),
          v.bars.join(v.stock.filter(F.col("security_type") == "etf"), "stock_id", "left_semi")
          .select("stock_id", "trade_date", (F.col("volume") * 2).alias("volume")), ("stock_id", "trade_date")),
      """SELECT stock_id, trade_date, CASE WHEN security_type = 'etf' THEN volume * 2 ELSE volume END AS volume
         FROM fx_bars JOIN fx_stock USING (stock_id)""", "fx_bars", "fx_stock")
query("u04_distinct_codes", lambda v: distinct_codes(v.ticks, v.stock),
      "SELECT stock_id FROM fx_ticks UNION SELECT stock_id FROM fx_stock", "fx_ticks", "fx_stock")
query("u05_requested_and_known",
      lambda v: requested_and_known(v.stock, v.ticks.filter("l_discount >= 0.10")),
      "SELECT stock_id FROM fx_stock INTERSECT SELECT stock_id FROM fx_ticks WHERE l_discount >= 0.10", "fx_stock", "fx_ticks")
query("u06_months_without_ticks",
      lambda v: v.revenue_raw.select("stock_id", "revenue_month").join(
          v.holder.filter("level = 15").select("stock_id", F.col("data_date").alias("revenue_month")).distinct(),
          ["stock_id", "revenue_month"], "left_anti"),
      """SELECT stock_id, revenue_month FROM fx_revenue EXCEPT
         SELECT stock_id, data_date FROM fx_holder WHERE level = 15""", "fx_revenue", "fx_holder")

# -- aggregates -------------------------------------------------------------------

LATEST = {"fx_latest": (("fx_bars",), f"""SELECT * FROM (SELECT stock_id, trade_date, close, amount,
    adj_close / nullif(lag(adj_close) OVER ({W}), 0) - 1 AS chg, lag(amount) OVER ({W}) AS prev_amount,
    row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) AS k FROM fx_bars
    WHERE trade_date > (SELECT max(trade_date) FROM fx_bars) - 15) WHERE k = 1""")}
query("g09_market_breadth", lambda v: mk.breadth(v.bars),
      """SELECT max(trade_date) AS as_of, count(*) FILTER (chg > 0) AS up, count(*) FILTER (chg < 0) AS down,
         count(*) FILTER (chg = 0) AS flat, sum(amount)::BIGINT AS total_amount FROM fx_latest""", "fx_latest", extra=LATEST)
for _m, _tag, _where in (("上市", "listed", "LIKE '上市%'"), ("上櫃", "otc", "= '上櫃'")):
    query(f"g10_sectors_{_tag}", lambda v, m=_m: mk.sectors(v.bars, v.stock, m),
          f"""SELECT industry, avg(chg * 100) AS avg_pct, count(*) AS n, arg_min(stock_id, (-chg, stock_id)) AS top_id,
              arg_min(name, (-chg, stock_id)) AS top_name, max(chg) * 100 AS top_pct
              FROM fx_latest JOIN fx_stock USING (stock_id) WHERE chg IS NOT NULL AND market {_where} GROUP BY 1""",
          "fx_latest", "fx_stock", extra=LATEST, avg_pct=2, top_pct=2)
    query(f"g11_money_flow_{_tag}", lambda v, m=_m: mk.money_flow(v.bars, v.stock, m),
          f"""SELECT industry, t / sum(t) OVER () * 100 AS share_pct,
                (t / sum(t) OVER () - p / sum(p) OVER ()) * 100 AS chg_pct
              FROM (SELECT industry, sum(amount)::DOUBLE AS t, sum(prev_amount)::DOUBLE AS p
                    FROM fx_latest JOIN fx_stock USING (stock_id) WHERE market {_where} GROUP BY 1)""",
          "fx_latest", "fx_stock", extra=LATEST, share_pct=2, chg_pct=2)
query("w15_share_of_total", lambda v: mk.money_flow(v.bars, v.stock, "上市").select("industry", "share_pct"),
      """SELECT industry, sum(amount)::DOUBLE / sum(sum(amount)) OVER () * 100 AS share_pct
         FROM fx_latest JOIN fx_stock USING (stock_id) WHERE market LIKE '上市%' GROUP BY 1""",
      "fx_latest", "fx_stock", extra=LATEST, share_pct=2)
query("p06_market_filter", lambda v: v.stock.filter(mk.on_market("上市")).select("stock_id", "market"),
      "SELECT stock_id, market FROM fx_stock WHERE market LIKE '上市%'", "fx_stock")
for _kind, _order in (("gainers", "chg DESC"), ("losers", "chg ASC"), ("active", "amount DESC")):
    query(f"t02_movers_{_kind}", lambda v, k=_kind: mk.movers(v.bars, v.stock, k, 15),
          f"""SELECT stock_id, name, industry, chg * 100 AS chg_pct, close, amount FROM fx_latest JOIN fx_stock USING (stock_id)
              WHERE amount >= 20000000 AND chg IS NOT NULL ORDER BY {_order}, stock_id LIMIT 15""",
          "fx_latest", "fx_stock", extra=LATEST, chg_pct=2, close=6)
query("t02_movers_all", lambda v: mk.movers(v.bars, v.stock, "gainers", None, min_amount=0),
      """SELECT stock_id, name, industry, chg * 100 AS chg_pct, close, amount FROM fx_latest JOIN fx_stock USING (stock_id)
         WHERE amount >= 0 AND chg IS NOT NULL""", "fx_latest", "fx_stock", extra=LATEST, chg_pct=2, close=6)
for _unit in ("week", "month"):
    query(f"g12_resample_{_unit}", lambda v, u=_unit: sv.resample_bars(v.bars, u),
          f"""SELECT stock_id, date_trunc('{_unit}', trade_date)::DATE AS trade_date, arg_min(adj_open, trade_date) AS open,
              max(adj_high) AS high, min(adj_low) AS low, arg_max(adj_close, trade_date) AS close, sum(volume)::BIGINT AS volume
              FROM fx_bars GROUP BY 1, 2""", "fx_bars", open=6, high=6, low=6, close=6)
query("g13_period_end_quarter", lambda v: sv.period_end(v.margin, "quarter"),
      """SELECT stock_id, date_trunc('quarter', trade_date)::DATE AS trade_date,
         arg_max(margin_balance, trade_date) AS margin_balance, arg_max(short_balance, trade_date) AS short_balance
         FROM fx_margin GROUP BY 1, 2""", "fx_margin")
query("g14_ttm_dividends", lambda v: sv.ttm_dividends(v.dividend, v.bars),
      """SELECT stock_id, coalesce(cash, 0) AS ttm_cash, coalesce(n, 0) AS ttm_count,
           nullif(coalesce(cash, 0), 0) / close * 100 AS ttm_yield
         FROM (SELECT stock_id, arg_max(close, trade_date) AS close FROM fx_bars GROUP BY 1)
         LEFT JOIN (SELECT stock_id, round(sum(cash_dividend), 4) AS cash, count(*) AS n FROM fx_dividend
           WHERE ex_cash_date >= (SELECT max(trade_date) FROM fx_bars) - 365 GROUP BY 1) USING (stock_id)""",
      "fx_bars", "fx_dividend", ttm_cash=4, ttm_yield=2)
query("g19_dividend_events", lambda v: dividend_events(v.dividend), "SELECT * FROM fx_events", "fx_events", cash=6, stock=6)
query("g19_reduction_events", lambda v: reduction_events(v.reduction), "SELECT * FROM fx_cuts", "fx_cuts", reduction=8)
query("f24_event_ratios",
      lambda v: around_events(dividend_events(v.dividend), v.bars).select(
          "stock_id", "ex_date", dividend_ratio(F.col("prev_close"), F.col("cash"), F.col("stock")).alias("ratio")).filter("ratio > 0"),
      """SELECT e.stock_id, e.ex_date, (b.close - e.cash) / (b.close * (1 + e.stock / 10)) AS ratio
         FROM fx_events e ASOF JOIN fx_bars b ON e.stock_id = b.stock_id AND e.ex_date > b.trade_date""",
      "fx_events", "fx_bars", ratio=8)
query("d05_adjust_prices",
      lambda v: v.adjusted.select("stock_id", "trade_date", "adj_open", "adj_high", "adj_low", "adj_close", "adj_factor"),
      "SELECT stock_id, trade_date, adj_open, adj_high, adj_low, adj_close, adj_factor FROM fx_adjusted", "fx_adjusted",
      adj_factor=8)
query("g20_best_dividend", lambda v: v.dividend, "SELECT * FROM fx_dividend", "fx_dividend", cash_dividend=6, stock_dividend=6)
query("g26_coverage", lambda v: ql.coverage(v.revenue_raw.join(v.stock, "stock_id"), "revenue_month", "market"),
      """SELECT market, count(*) AS rows, count(DISTINCT revenue_month) AS dates, min(revenue_month) AS first_date,
         max(revenue_month) AS last_date FROM fx_revenue JOIN fx_stock USING (stock_id) GROUP BY 1""", "fx_revenue", "fx_stock")
query("g27_max_date_per_month", lambda v: ql.newest_per_month(v.bars),
      "SELECT stock_id, date_trunc('month', trade_date)::DATE AS month, max(trade_date) AS max_date FROM fx_bars GROUP BY 1, 2",
      "fx_bars")
_COUNTED = {
    "stock": "fx_stock", "price_daily": "fx_bars", "market_index": "fx_index", "fundamentals_quarterly": "fx_quarterly",
    "monthly_revenue": "fx_revenue", "valuation_daily": "fx_valuation", "inst_trades": "fx_inst", "margin_trading": "fx_margin",
    "shareholding": "fx_shareholding", "shareholding_dist": "fx_holder",
}
query("g31_table_counts",
      lambda v: table_counts(v.tables),
      " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {f}" for t, f in _COUNTED.items()), *_COUNTED.values())

# -- index and per-security views ----------------------------------------------------

query("d41_index_quotes", lambda v: mk.index_quotes(v.index),
      """SELECT index_id, trade_date, close, close - p AS change, (close / nullif(p, 0) - 1) * 100 AS pct FROM (
           SELECT *, lag(close) OVER (PARTITION BY index_id ORDER BY trade_date) AS p,
             row_number() OVER (PARTITION BY index_id ORDER BY trade_date DESC) AS k FROM fx_index) WHERE k = 1""",
      "fx_index", close=4, change=4, pct=4)


def _overview(v: Views):
    o = mk.market_overview(v.bars, v.index)
    return o.select("as_of", "up", "down", "flat", "total_amount", F.col("taiex.close").alias("taiex_close"),
                    F.col("taiex.pct").alias("taiex_pct"), F.col("tpex.close").alias("tpex_close"), F.col("tpex.pct").alias("tpex_pct"))


_QUOTE = """(SELECT {what} FROM (SELECT close, (close / nullif(lag(close) OVER (ORDER BY trade_date), 0) - 1) * 100 AS pct,
   trade_date FROM fx_index WHERE index_id = '{i}') ORDER BY trade_date DESC LIMIT 1)"""
query("d42_market_overview", _overview,
      f"""SELECT max(trade_date) AS as_of, count(*) FILTER (chg > 0) AS up, count(*) FILTER (chg < 0) AS down,
         count(*) FILTER (chg = 0) AS flat, sum(amount)::BIGINT AS total_amount,
         {_QUOTE.format(what='close', i='TAIEX')} AS taiex_close, {_QUOTE.format(what='pct', i='TAIEX')} AS taiex_pct,
         {_QUOTE.format(what='close', i='TPEx')} AS tpex_close, {_QUOTE.format(what='pct', i='TPEx')} AS tpex_pct
         FROM fx_latest""", "fx_latest", "fx_index", extra=LATEST, taiex_close=4, taiex_pct=4, tpex_close=4, tpex_pct=4)
query("d43_index_series", lambda v: mk.index_series(v.index, "TPEx", 120),
      "SELECT trade_date, close FROM fx_index WHERE index_id = 'TPEx' ORDER BY trade_date DESC LIMIT 120", "fx_index", close=4)
query("d44_prices_daily", lambda v: sv.prices(v.bars, "D", 250),
      """SELECT stock_id, trade_date, adj_open AS open, adj_high AS high, adj_low AS low, adj_close AS close, volume FROM fx_bars
         QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 250""", "fx_bars",
      open=6, high=6, low=6, close=6)
query("p12_raw_or_adjusted", lambda v: sv.prices(v.adjusted, "D", 60, adjusted=False),
      """SELECT stock_id, trade_date, open, high, low, close, volume FROM fx_bars
         QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 60""", "fx_bars",
      open=6, high=6, low=6, close=6)
query("d44_prices_month", lambda v: sv.prices(v.bars, "M", 24),
      """SELECT stock_id, date_trunc('month', trade_date)::DATE AS trade_date, arg_min(adj_open, trade_date) AS open,
         max(adj_high) AS high, min(adj_low) AS low, arg_max(adj_close, trade_date) AS close, sum(volume)::BIGINT AS volume
         FROM fx_bars GROUP BY 1, 2
         QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY date_trunc('month', trade_date)::DATE DESC) <= 24""",
      "fx_bars", open=6, high=6, low=6, close=6)
query("d45_chips", lambda v: sv.chips(v.inst, v.margin, 60),
      """SELECT stock_id, trade_date, inst_net, foreign_net, trust_net, margin_balance, short_balance FROM (
           SELECT stock_id, trade_date, coalesce(foreign_net, 0) + coalesce(trust_net, 0) + coalesce(dealer_self_net, 0) AS inst_net,
             foreign_net, trust_net FROM fx_inst QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 60)
         FULL JOIN (SELECT stock_id, trade_date, margin_balance, short_balance FROM fx_margin
           QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 60) USING (stock_id, trade_date)""",
      "fx_inst", "fx_margin")
query("f32_null_safe_net",
      lambda v: v.inst.select("stock_id", "trade_date", net_of(*[F.col(c) for c in sv.NET_PARTS]).alias("inst_net")),
      """SELECT stock_id, trade_date, coalesce(foreign_net, 0) + coalesce(trust_net, 0) + coalesce(dealer_self_net, 0) AS inst_net
         FROM fx_inst""", "fx_inst")
query("d40_etf_latest", lambda v: sv.etf_latest(v.etf, v.bars),
      """SELECT e.*, b.close, CASE WHEN b.close <> 0 AND nav <> 0 THEN (b.close - nav) / nav * 100 END AS premium_discount
         FROM (SELECT * FROM fx_etf QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) = 1) e
         JOIN fx_bars b USING (stock_id, trade_date)""", "fx_etf", "fx_bars",
      nav=4, prev_nav=4, aum=1, close=6, premium_discount=3)
query("d40_etf_history", lambda v: sv.etf_history(v.etf).select("stock_id", "trade_date", "nav", "units"),
      "SELECT stock_id, trade_date, nav, units FROM fx_etf QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 60",
      "fx_etf", nav=4)
query("d47_dividend_history", lambda v: sv.dividend_history(v.dividend),
      """SELECT * FROM fx_dividend QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY ex_cash_date DESC) <= 36""",
      "fx_dividend", cash_dividend=4, stock_dividend=4)
query("t08_revenue_history", lambda v: sv.revenue_history(v.revenue).select("stock_id", "revenue_month", "revenue"),
      "SELECT stock_id, revenue_month, revenue FROM fx_revenue QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY revenue_month DESC) <= 24",
      "fx_revenue")
query("d48_quarterly_history", lambda v: sv.quarterly_history(v.quarterly).select("stock_id", "period_date", "revenue", "net_income", "eps", "roe"),
      """SELECT stock_id, period_date, revenue, net_income, eps, roe FROM fx_quarterly
         QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY period_date DESC) <= 12""", "fx_quarterly", roe=2)

# -- statements -----------------------------------------------------------------------

ITEM_NAMES = ("Revenue", "GrossProfit", "OperatingIncome", "NetIncome", "EPS", "TotalAssets", "Equity", "Liabilities")


def _pivot(v: Views):
    from equilens.operators.fundamentals import pivot_statement

    long = v.statement.select("stock_id", F.col("period_date").alias("date"), F.col("item").alias("type"), "value")
    return pivot_statement(long, ITEM_NAMES)


query("g15_pivot_statement", _pivot,
      "SELECT stock_id, date, " + ", ".join(f'"{i}"::DOUBLE AS "{i}"' for i in ITEM_NAMES) + " FROM fx_statement_wide",
      "fx_statement_wide")


def _investors(v: Views):
    from equilens.operators.fundamentals import pivot_investor_net

    flows = v.ticks.select(
        "stock_id", F.col("trade_date").alias("date"),
        F.when(F.col("l_linenumber") == 1, "Foreign").when(F.col("l_linenumber") == 2, "Trust").otherwise("Dealer").alias("name"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_quantity").cast("bigint")).alias("buy"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("bigint")).otherwise(0).alias("sell"),
    )
    return pivot_investor_net(flows, ("Foreign", "Trust", "Dealer"))


query("g16_pivot_investor_net", _investors,
      """SELECT stock_id, trade_date AS date, foreign_net AS "Foreign_net", trust_net AS "Trust_net",
         dealer_self_net AS "Dealer_net" FROM fx_inst""", "fx_inst")
query("g17_unpivot_statement", lambda v: v.statement, "SELECT * FROM fx_statement", "fx_statement")
query("g18_build_quarterly", lambda v: v.quarterly, "SELECT * FROM fx_quarterly", "fx_quarterly",
      gross_margin=2, op_margin=2, net_margin=2, roe=2, debt_ratio=2)


def _holders(v: Views):
    from equilens.operators.fundamentals import holders_at_least

    return holders_at_least(v.holder)


def _top_holders(v: Views):
    from equilens.operators.fundamentals import top_holders

    return top_holders(v.holder).select("stock_id", "data_date", "pct")


query("g24_holders_400_lots", _holders, "SELECT stock_id, data_date, sum(pct) AS pct FROM fx_holder WHERE level >= 12 GROUP BY 1, 2",
      "fx_holder", pct=4)
query("g25_holders_1000_lots", _top_holders, "SELECT stock_id, data_date, pct FROM fx_holder WHERE level = 15", "fx_holder", pct=4)

# -- scalar functions over the tables -----------------------------------------------------

query("f10_revenue_available", lambda v: v.revenue_raw.select("stock_id", "revenue_month", revenue_available(F.col("revenue_month")).alias("available")),
      "SELECT stock_id, revenue_month, available_date AS available FROM fx_revenue", "fx_revenue")
query("f12_statement_available", lambda v: v.statement_wide.select("stock_id", "date", statement_available(F.col("date")).alias("available")),
      "SELECT DISTINCT stock_id, period_date AS date, available_date AS available FROM fx_statement", "fx_statement")
query("f13_pct", lambda v: v.statement_wide.select("stock_id", "date", pct(F.col("GrossProfit"), F.col("Revenue")).alias("margin")),
      'SELECT stock_id, date, "GrossProfit"::DOUBLE / nullif("Revenue", 0) * 100 AS margin FROM fx_statement_wide',
      "fx_statement_wide", margin=2)
query("f15_clamp", lambda v: v.bars.select("stock_id", "trade_date", clamp(F.col("close"), 1000.0, 3000.0).alias("clamped")),
      "SELECT stock_id, trade_date, least(greatest(close, 1000), 3000) AS clamped FROM fx_bars", "fx_bars", clamped=6)
query("f22_effective_start", lambda v: v.stock.select("stock_id", effective_start(F.col("list_date"), F.col("market")).alias("start")),
      """SELECT stock_id, greatest(date_trunc('month', list_date)::DATE,
           CASE WHEN market = '上櫃' THEN DATE '1994-01-01' ELSE DATE '2010-01-01' END) AS start FROM fx_stock""", "fx_stock")
query("f25_candle_anatomy",
      lambda v: anatomy(v.bars).select("stock_id", "trade_date", "range", "body", "upper_shadow", "lower_shadow", "white", "midpoint"),
      """SELECT stock_id, trade_date, adj_high - adj_low AS range, abs(adj_close - adj_open) AS body,
         adj_high - greatest(adj_open, adj_close) AS upper_shadow, least(adj_open, adj_close) - adj_low AS lower_shadow,
         adj_close > adj_open AS white, (adj_open + adj_close) / 2 AS midpoint FROM fx_bars""", "fx_bars",
      range=5, body=5, upper_shadow=5, lower_shadow=5, midpoint=5)
query("f27_calendar_labels",
      lambda v: v.ticks.select("d").distinct().select(
          "d", iso_week_label(F.col("d")).alias("week"), publishable_quarter(F.col("d")).alias("quarter"),
          in_dividend_season(F.col("d")).alias("season")),
      """SELECT d, isoyear(d) || 'W' || lpad(weekofyear(d)::VARCHAR, 2, '0') AS week,
         CASE WHEN month(d) = 4 THEN (year(d) - 1) || 'Q4' WHEN month(d) = 5 AND day(d) >= 16 THEN year(d) || 'Q1'
              WHEN month(d) = 8 AND day(d) >= 15 THEN year(d) || 'Q2' WHEN month(d) = 11 AND day(d) >= 15 THEN year(d) || 'Q3'
         END AS quarter, month(d) BETWEEN 5 AND 8 AND dayofweek(d) IN (0, 6) AS season
         FROM (SELECT DISTINCT d FROM fx_ticks)""", "fx_ticks")
query("f30_calendar_predicates",
      lambda v: v.ticks.select("d").distinct().select("d", is_weekend(F.col("d")).alias("weekend"), in_revenue_window(F.col("d")).alias("revenue_window")),
      "SELECT d, dayofweek(d) IN (0, 6) AS weekend, day(d) BETWEEN 11 AND 20 AS revenue_window FROM (SELECT DISTINCT d FROM fx_ticks)",
      "fx_ticks")
query("f26_bar_ratios", lambda v: with_baseline(v.bars).select("stock_id", "trade_date", "vr", "sr", "pos"),
      "SELECT stock_id, trade_date, vr, sr, pos FROM fx_vpa", "fx_vpa", vr=6, sr=6, pos=6,
      extra={"fx_vpa": (("fx_bars",), f"""SELECT stock_id, trade_date,
        CASE WHEN ok THEN volume / va END AS vr, CASE WHEN ok THEN (adj_high - adj_low) / sa END AS sr,
        CASE WHEN ok THEN (adj_close - adj_low) / (adj_high - adj_low) END AS pos
        FROM (SELECT *, va > 0 AND sa > 0 AND adj_high > adj_low AND pc IS NOT NULL AS ok FROM (
          SELECT *, avg(volume) OVER p AS va, avg(adj_high - adj_low) OVER p AS sa, lag(adj_close) OVER ({W}) AS pc
          FROM fx_bars WINDOW p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)))""")})

# -- levels -------------------------------------------------------------------------------

LEVELS = {
    "fx_lv": (("fx_bars",), """SELECT *, count(*) OVER (PARTITION BY stock_id) AS bars,
        first_value(adj_close) OVER (PARTITION BY stock_id ORDER BY trade_date DESC) AS c FROM (
        SELECT * FROM fx_bars QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 120)"""),
    "fx_pv": (("fx_lv",), f"""SELECT stock_id, c, side, v, row_number() OVER (PARTITION BY stock_id, side ORDER BY v) AS i FROM (
        SELECT stock_id, c, bars, 'high' AS side, CASE WHEN count(*) OVER f = 7 AND adj_high = max(adj_high) OVER f THEN adj_high END AS v
        FROM fx_lv WINDOW f AS ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
        UNION ALL
        SELECT stock_id, c, bars, 'low', CASE WHEN count(*) OVER f = 7 AND adj_low = min(adj_low) OVER f THEN adj_low END
        FROM fx_lv WINDOW f AS ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE v IS NOT NULL AND bars >= 20"""),
}
LEVELS |= {
    "walk": (("fx_pv",), """
    SELECT stock_id, c, side, i, v AS total, 1 AS n, 1 AS grp FROM fx_pv WHERE i = 1
    UNION ALL
    SELECT p.stock_id, p.c, p.side, p.i,
      CASE WHEN abs(p.v - w.total / w.n) <= 0.02::DOUBLE * (w.total / w.n) THEN w.total + p.v ELSE p.v END,
      CASE WHEN abs(p.v - w.total / w.n) <= 0.02::DOUBLE * (w.total / w.n) THEN w.n + 1 ELSE 1 END,
      CASE WHEN abs(p.v - w.total / w.n) <= 0.02::DOUBLE * (w.total / w.n) THEN w.grp ELSE w.grp + 1 END
    FROM walk w JOIN fx_pv p ON p.stock_id = w.stock_id AND p.side = w.side AND p.i = w.i + 1"""),
    "clusters": (("walk",), """SELECT stock_id, c AS close, side, round((arg_max(total, i) / max(n))::DECIMAL(30, 7), 2)::DOUBLE AS price, max(n) AS touches
               FROM walk GROUP BY stock_id, c, side, grp"""),
    "usable": (("clusters",), """SELECT *, abs(price - close) AS gap FROM clusters
        WHERE (side = 'high' AND price > close * 1.005::DOUBLE) OR (side = 'low' AND price < close * 0.995::DOUBLE)"""),
    "ranked": (("usable",), """SELECT *, row_number() OVER (PARTITION BY stock_id, side ORDER BY touches DESC, gap) AS a,
        row_number() OVER (PARTITION BY stock_id, side ORDER BY gap, touches DESC) AS b FROM usable"""),
    "neck": (("ranked",), "SELECT * FROM ranked WHERE side = 'low' AND a = 1"),
}
query("d33_level_clusters", lambda v: level_clusters(v.bars, 120).select("stock_id", "side", "price", "touches"),
      "SELECT stock_id, side, price, touches FROM clusters", "clusters", extra=LEVELS)
query("d33_levels", lambda v: levels(v.bars, 120),
      """SELECT stock_id, 'resistance' AS type, '壓力' AS label, price, touches FROM ranked WHERE side = 'high' AND a = 1
        UNION ALL SELECT stock_id, 'neckline', '頸線', price, touches FROM neck
        UNION ALL SELECT r.stock_id, 'support', '近期支撐', r.price, r.touches FROM ranked r JOIN neck n USING (stock_id)
          WHERE r.side = 'low' AND r.b = 1 AND abs(r.price - n.price) > 0.02::DOUBLE * n.price""",
      "neck", extra=LEVELS)
query("t06_level_ranking", lambda v: levels(v.bars, 800).filter("type = 'resistance'").select("stock_id", "price", "touches"),
      """SELECT stock_id, price, touches FROM clusters WHERE side = 'high' AND price > close * 1.005::DOUBLE
        QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY touches DESC, abs(price - close)) = 1""",
      "clusters", extra={**LEVELS, "fx_lv": (("fx_bars",), LEVELS["fx_lv"][1].replace("<= 120", "<= 800"))})

# -- quality ------------------------------------------------------------------------------

query("q01_duplicate_keys", lambda v: ql.duplicate_keys(v.ticks, ("l_orderkey", "l_linenumber")),
      "SELECT l_orderkey, l_linenumber, count(*) AS n FROM fx_ticks GROUP BY 1, 2 HAVING count(*) > 1", "fx_ticks")
query("q02_unknown_keys", lambda v: ql.unknown_keys(v.bars, v.stock.filter("security_type = 'stock'")),
      "SELECT DISTINCT stock_id FROM fx_bars WHERE stock_id NOT IN (SELECT stock_id FROM fx_stock WHERE security_type = 'stock')",
      "fx_bars", "fx_stock")
query("q03_month_completeness", lambda v: ql.all_month_completeness(v.bars),
      """SELECT stock_id, month, max_date, CASE WHEN max_date >= last_day THEN 'complete' ELSE 'short' END AS status
         FROM (SELECT stock_id, date_trunc('month', trade_date)::DATE AS month, max(trade_date) AS max_date FROM fx_bars GROUP BY 1, 2)
         JOIN (SELECT date_trunc('month', trade_date)::DATE AS month, max(trade_date) AS last_day FROM fx_bars GROUP BY 1) USING (month)""",
      "fx_bars")
query("j13_completeness_one_month", lambda v: ql.month_completeness(v.bars, v.stock, "1999-06-01"),
      """SELECT stock_id, max_date, CASE WHEN max_date IS NULL THEN 'missing' WHEN max_date >=
           (SELECT max(trade_date) FROM fx_bars WHERE date_trunc('month', trade_date) = DATE '1999-06-01') THEN 'complete'
           ELSE 'short' END AS status
         FROM fx_stock LEFT JOIN (SELECT stock_id, max(trade_date) AS max_date FROM fx_bars
           WHERE date_trunc('month', trade_date) = DATE '1999-06-01' GROUP BY 1) USING (stock_id)""", "fx_stock", "fx_bars")
query("g29_completeness_counts", lambda v: ql.completeness_counts(ql.all_month_completeness(v.bars)),
      """SELECT CASE WHEN max_date >= last_day THEN 'complete' ELSE 'short' END AS status, count(*) AS n
         FROM (SELECT stock_id, date_trunc('month', trade_date)::DATE AS month, max(trade_date) AS max_date FROM fx_bars GROUP BY 1, 2)
         JOIN (SELECT date_trunc('month', trade_date)::DATE AS month, max(trade_date) AS last_day FROM fx_bars GROUP BY 1) USING (month)
         GROUP BY 1""", "fx_bars")
query("q04_trading_calendar", lambda v: ql.trading_calendar(v.bars),
      "SELECT DISTINCT trade_date, date_trunc('month', trade_date)::DATE AS month FROM fx_bars", "fx_bars")
_GRID = """SELECT stock_id, unnest(generate_series(greatest(date_trunc('month', list_date)::DATE,
   CASE WHEN market = '上櫃' THEN DATE '1994-01-01' ELSE DATE '2010-01-01' END)::TIMESTAMP, TIMESTAMP '2012-12-01',
   INTERVAL 1 MONTH))::DATE AS month FROM fx_stock"""
query("q05_backfill_plan", lambda v: ql.backfill_plan(v.stock, v.bars, "2012-12-01"),
      f"""SELECT * FROM ({_GRID}) EXCEPT SELECT stock_id, date_trunc('month', trade_date)::DATE FROM fx_bars""",
      "fx_stock", "fx_bars")
query("j14_backfill_with_empty_log",
      lambda v: ql.backfill_plan(v.stock, v.bars, "2012-12-01",
                                 v.revenue_raw.select("stock_id", F.add_months("revenue_month", 96).alias("month"))),
      f"""SELECT * FROM ({_GRID}) EXCEPT SELECT stock_id, date_trunc('month', trade_date)::DATE FROM fx_bars
          EXCEPT SELECT stock_id, (revenue_month + INTERVAL 96 MONTH)::DATE FROM fx_revenue""",
      "fx_stock", "fx_bars", "fx_revenue")
