"""Candle, volume-price, snapshot, screen, diagnosis, ledger, portfolio and news queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.market_queries import LEVELS
from checks.registry import query
from checks.views import ID_BLOCK, LOOKBACK_DAYS, Views
from equilens.functions.parse import is_security_code, strip_tags
from equilens.functions.windows import trailing_calendar, with_age
from equilens.operators import candles as cd
from equilens.operators import ledger as lg
from equilens.operators import news as nw
from equilens.operators import vpa
from equilens.operators.market import index_ratio
from equilens.plans import portfolio as pf
from equilens.plans import screen as sc
from equilens.plans import snapshot as sn
from equilens.plans.diagnose import diagnose
from equilens.sinks.tables import export_screen
from equilens.streaming.jobs import bars_from_events

W = "PARTITION BY stock_id ORDER BY trade_date"

# -- candles ------------------------------------------------------------------


def _trend(start: int, look: int) -> str:
    f = f"({W} ROWS BETWEEN {start + look - 1} PRECEDING AND {start} PRECEDING)"
    return (f"CASE WHEN count(adj_close) OVER {f} < 2 THEN 0 ELSE sign(lag(adj_close, {start}) OVER ({W}) - "
            f"first_value(adj_close) OVER {f}) END")


_LAGS = ", ".join(
    f"lag(adj_{name}, {back}) OVER ({W}) AS {'pq'[back - 1]}{name[0]}"
    for back in (1, 2) for name in ("open", "high", "low", "close"))
_CANDLE = {
    "fx_cl": (("fx_bars",), f"""SELECT stock_id, trade_date, adj_open AS ao, adj_high AS ah, adj_low AS al, adj_close AS ac,
        {_LAGS}, {_trend(1, 5)} AS t1, {_trend(2, 5)} AS t2, {_trend(3, 5)} AS t3 FROM fx_bars"""),
    "fx_body": (("fx_cl",), """SELECT *, ah - al AS rng, abs(ac - ao) AS body, ah - greatest(ao, ac) AS up, least(ao, ac) - al AS lo,
        ac > ao AS aw, pc > po AS pw, qc > qo AS qw, abs(pc - po) AS pbody, ph - pl AS prng, abs(qc - qo) AS qbody, qh - ql AS qrng,
        (po + pc) / 2 AS pmid, (qo + qc) / 2 AS qmid FROM fx_cl"""),
    "fx_pat": (("fx_body",), """SELECT stock_id, trade_date,
        coalesce(rng > 0 AND body <= 0.1 * rng, false) AS doji,
        coalesce(rng > 0 AND lo >= 2 * body AND up <= 0.3 * rng AND body > 0 AND body <= 0.4 * rng AND t1 < 0, false) AS hammer,
        coalesce(rng > 0 AND lo >= 2 * body AND up <= 0.3 * rng AND body > 0 AND body <= 0.4 * rng AND t1 >= 0, false) AS hanging_man,
        coalesce(rng > 0 AND up >= 2 * body AND lo <= 0.3 * rng AND body > 0 AND body <= 0.4 * rng AND t1 < 0, false) AS inverted_hammer,
        coalesce(rng > 0 AND up >= 2 * body AND lo <= 0.3 * rng AND body > 0 AND body <= 0.4 * rng AND t1 >= 0, false) AS shooting_star,
        coalesce(rng > 0 AND NOT pw AND aw AND ac >= po AND ao <= pc AND body > pbody, false) AS bull_engulfing,
        coalesce(rng > 0 AND pw AND NOT aw AND ao >= pc AND ac <= po AND body > pbody, false) AS bear_engulfing,
        coalesce(rng > 0 AND t2 < 0 AND NOT pw AND aw AND ao < pl AND pmid < ac AND ac < po, false) AS piercing,
        coalesce(rng > 0 AND t2 > 0 AND pw AND NOT aw AND ao > ph AND po < ac AND ac < pmid, false) AS dark_cloud,
        coalesce(rng > 0 AND prng > 0 AND pbody >= 0.6 * prng AND greatest(ao, ac) <= greatest(po, pc)
          AND least(ao, ac) >= least(po, pc) AND body < pbody AND NOT pw AND aw, false) AS bull_harami,
        coalesce(rng > 0 AND prng > 0 AND pbody >= 0.6 * prng AND greatest(ao, ac) <= greatest(po, pc)
          AND least(ao, ac) >= least(po, pc) AND body < pbody AND pw AND NOT aw, false) AS bear_harami,
        coalesce(rng > 0 AND t3 < 0 AND qrng > 0 AND qbody >= 0.6 * qrng AND NOT qw AND pbody <= 0.4 * greatest(prng, 1e-9)
          AND aw AND ac > qmid AND greatest(po, pc) < qc, false) AS morning_star,
        coalesce(rng > 0 AND t3 > 0 AND qrng > 0 AND qbody >= 0.6 * qrng AND qw AND pbody <= 0.4 * greatest(prng, 1e-9)
          AND NOT aw AND ac < qmid AND least(po, pc) > qc, false) AS evening_star,
        coalesce(rng > 0 AND qw AND pw AND aw AND ac > pc AND pc > qc AND qo < po AND po < ao AND po <= qc AND ao <= pc, false) AS three_soldiers,
        coalesce(rng > 0 AND NOT qw AND NOT pw AND NOT aw AND ac < pc AND pc < qc AND qo > po AND po > ao, false) AS three_crows
        FROM fx_body"""),
}


def _flag_counts(flags: DataFrame, key: str) -> DataFrame:
    return flags.groupBy("stock_id").agg(
        F.count_if(F.col(key)).alias("n"), F.max(F.when(F.col(key), F.col("trade_date"))).alias("last_date"))


_COUNT = """SELECT stock_id, count(*) FILTER ({k}) AS n, max(trade_date) FILTER ({k}) AS last_date FROM {src} GROUP BY 1"""
for _i, _key in enumerate((
    "doji", "hammer", "hanging_man", "inverted_hammer", "shooting_star", "bull_engulfing", "bear_engulfing", "piercing",
    "dark_cloud", "bull_harami", "bear_harami", "morning_star", "evening_star", "three_soldiers", "three_crows",
), 7):
    query(f"d{_i:02d}_{_key}", lambda v, k=_key: _flag_counts(cd.pattern_flags(v.bars), k), _COUNT.format(k=_key, src="fx_pat"),
          "fx_pat", extra=_CANDLE)
_NAMES = " UNION ALL ".join(f"SELECT '{k}' AS pattern, '{n}' AS name, '{d}' AS dir" for k, (n, d) in cd.CATALOG.items())
_EVENTS = {
    **_CANDLE,
    "fx_events_long": (("fx_pat",), f"""SELECT stock_id, trade_date, pattern FROM fx_pat UNPIVOT (hit FOR pattern IN
        ({', '.join(cd.CATALOG)})) WHERE hit"""),
    "fx_catalog": ((), _NAMES),
}
query("d28_pattern_events", lambda v: cd.pattern_events(v.bars, 90),
      """SELECT stock_id, trade_date, pattern, name, dir FROM fx_events_long JOIN fx_catalog USING (pattern)
         JOIN (SELECT stock_id, trade_date FROM fx_bars QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 90)
         USING (stock_id, trade_date)""", "fx_events_long", "fx_catalog", extra=_EVENTS)
query("d29_last_patterns",
      lambda v: cd.last_patterns(v.bars).select(
          "stock_id", "trade_date", F.array_join(F.array_sort(F.transform("last_patterns", lambda p: p["name"])), "、").alias("names")),
      """SELECT stock_id, trade_date, coalesce(string_agg(name, '、' ORDER BY name), '') AS names
         FROM (SELECT stock_id, max(trade_date) AS trade_date FROM fx_bars GROUP BY 1)
         LEFT JOIN (SELECT * FROM fx_events_long JOIN fx_catalog USING (pattern)) USING (stock_id, trade_date) GROUP BY 1, 2""",
      "fx_events_long", "fx_catalog", extra=_EVENTS)


def _signed(v: Views) -> DataFrame:
    marks = [f"cdl_{x}" for x in ("hammer", "engulf", "morning", "shooting", "evening")]
    return cd.signed_candles(cd.pattern_flags(v.bars)).select("stock_id", "trade_date", *marks)


query("d39_signed_candles", _signed,
      """SELECT stock_id, trade_date, CASE WHEN hammer THEN 100 ELSE 0 END AS cdl_hammer,
         CASE WHEN bull_engulfing THEN 100 WHEN bear_engulfing THEN -100 ELSE 0 END AS cdl_engulf,
         CASE WHEN morning_star THEN 100 ELSE 0 END AS cdl_morning, CASE WHEN shooting_star THEN -100 ELSE 0 END AS cdl_shooting,
         CASE WHEN evening_star THEN -100 ELSE 0 END AS cdl_evening FROM fx_pat""", "fx_pat", extra=_CANDLE)

_ADAPTIVE = {
    "fx_ad0": (("fx_bars",), """SELECT *, abs(close - open) AS body, high - low AS rng, greatest(open, close) AS top, least(open, close) AS bot,
        CASE WHEN close >= open THEN 1 ELSE -1 END AS sgn FROM fx_bars"""),
    "fx_ad": (("fx_ad0",), f"""SELECT *, row_number() OVER w AS r, lag(body) OVER w AS body1, lag(body, 2) OVER w AS body2, lag(sgn) OVER w AS sgn1,
        lag(sgn, 2) OVER w AS sgn2, lag(top) OVER w AS top1, lag(bot) OVER w AS bot1, lag(top, 2) OVER w AS top2, lag(bot, 2) OVER w AS bot2,
        lag(open) OVER w AS open1, lag(close) OVER w AS close1, lag(close, 2) OVER w AS close2, lag(low) OVER w AS low1,
        avg(body) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b0, avg(body) OVER ({W} ROWS BETWEEN 11 PRECEDING AND 2 PRECEDING) AS b1,
        avg(body) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 3 PRECEDING) AS b2, avg(rng) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) * 0.1::DOUBLE AS tiny,
        avg(rng) OVER ({W} ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING) * 0.2::DOUBLE AS near1 FROM fx_ad0 WINDOW w AS ({W})"""),
}
query("d39_adaptive_candles", lambda v: cd.adaptive_candles(v.bars).select(
          "stock_id", "trade_date", *[f"adaptive_{x}" for x in ("hammer", "engulf", "morning", "shooting", "evening")]),
      """SELECT stock_id, trade_date,
         CASE WHEN r > 11 AND body < b0 AND bot - low > body AND high - top < tiny AND bot <= low1 + near1 THEN 100 ELSE 0 END AS adaptive_hammer,
         CASE WHEN r > 2 AND sgn = 1 AND sgn1 = -1 AND close >= open1 AND open <= close1 AND (close > open1 OR open < close1) THEN 100
              WHEN r > 2 AND sgn = -1 AND sgn1 = 1 AND open >= close1 AND close <= open1 AND (open > close1 OR close < open1) THEN -100 ELSE 0 END AS adaptive_engulf,
         CASE WHEN r > 12 AND body2 > b2 AND sgn2 = -1 AND body1 <= b1 AND top1 < bot2 AND body > b0 AND sgn = 1
              AND close - close2 > body2 * 0.3::DOUBLE THEN 100 ELSE 0 END AS adaptive_morning,
         CASE WHEN r > 11 AND body < b0 AND high - top > body AND bot - low < tiny AND bot > top1 THEN -100 ELSE 0 END AS adaptive_shooting,
         CASE WHEN r > 12 AND body2 > b2 AND sgn2 = 1 AND body1 <= b1 AND bot1 > top2 AND body > b0 AND sgn = -1
              AND close2 - close > body2 * 0.3::DOUBLE THEN -100 ELSE 0 END AS adaptive_evening FROM fx_ad""", "fx_ad", extra=_ADAPTIVE)

# -- volume-price -------------------------------------------------------------------

_VPA = {
    "fx_vb": (("fx_bars",), f"""SELECT *, avg(volume) OVER p AS va, avg(adj_high - adj_low) OVER p AS sa,
        lag(adj_close) OVER ({W}) AS pc, row_number() OVER ({W}) - 1 AS prior, {_trend(1, 10)} AS t10
        FROM fx_bars WINDOW p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"""),
    "fx_vr": (("fx_vb",), """SELECT *, volume / va AS vr, (adj_high - adj_low) / sa AS sr,
        (adj_close - adj_low) / (adj_high - adj_low) AS pos, adj_close > pc AS up, adj_close < pc AS down
        FROM fx_vb WHERE va > 0 AND sa > 0 AND adj_high > adj_low AND pc IS NOT NULL"""),
    "fx_vs": (("fx_vr",), """SELECT stock_id, trade_date, stopping_vol,
        NOT stopping_vol AND down AND vr >= 1.5 AND pos >= 0.6 AS accumulation,
        down AND vr <= 0.6 AND sr <= 0.6 AS no_supply, up AND vr <= 0.6 AND sr <= 0.6 AS no_demand,
        vr >= 1.5 AND sr <= 0.6 AS churning, t10 > 0 AND up AND vr >= 2.0 AND sr >= 1.5 AND pos <= 0.5 AS buying_climax
        FROM (SELECT *, down AND vr >= 2.0 AND sr >= 1.5 AND pos >= 0.45 AS stopping_vol FROM fx_vr) WHERE prior >= 6"""),
}
for _i, _key in enumerate(("stopping_vol", "accumulation", "no_supply", "no_demand", "churning", "buying_climax"), 22):
    query(f"d{_i}_{_key}", lambda v, k=_key: _flag_counts(vpa.vpa_flags(v.bars), k),
          f"""SELECT stock_id, count(*) FILTER (s.{_key}) AS n, max(trade_date) FILTER (s.{_key}) AS last_date
              FROM fx_bars LEFT JOIN fx_vs s USING (stock_id, trade_date) GROUP BY 1""", "fx_vs", extra=_VPA)
_SIGNALS = " UNION ALL ".join(
    f"SELECT '{k}' AS signal, '{n}' AS name, '{d}' AS dir, '{p}' AS phase" for k, (n, d, p) in vpa.CATALOG.items())
query("d31_vpa_events_all", lambda v: vpa.vpa_events(v.bars, None).groupBy("stock_id", "signal").agg(F.count(F.lit(1)).alias("n")),
      f"""SELECT stock_id, signal, count(*) AS n
          FROM (SELECT * FROM fx_vs UNPIVOT (hit FOR signal IN ({', '.join(vpa.CATALOG)})) WHERE hit) GROUP BY ALL""", "fx_vs", extra=_VPA)
query("d31_vpa_events", lambda v: vpa.vpa_events(v.bars, 90),
      f"""SELECT stock_id, trade_date, signal, name, dir, phase
          FROM (SELECT * FROM fx_vs UNPIVOT (hit FOR signal IN ({', '.join(vpa.CATALOG)})) WHERE hit) JOIN ({_SIGNALS}) USING (signal)
          JOIN (SELECT stock_id, trade_date FROM fx_bars QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 90)
          USING (stock_id, trade_date)""", "fx_vs", extra=_VPA)

# -- snapshot ---------------------------------------------------------------------------

# Comparison SQL for the snapshot: one list of bars per security, newest first, from which everything is sliced.
def _mean(values: str, last: int, first: int = 1) -> str:
    return f"list_avg(bar.{values}[{first}:{last}])"


_SNAP = {
    **_VPA,
    "fx_bar_lists": (("fx_bars",), """SELECT stock_id, {'p': list(adj_close ORDER BY trade_date DESC), 'raw': list(close ORDER BY trade_date DESC),
          'q': list(volume ORDER BY trade_date DESC), 'money': list(amount ORDER BY trade_date DESC)} AS bar FROM fx_bars GROUP BY stock_id"""),
    "fx_month_of_signals": (("fx_vr",), """SELECT stock_id,
          sum(CASE WHEN (down AND vr >= 2.0 AND sr >= 1.5 AND pos >= 0.45) OR (vr >= 1.5 AND pos >= 0.6) AND down OR down AND vr <= 0.6 AND sr <= 0.6
            THEN 1 ELSE 0 END)::BIGINT AS bought,
          sum(CASE WHEN vr >= 1.5 AND sr <= 0.6 THEN 1 WHEN NOT up THEN 0 WHEN vr <= 0.6 AND sr <= 0.6 THEN 1
            WHEN vr >= 2.0 AND sr >= 1.5 AND pos <= 0.5 THEN 1 ELSE 0 END)::BIGINT AS sold
        FROM fx_vr SEMI JOIN (SELECT stock_id, trade_date FROM fx_bars
          QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 20) USING (stock_id, trade_date) GROUP BY stock_id"""),
    "fx_feat": (("fx_bar_lists", "fx_month_of_signals"), f"""
        WITH b AS (FROM fx_bar_lists)
        SELECT stock_id, bar.raw[1] AS close, len(bar.p) AS trading_days, {_mean('money', 20)} AS amt20,
          {', '.join(f'bar.p[{k}] AS {n}' for n, k in sn.RANKS.items())},
          {', '.join(f"{_mean('p', n)} AS ma{n}" for n in sn.MEANS)}, {_mean('p', 221, 22)} AS ma200_1m,
          list_max(bar.p[:252]) AS high_52w, list_min(bar.p[:252]) AS low_52w,
          {', '.join(f'bar.p[1] / nullif(bar.p[{k}], 0) - 1 AS ret_{n}' for n, k in (('1m', 21), ('3m', 63), ('6m', 126), ('12m', 252)))},
          bar.p[21] / nullif(bar.p[252], 0) - 1 AS ret_12_1,
          {' + '.join(f'{w} * bar.p[1] / nullif(bar.p[{k}], 0)' for w, k in ((2, 63), (1, 126), (1, 252)))} AS rs_raw,
          bar.p[1] / nullif(list_max(bar.p[:252]), 0) - 1 AS dist_52w_high, bar.p[1] / nullif(list_min(bar.p[:252]), 0) - 1 AS pct_from_low,
          {', '.join(f'round((list_max(bar.p[{i}:{j}]) - list_min(bar.p[{i}:{j}])) / nullif(bar.p[1], 0), 4) AS tight_{n}'
                     for n, i, j in (('recent', 1, 15), ('prior', 16, 40)))},
          round({_mean('q', 10)} / nullif({_mean('q', 50, 11)}, 0), 3) AS vol_dry, round(bar.p[1] / nullif(list_max(bar.p[:60]), 0), 4) AS near_pivot,
          coalesce(bought, 0) AS vpa_accum_20d, coalesce(sold, 0) AS vpa_distrib_20d
        FROM b LEFT JOIN fx_month_of_signals USING (stock_id)"""),
    "fx_in20": (("fx_inst",), """SELECT stock_id, list_sum(list(coalesce(foreign_net, 0) + coalesce(trust_net, 0) + coalesce(dealer_self_net, 0)
        ORDER BY trade_date DESC)[:20])::BIGINT AS inst_net_20d FROM fx_inst GROUP BY stock_id"""),
    "fx_mg20": (("fx_margin",), """SELECT stock_id, held[1] AS margin_balance, held[1] - held[20] AS margin_chg_20d
        FROM (SELECT stock_id, list(margin_balance ORDER BY trade_date DESC) AS held FROM fx_margin GROUP BY stock_id)"""),
    "fx_big": (("fx_holder",), """SELECT stock_id, top[1] AS big1000_pct, round(top[1] - top[5], 4) AS big1000_chg
        FROM (SELECT stock_id, list(pct ORDER BY data_date DESC) AS top FROM fx_holder WHERE level = 15 GROUP BY stock_id)"""),
    "fx_ir": (("fx_index",), """SELECT level[1] / nullif(level[126], 0) AS r
        FROM (SELECT list(close ORDER BY trade_date DESC) AS level FROM fx_index WHERE index_id = 'TAIEX')"""),
    "fx_last": (("fx_quarterly", "fx_revenue", "fx_valuation", "fx_shareholding"), """
        SELECT stock_id, q.*, r.*, v.*, h.*
        FROM (SELECT stock_id, arg_max({'roe': roe, 'eps': eps, 'gross_margin': gross_margin, 'net_margin': net_margin,
                'debt_ratio': debt_ratio}, period_date) AS q FROM fx_quarterly GROUP BY 1)
        FULL JOIN (SELECT stock_id, arg_max({'rev_yoy': yoy_pct, 'rev_mom': mom_pct}, revenue_month) AS r FROM fx_revenue GROUP BY 1) USING (stock_id)
        FULL JOIN (SELECT stock_id, arg_max({'per': per, 'pbr': pbr, 'dividend_yield': dividend_yield}, trade_date) AS v
              FROM fx_valuation GROUP BY 1) USING (stock_id)
        FULL JOIN (SELECT stock_id, arg_max({'foreign_ratio': foreign_ratio}, trade_date) AS h FROM fx_shareholding GROUP BY 1) USING (stock_id)"""),
    "fx_snap": (("fx_stock", "fx_feat", "fx_last", "fx_in20", "fx_mg20", "fx_big", "fx_ir", "fx_bars"), f"""
        WITH wide AS (
          FROM fx_stock JOIN fx_feat USING (stock_id) LEFT JOIN fx_last USING (stock_id) LEFT JOIN fx_in20 USING (stock_id)
            LEFT JOIN fx_mg20 USING (stock_id) LEFT JOIN fx_big USING (stock_id)
        ), judged AS (
          SELECT * REPLACE ({', '.join(f'round(ma{n}::DECIMAL(30, 9), 4)::DOUBLE AS ma{n}' for n in sn.MEANS)},
              round(high_52w, 4) AS high_52w, round(low_52w, 4) AS low_52w, round(amt20) AS amt20),
            round(c0, 4) AS adj_close, c0 > ma60 AS above_ma60, ma20 > ma60 AND ma60 > ma120 AS ma_bull,
            coalesce(ma200 > ma200_1m, false) AS ma200_up, (ret_6m + 1) / nullif((SELECT r FROM fx_ir), 0) - 1 AS rs_6m,
            least(trading_days - 60, amt20 - 5000000) >= 0 AS in_universe, (SELECT max(trade_date) FROM fx_bars) AS as_of_date,
            round_even(100 * percent_rank() OVER (PARTITION BY security_type ORDER BY rs_raw NULLS FIRST), 0)::INT AS rs_rating,
            greatest(sign(coalesce(big1000_chg, 0)), sign(coalesce(inst_net_20d, 0))) > 0 AS flows_in,
            least(sign(coalesce(big1000_chg, 0)), sign(coalesce(inst_net_20d, 0))) < 0 AS flows_out,
            vpa_accum_20d - vpa_distrib_20d AS surplus
          FROM wide
        ), trend AS (
          SELECT *, rs_rating >= 70 AND ma200_up AND ma150 > ma200 AND ma50 > ma150 AND ma50 > ma200
            AND adj_close > ma50 AND adj_close > ma150 AND adj_close > ma200
            AND adj_close >= 1.30::DOUBLE * low_52w AND adj_close >= 0.75::DOUBLE * high_52w AS trend_template FROM judged
        )
        SELECT *, trend_template AND near_pivot >= 0.90 AND vol_dry < 0.80 AND tight_recent <= 0.10 AND tight_recent < 0.85 * tight_prior AS vcp,
          in_universe AND flows_in AND surplus > 0 AND vpa_accum_20d >= 2 AS mf_accumulate,
          in_universe AND flows_out AND surplus < 0 AND vpa_distrib_20d >= 2 AND near_pivot >= 0.85 AS mf_distribute FROM trend"""),
}
_SNAP_DIGITS = {c: 6 for c in ("ret_1m", "ret_3m", "ret_6m", "ret_12m", "ret_12_1", "dist_52w_high", "pct_from_low", "rs_6m", "rs_raw")}


def _features(v: Views) -> DataFrame:
    return sn.add_returns(sn.price_features(v.bars, LOOKBACK_DAYS))


def _pick(*cols: str):
    return lambda v: _features(v).select("stock_id", *cols)


def _px_query(name: str, cols: tuple[str, ...], **digits: int) -> None:
    query(name, _pick(*cols), f"SELECT stock_id, {', '.join(cols)} FROM fx_feat", "fx_feat", extra=_SNAP, **digits)


_px_query("g01_closes_at_rank", ("close", *sn.RANKS))
_px_query("g02_trailing_means", (*[f"ma{n}" for n in sn.MEANS], "ma200_1m", "high_52w", "low_52w", "amt20", "trading_days"),
          **{f"ma{n}": 6 for n in sn.MEANS}, ma200_1m=6, amt20=3)
_px_query("g03_contraction", ("tight_recent", "tight_prior", "vol_dry", "near_pivot"))
_px_query("g08_vpa_counts", ("vpa_accum_20d", "vpa_distrib_20d"))
_px_query("f18_returns", ("ret_1m", "ret_3m", "ret_6m", "ret_12m", "ret_12_1", "dist_52w_high", "pct_from_low"),
          ret_1m=6, ret_3m=6, ret_6m=6, ret_12m=6, ret_12_1=6, dist_52w_high=6, pct_from_low=6)
_px_query("f19_rs_raw", ("rs_raw",), rs_raw=6)
query("g04_index_legs", lambda v: v.index.groupBy("index_id").agg(F.count(F.lit(1)).alias("bars")).filter("index_id = 'TAIEX'").select(
          "bars", index_ratio(v.index, "TAIEX").alias("r")),
      "SELECT (SELECT count(*) FROM fx_index WHERE index_id = 'TAIEX') AS bars, r FROM fx_ir", "fx_ir", extra=_SNAP, r=6)
query("j10_growth_over_index",
      lambda v: _features(v).select("stock_id", ((F.col("ret_6m") + 1) / index_ratio(v.index, "TAIEX") - 1).alias("rs_6m")),
      "SELECT stock_id, (ret_6m + 1) / (SELECT r FROM fx_ir) - 1 AS rs_6m FROM fx_feat", "fx_feat", "fx_ir", extra=_SNAP, rs_6m=6)
_NEWEST = "trade_date"
query("g05_inst_net_20d", lambda v: sn.institutional_20d(v.inst, v.bars.agg(F.max(_NEWEST)).scalar(), LOOKBACK_DAYS),
      "SELECT * FROM fx_in20", "fx_in20", extra=_SNAP)
query("g06_margin_change", lambda v: sn.margin_20d(v.margin, v.bars.agg(F.max(_NEWEST)).scalar(), LOOKBACK_DAYS),
      "SELECT * FROM fx_mg20", "fx_mg20", extra=_SNAP)
query("g07_big_holders", lambda v: sn.big_holders(v.holder), "SELECT * FROM fx_big", "fx_big", extra=_SNAP,
      big1000_pct=4, big1000_chg=4)
_SNAP_COLUMNS = (
    "stock_id", "name", "market", "industry", "security_type", "as_of_date", "close", "adj_close", "ret_1m", "ret_3m", "ret_6m",
    "ret_12m", "ret_12_1", "ma20", "ma50", "ma60", "ma120", "ma150", "ma200", "above_ma60", "ma_bull", "ma200_up", "high_52w",
    "low_52w", "dist_52w_high", "pct_from_low", "rs_6m", "rs_raw", "rs_rating", "tight_recent", "tight_prior", "vol_dry",
    "near_pivot", "vpa_accum_20d", "vpa_distrib_20d", "amt20", "trading_days", "roe", "eps", "gross_margin", "net_margin",
    "debt_ratio", "rev_yoy", "rev_mom", "per", "pbr", "dividend_yield", "inst_net_20d", "margin_balance", "margin_chg_20d",
    "foreign_ratio", "big1000_pct", "big1000_chg", "in_universe", "trend_template", "vcp", "mf_accumulate", "mf_distribute",
)
query("d50_snapshot", lambda v: v.snapshot.select(*_SNAP_COLUMNS), f"SELECT {', '.join(_SNAP_COLUMNS)} FROM fx_snap", "fx_snap",
      extra=_SNAP, **_SNAP_DIGITS)


def _snap_query(name: str, *cols: str, **digits: int) -> None:
    query(name, lambda v: v.snapshot.select("stock_id", *cols), f"SELECT stock_id, {', '.join(cols)} FROM fx_snap", "fx_snap",
          extra=_SNAP, **digits)


_snap_query("j01_snapshot_join", "name", "industry", "close", "roe", "rev_yoy", "per", "inst_net_20d", "margin_balance",
            "foreign_ratio", "big1000_pct")
_snap_query("w04_rs_rating", "security_type", "rs_raw", "rs_rating", rs_raw=6)
_snap_query("d01_trend_template", "trend_template")
_snap_query("d02_vcp", "vcp")
_snap_query("d03_mf_accumulate", "mf_accumulate")
_snap_query("d04_mf_distribute", "mf_distribute")
_snap_query("p03_in_universe", "trading_days", "amt20", "in_universe")
query("d49_stock_detail", lambda v: v.snapshot.join(
          v.stock.agg(F.min("stock_id").alias("stock_id")), "stock_id", "left_semi").select(*_SNAP_COLUMNS[:12]),
      f"SELECT {', '.join(_SNAP_COLUMNS[:12])} FROM fx_snap WHERE stock_id = (SELECT min(stock_id) FROM fx_stock)", "fx_snap",
      extra=_SNAP, **{c: 6 for c in _SNAP_COLUMNS[8:12]})
_PIT = "1999-06-30"


def _pit(v: Views) -> DataFrame:
    return sn.snapshot(v.tables, as_of=_PIT, lookback_days=LOOKBACK_DAYS, side_days=LOOKBACK_DAYS).select(
        "stock_id", "as_of_date", "close", "trading_days", "roe", "rev_yoy")


query("d50_snapshot_as_of", _pit,
      f"""SELECT stock_id, (SELECT max(trade_date) FROM fx_bars WHERE trade_date <= DATE '{_PIT}') AS as_of_date, close,
            trading_days, roe, rev_yoy
          FROM (SELECT stock_id, arg_max(close, trade_date) AS close, count(*) AS trading_days FROM fx_bars
                WHERE trade_date <= DATE '{_PIT}' GROUP BY 1)
          LEFT JOIN (SELECT stock_id, roe FROM fx_quarterly WHERE available_date <= DATE '{_PIT}'
            QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY period_date DESC) = 1) USING (stock_id)
          LEFT JOIN (SELECT stock_id, yoy_pct AS rev_yoy FROM fx_revenue WHERE available_date <= DATE '{_PIT}'
            QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY revenue_month DESC) = 1) USING (stock_id)""",
      "fx_bars", "fx_quarterly", "fx_revenue")

# -- screens ------------------------------------------------------------------------------


def _momentum(v: Views) -> DataFrame:
    px = _features(v).select("stock_id", "c0", "ma60", "ret_3m").filter(F.col("c0") > F.col("ma60"))
    return px.orderBy(F.col("ret_3m").desc_nulls_last(), "stock_id").limit(50).select("stock_id", "c0", "ma60", "ret_3m")


query("t01_screen_momentum", _momentum,
      "SELECT stock_id, c0, ma60, ret_3m FROM fx_feat WHERE c0 > ma60 ORDER BY ret_3m DESC NULLS LAST, stock_id LIMIT 50",
      "fx_feat", extra=_SNAP, ma60=6, ret_3m=6)
_SHOWN = ("stock_id", "industry", "rs_rating", "ret_3m", "ret_12_1", "roe", "per", "amt20")
_CRITERIA = {"ret_3m_min": -0.9, "per_max": 400, "rs_rating_min": 10, "above_ma60": True, "security_type": "stock",
             "unknown_key": 1, "pbr_max": None, "eps_min": "n/a", "in_universe": True}
query("p01_build_predicate", lambda v: v.snapshot.filter(sc.build_predicate(_CRITERIA)).select(*_SHOWN),
      f"""SELECT {', '.join(_SHOWN)} FROM fx_snap WHERE ret_3m >= -0.9 AND per <= 400 AND per > 0 AND rs_rating >= 10
          AND above_ma60 AND security_type = 'stock' AND in_universe""", "fx_snap", extra=_SNAP, ret_3m=6, ret_12_1=6)
query("t01_screen_all", lambda v: sc.screen(v.snapshot, {}, "amt20", True, None).select(*_SHOWN), f"SELECT {', '.join(_SHOWN)} FROM fx_snap",
      "fx_snap", extra=_SNAP, ret_3m=6, ret_12_1=6)
query("t01_screen_sorted", lambda v: sc.screen(v.snapshot, {"in_universe": True}, "amt20", True, 30).select(*_SHOWN),
      f"SELECT {', '.join(_SHOWN)} FROM fx_snap WHERE in_universe ORDER BY amt20 DESC NULLS LAST, stock_id LIMIT 30",
      "fx_snap", extra=_SNAP, ret_3m=6, ret_12_1=6)
_PRESETS = {
    "momentum": ("ret_12_1 >= 0.15 AND above_ma60 AND inst_net_20d >= 0 AND amt20 >= 20000000", "ret_12_1", 50),
    "garp": ("roe >= 15 AND per <= 15 AND per > 0 AND rev_yoy >= 10 AND debt_ratio <= 60", "roe", 50),
    "dividend": ("dividend_yield >= 4 AND roe >= 8 AND debt_ratio <= 50", "dividend_yield", 50),
    "chip": ("inst_net_20d >= 0 AND above_ma60 AND margin_chg_20d <= 0", "inst_net_20d", 50),
    "minervini": ("trend_template", "rs_rating", 100),
    "vcp": ("vcp", "rs_rating", 50),
    "mf_accumulate": ("mf_accumulate", "vpa_accum_20d", 50),
    "mf_distribute": ("mf_distribute", "vpa_distrib_20d", 50),
}
for _name, (_where, _sort, _n) in _PRESETS.items():
    query(f"p02_strategy_{_name}",
          lambda v, n=_name, c=_sort: v.snapshot.select(
              "stock_id", c, sc.build_predicate(sc.STRATEGIES[n]["filters"]).alias("hit")),
          f"SELECT stock_id, {_sort}, {_where} AND in_universe AS hit FROM fx_snap", "fx_snap", extra=_SNAP, **(
              {"ret_12_1": 6} if _sort == "ret_12_1" else {}))
query("t01_run_strategy", lambda v: sc.run_strategy(v.snapshot, "mf_accumulate").select(*_SHOWN),
      f"""SELECT {', '.join(_SHOWN)} FROM fx_snap WHERE {_PRESETS['mf_accumulate'][0]} AND in_universe
          ORDER BY vpa_accum_20d DESC NULLS LAST, stock_id LIMIT 50""", "fx_snap", extra=_SNAP, ret_3m=6, ret_12_1=6)
query("p05_search_rank", lambda v: sc.search(v.stock, "00000000001", 50).unionByName(sc.search(v.stock, "#000000002", 50)),
      """SELECT * FROM (SELECT stock_id, name, market, industry FROM fx_stock WHERE stock_id LIKE '00000000001%' OR name LIKE '%00000000001%'
           ORDER BY CASE WHEN stock_id LIKE '00000000001%' THEN 0 ELSE 1 END, stock_id LIMIT 50)
         UNION ALL SELECT * FROM (SELECT stock_id, name, market, industry FROM fx_stock WHERE stock_id LIKE '#000000002%'
           OR name LIKE '%#000000002%' ORDER BY CASE WHEN stock_id LIKE '#000000002%' THEN 0 ELSE 1 END, stock_id LIMIT 50)""", "fx_stock")
query("t07_numeric_first", lambda v: sc.codes_numeric_first(
          v.stock.select("stock_id").unionByName(v.stock.select(F.col("name").alias("stock_id")))),
      """SELECT stock_id FROM (SELECT stock_id FROM fx_stock UNION ALL SELECT name FROM fx_stock)
         ORDER BY try_cast(stock_id AS DOUBLE) NULLS LAST, stock_id""", "fx_stock")
query("p07_security_code", lambda v: v.table("supplier").select(
          "s_suppkey", is_security_code(F.concat(F.lit('="'), F.lpad(F.col("s_suppkey").cast("string"), 4, "0"), F.lit('"'))).alias("ok"),
          is_security_code(F.col("s_name")).alias("name_ok")),
      "SELECT s_suppkey, true AS ok, false AS name_ok FROM supplier")


def _by_pattern(v: Views) -> DataFrame:
    return sc.screen_by_pattern(v.snapshot, v.loaded.bars, "doji", 300, days=LOOKBACK_DAYS).select("stock_id", "name", "close", "ret_3m", "per")


query("d30_screen_by_pattern", _by_pattern,
      """SELECT stock_id, name, close, ret_3m, per FROM fx_snap WHERE in_universe AND stock_id IN (
           SELECT stock_id FROM fx_pat WHERE doji AND (stock_id, trade_date) IN (SELECT stock_id, max(trade_date) FROM fx_bars GROUP BY 1))
         ORDER BY amt20 DESC NULLS LAST, stock_id LIMIT 300""", "fx_snap", "fx_pat", extra={**_SNAP, **_CANDLE}, ret_3m=6)
query("j16_pattern_semi_join",
      lambda v: v.stock.join(with_age(cd.pattern_flags(trailing_calendar(v.bars, "trade_date", 20))).filter("rn = 1")
                             .filter("doji").select("stock_id"), "stock_id", "left_semi").select("stock_id", "name"),
      """SELECT stock_id, name FROM fx_stock WHERE stock_id IN (SELECT stock_id FROM fx_pat WHERE doji
           AND trade_date > (SELECT max(trade_date) FROM fx_bars) - 20
           AND (stock_id, trade_date) IN (SELECT stock_id, max(trade_date) FROM fx_bars GROUP BY 1))""",
      "fx_stock", "fx_pat", extra=_CANDLE)


def _export(v: Views) -> DataFrame:
    rows = sc.with_last_patterns(sc.screen(v.snapshot, {"in_universe": True}, "amt20", True, None), v.loaded.bars)
    out = export_screen(rows)
    return out.select(F.col("代碼").alias("code"), F.col("近3月%").alias("ret"), F.col("站季線").alias("above"),
                      F.col("VCP").alias("vcp"), F.col("類別").alias("kind"))


query("k10_export_screen", _export,
      """SELECT stock_id AS code, coalesce(printf('%.2f', ret_3m * 100), '') AS ret, CASE WHEN above_ma60 THEN '是' ELSE '' END AS above,
         CASE WHEN vcp THEN '是' ELSE '' END AS vcp, security_type AS kind FROM fx_snap WHERE in_universe""", "fx_snap", extra=_SNAP)

# -- diagnosis ----------------------------------------------------------------------------

_DIAG = {
    **_SNAP,
    "fx_dg0": (("fx_snap",), """SELECT *, coalesce(trend_template, false) AS tr, coalesce(vcp, false) AS vc,
        coalesce(mf_accumulate, false) AS ac, coalesce(mf_distribute, false) AS di, coalesce(above_ma60, false) AS ab,
        coalesce(ma_bull, false) AS bu, CASE WHEN rs_rating IS NULL OR rs_rating = 0 THEN 50 ELSE rs_rating END AS rs,
        coalesce(inst_net_20d, 0) AS inst, coalesce(big1000_chg, 0) AS big FROM fx_snap"""),
    "fx_dg1": (("fx_dg0",), """SELECT *,
        least(greatest(20 + CASE WHEN tr THEN 12 ELSE 0 END + CASE WHEN ab THEN 6 ELSE -6 END
          + least(greatest((rs - 50) / 5.0::DOUBLE, -10), 10) + CASE WHEN vc THEN 4 ELSE 0 END + CASE WHEN bu THEN 2 ELSE 0 END, 0), 40) AS tech,
        least(greatest(17 + CASE WHEN ac THEN 10 ELSE 0 END - CASE WHEN di THEN 12 ELSE 0 END + 5 * sign(inst) + 5 * sign(big)
          + least(greatest(vpa_accum_20d - vpa_distrib_20d, -5), 5), 0), 35) AS chip,
        least(greatest(12 + CASE WHEN roe >= 15 THEN 6 WHEN roe >= 8 THEN 3 WHEN roe < 0 THEN -4 ELSE 0 END
          + CASE WHEN rev_yoy >= 10 THEN 5 WHEN rev_yoy > 0 THEN 2 WHEN rev_yoy < 0 THEN -3 ELSE 0 END
          + CASE WHEN per > 0 AND per <= 20 THEN 3 WHEN per > 40 THEN -2 ELSE 0 END
          + CASE WHEN dividend_yield >= 4 THEN 2 ELSE 0 END, 0), 25) AS fund FROM fx_dg0"""),
    "fx_dg2": (("fx_dg1",), "SELECT *, round_even(tech + chip + fund, 0)::INT AS score FROM fx_dg1"),
    "fx_diag": (("fx_dg2",), """SELECT *, CASE WHEN di OR score < 40 OR (NOT ab AND (inst < 0 OR big < 0)) THEN 'reduce'
          WHEN tr OR score >= 70 OR (ab AND ac AND rs >= 70) THEN 'strong' ELSE 'watch' END AS level,
        array_to_string(list_slice(list_filter([CASE WHEN di THEN '主力出貨' END, CASE WHEN tr THEN '趨勢範本' END,
          CASE WHEN vc THEN 'VCP收縮' END, CASE WHEN ac THEN '主力承接' END, CASE WHEN ab THEN '站上季線' ELSE '跌破季線' END,
          CASE WHEN rs >= 80 THEN 'RS強勢(' || rs || ')' WHEN rs <= 30 THEN 'RS弱勢(' || rs || ')' END,
          CASE WHEN inst > 0 THEN '法人買超' WHEN inst < 0 THEN '法人賣超' END,
          CASE WHEN big > 0 THEN '大戶增持' WHEN big < 0 THEN '大戶減持' END,
          CASE WHEN rev_yoy >= 20 THEN '營收高成長' WHEN rev_yoy < 0 THEN '營收衰退' END,
          CASE WHEN dist_52w_high >= -0.03 THEN '逼近前高' END], lambda x: x IS NOT NULL), 1, 6), '、') AS reasons FROM fx_dg2"""),
}


def _diag(v: Views) -> DataFrame:
    return diagnose(v.snapshot).select(
        "stock_id", "score", "level", F.col("facets.tech").alias("tech"), F.col("facets.chip").alias("chip"),
        F.col("facets.fund").alias("fund"), F.array_join(F.transform("reasons", lambda r: r["text"]), "、").alias("reasons"))


query("d32_diagnose", _diag,
      """SELECT stock_id, score, level, round_even(tech, 0)::INT AS tech, round_even(chip, 0)::INT AS chip,
         round_even(fund, 0)::INT AS fund, reasons FROM fx_diag""", "fx_diag", extra=_DIAG)

# -- ledger and portfolio --------------------------------------------------------------------

_LEDGER = {
    "fx_lg0": (("fx_trades",), """SELECT *, shares::DECIMAL(18, 6) AS q, CASE WHEN action = 'buy' THEN 0 ELSE 1 END AS side
        FROM fx_trades WHERE shares > 0"""),
    "fx_lg1": (("fx_lg0",), """SELECT *, sum(CASE side WHEN 0 THEN q ELSE 0 END) OVER o AS b,
        sum(CASE side WHEN 1 THEN q ELSE 0 END) OVER o AS s,
        sum(CASE side WHEN 0 THEN q ELSE -q END) OVER o AS bal FROM fx_lg0
        WINDOW o AS (PARTITION BY stock_id ORDER BY trade_date, side, id ROWS UNBOUNDED PRECEDING)"""),
    "fx_lg2": (("fx_lg1",), """SELECT *, greatest(0, -min(bal) OVER o) AS dropped FROM fx_lg1
        WINDOW o AS (PARTITION BY stock_id ORDER BY trade_date, side, id ROWS UNBOUNDED PRECEDING)"""),
    "fx_lg3": (("fx_lg2",), """SELECT *, s - dropped AS c_hi, coalesce(lag(s - dropped) OVER (PARTITION BY stock_id
        ORDER BY trade_date, side, id), 0) AS c_lo FROM fx_lg2"""),
    # Both axes are cut at the union of their borders; a piece belongs to the lot and the sell that end at or after it.
    "fx_piece": (("fx_lg3",), """SELECT stock_id, pos - coalesce(lag(pos) OVER up, 0) AS piece,
        first_value(buy IGNORE NULLS) OVER on_ AS buy_id, first_value(sell IGNORE NULLS) OVER on_ AS sell_id
        FROM (SELECT stock_id, pos, max(buy) AS buy, max(sell) AS sell FROM (
            SELECT stock_id, b AS pos, id AS buy, NULL::BIGINT AS sell FROM fx_lg3 WHERE side = 0
            UNION ALL SELECT stock_id, c_hi, NULL, id FROM fx_lg3 WHERE side = 1 AND c_hi > c_lo) GROUP BY 1, 2)
        WINDOW up AS (PARTITION BY stock_id ORDER BY pos),
          on_ AS (PARTITION BY stock_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""),
    "fx_match": (("fx_lg0", "fx_piece"), """SELECT *, (sell_price - buy_price) * qty - ((s_fee + s_tax) / s_shares + b_fee / b_shares) * qty AS gain FROM (
        SELECT m.*, b.trade_date AS buy_date, b.price AS buy_price, s.trade_date AS sell_date, s.price AS sell_price,
          s.fee AS s_fee, s.tax AS s_tax, s.shares AS s_shares, b.fee AS b_fee, b.shares AS b_shares
        FROM (SELECT stock_id, buy_id, sell_id, sum(piece)::DOUBLE AS qty FROM fx_piece
              WHERE buy_id IS NOT NULL AND sell_id IS NOT NULL GROUP BY 1, 2, 3) m
        JOIN fx_lg0 b ON b.stock_id = m.stock_id AND b.id = buy_id AND b.side = 0
        JOIN fx_lg0 s ON s.stock_id = m.stock_id AND s.id = sell_id AND s.side = 1)"""),
    "fx_pos": (("fx_lg3", "fx_match"), """SELECT stock_id, round(net, 3) AS net_shares,
        CASE WHEN net > 1e-9 THEN round((cost / net)::DECIMAL(30, 9), 4)::DOUBLE END AS avg_cost, round_even(coalesce(gain, 0), 0)::BIGINT AS realized_pnl,
        bought AS buy_shares, sold AS sell_shares
        FROM (SELECT stock_id, sum(CASE side WHEN 0 THEN greatest(b - greatest(b - q, e), 0)::DOUBLE ELSE 0 END) AS net,
            sum(CASE side WHEN 0 THEN greatest(b - greatest(b - q, e), 0)::DOUBLE * price ELSE 0 END) AS cost,
            sum(CASE side WHEN 0 THEN shares ELSE 0 END) AS bought, sum(CASE side WHEN 1 THEN shares ELSE 0 END) AS sold
          FROM (SELECT *, max(c_hi) OVER (PARTITION BY stock_id) AS e FROM fx_lg3) GROUP BY 1)
        LEFT JOIN (SELECT stock_id, sum(gain) AS gain FROM fx_match GROUP BY 1) USING (stock_id)"""),
}
query("w23_cumulative_shares", lambda v: lg.cumulative(v.trades, ID_BLOCK).select(
          "id", "stock_id", "action", F.col("cum_shares").cast("double").alias("cum_shares")),
      "SELECT id, stock_id, action, (CASE side WHEN 0 THEN b ELSE s END)::DOUBLE AS cum_shares FROM fx_lg3", "fx_lg3", extra=_LEDGER)
query("d34_fifo_matches", lambda v: lg.matches(v.trades, ID_BLOCK).drop("pnl_exact"),
      """SELECT stock_id, buy_id, sell_id, round(qty, 3) AS shares, buy_date, buy_price, sell_date, sell_price,
         round_even(gain, 0)::BIGINT AS pnl, sell_price / nullif(buy_price, 0) - 1 AS ret_pct, (sell_date - buy_date)::INT AS days
         FROM fx_match""", "fx_match", extra=_LEDGER, ret_pct=6)
query("j08_fifo_overlap_join", lambda v: lg.matches(v.trades, ID_BLOCK).groupBy("stock_id").agg(
          F.count(F.lit(1)).alias("pairs"), F.sum("shares").alias("shares")),
      "SELECT stock_id, count(*) AS pairs, sum(qty) AS shares FROM fx_match GROUP BY 1", "fx_match", extra=_LEDGER, shares=3)
query("d34_positions", lambda v: lg.positions(v.trades, id_block=ID_BLOCK), "SELECT * FROM fx_pos", "fx_pos", extra=_LEDGER)
query("r04_open_shares_from_day_sums",
      lambda v: lg.open_shares(v.trades.groupBy("stock_id", "trade_date").agg(
          F.sum(F.when(F.col("action") == "buy", F.col("shares")).otherwise(0.0)).alias("bought"),
          F.sum(F.when(F.col("action") == "sell", F.col("shares")).otherwise(0.0)).alias("sold"))),
      "SELECT stock_id, net_shares FROM fx_pos", "fx_pos", extra=_LEDGER, net_shares=3)
query("g22_realized_stats", lambda v: pf.realized_stats(lg.matches(v.trades, ID_BLOCK)),
      """SELECT sum(round_even(gain, 0)::BIGINT)::BIGINT AS realized_total, count(*) AS closed_n,
         avg(CASE WHEN round_even(gain, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS win_rate FROM fx_match""",
      "fx_match", extra=_LEDGER, win_rate=1)
query("t12_realized_listing", lambda v: pf.realized(v.trades, v.stock, ID_BLOCK).select("stock_id", "name", "sell_date", "buy_id", "sell_id", "pnl"),
      """SELECT stock_id, name, sell_date, buy_id, sell_id, round_even(gain, 0)::BIGINT AS pnl FROM fx_match
         LEFT JOIN fx_stock USING (stock_id)""", "fx_match", "fx_stock", extra=_LEDGER)
query("j07_trades_with_name", lambda v: pf.trades_listing(v.trades, v.stock).select("id", "stock_id", "name", "action"),
      "SELECT id, stock_id, coalesce(name, stock_id) AS name, action FROM fx_trades LEFT JOIN fx_stock USING (stock_id)", "fx_trades", "fx_stock")
query("t11_trades_listing", lambda v: pf.trades_listing(v.trades, v.stock).select("id", "stock_id", "trade_date", "shares"),
      "SELECT id, stock_id, trade_date, shares FROM fx_trades", "fx_trades")
_ITEMS = {
    **_DIAG, **_LEDGER,
    "fx_items": (("fx_pos", "fx_diag"), """SELECT p.stock_id, coalesce(name, p.stock_id) AS name, industry, net_shares AS shares, avg_cost AS cost, close,
        net_shares * close AS market_value, net_shares * avg_cost AS cost_value, net_shares * close - net_shares * avg_cost AS unrealized,
        close / nullif(avg_cost, 0) - 1 AS unrealized_pct, realized_pnl AS realized, score, coalesce(level, 'watch') AS level, rs_rating,
        coalesce(mf_accumulate, false) AS mf_accumulate, coalesce(mf_distribute, false) AS mf_distribute
        FROM fx_pos p LEFT JOIN fx_diag USING (stock_id) WHERE net_shares > 1e-9"""),
}
_ITEM_COLS = ("stock_id", "name", "industry", "shares", "cost", "close", "market_value", "unrealized", "unrealized_pct", "realized",
              "score", "level", "rs_rating")


def _portfolio(v: Views, summarized: bool = False):
    return pf.portfolio(v.trades, v.snapshot, v.loaded.bars, id_block=ID_BLOCK, summarized=summarized)


query("d35_portfolio", lambda v: _portfolio(v)[0].select(*_ITEM_COLS), f"SELECT {', '.join(_ITEM_COLS)} FROM fx_items", "fx_items",
      extra=_ITEMS, market_value=3, unrealized=3, unrealized_pct=6)
query("j15_portfolio_enrichment", lambda v: _portfolio(v)[0].select("stock_id", "support", "resistance", F.size("last_patterns").alias("n_patterns")),
      """SELECT i.stock_id, coalesce(s.price, n.price) AS support, r.price AS resistance, coalesce(p.n, 0)::INT AS n_patterns
         FROM fx_items i LEFT JOIN (SELECT stock_id, price FROM ranked WHERE side = 'high' AND a = 1) r USING (stock_id)
         LEFT JOIN neck n USING (stock_id)
         LEFT JOIN (SELECT x.stock_id, x.price FROM ranked x JOIN neck k USING (stock_id) WHERE x.side = 'low' AND x.b = 1
           AND abs(x.price - k.price) > 0.02::DOUBLE * k.price) s USING (stock_id)
         LEFT JOIN (SELECT stock_id, count(*) AS n FROM fx_events_long
           WHERE (stock_id, trade_date) IN (SELECT stock_id, max(trade_date) FROM fx_bars GROUP BY 1) GROUP BY 1) p USING (stock_id)""",
      "fx_items", "neck", "fx_events_long", extra={**_ITEMS, **LEVELS, **_EVENTS})
query("g21_portfolio_summary", lambda v: _portfolio(v, summarized=True)[1].select(
          "n", "total_value", "realized_total", "closed_n", "win_rate", "strong_n", "watch_n", "reduce_n", "avg_rs", "accum_n", "distrib_n",
          "top_industry", "top_industry_share"),
      """SELECT count(*) AS n, sum(market_value) AS total_value,
         (SELECT sum(round_even(gain, 0)::BIGINT)::BIGINT FROM fx_match) AS realized_total, (SELECT count(*) FROM fx_match) AS closed_n,
         (SELECT avg(CASE WHEN round_even(gain, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100 FROM fx_match) AS win_rate,
         count(*) FILTER (level = 'strong') AS strong_n, count(*) FILTER (level = 'watch') AS watch_n,
         count(*) FILTER (level = 'reduce') AS reduce_n, round_even(avg(rs_rating), 0)::INT AS avg_rs,
         count(*) FILTER (mf_accumulate) AS accum_n, count(*) FILTER (mf_distribute) AS distrib_n,
         (SELECT arg_max(i, v) FROM (SELECT coalesce(industry, '其他') AS i, sum(market_value) AS v FROM fx_items GROUP BY 1)) AS top_industry,
         (SELECT max(v) / sum(v) * 100 FROM (SELECT industry, sum(market_value) AS v FROM fx_items GROUP BY 1)) AS top_industry_share
         FROM fx_items""", "fx_items", "fx_match", extra=_ITEMS, total_value=0, win_rate=1, top_industry_share=1)
query("g23_top_industry", lambda v: pf.top_industry(_portfolio(v)[0]),
      """SELECT arg_max(i, v) AS top_industry, max(v) / sum(v) * 100 AS top_industry_share
         FROM (SELECT coalesce(industry, '其他') AS i, sum(market_value) AS v FROM fx_items GROUP BY 1)""", "fx_items",
      extra=_ITEMS, top_industry_share=1)
query("k08_validate_trades", lambda v: _validated(v),
      """SELECT CASE WHEN market = '上市' THEN 'accepted' ELSE 'unknown security' END AS reason, count(*) AS n
         FROM fx_trades JOIN fx_stock USING (stock_id) GROUP BY 1""", "fx_trades", "fx_stock")


def _validated(v: Views) -> DataFrame:
    from equilens.sinks.tables import check_trades

    listed = v.stock.filter("market = '上市'")
    accepted, rejected = check_trades(v.trades, listed)
    return accepted.agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted").alias("reason"), "n").unionByName(
        rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


# -- news --------------------------------------------------------------------------------------

_DIST = "1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[])"


def _probe(v: Views):
    return v.embedding.filter("news_id = 0").select("embedding").scalar()


query("j18_news_with_embedding", lambda v: nw.with_embedding(v.news, v.embedding).select("news_id", "stock_id", F.size("embedding").alias("dims")),
      "SELECT news_id, stock_id, len(embedding)::INT AS dims FROM fx_news JOIN fx_embed USING (news_id)", "fx_news", "fx_embed")
query("f33_cosine_distance", lambda v: nw.with_distance(v.embedding, _probe(v)).select("news_id", "dist"),
      f"SELECT vec_id AS news_id, {_DIST} AS dist FROM embeddings", dist=6)
def _questions(v: Views) -> DataFrame:
    return v.embedding.filter("news_id % 25 = 0").select(F.col("news_id").alias("query_id"), F.col("embedding").alias("vector"))


query("d36_retrieve", lambda v: nw.retrieve(nw.with_embedding(v.news, v.embedding), _probe(v), 10, "en", "2024-06-30").select("news_id", "title", "dist"),
      f"""SELECT news_id, title, {_DIST} AS dist FROM fx_news JOIN fx_embed USING (news_id)
          WHERE stock_id = 'en' AND published_at <= TIMESTAMP '2024-06-30' ORDER BY dist, news_id LIMIT 10""",
      "fx_news", "fx_embed", dist=6)
query("d36_retrieve_many", lambda v: nw.retrieve_many(v.news, v.embedding, _questions(v), 5).select("query_id", "rank", "news_id", "title", "dist"),
      """SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), news_id)::INT
           AS rank, news_id, title, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dist
         FROM fx_news JOIN fx_embed e USING (news_id) JOIN embeddings q ON q.vec_id % 25 = 0 QUALIFY rank <= 5""", "fx_news", "fx_embed", dist=6)
query("t04_vector_top_k", lambda v: nw.retrieve(v.embedding.withColumn("published_at", F.lit(None).cast("timestamp")), _probe(v), 25).select("news_id", "dist"),
      f"SELECT vec_id AS news_id, {_DIST} AS dist FROM embeddings ORDER BY dist, vec_id LIMIT 25", dist=6)
query("d37_build_context",
      lambda v: nw.build_context(nw.retrieve(nw.with_embedding(v.news, v.embedding), _probe(v), 3, "en")),
      f"""SELECT string_agg('[來源' || k || '｜' || strftime(published_at, '%Y-%m-%d') || '] ' || title || chr(10) || content,
            chr(10) || chr(10) ORDER BY k) AS context
          FROM (SELECT *, row_number() OVER (ORDER BY dist, news_id) AS k FROM (
            SELECT *, {_DIST} AS dist FROM fx_news JOIN fx_embed USING (news_id) WHERE stock_id = 'en'
            ORDER BY dist, news_id LIMIT 3))""", "fx_news", "fx_embed")
query("f20_strip_tags", lambda v: v.table("pages").select("page_id", F.md5(strip_tags(F.col("html"))).alias("text_md5")),
      "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_md5 FROM pages")
query("p10_recent_days", lambda v: nw.recent(v.news, 90, F.lit("2024-12-01").cast("timestamp")).select(
          "news_id", F.col("published_at").cast("timestamp_ntz").alias("published_at")),
      "SELECT news_id, published_at FROM fx_news WHERE published_at IS NULL OR published_at >= TIMESTAMP '2024-12-01' - INTERVAL 90 DAY", "fx_news")


def _feed(v: Views) -> DataFrame:
    return v.table("pages").select(F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1).alias("stock_id"), F.col("url"), "page_id")


_FEED = {"fx_feed": ((), r"SELECT regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS stock_id, url, page_id FROM pages")}
query("j06_fresh_news",
      lambda v: nw.fresh_news(_feed(v), _feed(v).filter(F.col("url").contains("?")), "page_id"),
      """SELECT stock_id, url, page_id FROM fx_feed WHERE (stock_id, url) NOT IN (SELECT stock_id, url FROM fx_feed WHERE contains(url, '?'))
         QUALIFY row_number() OVER (PARTITION BY stock_id, url ORDER BY page_id) = 1""", "fx_feed", extra=_FEED)

# -- streams, as batch ------------------------------------------------------------------------------

query("r02_bars_from_events", lambda v: bars_from_events(v.table("events")).select(
          "event_type", F.col("bar_start").cast("timestamp_ntz").alias("bar_start"), "open", "high", "low", "close", "volume", "trades"),
      """SELECT event_type, bar_start, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, value)) AS close, sum(value) AS volume, count(*) AS trades
         FROM (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS bar_start FROM events) GROUP BY 1, 2""", volume=3)
