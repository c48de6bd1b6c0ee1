"""Parsers and table maintenance over values written out as the landed files write them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.registry import query
from checks.views import Views
from equilens.functions import parse as p
from equilens.functions.calendar import MARKET_OTC, revenue_month
from equilens.operators.adjust import valid_event
from equilens.operators.relational import overlay, union_all
from equilens.plans.screen import codes_numeric_first
from equilens.session import shared_folder
from equilens.sinks.tables import append_trades, delete_trades, dry_run_profile, incremental, read_fact, read_version, replace_keys, write_version


def _days(v: Views) -> DataFrame:
    return v.ticks.select("d").distinct()


def _part(fmt: str) -> Column:
    return F.date_format("d", fmt)


def _roc_year() -> Column:
    return F.lpad((F.year("d") - p.ROC_YEAR_OFFSET).cast("string"), 3, "0")


_SAME_DAY = "SELECT d, d AS parsed FROM (SELECT DISTINCT d FROM fx_ticks)"
_SAME_MONTH = "SELECT d, date_trunc('month', d)::DATE AS parsed FROM (SELECT DISTINCT d FROM fx_ticks)"

query("f01_parse_num", lambda v: v.ticks.select(
          "l_orderkey", "cents", p.parse_num(F.format_number(F.col("cents") / 100, 2)).alias("parsed")),
      "SELECT l_orderkey, cents, cents / 100.0::DOUBLE AS parsed FROM fx_ticks", "fx_ticks", parsed=2)
query("f02_parse_bigint", lambda v: v.ticks.select("l_orderkey", "cents", p.parse_bigint(F.format_number("cents", 0)).alias("parsed")),
      "SELECT l_orderkey, cents, cents AS parsed FROM fx_ticks", "fx_ticks")
query("f03_to_num", lambda v: v.ticks.select("l_orderkey", "cents", p.to_num(F.when(F.col("l_returnflag") == "R", "--").otherwise(
          F.concat(F.lit('"'), F.format_number("cents", 0), F.lit('"')))).alias("parsed")),
      "SELECT l_orderkey, cents, CASE WHEN l_returnflag <> 'R' THEN cents::DOUBLE END AS parsed FROM fx_ticks", "fx_ticks")
query("f04_iso_date", lambda v: _days(v).select("d", p.iso_date(_part("yyyy/MM/dd HH:mm")).alias("parsed")), _SAME_DAY, "fx_ticks")
query("f05_roc_date", lambda v: _days(v).select(
          "d", p.roc_date(F.concat(F.lit('" '), F.concat_ws("/", _roc_year(), _part("MM"), _part("dd")), F.lit('"'))).alias("parsed")),
      _SAME_DAY, "fx_ticks")
query("f06_roc_month", lambda v: _days(v).select("d", p.roc_month(F.concat(_roc_year(), _part("MM"))).alias("parsed")), _SAME_MONTH, "fx_ticks")
query("f07_ymd_date", lambda v: _days(v).select("d", p.ymd_date(_part("yyyyMMdd")).alias("parsed")), _SAME_DAY, "fx_ticks")
query("f08_any_date", lambda v: _days(v).select("d", p.any_date(
          F.when(F.day("d") < 8, F.concat(_roc_year(), _part("MMdd"))).when(F.day("d") < 16, _part("yyyyMMdd"))
          .when(F.day("d") < 24, _part("yyyy-MM-dd")).otherwise(_part("yyyy/MM/dd"))).alias("parsed")), _SAME_DAY, "fx_ticks")
query("f09_clean_code", lambda v: v.stock.select("stock_id", p.clean_code(F.concat(F.lit(' ="'), "stock_id", F.lit('" '))).alias("parsed")),
      "SELECT stock_id, stock_id AS parsed FROM fx_stock", "fx_stock")
query("f11_revenue_month", lambda v: _days(v).select("d", revenue_month(F.year("d"), F.month("d")).alias("parsed")), _SAME_MONTH, "fx_ticks")
query("f14_first_of", lambda v: v.inst.select("stock_id", "trade_date", p.first_of(F.col("foreign_net"), F.col("trust_net"), F.col("dealer_self_net")).alias("net")),
      "SELECT stock_id, trade_date, coalesce(foreign_net, trust_net, dealer_self_net) AS net FROM fx_inst", "fx_inst")
query("f16_to_lots", lambda v: v.bars.select("stock_id", "trade_date", p.to_lots(F.format_number(F.col("volume") * 10, 0)).alias("lots")),
      """SELECT stock_id, trade_date, rtrim(rtrim(printf('%.3f', volume / 100.0::DOUBLE), '0'), '.') AS lots FROM fx_bars""", "fx_bars")
query("f17_signed_change", lambda v: v.ticks.select("l_orderkey", "cents", p.signed_change(
          F.when(F.col("l_returnflag") == "R", " - ").when(F.col("l_returnflag") == "A", "+").otherwise("X"),
          F.concat(F.lit(" "), F.col("l_linenumber").cast("string"))).alias("change")),
      """SELECT l_orderkey, cents, CASE l_returnflag WHEN 'R' THEN '-' WHEN 'A' THEN '+' ELSE '' END || l_linenumber AS change
         FROM fx_ticks""", "fx_ticks")
query("f29_payload_rows", lambda v: v.bars.select("trade_date", F.concat(
          F.lit('{"tables":[{"data":[["'), "stock_id", F.lit('",'), F.col("volume").cast("string"), F.lit("]]}]}")).alias("j"))
      .select("trade_date", F.explode(p.payload_rows(F.col("j"))).alias("c"))
      .select("trade_date", F.get("c", F.lit(0)).alias("stock_id"), F.get("c", F.lit(1)).cast("bigint").alias("volume")),
      "SELECT trade_date, stock_id, volume FROM fx_bars", "fx_bars")
query("p08_drop_untraded", lambda v: v.ticks.select("l_orderkey", "cents", F.when(F.col("l_returnflag") == "R", "--").otherwise(
          F.col("cents").cast("string")).alias("close")).filter(p.traded(F.col("close"))),
      "SELECT l_orderkey, cents, cents::VARCHAR AS close FROM fx_ticks WHERE l_returnflag <> 'R'", "fx_ticks")
query("p13_valid_event", lambda v: v.reduction.filter(valid_event()).groupBy("stock_id").agg(
          F.count(F.lit(1)).alias("n")),
      "SELECT stock_id, count(*) AS n FROM fx_reduction WHERE pre_close > 0 AND post_ref_price > 0 GROUP BY 1", "fx_reduction")
query("j17_market_unit_multiplier", lambda v: v.bars.join(v.stock.select(
          "stock_id", F.when(F.col("market") == MARKET_OTC, 1000).otherwise(1).alias("m")), "stock_id", "left").select(
          "stock_id", "trade_date", (F.col("volume") * F.col("m")).alias("volume")),
      """SELECT stock_id, trade_date, volume * CASE WHEN market = '上櫃' THEN 1000 ELSE 1 END AS volume
         FROM fx_bars LEFT JOIN fx_stock USING (stock_id)""", "fx_bars", "fx_stock")
query("k02_replace_keys", lambda v: _replaced(v),
      """SELECT stock_id, trade_date, volume FROM fx_bars JOIN fx_stock USING (stock_id) WHERE security_type = 'stock'
         UNION ALL SELECT stock_id, max(trade_date), sum(volume)::BIGINT FROM fx_bars JOIN fx_stock USING (stock_id)
         WHERE security_type = 'etf' GROUP BY 1""", "fx_bars", "fx_stock")


def _replaced(v: Views) -> DataFrame:
    old = v.bars.select("stock_id", "trade_date", "volume")
    funds = v.stock.filter("security_type = 'etf'").select("stock_id")
    new = old.join(funds, "stock_id", "left_semi").groupBy("stock_id").agg(
        F.max("trade_date").alias("trade_date"), F.sum("volume").alias("volume"))
    path = _scratch(v)
    write_version(old, path)
    replace_keys(v.spark, path, new)
    return read_version(v.spark, path)


def _scratch(v: Views) -> str:
    """A new folder in the cluster's shared folder."""
    return f"{shared_folder(v.spark).rstrip('/')}/check-{uuid.uuid4().hex}"


def _without_large(v: Views) -> DataFrame:
    path = _scratch(v)
    append_trades(v.spark, path, v.trades, v.stock)
    delete_trades(v.spark, path, v.trades.filter("shares >= 40").select("id"))
    return read_fact(v.spark, path).groupBy("stock_id").agg(F.count(F.lit(1)).alias("n"))


query("k03_incremental", lambda v: incremental(v.bars, "2000-01-01", "trade_date").select("stock_id", "trade_date", "volume"),
      "SELECT stock_id, trade_date, volume FROM fx_bars WHERE trade_date >= DATE '2000-01-01' AND stock_id <> ''", "fx_bars")
query("k04_merge_day_into_month", lambda v: _merged(v),
      """SELECT stock_id, trade_date, CASE WHEN trade_date = (SELECT max(trade_date) FROM fx_bars) THEN volume + 1 ELSE volume END AS volume
         FROM fx_bars""", "fx_bars")


def _merged(v: Views) -> DataFrame:
    bars = v.bars.select("stock_id", "trade_date", "volume")
    day = bars.filter(F.col("trade_date") == bars.agg(F.max("trade_date")).scalar())
    return overlay(bars, day.withColumn("volume", F.col("volume") + 1), ("stock_id", "trade_date"))


query("k09_delete_trades", _without_large,
      "SELECT stock_id, count(*) AS n FROM fx_trades WHERE shares < 40 GROUP BY 1", "fx_trades")
query("k11_merge_index", lambda v: overlay(v.index.filter("index_id = 'TWSE'"), v.index.filter("index_id = 'TPEx' and month(trade_date) = 3").withColumn(
          "index_id", F.lit("TWSE")), ("index_id", "trade_date")),
      """SELECT index_id, trade_date, coalesce(n.close, o.close) AS close FROM (FROM fx_index WHERE index_id = 'TWSE') o
         FULL JOIN (SELECT 'TWSE' AS index_id, trade_date, close FROM fx_index WHERE index_id = 'TPEx' AND month(trade_date) = 3) n
         USING (index_id, trade_date)""", "fx_index", close=4)
query("k14_dry_run_profile", lambda v: dry_run_profile(v.bars.select("stock_id", "trade_date")),
      """SELECT count(*) AS rows, min('{"stock_id":"' || stock_id || '","trade_date":"' || trade_date || '"}') AS sample FROM fx_bars""", "fx_bars")
query("k15_code_list", lambda v: codes_numeric_first(v.stock.select("stock_id")), "SELECT stock_id FROM fx_stock", "fx_stock")
query("u02_union_revenue_sources", lambda v: union_all(*[
          v.revenue_raw.join(v.stock.filter(F.col("industry").isNotNull() & (F.col("market") == m)), "stock_id", "left_semi") for m in ("上市", "上櫃")]),
      "SELECT stock_id, revenue_month, revenue FROM fx_revenue", "fx_revenue")
