"""Scoring of a holding from its snapshot row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.functions.price import clamp

MAX_REASONS = 6


def _points(*cases: tuple[Column, float], default: float = 0.0) -> Column:
    """Value of the first case that holds; unknown counts as not holding."""
    expr = None
    for cond, value in cases:
        expr = F.when(cond, float(value)) if expr is None else expr.when(cond, float(value))
    return expr.otherwise(float(default))


def diagnose(snapshot: DataFrame) -> DataFrame:
    """Snapshot plus ``score``, ``level``, ``facets`` (tech, chip, fund) and up to six ``reasons``."""
    flag = {
        k: F.coalesce(F.col(k), F.lit(False))
        for k in ("trend_template", "vcp", "mf_accumulate", "mf_distribute", "above_ma60", "ma_bull")
    }
    trend, is_vcp, accum, distrib, above, bull = flag.values()
    n = {
        k: F.coalesce(F.col(k).cast("double"), F.lit(0.0))
        for k in ("inst_net_20d", "big1000_chg", "vpa_accum_20d", "vpa_distrib_20d")
    }
    inst, big, va, vd = n.values()
    roe, yoy, per, dy, off_high = (
        F.col(k).cast("double") for k in ("roe", "rev_yoy", "per", "dividend_yield", "dist_52w_high")
    )
    rs_known = F.nullif(F.col("rs_rating").cast("double"), F.lit(0.0))
    rs = F.coalesce(rs_known, F.lit(50.0))  # a rating of 0 is treated as unknown

    tech = clamp(
        F.lit(20.0) + _points((trend, 12)) + _points((above, 6), default=-6) + clamp((rs - 50) / 5, -10, 10)
        + _points((is_vcp, 4)) + _points((bull, 2)), 0, 40,
    )
    chip = clamp(
        F.lit(17.0) + _points((accum, 10)) + _points((distrib, -12)) + F.signum(inst) * 5 + F.signum(big) * 5
        + clamp(va - vd, -5, 5), 0, 35,
    )
    fund = clamp(
        F.lit(12.0)
        + _points((roe >= 15, 6), (roe >= 8, 3), (roe < 0, -4))
        + _points((yoy >= 10, 5), (yoy > 0, 2), (yoy < 0, -3))
        + _points(((per > 0) & (per <= 20), 3), (per > 40, -2))
        + _points((dy >= 4, 2)), 0, 25,
    )
    scored = snapshot.select("*", tech.alias("_tech"), chip.alias("_chip"), fund.alias("_fund"), rs.alias("_rs"))
    score = F.rint(F.col("_tech") + F.col("_chip") + F.col("_fund")).cast("int")
    rs = F.col("_rs")

    leaving = (inst < 0) | (big < 0)
    level = (
        F.when(distrib | (score < 40) | (~above & leaving), "reduce")
        .when(trend | (score >= 70) | (above & accum & (rs >= 70)), "strong")
        .otherwise("watch")
    )

    def reason(cond: Column, text, direction: str, otherwise: tuple | None = None) -> Column:
        def entry(t, d):
            return F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(d).alias("dir"))

        out = F.when(cond, entry(text, direction))
        return out.when(otherwise[0], entry(otherwise[1], otherwise[2])) if otherwise else out

    rs_text = F.concat(F.lit("("), rs.cast("int").cast("string"), F.lit(")"))
    # Reason texts in order of importance.
    reasons = F.array(
        reason(distrib, "主力出貨", "bull"),
        reason(trend, "趨勢範本", "bull"),
        reason(is_vcp, "VCP收縮", "bull"),
        reason(accum, "主力承接", "bull"),
        reason(above, "站上季線", "bull", (~above, "跌破季線", "bear")),
        reason(rs >= 80, F.concat(F.lit("RS強勢"), rs_text), "bull",
               (rs <= 30, F.concat(F.lit("RS弱勢"), rs_text), "bear")),
        reason(inst > 0, "法人買超", "bull", (inst < 0, "法人賣超", "bear")),
        reason(big > 0, "大戶增持", "bull", (big < 0, "大戶減持", "bear")),
        reason(yoy >= 20, "營收高成長", "bull", (yoy < 0, "營收衰退", "bear")),
        reason(off_high >= -0.03, "逼近前高", "neutral"),
    )
    facets = F.struct(*[F.rint(F.col(f"_{k}")).cast("int").alias(k) for k in ("tech", "chip", "fund")])
    return scored.select(
        *snapshot.columns, score.alias("score"), level.alias("level"), facets.alias("facets"),
        F.slice(F.filter(reasons, lambda r: r.isNotNull()), 1, MAX_REASONS).alias("reasons"),
    )
