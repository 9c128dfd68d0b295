"""What a report says of its figures: headline, takeaways, themes with scores, and how guidance changed. Words are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartermill.functions.numbers import clamped_score, money, pct_change, percent
from quartermill.operators.series import before


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _above(c: Column) -> Column:
    return F.greatest(_zero(c), F.lit(0.0))


def _below(c: Column) -> Column:
    return F.greatest(-_zero(c), F.lit(0.0))


def _themes(*items: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(label).alias("label"), clamped_score(score).alias("score")) for label, score in items))


def focus_themes(yoy: Column, qoq: Column, ttm: Column, gross_margin: Column, net_margin: Column) -> Column:
    """array<struct<label, score>> of what a quarter is about."""
    return _themes(
        ("收入动能与需求持续性", 62 + _above(yoy) * 0.45 + _above(qoq) * 0.35),
        ("利润率与经营杠杆", 50 + _zero(gross_margin) * 0.5 + _above(net_margin) * 0.25),
        ("TTM 成长延续性", 48 + _above(ttm) * 0.6),
        ("研究主线与结构披露", F.lit(58.0)),
    )


def question_themes(ttm: Column, margin_change: Column) -> Column:
    """array<struct<label, score>> of what will be asked; margin_change: over the fourth quarter before."""
    return _themes(("增长是否可持续", 58 + _above(ttm) * 0.45), ("利润率拐点与兑现", 50 + F.abs(_zero(margin_change)) * 2.2), ("结构升级与第二曲线", F.lit(54.0)), ("经营基线与估值锚", F.lit(52.0)))


def risks(yoy: Column, qoq: Column, margin_change: Column) -> Column:
    return _themes(("收入增速放缓", 56 + F.greatest(F.lit(0.0), 18 - _zero(yoy)) * 1.2 + _below(qoq) * 1.5), ("利润率回落", 48 + _below(margin_change) * 2.5), ("披露粒度有限", F.lit(62.0)))


def catalysts(yoy: Column, qoq: Column, ttm: Column, margin_change: Column) -> Column:
    return _themes(("收入动能延续", 54 + _above(yoy) * 0.6 + _above(qoq) * 0.45), ("利润率继续改善", 48 + _above(margin_change) * 2.6), ("TTM 周期上修", 50 + _above(ttm) * 0.55))


def headline(name: Column, fiscal_label: Column, revenue: Column, revenue_yoy: Column, earnings: Column, earnings_yoy: Column, driver: Column, symbol: str = "$") -> Column:
    """One sentence of revenue, profit, their changes and what drove them; null without revenue."""
    first = F.concat_ws("，", F.concat(name, F.lit(" "), fiscal_label, F.lit(" 收入 "), money(revenue, symbol)), F.when(revenue_yoy.isNotNull(), F.concat(F.lit("同比 "), percent(revenue_yoy, True))))
    second = F.when(earnings.isNotNull(), F.concat_ws("，", F.concat(F.lit("净利润 "), money(earnings, symbol)), F.when(earnings_yoy.isNotNull(), F.concat(F.lit("同比 "), percent(earnings_yoy, True)))))
    return F.when(revenue.isNotNull(), F.concat(F.concat_ws("；", first, second, F.when(driver != "", driver)), F.lit("。")))


def profit_takeaway(earnings: Column, earnings_yoy: Column, symbol: str = "$") -> Column:
    """A sentence of profit and its change, of what is known; null for neither."""
    both = F.concat(F.lit("净利润 "), money(earnings, symbol), F.lit("，同比 "), percent(earnings_yoy, True), F.lit("。"))
    return (
        F.when(earnings.isNotNull() & earnings_yoy.isNotNull(), both)
        .when(earnings.isNotNull(), F.concat(F.lit("净利润 "), money(earnings, symbol), F.lit("。")))
        .when(earnings_yoy.isNotNull(), F.concat(F.lit("净利润同比 "), percent(earnings_yoy, True), F.lit("。")))
    )


def takeaways(given: Column, profit: Column, most: int = 4) -> Column:
    """The first of the given ones, the sentence of profit, then the others; those that tell profit again go where that sentence is there."""
    rest = F.filter(F.slice(given, F.lit(2), F.greatest(F.size(given) - 1, F.lit(0))), lambda x: profit.isNull() | ~x.contains("净利润"))
    return F.slice(F.concat(F.slice(given, 1, 1), F.array_compact(F.array(profit)), rest), 1, most)


def guidance_change(quarters: DataFrame) -> DataFrame:
    """How guidance came out and changed. quarters: company, quarter_index, revenue, mode, point, low, high, margin; a row a quarter, without gaps.

    realised: revenue against the point given the quarter before; in_range: against its range where there was no point. change: point
    to point, else middle to middle of ranges, in percent. switched: another mode than before; margin_delta where the mode stayed.
    """
    last = lambda c: before(c, 1)
    middle = lambda low, high: (low + high) / 2
    known = last("mode").isNotNull()
    ranged = F.col("low").isNotNull() & F.col("high").isNotNull() & last("low").isNotNull() & last("high").isNotNull()
    points = F.col("point").isNotNull() & last("point").isNotNull()
    return quarters.withColumns({
        "realised": F.when(last("point").isNotNull() & (F.col("revenue") != 0), pct_change(F.col("revenue"), last("point"))),
        "in_range": F.when(last("point").isNull() & last("low").isNotNull() & last("high").isNotNull(), F.col("revenue").between(last("low"), last("high"))),
        "change": F.when(points, pct_change(F.col("point"), last("point"))).when(ranged, F.coalesce(pct_change(middle(F.col("low"), F.col("high")), middle(last("low"), last("high"))), F.lit(0.0))),
        "switched": known & (F.col("mode") != last("mode")),
        "margin_delta": F.when(known & (F.col("mode") == last("mode")), F.col("margin") - last("margin")),
    })
