"""Quarterly series: growth, trailing sums, returns, windows, gaps, fact choice and merging.

Lags are positional over the rows a company has. All of a series' windows share one partitioning and order, so a plan needs one
shuffle and one sort by company, and the partial aggregation below has reduced the input to a row a quarter by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartermill.functions.numbers import pct_change, pct_change_abs
from quartermill.functions.periods import label, majority_index

KEY, AT = "company", "quarter_index"


def by_quarter(frame: tuple[int, int] | None = None):
    w = Window.partitionBy(KEY).orderBy(AT)
    return w.rowsBetween(*frame) if frame else w


def before(name: str, n: int) -> Column:
    return F.lag(name, n).over(by_quarter())


def growth(series: DataFrame) -> DataFrame:
    """Revenue year on year (over the base's magnitude), quarter on quarter, and earnings year on year (signed base)."""
    return series.withColumns({
        "revenue_yoy": pct_change_abs(F.col("revenue"), before("revenue", 4)),
        "revenue_qoq": pct_change(F.col("revenue"), before("revenue", 1)),
        "earnings_yoy": pct_change(F.col("earnings"), before("earnings", 4)),
    })


def trailing_sum(name: str, n: int = 4) -> Column:
    """Null unless all n rows have a value."""
    w = by_quarter((-(n - 1), 0))
    return F.when(F.count(name).over(w) == n, F.sum(name).over(w))


def trailing(series: DataFrame) -> DataFrame:
    """Trailing four-quarter sums and their growth over the four before."""
    series = series.withColumns({"ttm_revenue": trailing_sum("revenue"), "ttm_earnings": trailing_sum("earnings")})
    return series.withColumn("ttm_growth", pct_change(F.col("ttm_revenue"), before("ttm_revenue", 4)))


def trailing_roe(series: DataFrame) -> DataFrame:
    """Four quarters' earnings over the mean of up to five equities (null and zero skipped, two at least); outside (-100, 250) null."""
    w = by_quarter((-4, 0))
    equity = F.nullif(F.col("equity"), F.lit(0))
    mean = F.when((F.count(equity).over(w) >= 2) & (F.avg(equity).over(w) > 0), F.avg(equity).over(w))
    roe = trailing_sum("earnings") / mean * 100
    return series.withColumn("ttm_roe", F.when((roe > -100) & (roe < 250), roe))


def trailing_mean(name: str, n: int = 4) -> Column:
    """Nulls skipped."""
    return F.avg(name).over(by_quarter((-(n - 1), 0)))


def has_core() -> Column:
    return F.col("revenue").isNotNull() & F.col("earnings").isNotNull()


def report_ready(series: DataFrame, window: int = 12) -> DataFrame:
    """Rows whose trailing window is whole: `window` rows, each with revenue and earnings."""
    ready = F.count(F.when(has_core(), 1)).over(by_quarter((-(window - 1), 0))) == window
    return series.withColumn("_ready", ready & (F.row_number().over(by_quarter()) >= window)).where("_ready").drop("_ready")


def gated(supported: DataFrame, audited: DataFrame, window: int) -> DataFrame:
    """supported rows that an audit passed; a company whose audit isn't complete for this window keeps all. audited: company, quarter_index, history_window, complete."""
    binding = audited.where(F.col("complete") & (F.col("history_window") == window))
    passed = binding.select(KEY, AT, F.lit(True).alias("_passed"))
    bound = binding.select(KEY).distinct().withColumn("_bound", F.lit(True))
    return supported.join(bound, KEY, "left").join(passed, [KEY, AT], "left").where("_bound IS NULL OR _passed").drop("_bound", "_passed")


def dense_window(series: DataFrame, targets: DataFrame, window: int = 12) -> DataFrame:
    """The `window` calendar quarters up to each target, with or without a row; a target before its company's first quarter fails. targets: company, target_index."""
    first = series.groupBy(KEY).agg(F.min(AT).alias("_first"))
    checked = targets.join(first, KEY, "left")
    problem = F.concat(F.lit("no quarter of company "), F.col(KEY).cast("string"), F.lit(" is as early as the target"))
    checked = checked.withColumn("target_index", F.when(F.col("_first") <= F.col("target_index"), F.col("target_index")).otherwise(F.raise_error(problem).cast("int")))
    grid = checked.drop("_first").withColumn(AT, F.explode(F.sequence(F.col("target_index") - window + 1, F.col("target_index"))))
    return grid.join(series, [KEY, AT], "left")


def _known(name: str, ahead: bool) -> tuple[Column, Column]:
    """Value and quarter of the nearest known row before (or after)."""
    w = by_quarter((1, Window.unboundedFollowing)) if ahead else by_quarter((Window.unboundedPreceding, -1))
    pair = F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("v"), F.col("_row").alias("at")))
    found = (F.first if ahead else F.last)(pair, ignorenulls=True).over(w)
    return found["v"], found["at"]


def interpolated(series: DataFrame, *names: str) -> DataFrame:
    """Gaps filled by position: linear inside, the last value carried on at the end, and at the start only the row next to the first known one."""
    series = series.withColumn("_row", F.row_number().over(by_quarter()))
    filled = {}
    for name in names:
        (v0, at0), (v1, at1) = _known(name, False), _known(name, True)
        row = F.col("_row")
        inside = v0 + (v1 - v0) * (row - at0) / (at1 - at0)
        lead = F.when(at1 - row == 1, v1)
        filled[f"{name}_filled"] = F.coalesce(F.col(name), F.when(v0.isNotNull() & v1.isNotNull(), inside), v0, lead)
        filled[f"{name}_inferred"] = F.col(name).isNull() & F.coalesce(v0, lead).isNotNull()
    return series.withColumns(filled).drop("_row")


def with_margin(series: DataFrame) -> DataFrame:
    """Net margin of filled revenue and earnings, where both are there and revenue isn't 0; the old one otherwise."""
    margin = F.col("earnings_filled") / F.nullif(F.col("revenue_filled"), F.lit(0.0)) * 100
    return series.withColumn("net_margin", F.coalesce(margin, "net_margin")).withColumn("inferred", F.col("revenue_inferred") | F.col("earnings_inferred"))


def metrics_with_data(series: DataFrame, names: list[str], most: int = 4) -> DataFrame:
    """company and the first `most` of the names that have a value in any of its quarters."""
    known = F.array_compact(F.array(*(F.when(F.count(n) > 0, F.lit(n)) for n in names)))
    return series.groupBy(KEY).agg(F.slice(known, 1, most).alias("metrics"))


def sparkline(series: DataFrame, name: str) -> DataFrame:
    """Carried forward, and the first known value carried back; then scaled to 0..1 (all alike: a half)."""
    value = F.coalesce(F.last(name, ignorenulls=True).over(by_quarter((Window.unboundedPreceding, 0))), F.first(name, ignorenulls=True).over(by_quarter((Window.unboundedPreceding, Window.unboundedFollowing))))
    series = series.withColumn("level", value)
    whole = Window.partitionBy(KEY)
    low, high = F.min("level").over(whole), F.max("level").over(whole)
    pad = F.when(high == low, F.lit(1.0)).otherwise(0.0)
    return series.withColumn("scaled", (F.col("level") - (low - pad)) / ((high + pad) - (low - pad)))


def despiked(series: DataFrame, name: str = "roe") -> DataFrame:
    """company and an array of (quarter_index, value): a value over 20, 2.2 times and 10 beyond the upper median of the last four accepted is dropped, if that median is positive."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(AT), F.col(name).alias("v"))))
    grouped = series.groupBy(KEY).agg(rows.alias("rows"))

    def step(state: Column, row: Column) -> Column:
        recent = F.slice(state["accepted"], F.greatest(F.size(state["accepted"]) - 3, F.lit(1)), F.lit(4))
        median = F.get(F.sort_array(recent), F.floor(F.size(recent) / 2).cast("int"))
        spike = F.coalesce((F.size(recent) >= 4) & (median > 0) & (row["v"] > 20) & (row["v"] > 2.2 * median) & (row["v"] > median + 10), F.lit(False))
        keep = F.when(~spike, row["v"])
        return F.struct(F.when(keep.isNotNull(), F.concat(state["accepted"], F.array(keep))).otherwise(state["accepted"]).alias("accepted"), F.concat(state["out"], F.array(F.struct(row[AT].alias(AT), keep.alias("v")))).alias("out"))

    start = F.struct(F.array().cast("array<double>").alias("accepted"), F.array().cast(f"array<struct<{AT}:int,v:double>>").alias("out"))
    return grouped.select(KEY, F.inline(F.aggregate("rows", start, step, lambda s: s["out"]))).withColumnRenamed("v", f"{name}_kept")


def longest_run(series: DataFrame, name: str) -> DataFrame:
    """company and its longest run of equal values (six decimals); nulls break a run; 1 at least."""
    value = F.round(name, 6)
    same = value == F.lag(value).over(by_quarter())
    islands = series.withColumn("_v", value).withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(by_quarter((Window.unboundedPreceding, 0))))
    sizes = islands.groupBy(KEY, "_island").agg(F.count("_v").alias("n"))
    return sizes.groupBy(KEY).agg(F.greatest(F.lit(1), F.max("n")).cast("long").alias("longest_run"))


def best_facts(facts: DataFrame) -> DataFrame:
    """The best fact of each company, metric and period. facts: company, metric, period, value, frame, days, form_rank, filed, concept_rank, unit_rank, ordinal.

    Score: 30 if the frame names the period, 24 less the days off 91 (never below 0), less 3 for each form rank. Ties: filed later,
    form of higher rank, earlier concept, unit and row.
    """
    score = F.when(F.col("frame").contains(F.col("period")), 30).otherwise(0) + F.greatest(F.lit(0), 24 - F.abs(F.col("days") - 91)) - 3 * F.col("form_rank")
    own = Window.partitionBy(KEY, "metric", "period").orderBy(F.desc("score"), F.desc("filed"), "form_rank", "concept_rank", "unit_rank", "ordinal")
    return facts.withColumn("score", score).withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def annual_delta(series: DataFrame, annual: DataFrame, name: str) -> DataFrame:
    """A missing quarter in which a year ends gets the year less its three quarters before, rounded to whole units; under half a unit is 0, over 1.4 times the year is refused
    (a year of 0 refuses nothing). Quarters go in order, so one that was filled serves the following. annual: company, quarter_index, annual.
    """
    rows = series.select(KEY, AT, F.col(name).alias("v")).join(annual, [KEY, AT], "full_outer")
    packed = rows.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(AT, "v", F.col("annual").cast("double").alias("annual")))).alias("rows"))  # a company's quarters
    kind = f"array<struct<{AT}:int,v:double,derived:boolean>>"

    def step(done: Column, row: Column) -> Column:
        recent = F.slice(done, F.greatest(F.size(done) - 2, F.lit(1)), F.lit(3))
        before = F.filter(recent, lambda x: (x[AT] >= row[AT] - 3) & x["v"].isNotNull())
        rest = row["annual"] - F.aggregate(before, F.lit(0.0), lambda a, x: a + x["v"])
        rest = F.when(F.abs(rest) < 0.5, 0.0).otherwise(rest)
        derived = F.when(row["v"].isNull() & (F.size(before) == 3) & ((row["annual"] == 0) | (F.abs(rest) <= 1.4 * F.abs(row["annual"]))), F.bround(rest))
        return F.concat(done, F.array(F.struct(row[AT].alias(AT), F.coalesce(row["v"], derived).alias("v"), derived.isNotNull().alias("derived"))))

    filled = packed.select(KEY, F.inline(F.aggregate("rows", F.array().cast(kind), step)))
    filled = filled.select(KEY, AT, F.col("v").alias(name), F.col("derived").alias(f"{name}_derived"))
    others = [c for c in series.columns if c not in (KEY, AT, name)]
    return filled.join(series.select(KEY, AT, *others), [KEY, AT], "left") if others else filled


def merged(base: DataFrame, official: DataFrame) -> DataFrame:
    """Official values fill what base lacks; official equity replaces base's."""
    b, o = base.alias("b"), official.alias("o")
    on = (F.col(f"b.{KEY}") == F.col(f"o.{KEY}")) & (F.col(f"b.{AT}") == F.col(f"o.{AT}"))
    first = lambda c: F.coalesce(f"b.{c}", f"o.{c}").alias(c)
    return b.join(o, on, "full_outer").select(first(KEY), first(AT), first("revenue"), first("earnings"), F.coalesce("o.equity", "b.equity").alias("equity"))


def merged_with_roe(base: DataFrame, official: DataFrame) -> DataFrame:
    """merged, and the trailing return on equity of what came out; none is carried over from base."""
    return trailing_roe(merged(base, official))


def concept_union(facts: DataFrame, metrics: list[str]) -> DataFrame:
    """company, period and a column for each metric: all periods that any concept has. facts: company, metric, period, value, one a key. One shuffle, no joins."""
    return facts.groupBy(KEY, "period").agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics))


def page_series(rows: DataFrame) -> DataFrame:
    """company, period (YYYYQn), revenue, earnings, gross_margin, revenue_yoy of a page's rows: whole numbers, change over the fourth row before. rows: company, date_key, revenue, earnings, gross_profit."""
    index = majority_index(F.try_to_date("date_key", "yyyy-MM-dd"))
    own = rows.select(KEY, index.alias(AT), F.col("revenue").cast("long").alias("revenue"), F.col("earnings").cast("long").alias("earnings"), (F.col("gross_profit") / F.nullif(F.col("revenue"), F.lit(0.0)) * 100).alias("gross_margin")).where(f"{AT} IS NOT NULL")
    before_ = F.nullif(F.lag("revenue", 4).over(by_quarter()), F.lit(0))
    return own.withColumns({"period": label(F.col(AT)), "revenue_yoy": (F.nullif(F.col("revenue"), F.lit(0)) - before_) / F.abs(before_) * 100})


def relabelled(series: DataFrame, new_index: Column) -> DataFrame:
    """Series under new quarters; of rows that meet in one, the later stays."""
    values = [c for c in series.columns if c not in (KEY, AT)]
    return series.withColumn("_new", new_index).groupBy(KEY, F.col("_new").alias(AT)).agg(*(F.max_by(c, AT).alias(c) for c in values))


def recomputed(series: DataFrame) -> DataFrame:
    """A second derivation: earnings growth keeps its old value where it can't be derived."""
    return series.withColumn("earnings_yoy", F.coalesce(pct_change(F.col("earnings"), before("earnings", 4)), F.col("earnings_yoy")))


def endpoints(series: DataFrame, name: str) -> DataFrame:
    """Per company: first, latest, previous, year-ago (or earliest), the middle one and cumulative change."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(AT), F.col(name).alias("v"))))
    g = series.groupBy(KEY).agg(rows.alias("r"))
    at = lambda k: F.get("r", F.size("r") - k)["v"]
    first, last = F.get("r", F.lit(0))["v"], at(1)
    return g.select(KEY, first.alias("first"), last.alias("latest"), F.when(F.size("r") >= 2, at(2)).otherwise(first).alias("previous"), F.when(F.size("r") >= 5, at(5)).otherwise(first).alias("year_ago"), F.get("r", F.floor(F.size("r") / 2).cast("int"))["v"].alias("middle"), pct_change(last, first).alias("total_change"))
