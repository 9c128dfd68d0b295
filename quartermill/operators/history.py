"""A company's history of quarters, enriched by what was parsed from official material and refreshed by the latest figures.

History: company, quarter_index, revenue, earnings, equity, gross_margin, net_margin, revenue_yoy, earnings_yoy (doubles, billions
and percent), segments and geographies (array<struct<name, value>>), basis, source_type, source_url, release_date (strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartermill.functions.numbers import candidate, pct_change, revenue_candidate
from quartermill.operators.series import AT, KEY, before, by_quarter, trailing_sum
from quartermill.operators.structure import QUARTER, REGIONS, name_profile, should_replace

ITEMS = "array<struct<name:string,value:double>>"
METRICS = ("revenue", "earnings", "gross_margin", "revenue_yoy", "earnings_yoy", "equity")


def _empty() -> Column:
    return F.array().cast(ITEMS)


def normal_items(items: Column) -> Column:
    """Items with a positive value."""
    return F.filter(F.coalesce(items, _empty()), lambda x: x["value"] > 0)


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x["value"])


def array_quality(items: Column, revenue: Column, names: Column, cores: Column, target: Column) -> Column:
    """struct<count, coverage, reasonable, complete> of a quarter's segments against the company's profile; regions alone count as none."""
    own = normal_items(items)
    regional = F.forall(own, lambda x: F.lower(x["name"]).isin(*REGIONS))
    used = F.when(regional, _empty()).otherwise(own)
    coverage = F.coalesce(_sum(used) / F.nullif(revenue, F.lit(0.0)), F.lit(0.0))
    fit = (F.size(used) > 0) & coverage.between(0.45, 1.45)
    known = F.size(F.filter(used, lambda x: (F.size(names) == 0) | F.array_contains(names, x["name"])))
    core = F.size(F.filter(used, lambda x: F.array_contains(cores, x["name"])))
    need = F.least(F.size(cores), F.when(target >= 4, 2).otherwise(1))
    return F.struct(F.size(used).cast("long").alias("count"), coverage.alias("coverage"), fit.alias("reasonable"), (fit & (known >= target) & (core >= need)).alias("complete"))


def profiles(history: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """company, names, cores (arrays), target: structure.name_profile of a history, packed."""
    items = history.select(*QUARTER, F.posexplode("segments").alias("position", "s")).select(*QUARTER, F.col("s.name").alias("name"), "position").where("name IS NOT NULL")
    rows = name_profile(items, canonical)
    return rows.groupBy(KEY).agg(F.collect_list("name").alias("names"), F.collect_list(F.when(F.col("core"), F.col("name"))).alias("cores"), F.max("target").alias("target"))  # a company's names


def enriched(history: DataFrame, found: DataFrame, needs_metrics: DataFrame, profile: DataFrame) -> DataFrame:
    """history with the figures and structures of `found` where they pass the gates.

    found: company, quarter_index, revenue, earnings, equity, gross_margin, revenue_yoy, earnings_yoy, segments, geographies,
    source_url, source_date, adjusted (profit is an adjusted one), stale (structures of another period's snapshot).
    needs_metrics: company, needed. profile: profiles().

    Only quarters without a structure, or where figures are needed and missing, are looked at. Revenue and profit must be near what is
    known; margins, changes and equity within bounds. Complete segments replace what should_replace allows; reasonable ones of two items
    and more do so as partial ones; else geographies stand in for segments that aren't complete.
    """
    f = found.select(*QUARTER, F.struct(*(c for c in found.columns if c not in QUARTER)).alias("_f"))
    met = history.join(f, QUARTER, "left").join(needs_metrics.select(KEY, F.col("needed").alias("_needed")), KEY, "left").join(profile, KEY, "left")
    bare = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    missing = F.coalesce("_needed", F.lit(False)) & ~F.array_compact(F.array(*(F.when(F.col(c).isNull(), 1) for c in METRICS))).eqNullSafe(F.array().cast("array<int>"))
    looked = F.col("_f").isNotNull() & (bare("segments") | bare("geographies") | missing)
    new = lambda c: F.col("_f")[c]
    old = {c: F.col(c) for c in history.columns}
    earnings = F.coalesce(F.when(new("adjusted") & new("earnings").isNotNull(), new("earnings")).otherwise(candidate(old["earnings"], new("earnings"), 0.25, 2.8)), old["earnings"])
    revenue = F.coalesce(revenue_candidate(old["revenue"], new("revenue"), earnings), old["revenue"])
    within = lambda c, condition: F.when(condition, new(c)).otherwise(old[c])
    figures = {
        "revenue": revenue,
        "earnings": earnings,
        "equity": within("equity", new("equity") > 0),
        "gross_margin": within("gross_margin", new("gross_margin").between(-10, 95)),
        "revenue_yoy": within("revenue_yoy", F.abs(new("revenue_yoy")) <= 500),
        "earnings_yoy": within("earnings_yoy", F.abs(new("earnings_yoy")) <= 800),
    }
    met = met.withColumns({"_looked": F.coalesce(looked, F.lit(False))})
    met = met.withColumns({c: F.when(F.col("_looked"), v).otherwise(old[c]) for c, v in figures.items()})
    met = met.withColumn("net_margin", F.when(F.col("_looked") & F.col("earnings").isNotNull(), F.coalesce(F.col("earnings") / F.nullif(F.col("revenue"), F.lit(0.0)) * 100, "net_margin")).otherwise(F.col("net_margin")))
    trusted = F.coalesce(F.nullif("revenue", F.lit(0.0)), new("revenue"))
    names, cores, target = F.coalesce("names", F.array().cast("array<string>")), F.coalesce("cores", F.array().cast("array<string>")), F.coalesce("target", F.lit(1).cast("long"))
    met = met.select("*", F.explode(F.array(F.struct(array_quality(F.col("segments"), trusted, names, cores, target).alias("had"), array_quality(new("segments"), trusted, names, cores, target).alias("got"), normal_items(new("segments")).alias("s"), normal_items(new("geographies")).alias("g")))).alias("_q"))
    had, got, s, g = (F.col("_q")[c] for c in ("had", "got", "s", "g"))
    whole = got["complete"] & should_replace(had, got, False)
    part = (F.size(s) >= 2) & got["reasonable"] & should_replace(had, got, True)
    instead = (F.size(g) > 0) & ~had["complete"]
    case = lambda a, b, c, otherwise: F.when(F.col("_looked") & whole, a).when(F.col("_looked") & part, b).when(F.col("_looked") & instead, c).otherwise(otherwise)
    told = ~F.coalesce(new("stale"), F.lit(False)) & (new("revenue").isNotNull() | new("earnings").isNotNull() | new("equity").isNotNull() | (F.size(s) > 0) | (F.size(g) > 0))
    iso = (F.length(new("source_date")) == 10) & (F.substring(new("source_date"), 5, 1) == "-") & (F.substring(new("source_date"), 8, 1) == "-")
    changed = {
        "basis": case(F.lit("segment"), F.lit("segment_partial"), F.lit("geography"), F.col("basis")),
        "segments": case(s, s, _empty(), F.col("segments")),
        "geographies": F.when(F.col("_looked") & (F.size(g) > 0), g).otherwise(F.col("geographies")),
        "source_type": F.when(F.col("_looked") & told, "official_release").otherwise(F.col("source_type")),
        "source_url": F.when(F.col("_looked") & (new("source_url") != ""), new("source_url")).otherwise(F.col("source_url")),
        "release_date": F.when(F.col("_looked") & iso, new("source_date")).otherwise(F.col("release_date")),
    }
    return met.withColumns(changed).select(*history.columns)


def refreshed(history: DataFrame, latest: DataFrame) -> DataFrame:
    """history, a company's last quarter filled from its latest figures and what follows from them worked out again; other quarters stay.

    latest: company, revenue, earnings, equity, gross_margin, revenue_yoy, earnings_yoy, segments, geographies. Adds revenue_qoq,
    ttm_revenue and ttm_growth (null but for the last quarter) and is_latest.
    """
    whole = Window.partitionBy(KEY)
    k = latest.select(KEY, F.struct(*(c for c in latest.columns if c != KEY)).alias("_k"))
    met = history.withColumn("is_latest", F.col(AT) == F.max(AT).over(whole)).join(k, KEY, "left")
    last = F.col("is_latest") & F.col("_k").isNotNull()
    new = lambda c: F.col("_k")[c]
    fill = {c: F.when(last, F.coalesce(new(c), F.col(c))).otherwise(F.col(c)) for c in ("revenue", "earnings", "gross_margin", "revenue_yoy", "earnings_yoy")}
    fill["equity"] = F.when(last & (new("equity") > 0), new("equity")).otherwise(F.col("equity"))
    met = met.withColumns(fill)
    some = lambda c: last & (F.coalesce(F.size(new(c)), F.lit(0)) > 0)
    segmented = some("segments") & (F.coalesce(F.col("revenue"), F.lit(0.0)) != 0)
    met = met.withColumns({
        "segments": F.when(segmented, new("segments")).otherwise(F.col("segments")),
        "geographies": F.when(some("geographies"), new("geographies")).otherwise(F.col("geographies")),
        "basis": F.when(segmented, "segment").when(some("geographies") & (F.coalesce(F.size("segments"), F.lit(0)) == 0), "geography").otherwise(F.col("basis")),
        "net_margin": F.when(last & F.col("earnings").isNotNull() & F.col("revenue").isNotNull(), F.col("earnings") / F.nullif(F.col("revenue"), F.lit(0.0)) * 100).otherwise(F.col("net_margin")),
    })
    ttm = trailing_sum("revenue")
    met = met.withColumn("_ttm", ttm)
    yoy = pct_change(F.col("earnings"), before("earnings", 4))
    met = met.withColumns({
        "earnings_yoy": F.when(F.col("is_latest"), F.coalesce(yoy, "earnings_yoy")).otherwise(F.col("earnings_yoy")),
        "revenue_qoq": F.when(F.col("is_latest"), pct_change(F.col("revenue"), before("revenue", 1))),
        "ttm_revenue": F.when(F.col("is_latest"), F.col("_ttm")),
        "ttm_growth": F.when(F.col("is_latest") & (F.row_number().over(by_quarter()) >= 8), pct_change(F.col("_ttm"), before("_ttm", 4))),
    })
    return met.drop("_ttm", "_k")
