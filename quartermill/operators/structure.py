"""Revenue structures: items of a company's quarter by segment or geography.

A structure is long: company, quarter_index, name, value and position. Totals are windows over a quarter, which the grouping that
made the items has brought together already.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartermill.functions.subsets import best_places
from quartermill.operators.series import AT, KEY

QUARTER = [KEY, AT]


def in_quarter():
    return Window.partitionBy(*QUARTER)


def total() -> Column:
    return F.sum("value").over(in_quarter())


def normalised(items: DataFrame) -> DataFrame:
    """One item a name: values added, the first known note kept, in the place of the first."""
    return items.groupBy(*QUARTER, "name").agg(F.sum("value").alias("value"), F.min("position").alias("position"), F.min_by("note", F.when(F.col("note").isNotNull(), F.col("position"))).alias("note"))


def aliased(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names by their alias in full, else by the alias of their letters and digits, else as they are. aliases: alias, canonical; no alias twice."""
    token = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9一-鿿]+", "")
    exact = aliases.select(F.lower("alias").alias("_a"), F.col("canonical").alias("_by_name"))
    loose = aliases.groupBy(token(F.col("alias")).alias("_t")).agg(F.min("canonical").alias("_by_token"))
    met = items.withColumns({"_a": F.lower("name"), "_t": token(F.col("name"))}).join(exact, "_a", "left").join(loose, "_t", "left")
    return met.withColumn("name", F.coalesce("_by_name", "_by_token", "name")).drop("_a", "_t", "_by_name", "_by_token")


def shares(items: DataFrame) -> DataFrame:
    """Share of revenue if the items make up 0.55 to 1.35 of it, else of their sum; items without a positive value go. Reads revenue."""
    positive = items.where("value > 0")
    whole = F.when((total() / F.nullif(F.col("revenue"), F.lit(0))).between(0.55, 1.35), F.col("revenue")).otherwise(total())
    return positive.withColumn("share", F.col("value") / whole * 100)


#: Issuers whose items don't add up to revenue by design, and their bounds.
RATIO_BOUNDS = {"visa": (0.55, 1.55)}


def reasonable(items: DataFrame, low: float = 0.45, high: float = 1.45, bounds: DataFrame | None = None) -> DataFrame:
    """company, quarter_index, ratio of the items' sum to revenue, and whether it is in the band. bounds: company, low, high, for companies with a band of their own."""
    sums = items.groupBy(*QUARTER).agg((F.sum("value") / F.nullif(F.max("revenue"), F.lit(0))).alias("ratio"))
    if bounds is not None:
        sums = sums.join(bounds, KEY, "left")
    own = (F.coalesce("low", F.lit(low)), F.coalesce("high", F.lit(high))) if bounds is not None else (F.lit(low), F.lit(high))
    return sums.withColumn("reasonable", F.coalesce(F.col("ratio").between(*own), F.lit(False))).select(*QUARTER, "ratio", "reasonable")


def top_and_other(items: DataFrame, most: int = 5, least_share: float = 0.0) -> DataFrame:
    """At most `most` items a quarter: of more, the largest with `least_share` percent in their old order, and the others as one."""
    order = in_quarter().orderBy(F.desc("value"), "position")
    ranked = items.where("value > 0").withColumns({"_n": F.count("*").over(in_quarter()), "_k": F.row_number().over(order), "_share": F.col("value") / total() * 100})
    other = (F.col("_n") > most) & ((F.col("_k") > most - 1) | (F.col("_share") < least_share))
    return _with_other(ranked, other, "Other")


def first_and_other(items: DataFrame, most: int = 4, least_share: float = 5.0, name: str = "Other operating items") -> DataFrame:
    """At most `most` items a quarter: of more, the first ones with `least_share` percent, in their order, and the others as one."""
    large = F.col("value") / total() * 100 >= least_share
    ranked = items.withColumns({"_n": F.count("*").over(in_quarter()), "_large": large})
    ranked = ranked.withColumn("_k", F.sum(F.when(F.col("_large"), 1).otherwise(0)).over(in_quarter().orderBy("position").rowsBetween(Window.unboundedPreceding, 0)))
    return _with_other(ranked, (F.col("_n") > most) & ~(F.col("_large") & (F.col("_k") <= most - 1)), name).where("value > 0")


def _with_other(ranked: DataFrame, other: Column, name: str) -> DataFrame:
    named = ranked.withColumn("_other", other)
    named = named.withColumns({"name": F.when(F.col("_other"), name).otherwise(F.col("name")), "position": F.when(F.col("_other"), 1 << 30).otherwise(F.col("position")).cast("int")})
    return named.groupBy(*QUARTER, "name", "position").agg(F.sum("value").alias("value"))


def delta(items: DataFrame) -> DataFrame:
    """company, name, first, latest and change between a company's first and latest quarter; a name in one only counts 0 in the other."""
    edge = Window.partitionBy(KEY)
    marked = items.withColumns({"_a": F.min(AT).over(edge), "_b": F.max(AT).over(edge)})
    at = lambda q: F.coalesce(F.sum(F.when(F.col(AT) == F.col(q), F.col("value"))), F.lit(0.0))
    return marked.where("quarter_index IN (_a, _b)").groupBy(KEY, "name").agg(at("_a").alias("first"), at("_b").alias("latest")).withColumn("change", F.col("latest") - F.col("first"))


def delta_leader(items: DataFrame, least: float = 0.05) -> DataFrame:
    """The name that grew most, if by more than `least`."""
    return delta(items).where(F.col("change") > least).groupBy(KEY).agg(F.max_by("name", F.struct("change", "name")).alias("leader"), F.max("change").alias("change"))


#: Names of regions.
REGIONS = (
    "north america", "international", "other international", "united states", "u s", "u.s.", "u.s", "united states and canada", "other countries", "americas", "americas excluding united states", "americas excluding u.s.",
    "americas excluding us", "other americas", "europe", "greater china", "japan", "rest of asia pacific", "rest of asia-pacific", "other asia pacific", "other asia-pacific", "rest of asia", "asia", "asia-pacific", "asia pacific",
    "apac", "apj", "emea", "europe, the middle east and africa", "europe middle east africa", "europe / middle east / africa", "middle east and africa", "latin america / caribbean", "latin america/caribbean", "south korea",
    "singapore", "taiwan", "china", "china including hong kong", "mainland china excluding hong kong", "hong kong", "non u.s.", "non-u.s.", "rest of world", "others", "other",
)


def required_names(n: Column) -> Column:
    """Names a company's quarter needs, by how many canonical names it has."""
    return F.when(n >= 5, 3).when(n >= 3, 2).otherwise(1)


def incomplete(names: Column, n_canonical: Column) -> Column:
    """Whether a structure has too few names, or only regions though the company has three canonical names or more; none at all isn't incomplete."""
    regional = F.forall(names, lambda x: F.lower(x).isin(*REGIONS))
    return (F.size(names) > 0) & ((F.size(names) < required_names(n_canonical)) | (regional & (n_canonical >= 3)))


def name_profile(items: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """company, name, quarters it occurs in, rank, and whether it is a core name; with the target count of names.

    canonical: company, names (array in order); they come first, the others by how often they occur, then by where they stand.
    Quarters of regions alone don't count. The target is four fifths of the upper median number of names (of the required number at
    least; 2 at least, no more than there are, never less than required). Core names are the first two in rank that are in two fifths of
    the quarters, 2 at least; without such, the first two.
    """
    quarter = in_quarter()
    marked = items.select(*QUARTER, "name", "position").withColumns({
        "_only": F.bool_and(F.lower("name").isin(*REGIONS)).over(quarter),
        "_n": F.size(F.collect_set("name").over(quarter)),
        "_first": F.row_number().over(quarter.orderBy("position", "name")) == 1,
    }).where("NOT _only")
    # a quarter's number of names goes with its first item
    found = marked.groupBy(KEY, "name").agg(F.size(F.collect_set(AT)).cast("long").alias("quarters"), F.min(F.struct(AT, "position")).alias("_p"), F.collect_list(F.when(F.col("_first"), F.col("_n"))).alias("_sizes"))
    found = found.select(KEY, "name", "quarters", "_p", "_sizes", F.lit(None).cast("int").alias("_place"))
    if canonical is not None:
        wanted = canonical.select(KEY, F.posexplode("names").alias("_place", "name"), F.lit(0).cast("long").alias("_none"))
        found = found.drop("_place").join(wanted, [KEY, "name"], "full_outer").select(KEY, "name", F.coalesce("quarters", "_none").alias("quarters"), "_p", "_sizes", "_place")
        required = required_names(F.max(F.col("_place") + 1).over(Window.partitionBy(KEY)))
    else:
        required = F.lit(1)
    w = Window.partitionBy(KEY)
    order = w.orderBy(F.col("_place").asc_nulls_last(), F.desc("quarters"), "_p", "name")
    found = found.withColumn("_sizes", F.sort_array(F.flatten(F.collect_list("_sizes").over(w))))
    found = found.withColumns({"_quarters": F.size("_sizes"), "_median": F.get("_sizes", F.floor(F.size("_sizes") / 2).cast("int"))})
    ranked = found.withColumns({"rank": F.row_number().over(order), "_names": F.count("*").over(w), "_required": F.coalesce(required, F.lit(1))})
    most = F.greatest(F.lit(2), F.bround(F.greatest(F.coalesce("_median", F.lit(0)), F.col("_required")) * 0.8))
    target = F.greatest(F.col("_required"), F.least(F.col("_names"), most))
    stable = F.coalesce((F.col("_quarters") > 0) & (F.col("quarters") >= F.greatest(F.lit(2), F.bround(F.col("_quarters") * 0.4))), F.lit(False))
    ranked = ranked.withColumns({"_stable": stable, "_k": F.sum(F.when(stable, 1).otherwise(0)).over(w.orderBy("rank"))})
    core = F.when(F.max("_k").over(w) > 0, F.col("_stable") & (F.col("_k") <= 2)).otherwise(F.col("rank") <= 2)
    return ranked.select(KEY, "name", "quarters", "rank", core.alias("core"), target.cast("long").alias("target"))


def complete_snapshots(items: DataFrame, profile: DataFrame) -> DataFrame:
    """company, quarter_index, names known to the profile, core names present, and whether the quarter is complete.

    Complete: as many known names as the target, and one core name (two if the target is four or more, no more than there are).
    """
    met = items.where("value > 0").join(profile.select(KEY, "name", "core", "target"), [KEY, "name"], "left")
    found = met.groupBy(*QUARTER).agg(F.count("core").alias("known"), F.count_if("core").alias("core"))
    need = profile.groupBy(KEY).agg(F.max("target").alias("target"), F.count_if("core").alias("_cores"))
    wanted = F.least(F.col("_cores"), F.when(F.col("target") >= 4, 2).otherwise(1))
    return found.join(need, KEY).select(KEY, AT, "known", "core", ((F.col("known") >= F.col("target")) & (F.col("core") >= wanted)).alias("complete"))


def snapshot_quality(items: DataFrame, profile: DataFrame) -> DataFrame:
    """company, quarter_index, count, coverage, reasonable, complete of each structure. Reads revenue."""
    sums = items.where("value > 0").groupBy(*QUARTER).agg(F.count("*").alias("count"), F.coalesce(F.sum("value") / F.nullif(F.max("revenue"), F.lit(0.0)), F.lit(0.0)).alias("coverage"))
    met = sums.join(complete_snapshots(items, profile).select(*QUARTER, "complete"), QUARTER, "left")
    fit = F.col("coverage").between(0.45, 1.45)
    return met.select(*QUARTER, "count", "coverage", fit.alias("reasonable"), (fit & F.coalesce("complete", F.lit(False))).alias("complete"))


def should_replace(existing: Column, found: Column, partial: bool) -> Column:
    """Whether a found snapshot replaces the existing one; both: struct<count, coverage, reasonable, complete>, count 0 for none.

    Nothing never does, and anything replaces nothing. A complete one stays against an incomplete one and replaces it; of two complete
    ones the found one needs as many items and at most 0.03 less coverage. Otherwise, if partial ones may: more items,
    over 0.08 more coverage, or an unreasonable existing one.
    """
    better = (found["count"] > existing["count"]) | (found["coverage"] > existing["coverage"] + 0.08) | ~existing["reasonable"]
    return (
        F.when(found["count"] == 0, False)
        .when(existing["count"] == 0, True)
        .when(existing["complete"] != found["complete"], found["complete"])
        .when(found["complete"], (found["count"] >= existing["count"]) & (found["coverage"] >= existing["coverage"] - 0.03))
        .otherwise(better if partial else F.lit(False))
    )


def replacement(existing: DataFrame, found: DataFrame, partial: bool = True) -> DataFrame:
    """company, quarter_index, replace of each found snapshot; both: snapshot_quality."""
    pack = lambda df, name: df.select(*QUARTER, F.struct(F.col("count").cast("long").alias("count"), "coverage", "reasonable", "complete").alias(name))
    none = F.struct(F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("coverage"), F.lit(False).alias("reasonable"), F.lit(False).alias("complete"))
    met = pack(found, "found").join(pack(existing, "existing"), QUARTER, "left")
    return met.select(*QUARTER, should_replace(F.coalesce("existing", none), F.col("found"), partial).alias("replace"))


def dominant_basis(kinds: DataFrame) -> DataFrame:
    """company, basis: 'geography' if more of its quarters have that kind; equal: 'segment'. kinds: company, kind."""
    return kinds.groupBy(KEY).agg(F.when(F.count_if(F.col("kind") == "geography") > F.count_if(F.col("kind") == "segment"), "geography").otherwise("segment").alias("basis"))


def harmonised(kinds: DataFrame) -> DataFrame:
    """A company with any valid segment quarter is on the segment basis; its other quarters are cleared. kinds: company, quarter_index, kind, valid."""
    on_segments = F.bool_or((F.col("kind") == "segment") & F.col("valid")).over(Window.partitionBy(KEY))
    keep = F.col("valid") & (F.col("kind") == F.when(on_segments, "segment").otherwise("geography"))
    return kinds.withColumn("kind_kept", F.when(keep, F.col("kind")))


def inferred_shares(items: DataFrame, quarters: DataFrame, least: float = 0.2) -> DataFrame:
    """Structures of quarters without one, between (or beside) quarters that have one; shares under `least` percent go after the total is taken.

    items: company, quarter_index, name, share; quarters: company, quarter_index, revenue, every quarter in question.
    """
    anchors = items.select(*QUARTER).distinct().withColumn("_anchor", F.lit(True))
    w = Window.partitionBy(KEY).orderBy(AT)
    rows = quarters.withColumn("_row", F.row_number().over(w)).join(anchors, QUARTER, "left")
    at = F.when(F.col("_anchor"), F.struct(F.col(AT).alias("q"), F.col("_row").alias("r")))
    rows = rows.withColumns({"_p": F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_n": F.first(at, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    missing = rows.where("_anchor IS NULL AND (_p IS NOT NULL OR _n IS NOT NULL)")
    weight = F.when(F.col("_p").isNull(), 1.0).when(F.col("_n").isNull(), 0.0).otherwise((F.col("_row") - F.col("_p.r")) / (F.col("_n.r") - F.col("_p.r")))
    sides = missing.select(*QUARTER, "revenue", F.explode(F.array(F.struct(F.col("_p.q").alias("q"), (1 - weight).alias("w")), F.struct(F.col("_n.q").alias("q"), weight.alias("w")))).alias("s")).select(*QUARTER, "revenue", F.col("s.q").alias("_q"), F.col("s.w").alias("_w")).where("_q IS NOT NULL AND _w > 0")
    source = items.select(F.col(KEY).alias("_c"), F.col(AT).alias("_q2"), "name", "share")
    mixed = sides.join(source, (F.col(KEY) == F.col("_c")) & (F.col("_q") == F.col("_q2"))).groupBy(*QUARTER, "name").agg(F.sum(F.col("share") * F.col("_w")).alias("_s"), F.max("revenue").alias("revenue"))
    share = F.col("_s") / F.sum("_s").over(in_quarter()) * 100
    return mixed.withColumn("share", share).where(F.col("share") >= least).select(*QUARTER, "name", "share", (F.col("share") * F.col("revenue") / 100).alias("value"))


def rescaled(items: DataFrame) -> DataFrame:
    """Values scaled to add up to revenue where they are less than 0.55 or more than 1.35 of it, three decimals; changes beyond 500 % are null.

    items: company, quarter_index, name, value, revenue, yoy, scope. Structures that are annual or regional throughout keep their values.
    """
    quarterly = F.bool_or(~F.lower(F.coalesce("scope", F.lit(""))).isin("annual_filing", "regional_segment")).over(in_quarter())
    ratio = total() / F.nullif(F.col("revenue"), F.lit(0.0))
    off = quarterly & (total() > 0) & ~ratio.between(0.55, 1.35)
    value = F.when(F.coalesce(off, F.lit(False)), F.col("revenue") * F.col("value") / total()).otherwise(F.col("value"))
    return items.where("value IS NOT NULL").withColumns({"scaled": F.bround(value, 3), "yoy": F.when(F.abs("yoy") <= 500, F.col("yoy"))})


def flows(items: DataFrame, fallback: str = "Rest") -> DataFrame:
    """Flow values that meet `target`: small items go; a gap over max(0.2, 6 %) becomes a rest, an excess over it scales all, what is less goes to the last item.

    items: company, quarter_index, name, value, position, target.
    """
    clean = items.where("target > 0 AND value > 0.03")
    gap = F.col("target") - total()
    tolerance = F.greatest(F.lit(0.2), F.col("target") * 0.06)
    last = F.row_number().over(in_quarter().orderBy(F.desc("position"))) == 1
    flow = F.when(gap < -tolerance, F.col("value") * F.col("target") / total()).when((gap <= tolerance) & last, F.greatest(F.col("value") + gap, F.lit(0.0))).otherwise(F.col("value"))
    sized = clean.withColumn("flow", flow).select(*QUARTER, "name", "flow")
    rest = items.where("target > 0").groupBy(*QUARTER).agg(F.max("target").alias("t"), F.coalesce(F.sum(F.when(F.col("value") > 0.03, F.col("value"))), F.lit(0.0)).alias("s"))
    rest = rest.where("t - s > greatest(0.2, t * 0.06)").select(*QUARTER, F.lit(fallback).alias("name"), F.expr("t - s").alias("flow"))
    return sized.unionByName(rest)


def allocated(items: DataFrame) -> DataFrame:
    """Annual items as a quarter's: revenue by their share of the year, two items at least, 0.001 at least."""
    value = F.greatest(F.lit(0.001), F.col("revenue") * F.col("value") / total())
    return items.withColumn("_n", F.count("*").over(in_quarter())).withColumn("quarter_value", value).where("_n >= 2").drop("_n")


def income_bridge(rows: DataFrame) -> DataFrame:
    """Gross profit and operating profit of revenue, cost and opex; nothing below 0."""
    floor = lambda x: F.greatest(x, F.lit(0.0))
    gross = F.col("revenue") - F.col("cost")
    return rows.withColumns({"gross_profit": floor(gross), "operating_profit": floor(gross - F.col("opex")), "cost": floor(F.col("cost")), "opex": floor(F.col("opex"))})


#: Names of aggregates by issuer; issuers whose items keep the official order, and the one whose items stay as they are.
AGGREGATES = {"apple": ("products",), "alphabet": ("google services",)}
OFFICIAL_ORDER, KEPT_WHOLE = ("micron", "visa"), ("visa",)


def best_subset(quarters: DataFrame) -> DataFrame:
    """The items that best make up revenue, of all subsets. quarters: company, quarter_index, revenue, items array<struct<name, value, business, aggregate>>, ordered boolean.

    A subset's sum must be 0.45 to 1.18 of revenue. Score: closeness, 0.06 if all items are of one family (else less 0.08), 0.03 an item
    and 0.015 a business item, less 0.09 an aggregate. Ties: fewer items, then the earlier ones. The largest comes first unless the
    row is `ordered`. Items without a positive value go; a lone item, and items of which no subset fits, stay.

    Two halves of the items meet in the middle (functions.subsets), in Arrow batches: a row's memory is bounded by a half's subsets,
    forty items take under a second. No row is multiplied and nothing shuffles.
    """
    few = quarters.withColumn("items", F.filter("items", lambda x: x["value"] > 0))
    part = lambda name, kind: F.transform("items", lambda x: x[name].cast(kind))
    places = best_places(part("value", "double"), part("business", "boolean"), part("aggregate", "boolean"), F.col("revenue").cast("double"))
    few = few.withColumn("_places", places)
    kept = F.when(F.col("_places").isNull(), F.col("items")).otherwise(F.transform("_places", lambda i: F.get("items", i)))
    by_value = F.transform(F.array_sort(F.transform(kept, lambda x, i: F.struct((-x["value"]).alias("v"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    return few.withColumn("kept", F.when(F.col("ordered") | F.col("_places").isNull(), kept).otherwise(by_value)).drop("_places")


#: Coarse and plain region names, pairs of names that say little, and buckets beside the United States.
COARSE = ("international", "other countries", "rest of world", "non-u.s.")
PLAIN = ("united states", "u.s.", "u.s", "north america", "international", "asia", "europe", "americas", "japan", "emea", "apac", "asia-pacific")
AMBIGUOUS = (("north america", "international"), ("united states", "international"), ("united states", "canada", "other international"))
BESIDE_HOME = ("international", "other international", "other countries", "non-u.s.")


def _region_names(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.lower(F.trim(x["name"]))), lambda n: F.coalesce(n != "", F.lit(False))))


def ambiguous(names: Column) -> Column:
    """Whether lower-case names are just those that stand for several tables."""
    same = lambda want: (F.size(names) == len(want)) & (F.size(F.array_except(names, F.array(*map(F.lit, want)))) == 0)
    return same(AMBIGUOUS[0]) | same(AMBIGUOUS[1]) | same(AMBIGUOUS[2])


def geography_detail(items: Column) -> Column:
    """10 a name, less 12 for an ambiguous set, a point for each that isn't plain, less 2 for each coarse one; no items: -100. items: array<struct<name, ...>>."""
    names = _region_names(items)
    coarse = F.size(F.filter(names, lambda n: reduce(or_, (n.contains(c) for c in COARSE))))
    fine = F.size(F.filter(names, lambda n: ~n.isin(*PLAIN)))
    return F.when(F.size(items) == 0, -100).otherwise(F.size(names) * 10 - F.when(ambiguous(names), 12).otherwise(0) - 2 * coarse + fine)


def suspicious_geographies(items: Column, revenue: Column) -> Column:
    """Items without a positive sum; one of 95 % beside one of 2 % and less, where one of 1 % and less moved by 300 %; the United States under 2 % beside an
    international bucket; all under 8 % of revenue. No items aren't suspicious. items: array<struct<name, value, yoy>>."""
    value = lambda x: F.greatest(F.coalesce(x["value"], F.lit(0.0)), F.lit(0.0))
    whole = F.aggregate(items, F.lit(0.0), lambda a, x: a + value(x))
    shares = F.transform(items, lambda x: F.struct(F.lower(x["name"]).alias("name"), (value(x) / whole).alias("share"), F.abs(F.coalesce(x["yoy"], F.lit(0.0))).alias("move")))
    lone = F.exists(shares, lambda s: s["share"] >= 0.95) & F.exists(shares, lambda s: s["share"] <= 0.02) & F.exists(shares, lambda s: (s["share"] <= 0.01) & (s["move"] >= 300))
    last = lambda name: F.get(F.reverse(F.filter(shares, lambda s: s["name"] == name)), F.lit(0))["share"]
    home = F.exists(shares, lambda s: s["name"].isin(*BESIDE_HOME)) & reduce(or_, (F.coalesce(last(n) < 0.02, F.lit(False)) for n in ("united states", "u.s.", "u.s")))
    small = F.coalesce(whole / F.nullif(revenue, F.lit(0.0)) < 0.08, F.lit(False))
    return F.when(F.size(items) == 0, False).when(whole <= 0, True).otherwise(lone | home | small)


def richer_geographies(current: Column, found: Column, revenue: Column) -> Column:
    """found, where it isn't suspicious and current is, or is empty; or it has three names and more instead of two and less, two more names and more detail, or 8 more detail."""
    n, m = F.size(_region_names(current)), F.size(_region_names(found))
    a, b = geography_detail(current), geography_detail(found)
    better = ((m >= 3) & (n <= 2)) | ((m >= n + 2) & (b > a)) | (b >= a + 8)
    return (
        F.when((F.size(found) == 0) | suspicious_geographies(found, revenue), current)
        .when((F.size(current) == 0) | suspicious_geographies(current, revenue), found)
        .when(better, found)
        .otherwise(current)
    )


def geography_like(names: Column, regions: Column, markers: Column, canonical: Column) -> Column:
    """All names are regions, or all contain a marker, and not all are the company's own segment names."""
    low = F.transform(names, F.lower)
    every = (F.size(F.array_except(low, regions)) == 0) | F.forall(low, lambda n: F.exists(markers, lambda m: n.contains(m)))
    return (F.size(names) > 0) & every & (F.size(F.array_except(low, canonical)) > 0)


def without_overlap(segments: DataFrame, geographies: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """geographies less the quarters where every item is also a segment of the same value."""
    g, s = geographies.alias("g"), segments.alias("s")
    same = g.join(s, [F.col(f"g.{c}") == F.col(f"s.{c}") for c in QUARTER] + [F.lower("g.name") == F.lower("s.name"), F.abs(F.col("g.value") - F.col("s.value")) <= tolerance], "left_semi")
    hits = same.groupBy(*QUARTER).agg(F.count("*").alias("_hits"))
    sizes = geographies.groupBy(*QUARTER).agg(F.count("*").alias("_n"))
    bad = hits.join(sizes, QUARTER).where("_hits = _n").select(*QUARTER)
    return geographies.join(bad, QUARTER, "left_anti")


def promoted(payload: DataFrame) -> DataFrame:
    """Geographies stand in for missing segments, two at least. payload: segments and geographies, arrays of struct<name, value>."""
    proxy = F.transform("geographies", lambda g: F.struct(g["name"].alias("name"), g["value"].alias("value"), F.lit("geo_proxy").alias("scope")))
    own = F.transform("segments", lambda g: F.struct(g["name"].alias("name"), g["value"].alias("value"), F.lit("segment").alias("scope")))
    return payload.withColumn("segments", F.when((F.size("segments") == 0) & (F.size("geographies") >= 2), proxy).otherwise(own))


def crosswalk(shares_: DataFrame, weights: DataFrame, revenue: Column, least: float = 85.0) -> DataFrame:
    """Shares of one breakdown as values of another, if they make up `least` percent. weights: from_name, to_name, weight."""
    whole = F.sum("share").over(in_quarter())
    met = shares_.withColumn("_whole", whole).where(F.col("_whole") >= least).join(weights, F.col("name") == F.col("from_name"))
    return met.groupBy(*QUARTER, F.col("to_name").alias("name")).agg(F.sum(F.col("weight") * F.col("share") * revenue / 100).alias("value"))
