"""Revenue by geography from filings: generic profiles, HTML tables, and the tables of single issuers by configuration.

An issuer's table is a heading and rows of a label and numbers; a layout says which of the numbers are now and before. New tables are
rows of TABLES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartermill.functions import tables as H
from quartermill.functions.extract import NUMBER, bound, change, metric, quoted, tokens
from quartermill.functions.numbers import parsed
from quartermill.functions.periods import is_annual
from quartermill.functions.text import has_any
from quartermill.operators.structure import richer_geographies

ITEMS = "array<struct<name:string,value:double,yoy:double,scope:string>>"

#: Regions and their labels in generic tables, in order.
REGION_LABELS = {
    "United States": ("United States", "U.S.", "U.S", "US"), "Canada": ("Canada",), "United States and Canada": ("United States and Canada", "United States & Canada", "US & Canada"), "North America": ("North America",),
    "Americas": ("Americas",), "Americas Excluding U.S.": ("Other Americas", "Americas Excluding United States", "Americas Excluding U.S."), "Latin America / Caribbean": ("Latin America/Caribbean", "Latin America / Caribbean"),
    "Europe": ("Europe",), "Europe, the Middle East and Africa": ("Europe, the Middle East and Africa", "Europe, Middle East and Africa", "Europe/Middle East/Africa", "Europe / Middle East / Africa"), "EMEA": ("EMEA",),
    "Asia Pacific": ("Asia Pacific", "Asia-Pacific", "APAC"), "APJ": ("APJ", "Asia Pacific and Japan"), "Japan": ("Japan",), "Greater China": ("Greater China",), "China": ("China",), "Taiwan": ("Taiwan",),
    "South Korea": ("South Korea", "Korea"), "Rest of Asia Pacific": ("Rest of Asia Pacific", "Rest of Asia-Pacific"), "Rest of World": ("Rest of World",), "International": ("International",),
    "Other International": ("Other International",), "Other countries": ("Other countries",),
}
_WIDE = ("Europe, the Middle East and Africa", "Europe, Middle East and Africa")
_SALES = lambda name: (name, f"{name} net sales", f"{name} revenue")
#: Sets of regions that filings report together, each with its labels.
PROFILES = (
    {"Americas": _SALES("Americas"), "Europe": _SALES("Europe"), "Japan": _SALES("Japan"), "Asia-Pacific": ("Asia-Pacific", "Asia Pacific", "Asia-Pacific net sales", "Asia Pacific net sales", "Asia-Pacific revenue"), "Retail": _SALES("Retail")},
    {"United States and Canada": REGION_LABELS["United States and Canada"], "Europe": _SALES("Europe"), "Asia-Pacific": ("Asia-Pacific", "Asia Pacific", "Asia-Pacific net sales", "Asia Pacific net sales"), "Rest of World": ("Rest of World",)},
    {"Americas": _SALES("Americas"), "Europe": _SALES("Europe"), "Greater China": _SALES("Greater China"), "Japan": _SALES("Japan"), "Rest of Asia Pacific": ("Rest of Asia Pacific", "Rest of Asia-Pacific", "Rest of Asia Pacific net sales", "Rest of Asia-Pacific net sales")},
    {"United States": ("United States", "U.S."), "EMEA": ("EMEA", *_WIDE), "Asia Pacific": ("APAC", "Asia Pacific", "Asia-Pacific"), "Americas Excluding U.S.": REGION_LABELS["Americas Excluding U.S."]},
    {"United States": ("United States", "U.S."), "International": ("International", "Other countries")},
    {"United States": ("United States", "U.S.", "United States "), "Canada": ("Canada",), "Other International": ("Other International",)},
    {"North America": ("North America",), "International": ("International",)},
    {"United States": ("United States", "U.S."), "EMEA": ("EMEA", *_WIDE), "APAC": ("APAC", "Asia Pacific", "Asia-Pacific")},
    {"Americas": ("Americas",), "EMEA": ("EMEA", *_WIDE), "APJ": ("APJ", "Asia Pacific and Japan")},
    {"Americas": ("Americas",), "Asia Pacific": ("Asia Pacific", "Asia-Pacific", "APAC"), "Europe, the Middle East and Africa": (*_WIDE, "EMEA")},
)
#: Places of the profiles whose names alone don't tell that a row is of a geography, and what does.
VAGUE = (4, 5, 6)
CONTEXT = ("geographic", "geography", "region", "customers were located", "revenue by geographic", "geographic area", "geographic region")


def item(name: str | Column, value: Column, yoy: Column, scope: Column | None = None) -> Column:
    """A geography: value with three decimals, change with one; null without a value."""
    own = F.lit(name) if isinstance(name, str) else name
    made = F.struct(own.alias("name"), F.bround(value, 3).alias("value"), F.bround(yoy, 1).alias("yoy"), (F.lit(None).cast("string") if scope is None else scope).alias("scope"))
    return F.when(value.isNotNull(), made)


def _of_values(name: str, now: int, before: int, scope: Column):
    """An item of a row's numbers, millions; null without them."""
    return lambda v: item(name, F.get(v, F.lit(now)) / 1000, change(F.get(v, F.lit(now)), F.get(v, F.lit(before))), scope)


def by_value(items: Column) -> Column:
    """The largest first; equals in their order."""
    return F.transform(F.array_sort(F.transform(items, lambda x, i: F.struct((-x["value"]).alias("v"), i.alias("i"), x.alias("x")))), lambda s: s["x"])


def added(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x["value"], F.lit(0.0)))


def reasonable(items: Column, revenue: Column, low: float = 0.55, high: float = 1.35) -> Column:
    return F.coalesce((F.size(items) > 0) & (added(items) / F.nullif(revenue, F.lit(0.0))).between(low, high), F.lit(False))


def profile_geographies(materials: DataFrame) -> DataFrame:
    """company, quarter_index, geographies: the best profile over a quarter's materials. materials: company, quarter_index, material_rank, kind, label, text, revenue.

    A profile needs two regions and scores ten a region and the whole part of their sum. The best whose sum fits revenue wins, in the order of
    profiles, then materials; else the best of an annual report, marked as annual. Each label is looked for once a text; a region's
    value is that of its first label with a row.
    """
    text, annual = F.col("text"), is_annual(F.col("label"))
    labels = list(dict.fromkeys(label for p in PROFILES for own in p.values() for label in own))
    rows = materials.select("company", "quarter_index", "material_rank", "text", "revenue", annual.alias("annual"), F.explode(F.array(F.struct(*(metric(text, [label]).alias(f"l{k}") for k, label in enumerate(labels))))).alias("m"))
    context = has_any(F.lower(text), CONTEXT)
    tried = []
    for n, profile in enumerate(PROFILES):
        found = [F.coalesce(*(F.col(f"m.l{labels.index(label)}") for label in own)) for own in profile.values()]
        items = F.array_compact(F.array(*(item(name, x["value"], x["yoy"]) for name, x in zip(profile, found))))
        tried.append(F.struct(F.lit(n).alias("profile"), (F.when(context, items) if n in VAGUE else items).alias("items")))
    sets = rows.select("company", "quarter_index", "material_rank", "revenue", "annual", F.explode(F.array(*tried)).alias("p")).select("*", "p.profile", "p.items").where(F.size("items") >= 2)
    sets = sets.withColumn("score", F.size("items") * 10 + F.floor(added(F.col("items")))).withColumn("fits", reasonable(F.col("items"), F.col("revenue"))).where("fits OR annual")
    order = F.struct(F.col("fits").alias("fits"), F.col("score").alias("score"), (-F.col("profile")).alias("p"), (-F.col("material_rank")).alias("m"))
    marked = F.transform("items", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["yoy"].alias("yoy"), F.when(~F.col("fits"), "annual_filing").alias("scope")))
    best = sets.groupBy("company", "quarter_index").agg(F.max_by(F.struct(marked.alias("g")), order).alias("b"))
    return best.select("company", "quarter_index", by_value(F.col("b.g")).alias("geographies"))


#: Regions of an older kind of results table, each with its labels.
LEGACY = {
    "Americas": ("Americas net sales", "Americas revenue"),
    "Europe": ("Europe net sales", "Europe revenue"),
    "Japan": ("Japan net sales", "Japan revenue"),
    "Asia-Pacific": ("Asia-Pacific net sales", "Asia Pacific net sales", "Asia-Pacific revenue"),
    "Retail": ("Retail net sales", "Retail revenue"),
}


def legacy_geographies(materials: DataFrame) -> DataFrame:
    """company, quarter_index, geographies: the text with most regions whose sum fits revenue; of equals the first by material_rank. materials as in profile_geographies."""
    found = F.array(*(F.struct(F.lit(name).alias("name"), metric(F.col("text"), list(labels)).alias("m")) for name, labels in LEGACY.items()))
    rows = materials.select("company", "quarter_index", "material_rank", "revenue", F.filter(F.transform(found, lambda x: item(x["name"], x["m"]["value"], x["m"]["yoy"])), lambda x: x.isNotNull()).alias("items"))
    rows = rows.where(reasonable(F.col("items"), F.col("revenue")))
    best = rows.groupBy("company", "quarter_index").agg(F.max_by("items", F.struct(F.size("items").alias("n"), (-F.col("material_rank")).alias("m"))).alias("items"))
    return best.select("company", "quarter_index", by_value(F.col("items")).alias("geographies"))


def table_geographies(tables: Column, label: Column, revenue: Column, target: Column) -> Column:
    """The richest of a page's tables by the generic labels, two regions at least; an annual report's is marked. tables: tables.html_tables."""
    empty = F.array().cast(ITEMS)

    def regions(rows: Column) -> Column:
        own = F.transform(H.statement_metrics(rows, REGION_LABELS, target), lambda m: item(m["name"], m["value"], m["yoy"]))
        return bound(own, lambda x: F.when(F.size(x) >= 2, by_value(x)).otherwise(empty))

    best = F.aggregate(F.transform(tables, regions), empty, lambda a, x: richer_geographies(a, x, revenue))
    scope = F.when(is_annual(label), "annual_filing")
    return F.transform(best, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["yoy"].alias("yoy"), scope.alias("scope")))


#: For each issuer its tables: heading (a pattern), layout, whether it is annual, and rows (name, label).
#: Layouts: number of values a row, place of now, place of before; 'percents' where each value has a percentage behind it.
_AMERICAS = ("Americas", "Asia Pacific", "Europe, the Middle East and Africa")
TABLES = {
    "microsoft": ((r"classified by the major geographic areas in which our customers were located, was as follows:", (4, 0, 1), False, (("United States", "United States (a)"), ("Other countries", "Other countries"))),),
    "nvidia": ((r"Geographic Revenue based upon Customer Headquarters Location", (3, 0, 1), True, (("United States", "United States"), ("Taiwan", "Taiwan (2)"), ("China (including Hong Kong)", "China (including Hong Kong)"), ("Other", "Other"))),),
    "micron": ((r"Revenue based on the geographic location of our customers' headquarters was as follows:", (3, 0, 1), True, tuple((n, n) for n in ("U.S.", "Taiwan", "Mainland China (excluding Hong Kong)", "Other Asia Pacific", "Hong Kong", "Japan", "Europe", "Other"))),),
    "meta": (
        (r"property and equipment, net by geographic area \(in millions\):\s+Three\s+Months\s+Ended", (4, 0, 1), False, (("United States", "United States"), ("Rest of the world", "Rest of the world"))),
        (r"property and equipment, net by geographic area \(in millions\):\s+Year Ended", (3, 0, 1), True, (("United States", "United States"), ("Rest of the world", "Rest of the world"))),
    ),
    "tsmc": (
        (r"NT\$\s*NT\$\s*NT\$\s*Geography", (3, 2, 1), True, tuple((n, n) for n in ("Taiwan", "United States", "China", "Japan", "Europe, the Middle East and Africa", "Others"))),
        (r"(?=North America\s*NT\$)", (3, 2, 1, "percents"), True, tuple((n, n) for n in ("North America", "Asia", "Europe"))),
    ),
    "asml": ((r"Total net sales\s+and long-lived assets\s+by geographic region\s+were as follows:", (6, 4, 2), True, tuple((n, n) for n in ("Japan", "South Korea", "Singapore", "Taiwan", "China", "Rest of Asia", "Netherlands", "EMEA", "United States"))),),
    "tsla": ((r"revenues by geographic area based on the sales location of our products \(in millions\):", (3, 0, 1), True, (("United States", "United States"), ("China", "China"), ("Other international", "Other international"))),),
    "visa": ((r"(?=U\.S\.\s+\$?\s*[0-9])", (3, 0, 1), True, (("United States", "U.S."), ("International", "International"))),),
    "costco": ((r"(?=United States Total revenue)", (2, 0, 1), False, tuple((n, f"{n} Total revenue") for n in ("United States", "Canada", "Other International"))),),
}
#: Labels of regions that an annual report lists once a year, the latest first; now is the first, before the second.
STACKED = {
    "jpm": (("North America", r"North America(?:\s*\(a\))?"), ("Europe / Middle East / Africa", "Europe/Middle East/Africa"), ("Asia-Pacific", "Asia-Pacific"), ("Latin America / Caribbean", "Latin America/Caribbean")),
    "asml": tuple((n, n if n != "South Korea" else "Korea") for n in ("Japan", "South Korea", "Singapore", "Taiwan", "China", "Rest of Asia", "Netherlands", "EMEA", "United States")),
}


def _row(block: Column, label: str, layout: tuple) -> Column:
    """Numbers of a table's row: the label, then as many numbers as the layout has."""
    each = rf"\s*(?:NT)?\$?\s*{NUMBER}" + (r"\s*[0-9.]+\s*%" if len(layout) > 3 else "")
    piece = F.nullif(F.regexp_extract(block, rf"(?is){quoted(label)}(?:\s*\([0-9a]\)|[0-9])?((?:{each}){{{layout[0]}}})", 1), F.lit(""))
    bare = F.regexp_replace(piece, r"[0-9.]+\s*%", " ") if len(layout) > 3 else piece
    return tokens(bare, NUMBER)


def _table(text: Column, heading: str, layout: tuple, annual: bool, rows: tuple) -> Column:
    """Items of a table; empty unless the heading and each row are there."""
    block = F.nullif(F.regexp_extract(text, rf"(?is){heading}(.*)", 1), F.lit(""))
    scope = F.lit("annual_filing" if annual else None).cast("string")

    def read(own: Column) -> Column:
        made = []
        for name, label in rows:
            made.append(bound(_row(own, label, layout), _of_values(name, layout[1], layout[2], scope)))
        return F.array_compact(F.array(*made))

    found = bound(block, read)
    return F.when(F.size(found) == len(rows), found)


def _stacked(text: Column, issuer: str) -> Column:
    made = []
    for name, label in STACKED[issuer]:
        pattern = label if "(" in label else quoted(label)
        values = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i){pattern}\s+\$?\s*({NUMBER})"), F.lit(1)), parsed)
        made.append(bound(F.when(F.size(values) >= 2, values), _of_values(name, 0, 1, F.lit("annual_filing"))))
    found = F.array_compact(F.array(*made))
    return bound(found, lambda x: F.when(F.size(x) == len(STACKED[issuer]), x))


def _avgo(text: Column) -> Column:
    """Regions as columns: the 'Total' row of the first table is now, of the second before; quarters before years."""
    def blocks(lead: str) -> Column:
        cells = rf"\s+\$?\s*{NUMBER}" * 4
        pattern = rf"(?is){lead}\s+Americas\s+Asia Pacific\s+Europe, the Middle East and Africa\s+Total\s+\(In millions\)\s+Products{cells}\s+Subscriptions and services(?:\s+\(a\))?{cells}\s+Total({cells})"
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def items(totals: Column, scope: Column) -> Column:
        now, prior = tokens(F.get(totals, F.lit(0)), NUMBER), tokens(F.get(totals, F.lit(1)), NUMBER)
        return F.when(F.size(totals) > 0, F.array_compact(F.array(*(item(name, F.get(now, F.lit(k)) / 1000, change(F.get(now, F.lit(k)), F.get(prior, F.lit(k))), scope) for k, name in enumerate(_AMERICAS)))))

    date = r"[A-Za-z]+\s+\d{1,2},\s+\d{4}"
    return F.coalesce(items(blocks(rf"Fiscal Quarter Ended {date}"), F.lit(None).cast("string")), items(blocks(rf"Fiscal Year(?:\s+Ended\s+{date}|\s+\d{{4}})"), F.lit("annual_filing")))


def _xom(text: Column) -> Column:
    """Eight columns, at home and abroad in turn, of the first two years' rows."""
    row = r"(?is)Year ended December 31,\s*\d{4}\s+Revenues and other income\s+Sales and other operating revenue((?:\s+[0-9,()]+){9})"
    years = F.transform(F.regexp_extract_all(text, F.lit(row), F.lit(1)), lambda x: tokens(x, r"[0-9,()]+"))
    side = lambda v, odd: F.round(F.aggregate(F.filter(F.slice(v, 1, 8), lambda x, i: i % 2 == odd), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / 1000, 3)
    made = lambda y, name, odd: item(name, side(F.get(y, F.lit(0)), odd), change(side(F.get(y, F.lit(0)), odd), side(F.get(y, F.lit(1)), odd)), F.lit("annual_filing"))
    return bound(years, lambda y: F.when(F.size(y) >= 2, F.array_compact(F.array(made(y, "U.S.", 0), made(y, "Non-U.S.", 1)))))


def _berkshire(text: Column) -> Column:
    """Shares of the United States in two years' revenues, told in a sentence."""
    p = r"(?is)Consolidated sales, service and leasing revenues were \$\s*([0-9.]+)\s*billion in \d{4},\s*\$\s*([0-9.]+)\s*billion in \d{4}.*?Sales, service and leasing revenues attributable to the United States were\s*([0-9.]+)\s*%\s*in \d{4},\s*([0-9.]+)\s*%\s*in \d{4}"
    now, before, share, prior = (parsed(F.nullif(F.regexp_extract(text, p, g), F.lit(""))) for g in (1, 2, 3, 4))
    home, home_before = now * share / 100, before * prior / 100
    scope = F.lit("annual_filing")
    return F.when(home.isNotNull(), F.array_compact(F.array(item("United States", home, change(home, home_before), scope), item("Other", now - home, change(now - home, before - home_before), scope))))


OWN = {"avgo": _avgo, "xom": _xom, "berkshire": _berkshire}


def issuer_geographies(text: Column, issuer: str) -> Column:
    """An issuer's geographies in a filing's text, the largest first; null for none."""
    tries = [_table(text, *table) for table in TABLES.get(issuer, ())]
    tries += [OWN[issuer](text)] if issuer in OWN else []
    tries += [_stacked(text, issuer)] if issuer in STACKED else []
    return bound(F.coalesce(*tries), lambda x: F.when(x.isNotNull(), by_value(x)))


def filing_geographies(materials: DataFrame, issuer: str) -> DataFrame:
    """company, quarter_index, geographies: of an issuer's filings, the longest that fits revenue or is annual, the first of equals.

    materials: company, quarter_index, material_rank, kind, label, text, revenue.
    """
    annual = is_annual(F.col("label"))
    own = materials.where("kind = 'sec_filing'").select("*", annual.alias("annual"), F.explode(F.array(issuer_geographies(F.col("text"), issuer))).alias("g")).where("size(g) > 0")
    scoped = F.transform("g", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["yoy"].alias("yoy"), F.when(F.col("annual"), "annual_filing").otherwise(x["scope"]).alias("scope")))
    fit = own.where(F.col("annual") | reasonable(F.col("g"), F.col("revenue")))
    best = fit.groupBy("company", "quarter_index").agg(F.max_by(scoped, F.struct(F.size("g").alias("n"), (-F.col("material_rank")).alias("m"))).alias("geographies"))
    return best


def with_annual(parsed_rows: DataFrame, annual: DataFrame, least: int = 2, reach: int = 5) -> DataFrame:
    """parsed_rows with the geographies of the nearest annual report, up to `reach` quarters before, where they have none and it has `least`. Both: company, quarter_index, geographies."""
    from quartermill.operators.selection import nearest_annual

    near = nearest_annual(parsed_rows.select("company", "quarter_index"), annual.select("company", F.col("quarter_index").alias("annual_index")), reach).where("annual_index IS NOT NULL")
    own = annual.select("company", F.col("quarter_index").alias("annual_index"), F.col("geographies").alias("_g"))
    met = parsed_rows.join(near.join(own, ["company", "annual_index"]).drop("annual_index"), ["company", "quarter_index"], "left")
    return met.withColumn("geographies", F.when((F.coalesce(F.size("geographies"), F.lit(0)) == 0) & (F.size("_g") >= least), F.col("_g")).otherwise(F.col("geographies"))).drop("_g")

