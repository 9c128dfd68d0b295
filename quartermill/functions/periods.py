"""Quarters and dates. A quarter is an int, year * 4 + quarter - 1, so shifts are additions; labels are YYYYQn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_of_date(date: Column) -> Column:
    return (F.year(date) * 4 + F.quarter(date) - 1).cast("int")


def label(index: Column) -> Column:
    return F.concat(F.floor(index / 4).cast("int").cast("string"), F.lit("Q"), (F.pmod(index, F.lit(4)) + 1).cast("int").cast("string"))


def index_of_label(text: Column) -> Column:
    """-1 for what isn't a label, so that it sorts first."""
    year, quarter = F.regexp_extract(text, r"^(\d{4})Q([1-4])$", 1), F.regexp_extract(text, r"^(\d{4})Q([1-4])$", 2)
    return F.when(year != "", F.expr("0") + year.cast("int") * 4 + quarter.cast("int") - 1).otherwise(-1)


def shift(text: Column, quarters: int) -> Column:
    """A label so many quarters later; null for no label."""
    return F.when(index_of_label(text) >= 0, label(index_of_label(text) + quarters))


def end_date(index: Column) -> Column:
    """The quarter's last day."""
    return F.last_day(F.make_date(F.floor(index / 4).cast("int"), (F.pmod(index, F.lit(4)) * 3 + 3).cast("int"), F.lit(1)))


def months(index: Column) -> Column:
    """The quarter's months as YYYY-MM."""
    year, first = F.floor(index / 4).cast("int").cast("string"), F.pmod(index, F.lit(4)) * 3 + 1
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat_ws("-", year, F.lpad((first + k).cast("int").cast("string"), 2, "0")))


def majority_index(period_end: Column) -> Column:
    """The quarter that holds most of the three months up to period_end's; two of three always agree."""
    return index_of_date(F.add_months(period_end, -1))


def majority_of_months(tokens: Column) -> Column:
    """The quarter with most of the months YYYY-MM in an array; the later one of equals."""
    quarters = F.transform(tokens, lambda m: F.substring(m, 1, 4).cast("int") * 4 + F.floor((F.substring(m, 6, 2).cast("int") - 1) / 3).cast("int"))
    counted = F.transform(F.array_distinct(quarters), lambda q: F.struct(F.size(F.filter(quarters, lambda x: x == q)).alias("n"), q.alias("q")))
    return F.array_max(counted)["q"]


def fiscal_label(date: Column, fiscal_quarter: Column) -> Column:
    """The label of a date, or with a fiscal quarter token (Q1..Q4) its year and that; a Q4 that ends in January to March is the year before's."""
    late = (fiscal_quarter == "Q4") & (F.month(date) <= 3)
    own = F.concat((F.year(date) - F.when(late, 1).otherwise(0)).cast("string"), fiscal_quarter)
    return F.when(fiscal_quarter.rlike("^Q[1-4]$"), own).otherwise(label(index_of_date(date)))


def fiscal_period(date: Column, year_end_month: Column) -> tuple[Column, Column]:
    """Fiscal year and quarter, for a year that ends with a month."""
    year = F.year(date) + F.when(F.month(date) > year_end_month, 1).otherwise(0)
    start = F.pmod(year_end_month, F.lit(12)) + 1
    return year.cast("int"), (F.floor(F.pmod(F.month(date) - start + 12, F.lit(12)) / 3) + 1).cast("int")


def remapped(index: Column, mode: str, period_end: Column) -> Column:
    """The natural quarter: 'previous' is the one before, 'majority' that of most months."""
    return index - 1 if mode == "previous" else majority_index(period_end)


def coverage_months(index: Column, period_end: Column) -> Column:
    """The three months up to period_end if they belong to the quarter, else the quarter's own."""
    to = F.trunc(period_end, "month")
    own = F.transform(F.sequence(F.lit(-2), F.lit(0)), lambda k: F.date_format(F.add_months(to, k), "yyyy-MM"))
    return F.when(majority_index(period_end) == index, own).otherwise(months(index))


def parsed_date(text: Column) -> Column:
    """Leniently: ISO dates, timestamps, or 'March 31, 2024'; null for what isn't one."""
    return F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.try_to_date(text, "MMMM d, yyyy"), F.try_to_date(text, "MMM d, yyyy"), F.try_to_date(text, "M/d/yyyy"))


def normal_quarter(text: Column) -> Column:
    """A free-text quarter as a label: 2024Q3, 2024-Q3, Q3 2024, 3Q24, FY2024 Q3, 2024年第3季度, 2024年三季度; null otherwise."""
    bare = F.upper(F.trim(text))
    forms = ((r"^(20\d{2})\s*[-/ ]?\s*Q([1-4])$", 1, 2), (r"^Q([1-4])\s*[-/ ,]?\s*(20\d{2})$", 2, 1), (r"^FY\s*(20\d{2})\s*Q([1-4])$", 1, 2), (r"^(20\d{2})\s*年\s*第?\s*([1-4])\s*季度?$", 1, 2))
    found = [F.when(bare.rlike(p), F.concat(F.regexp_extract(bare, p, y), F.lit("Q"), F.regexp_extract(bare, p, q))) for p, y, q in forms]
    short = r"^([1-4])Q\s*'?(\d{2})$"
    found.append(F.when(bare.rlike(short), F.concat(F.lit("20"), F.regexp_extract(bare, short, 2), F.lit("Q"), F.regexp_extract(bare, short, 1))))
    spelled = r"^(20\d{2})\s*年\s*第?\s*([一二三四])\s*季度?$"
    found.append(F.when(bare.rlike(spelled), F.concat(F.regexp_extract(bare, spelled, 1), F.lit("Q"), F.translate(F.regexp_extract(bare, spelled, 2), "一二三四", "1234"))))
    return F.coalesce(*found)


def header_quarter(cell: Column) -> Column:
    """The quarter index of a table heading's date, 'September 30, 2024'."""
    found = F.regexp_extract(cell, r"(?i)((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4})", 1)
    dated = F.transform(F.array(found), lambda x: F.when(x != "", F.try_to_date(x, "MMMM d, yyyy")))  # parsed once, and only where there is a date
    return F.get(F.transform(dated, lambda x: index_of_date(x)), F.lit(0))


def header_span(cell: Column) -> Column:
    """Months that a heading covers: three, six, nine or twelve; null for none."""
    low = F.lower(cell)
    return F.when(low.rlike(r"three months|quarter(?:ly)? ended|3 months"), 3).when(low.rlike(r"six months|6 months"), 6).when(low.rlike(r"nine months|9 months"), 9).when(low.rlike(r"twelve months|year ended|fiscal year|12 months"), 12)


def search_window(index: Column, release: Column) -> tuple[Column, Column]:
    """70 days before the release (or the quarter's end) to 100 days after it."""
    anchor = F.coalesce(release, end_date(index))
    return F.date_sub(anchor, 70), F.date_add(anchor, 100)


def resolved_end(index: Column, *candidates: Column) -> Column:
    """The first candidate text that looks like an ISO date, else the quarter's last day; a string."""
    iso = lambda c: F.when((F.length(c) == 10) & (F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-"), c)
    return F.coalesce(*map(iso, candidates), F.date_format(end_date(index), "yyyy-MM-dd"))


def is_annual(label_text: Column) -> Column:
    """Whether a document's label names an annual report."""
    return F.coalesce(F.lower(label_text).rlike("10-k|20-f|annual report"), F.lit(False))


def before_cutoff(label_text: Column, cutoff: str) -> Column:
    """Whether a quarter label is before another; what isn't a label is (0, 0) and before all, an empty one isn't."""
    return F.when(F.coalesce(label_text, F.lit("")) == "", False).otherwise(index_of_label(label_text) < index_of_label(F.lit(cutoff)))


ORDINALS = ("first", "second", "third", "fourth")


def reference_terms(index: Column, period_end: Column, year_end_month: Column) -> Column:
    """struct<calendar, fiscal, years, quarters>: how texts may name a quarter.

    Calendar terms are the calendar quarter's, for companies whose year ends in December; period_end gives the fiscal ones.
    """
    word = lambda q: F.element_at(F.array(*map(F.lit, ORDINALS)), q.cast("int"))
    said = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    none, number = F.array().cast("array<string>"), F.array().cast("array<int>")
    calendar_year, q = F.floor(index / 4).cast("int"), (F.pmod(index, F.lit(4)) + 1).cast("int")
    ends = F.coalesce(year_end_month == 12, F.lit(True))
    o = word(q)
    plain = F.array(said("q", q), said(calendar_year, " q", q), said("q", q, " ", calendar_year), said(calendar_year, "q", q), said(o, " quarter"), said(o, " quarter ", calendar_year), said(calendar_year, " ", o, " quarter"), said(q, "q ", calendar_year))
    year, fq = fiscal_period(period_end, F.coalesce(year_end_month, F.lit(12)))
    fo, month, short, day, own = word(fq), F.lower(F.date_format(period_end, "MMMM")), F.lower(F.date_format(period_end, "MMM")), F.dayofmonth(period_end), F.year(period_end)
    fiscal = F.array(
        said("q", fq, " fy", year), said("fy", year, " q", fq), said("fy", year, "q", fq), said("q", fq, " fiscal year ", year), said("fiscal year ", year, " q", fq), said(fo, " quarter fiscal year ", year),
        said("fiscal year ", year, " ", fo, " quarter"), said("fy", F.substring(year.cast("string"), 3, 2), " q", fq), said("quarter ended ", month, " ", day, ", ", year), said("quarter ended ", month, " ", day, " ", year),
        said("quarter ended ", month, " ", own), said("quarter ended ", short, " ", day, " ", own), said("ended ", month, " ", day, ", ", own), said("ended ", month, " ", day, " ", own), said(month, " quarter ", own), said(short, " quarter ", own),
    )
    known = period_end.isNotNull()
    years = F.when(known, F.array(own.cast("string"), year.cast("string"))).otherwise(none)
    return F.struct(
        F.array_distinct(F.concat(F.when(ends, plain).otherwise(none), years)).alias("calendar"),
        F.when(known, F.array_distinct(fiscal)).otherwise(none).alias("fiscal"),
        F.array_distinct(F.concat(F.when(ends, F.array(calendar_year.cast("string"))).otherwise(none), years)).alias("years"),
        F.array_distinct(F.concat(F.when(ends, F.array(q)).otherwise(number), F.when(known, F.array(fq)).otherwise(number))).alias("quarters"),
    )


def compact_fiscal(text: Column) -> Column:
    """'FY2026 Q1' as 'Q1 FY26'; '-' for nothing."""
    short = F.replace(F.regexp_replace(text, "[Ff]iscal", "FY"), F.lit("FY20"), F.lit("FY"))
    words = F.split(F.replace(short, F.lit(","), F.lit(" ")), r"\s+")
    first = lambda mark: F.get(F.filter(words, lambda w: w.startswith(mark)), F.lit(0))
    pair = F.concat(first("Q"), F.lit(" "), first("FY"))
    return F.when(F.coalesce(text, F.lit("")) == "", "-").otherwise(F.coalesce(pair, short))


def period_badge(period_end: Column) -> Column:
    """'Ending Sept. 2025' of an ISO date; fixed values."""
    names = F.array(*map(F.lit, ("Jan.", "Feb.", "Mar.", "Apr.", "May", "Jun.", "Jul.", "Aug.", "Sept.", "Oct.", "Nov.", "Dec.")))
    month = F.substring(period_end, 6, 2)
    return F.when(F.length(F.coalesce(period_end, F.lit(""))) < 7, "Official period").otherwise(F.concat(F.lit("Ending "), F.coalesce(F.get(names, month.try_cast("int") - 1), month), F.lit(" "), F.substring(period_end, 1, 4)))
