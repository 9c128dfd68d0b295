"""HTML tables as arrays of rows of cells: scale, row search, number series, period columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quartermill.functions.numbers import parsed
from quartermill.functions.periods import header_quarter, header_span
from quartermill.functions.text import html_text, token


def _glued(cells: Column) -> Column:
    """A cell of ')' or '%' belongs to the one before."""
    return F.aggregate(cells, F.array().cast("array<string>"), lambda a, c: F.when(c.isin(")", "%", ")%") & (F.size(a) > 0), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(F.get(a, F.size(a) - 1), c)))).otherwise(F.concat(a, F.array(c))))


def html_tables(html: Column) -> Column:
    """array<array<array<string>>>: tables, rows, cells that aren't empty."""
    cells = lambda row: _glued(F.filter(F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), html_text), lambda c: c != ""))
    rows = lambda table: F.filter(F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1)), cells), lambda r: F.size(r) > 0)
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"), F.lit(1)), rows)


def scale(rows: Column) -> Column:
    """Billions a unit, by the heading; null if it doesn't say."""
    head = F.lower(F.array_join(F.flatten(F.slice(rows, 1, 4)), " "))
    return F.when(head.rlike(r"in billions"), 1.0).when(head.rlike(r"in millions"), 0.001).when(head.rlike(r"in thousands"), 0.000001)


def inferred_scale(values: Column, known: Column) -> Column:
    """The known scale, or by the largest magnitude: from a million thousands, from a thousand millions, else billions."""
    top = F.array_max(F.transform(values, F.abs))
    return F.coalesce(known, F.when(top >= 1e6, 0.000001).when(top >= 1e3, 0.001).otherwise(1.0))


def find_row(rows: Column, labels: list[str]) -> Column:
    """The row of the first label that one has: equal, or beginning so; the last row of equals; null for none."""

    def of(keyed: Column) -> Column:
        found = []
        for label in labels:
            own = "".join(c for c in label.lower() if c.isalnum())
            equal, begins = F.filter(keyed, lambda r: r["key"] == own), F.filter(keyed, lambda r: r["key"].startswith(own))  # noqa: B023
            found += [F.get(equal, F.size(equal) - 1), F.get(begins, F.lit(0))]
        return F.coalesce(*found)["row"]

    keyed = F.transform(rows, lambda r: F.struct(token(F.get(r, F.lit(0))).alias("key"), r.alias("row")))
    return F.get(F.transform(F.array(keyed), of), F.lit(0))


def series(row: Column) -> Column:
    """The row's numbers after its label, percentages left out; a small whole number before far larger ones is a footnote."""
    values = F.filter(F.transform(F.filter(F.filter(row, lambda _, i: i > 0), lambda c: ~c.contains("%")), parsed), lambda v: v.isNotNull())

    def own(v: Column) -> Column:
        first, rest = F.get(v, F.lit(0)), F.filter(v, lambda _, i: i > 0)
        note = (F.size(v) >= 2) & (first == F.floor(first)) & F.forall(rest, lambda x: (F.abs(x) > 100 * F.abs(first)) & (F.abs(x) > 10000))
        return F.when(note, rest).otherwise(v)

    return F.get(F.transform(F.array(values), own), F.lit(0))


def period_columns(rows: Column) -> Column:
    """array<struct<quarter, span>> of the table's value columns: each span heading covers an equal run of the dates."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    known = lambda head: F.struct(F.filter(F.transform(head, header_quarter), lambda q: q.isNotNull()).alias("dates"), F.filter(F.transform(head, header_span), lambda s: s.isNotNull()).alias("spans"))

    def columns(x: Column) -> Column:
        dates, spans = x["dates"], x["spans"]
        each = F.greatest(F.lit(1), F.floor(F.size(dates) / F.greatest(F.lit(1), F.size(spans)))).cast("int")
        return F.transform(dates, lambda q, i: F.struct(q.alias("quarter"), F.get(spans, F.least(F.floor(i / each).cast("int"), F.size(spans) - 1)).alias("span")))

    return once(once(F.flatten(F.slice(rows, 1, 4)), known), columns)


def quarter_columns(columns: Column, target: Column) -> Column:
    """Positions of the target quarter's three-month column and the one a year before; -1 for none."""
    at = lambda own, q: F.array_position(F.transform(own, lambda c: (c["quarter"] == q) & F.coalesce(c["span"] == 3, F.lit(True))), F.lit(True)).cast("int") - 1
    return F.get(F.transform(F.array(columns), lambda own: F.struct(at(own, target).alias("now"), at(own, target - 4).alias("before"))), F.lit(0))


def statement_metric(rows: Column, labels: list[str], target: Column) -> Column:
    """struct<value, prior, yoy> of a row for a quarter, in billions, three decimals. Row, columns and scale are bound once."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    found = F.struct(series(find_row(rows, labels)).alias("v"), quarter_columns(period_columns(rows), target).alias("at"), scale(rows).alias("unit"))

    def read(x: Column) -> Column:
        pick = lambda k: F.when(x["at"][k] >= 0, F.get(x["v"], x["at"][k])) * inferred_scale(x["v"], x["unit"])
        return F.struct(F.round(pick("now"), 3).alias("value"), F.round(pick("before"), 3).alias("prior"))

    return once(once(found, read), lambda m: F.struct(m["value"].alias("value"), m["prior"].alias("prior"), F.round((m["value"] / F.nullif(m["prior"], F.lit(0.0)) - 1) * 100, 1).alias("yoy")))


def statement_metrics(rows: Column, labels: dict[str, tuple[str, ...]], target: Column) -> Column:
    """array<struct<name, value, prior, yoy>> of the names that have a row with a value: statement_metric of many, keys, columns and scale bound once a table."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    keyed = F.transform(rows, lambda r: F.struct(token(F.get(r, F.lit(0))).alias("key"), series(r).alias("v")))
    known = F.struct(keyed.alias("rows"), quarter_columns(period_columns(rows), target).alias("at"), scale(rows).alias("unit"))

    def one(x: Column, name: str) -> Column:
        found = []
        for label in labels[name]:
            own = "".join(c for c in label.lower() if c.isalnum())
            equal, begins = F.filter(x["rows"], lambda r: r["key"] == own), F.filter(x["rows"], lambda r: r["key"].startswith(own))  # noqa: B023
            found += [F.get(equal, F.size(equal) - 1), F.get(begins, F.lit(0))]
        return F.struct(F.lit(name).alias("name"), F.coalesce(*found)["v"].alias("v"))

    def read(x: Column) -> Column:
        def valued(m: Column) -> Column:
            pick = lambda k: F.round(F.when(x["at"][k] >= 0, F.get(m["v"], x["at"][k])) * inferred_scale(m["v"], x["unit"]), 3)
            return F.struct(m["name"].alias("name"), pick("now").alias("value"), pick("before").alias("prior"))

        rated = F.transform(F.transform(F.array(*(one(x, name) for name in labels)), valued), lambda m: F.struct(m["name"].alias("name"), m["value"].alias("value"), m["prior"].alias("prior"), F.round((m["value"] / F.nullif(m["prior"], F.lit(0.0)) - 1) * 100, 1).alias("yoy")))
        return F.filter(rated, lambda m: m["value"].isNotNull())

    return once(known, read)
