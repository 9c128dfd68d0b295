"""Metrics from text: ordered cascades of row and sentence patterns.

Patterns ignore case and let a dot match a line's end. A pattern is searched once for the text that it covers; numbers are taken from
that piece, which a function over one element binds, so no text is scanned again for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartermill.functions.numbers import in_billions, parsed, percent_token
from quartermill.functions.text import has_any

NUMBER = r"[0-9,]+(?:\.[0-9]+)?"
PERCENT = r"\(?\s*-?[0-9]+(?:\.[0-9]+)?\s*\)?"
MONEY = rf"\s+\$?\s*{NUMBER}"
FLAGS = "(?is)"
METRIC = "struct<value:double,prior:double,yoy:double>"


def quoted(label: str) -> str:
    """A label as a pattern: any white space between its words."""
    return r"\s+".join("".join("\\" + c if not c.isalnum() else c for c in w) for w in label.split())


def labelled(label: str) -> str:
    """A label and the notes in brackets behind it."""
    return rf"{quoted(label)}(?:\s*\([^)]*\)\s*)*"


def bound(value: Column, use) -> Column:
    """use(value), the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tail(text: Column, label: str, numbers: str) -> Column:
    """What the numbers' pattern covers behind the first place where it follows the label; null for none."""
    return F.nullif(F.regexp_extract(text, rf"{FLAGS}{labelled(label)}({numbers})", 1), F.lit(""))


def tokens(piece: Column, pattern: str = rf"\(?\s*-?{NUMBER}\s*\)?|—") -> Column:
    """The numbers of a piece of text, as doubles."""
    return F.transform(F.regexp_extract_all(piece, F.lit(f"({pattern})"), F.lit(1)), parsed)


def change(now: Column, before: Column) -> Column:
    return (now / F.nullif(before, F.lit(0.0)) - 1) * 100


def accepted(now: Column, before: Column, yoy: Column) -> Column:
    """The stated change, else the derived one, each up to 500 %."""
    derived = change(now, before)
    return F.coalesce(F.when(F.abs(yoy) <= 500, yoy), F.when(F.abs(derived) <= 500, derived))


def rederived(m: Column) -> Column:
    """A row's metric with the change of its own two values where none was accepted, however large."""
    return F.when(m.isNotNull(), F.struct(m["value"].alias("value"), m["prior"].alias("prior"), F.coalesce(m["yoy"], change(m["value"], m["prior"])).alias("yoy")).cast(METRIC))


def _metric(now: Column, before: Column, yoy: Column, unit: float) -> Column:
    return F.when(now.isNotNull(), F.struct((now * unit).alias("value"), (before * unit).alias("prior"), yoy.alias("yoy")).cast(METRIC))


def _none() -> Column:
    return F.lit(None).cast("double")


# ---- rows ----------------------------------------------------------------------------------------------------------------


def row_with_percent(text: Column, label: str, unit: float = 0.001, now: int = 0, prior: int = 1) -> Column:
    """struct<value, prior, yoy> of 'label 1,200 1,000 20%'."""
    return bound(tokens(tail(text, label, rf"{MONEY}{MONEY}\s+{PERCENT}\s*%")), lambda t: _metric(F.get(t, F.lit(now)), F.get(t, F.lit(prior)), accepted(F.get(t, F.lit(now)), F.get(t, F.lit(prior)), F.get(t, F.lit(2))), unit))


def row_pair(text: Column, label: str, unit: float = 0.001, now: int = 0, prior: int = 1) -> Column:
    """struct<value, prior, yoy> of 'label 1,200 1,000'; reversed where now is 1 and prior 0."""
    return _two(tail(text, label, MONEY + MONEY), unit, now, prior)


def _two(piece: Column, unit: float, now: int, prior: int) -> Column:
    return bound(tokens(piece), lambda t: _metric(F.get(t, F.lit(now)), F.get(t, F.lit(prior)), accepted(F.get(t, F.lit(now)), F.get(t, F.lit(prior)), _none()), unit))


def row_of_two(text: Column, label: str, unit: float = 0.001, now: int = 0, prior: int = 1) -> Column:
    """row_with_percent, else row_pair. A text without the pair has no row with a percentage either, so that it is searched once."""
    pair = tail(text, label, MONEY + MONEY)
    return bound(pair, lambda p: F.when(p.isNotNull(), F.coalesce(row_with_percent(text, label, unit, now, prior), _two(p, unit, now, prior))))


def row_five_quarters(text: Column, label: str, unit: float = 0.001) -> Column:
    """struct<value, prior, yoy> of five quarters, the last one now and the first a year before, and a percentage; dashes are no value."""
    cell = rf"\s+(?:{NUMBER}|—)"
    return bound(tokens(tail(text, label, rf"(?:{cell}){{5}}\s+\(?-?[0-9]+(?:\.[0-9]+)?\)?%")), lambda t: _metric(F.get(t, F.lit(4)), F.get(t, F.lit(0)), accepted(F.get(t, F.lit(4)), F.get(t, F.lit(0)), F.get(t, F.lit(5))), unit))


def row_five_percents(text: Column, label: str) -> Column:
    """struct<value, prior, yoy> of five quarters' percentages and a change in points or percent."""
    return bound(tokens(tail(text, label, rf"(?:\s+{NUMBER}%){{5}}\s+\(?-?[0-9]+(?:\.[0-9]+)?\)?\s*(?:bp|%)")), lambda t: _metric(F.get(t, F.lit(4)), F.get(t, F.lit(0)), change(F.get(t, F.lit(4)), F.get(t, F.lit(0))), 1.0))


def row_three_columns(text: Column, label: str, unit: float = 0.001) -> Column:
    """struct<value, prior, yoy> of this quarter, the one before and the one a year before."""
    return bound(tokens(tail(text, label, MONEY * 3)), lambda t: _metric(F.get(t, F.lit(0)), F.get(t, F.lit(2)), accepted(F.get(t, F.lit(0)), F.get(t, F.lit(2)), _none()), unit))


def row_both_changes(text: Column, label: str, unit: float = 0.001) -> Column:
    """struct<value, before, prior, qoq, yoy> of three quarters and both changes in percent, '5 %' or 'Up 5%'."""
    percents, words = r"\s+\(?-?[0-9]+(?:\.[0-9]+)?\)?\s*%", r"\s+(?:Up|Down)\s+[0-9]+(?:\.[0-9]+)?%"
    plain, spelled = tail(text, label, MONEY * 3 + percents * 2), tail(text, label, MONEY * 3 + words * 2)
    at = lambda t, k: F.get(t, F.lit(k))
    make = lambda t, q, y: F.when(at(t, 0).isNotNull(), F.struct((at(t, 0) * unit).alias("value"), (at(t, 1) * unit).alias("before"), (at(t, 2) * unit).alias("prior"), q.alias("qoq"), y.alias("yoy")))
    signs = F.regexp_extract_all(spelled, F.lit("(?i)(up|down)"), F.lit(1))
    signed = lambda t, k: at(t, 3 + k) * F.when(F.lower(F.get(signs, F.lit(k))) == "down", -1.0).otherwise(1.0)
    return F.coalesce(bound(tokens(plain), lambda t: make(t, at(t, 3), at(t, 4))), bound(tokens(spelled), lambda t: make(t, signed(t, 0), signed(t, 1))))


def row_percents(text: Column, label: str) -> Column:
    """struct<value, prior, yoy> of two percentages."""
    return bound(tokens(tail(text, label, rf"\s+{NUMBER}\s*%\s+{NUMBER}\s*%")), lambda t: _metric(F.get(t, F.lit(0)), F.get(t, F.lit(1)), _none(), 1.0))


def row_per_share(text: Column, label: str) -> Column:
    """struct<value, prior, yoy> of two amounts a share."""
    return bound(tokens(tail(text, label, MONEY + MONEY)), lambda t: _metric(F.get(t, F.lit(0)), F.get(t, F.lit(1)), change(F.get(t, F.lit(0)), F.get(t, F.lit(1))), 1.0))


def metric(text: Column, labels: list[str], unit: float = 0.001) -> Column:
    """The first label that a row has; for each, the row with a percentage before the plain one."""
    return F.coalesce(*(row_of_two(text, label, unit) for label in labels))


def percent_metric(text: Column, labels: list[str]) -> Column:
    """The first label with two percentages behind it, or with 'was 12%'."""
    said = lambda label: parsed(F.nullif(F.regexp_extract(text, rf"{FLAGS}{quoted(label)}(?:\s+(?:was|were|of))?\s+([0-9]+(?:\.[0-9]+)?)\s*%", 1), F.lit("")))
    return F.coalesce(*(x for label in labels for x in (row_percents(text, label)["value"], said(label))))


# ---- sentences -----------------------------------------------------------------------------------------------------------

AMOUNT = rf"\$?({NUMBER})\s*(billion|million)"
VERBS = r"(?:\s+(?:was|were|of|totaled|reached|came in at|amounted to))?"


def growth_of(context: Column) -> Column:
    """The first 'up 5%' as 5, else the first 'down 5%' as -5."""
    first = lambda words: parsed(F.nullif(F.regexp_extract(context, rf"{FLAGS}(?:{words})\s+([0-9]+(?:\.[0-9]+)?)\s*%", 1), F.lit("")))
    return F.coalesce(first("up|increased|grew|rose"), -first("down|decreased|declined|fell"))


def _amount(piece: Column) -> Column:
    pair = lambda g: F.nullif(F.regexp_extract(piece, FLAGS + AMOUNT + "$", g), F.lit(""))
    return in_billions(parsed(pair(1)), pair(2))


def narrative(text: Column, subject: str) -> Column:
    """struct<value, yoy>: 'subject was $N billion', or '$N billion of subject', and the growth that the next 220 characters tell."""

    def read(pattern: str, reverse: bool) -> Column:
        def told(piece: Column) -> Column:
            at = F.position(piece, text)  # the first match is the first place of its letters
            begin = F.greatest(at - 20, F.lit(1))
            context = F.substring(text, begin, (at - begin + F.length(piece) + 220).cast("int"))
            amount = _amount(F.regexp_extract(piece, FLAGS + "^" + AMOUNT, 0) if reverse else piece)
            return F.when(piece != "", F.struct(amount.alias("value"), bound(context, growth_of).alias("yoy")))

        return bound(F.regexp_extract(text, FLAGS + pattern, 0), told)

    return F.coalesce(read(rf"(?:reported\s+)?(?:{subject})(?:\s+for\s+the\s+quarter)?{VERBS}\s+{AMOUNT}", False), read(rf"{AMOUNT}\s+(?:of\s+)?(?:{subject})", True))


def company_narrative(text: Column, subject: str) -> Column:
    """struct<value, yoy> of the sentence that tells it best: 3 for a quarter or period in its context, 4 for total revenue or sales, less 7 for a year; the first of equals."""
    lead, verb = r"(?:^|[.;:!?]\s+|•\s+)", r"(?:reported|generated|posted|delivered|recorded)"
    patterns = (
        rf"{lead}{verb}?\s*(?:the company's\s+)?(?:{subject})(?:\s+for\s+the\s+(?:quarter|period))?{VERBS}\s+{AMOUNT}",
        rf"{lead}{verb}\s+{AMOUNT}\s+(?:of\s+)?(?:{subject})",
    )
    score = lambda c: F.when(has_any(c, ("quarter", "period")), 3).otherwise(0) + F.when(has_any(c, ("total revenue", "net revenue", "net operating revenue", "total sales")), 4).otherwise(0) - F.when(has_any(c, ("full-year", "fiscal year", "annual")), 7).otherwise(0)

    def rated(own: Column, n: int, pattern: str) -> Column:
        """The sentences of a pattern with score, order and context: 48 characters before and 180 behind. The next match is the next place of its letters."""
        group = lambda m, g: F.regexp_extract(m, FLAGS + pattern, g)

        def step(a: Column, m: Column) -> Column:
            def placed(at: Column) -> Column:
                begin = F.greatest(at - 48, F.lit(1))
                context = F.lower(F.substring(own, begin, at - begin + F.length(m) + 180))
                item = lambda c: F.struct(score(c).alias("score"), (-F.size(a["found"]) - n * 100000).alias("early"), in_billions(parsed(group(m, 1)), group(m, 2)).alias("value"), c.alias("context"))
                return F.struct((at + F.length(m)).alias("end"), F.concat(a["found"], F.array(bound(context, item))).alias("found"))

            return bound(F.position(m, own, a["end"]), placed)

        start = F.struct(F.lit(1).alias("end"), F.array().cast("array<struct<score:int,early:int,value:double,context:string>>").alias("found"))
        return F.aggregate(F.regexp_extract_all(own, F.lit(FLAGS + pattern), F.lit(0)), start, step, lambda a: a["found"])

    found = lambda own: F.filter(F.concat(*(rated(own, n, p) for n, p in enumerate(patterns))), lambda x: x["value"].isNotNull())
    return bound(F.array_max(bound(text, found)), lambda best: F.when(best.isNotNull(), F.struct(best["value"].alias("value"), bound(best["context"], growth_of).alias("yoy"))))


def segment_narrative(text: Column, label: str) -> Column:
    """struct<value, yoy>: 'label ... up 5% ... to $N billion', or '... $N billion ... up 5%'."""
    own, up, down = quoted(label), r"(?:up|increased|grew|rose)", r"(?:down|decreased|declined|fell)"
    number, pct = rf"\$?({NUMBER})\s*(billion|million)", r"\s+([0-9]+(?:\.[0-9]+)?)\s*%"
    out = []
    for sign, way in ((1.0, up), (-1.0, down)):
        g = lambda k: F.nullif(F.regexp_extract(text, rf"{FLAGS}{own}(?:\s+revenue[s]?)?.{{0,120}}?{way}{pct}(?:.{{0,120}}?)to\s+{number}", k), F.lit(""))  # noqa: B023, E731
        out.append(F.when(g(2).isNotNull(), F.struct(in_billions(parsed(g(2)), g(3)).alias("value"), (parsed(g(1)) * sign).alias("yoy"))))
    for sign, way in ((1.0, up), (-1.0, down)):
        g = lambda k: F.nullif(F.regexp_extract(text, rf"{FLAGS}{own}(?:\s+revenue[s]?)?.{{0,80}}?{number}(?:.{{0,120}}?){way}{pct}", k), F.lit(""))  # noqa: B023, E731
        out.append(F.when(g(1).isNotNull(), F.struct(in_billions(parsed(g(1)), g(2)).alias("value"), (parsed(g(3)) * sign).alias("yoy"))))
    return F.coalesce(*out)


def per_share(text: Column) -> Column:
    """Diluted earnings a share, by row or sentence."""
    row = F.coalesce(*(row_per_share(text, label)["value"] for label in ("Diluted earnings per share", "Diluted net income per share", "Diluted EPS", "Diluted")))
    said = parsed(F.nullif(F.regexp_extract(text, rf"{FLAGS}(?:earnings|income)\s+per\s+(?:diluted\s+)?share\s+(?:was|were|of)\s+\$?([0-9.]*[0-9])", 1), F.lit("")))
    return bound(F.coalesce(said, row), lambda value: F.when(F.abs(value) <= 100, value))


#: What tells that a profit holds items of its own.
SPECIAL_ITEMS = ("special item", "special items", "excluding special", "including special", "one-time", "one time", "restructuring", "acquisition", "integration", "legal entity reorganization", "impairment", "settlement", "tax reform", "tax benefit", "tax charge", "remeasurement")


def profit_signal(text: Column) -> Column:
    """struct<special, reported, reported_prior, reported_eps, adjusted, adjusted_prior, adjusted_eps>: net income as reported and as adjusted.

    Rows of a statement come first (over 100 they are millions), sentences with an amount a share fill what they lack.
    """
    pair = lambda label, k: F.get(tokens(tail(text, label, MONEY + MONEY)), F.lit(k))
    scaled = lambda v: F.when(v > 100, v * 0.001).otherwise(v)
    lead = r"(?:^|[.;:!?]\s+|•\s+)"
    rest = rf"\$\s*({NUMBER})\s*(billion|million)(?:[^.;]{{0,120}}?)(?:or|and)\s+\$?([0-9]+(?:\.[0-9]+)?)\s+per share"
    told = {
        "gaap": rf"{lead}GAAP(?:\s+\w+){{0,4}}\s+net income(?:[^.;]{{0,140}}?){rest}",
        "adjusted": rf"{lead}(?:Adjusted|Non-GAAP)(?:\s+\w+){{0,4}}\s+net income(?:[^.;]{{0,140}}?){rest}",
        "plain": rf"{lead}(?:Net income|Net earnings|Earnings attributable to [A-Za-z& .]+)(?:[^.;]{{0,120}}?){rest}",
    }
    group = lambda kind, k: F.nullif(F.regexp_extract(text, FLAGS + told[kind], k), F.lit(""))
    amount = lambda kind: in_billions(parsed(group(kind, 1)), group(kind, 2))
    eps = lambda kind: parsed(group(kind, 3))
    row = "Net income, as {}"
    share = "Diluted earnings per share, as {}"
    return F.struct(
        has_any(F.lower(text), SPECIAL_ITEMS).alias("special"),
        F.coalesce(scaled(pair(row.format("reported"), 0)), amount("gaap"), amount("plain")).alias("reported"),
        scaled(pair(row.format("reported"), 1)).alias("reported_prior"),
        F.coalesce(pair(share.format("reported"), 0), eps("gaap"), eps("plain")).alias("reported_eps"),
        F.coalesce(scaled(pair(row.format("adjusted"), 0)), amount("adjusted")).alias("adjusted"),
        scaled(pair(row.format("adjusted"), 1)).alias("adjusted_prior"),
        F.coalesce(pair(share.format("adjusted"), 0), eps("adjusted")).alias("adjusted_eps"),
    )


def prefers_adjusted(signal: Column, revenue: Column) -> Column:
    """Whether the adjusted profit is the one to use: without a reported one if there are special items; else with them, a gap of 0.35
    and 8 % of revenue, and a reported profit near 0, 1.35 times and more, or a margin of 12 % and less that grows by 8 points."""
    a, r = signal["adjusted"], signal["reported"]
    base = F.coalesce(revenue, F.lit(0.0))
    share = lambda x: F.abs(x) / F.nullif(revenue, F.lit(0.0))
    much = (F.abs(r) < 1e-6) | (F.abs(a) / F.greatest(F.abs(r), F.lit(1e-6)) >= 1.35) | F.coalesce((share(r) <= 0.12) & (share(a) >= share(r) + 0.08), F.lit(False))
    wide = F.abs(a - r) >= F.greatest(F.lit(0.35), base * 0.08)
    return F.when(a.isNull(), False).when(r.isNull(), signal["special"]).otherwise(signal["special"] & wide & much)


#: Labels of equity, and what tells that a text has a balance sheet.
EQUITY = ("Total stockholders' equity", "Total stockholders equity", "Total shareholders' equity", "Total shareholders equity", "Total equity", "Stockholders' equity", "Shareholders' equity", "Equity attributable to shareholders of the parent", "Equity attributable to owners of the company", "Equity attributable to owners of parent")
BALANCE = ("balance sheets", "balance sheet", "financial position", "selected items from balance sheets")


def ending_equity(text: Column) -> Column:
    """Equity in billions, of a text with a balance sheet, by the scale that it states: billions, millions, thousands; null if it states none."""
    own = parsed(F.coalesce(*(F.nullif(F.regexp_extract(text, rf"{FLAGS}{labelled(label)}\s+\$?\s*({NUMBER})", 1), F.lit("")) for label in EQUITY)))
    stated = F.when(text.rlike(r"(?is)in\s+(?:nt\$|us\$)?\s*billions|\(in\s+billions\)"), 1.0).when(text.rlike(r"(?is)in\s+millions|\(millions\)"), 0.001).when(text.rlike(r"(?is)in\s+thousands"), 0.000001)
    return F.when(has_any(F.lower(text), BALANCE), own * stated)


def guidance(text: Column) -> Column:
    """struct<low, high, mid, kind>: a range, a point with a tolerance, a point, else context, where a passage of outlook has a business term and isn't accounting."""
    from quartermill.functions.text import guidance_signal

    currency = r"(?:us\$|u\.s\.\$|usd\s+|eur\s+|€|\$)?\s*"
    number, unit, about = rf"{currency}({NUMBER})", r"\s*(billion|million)", r"(?:revenues|revenue|sales)"
    leads = (rf"(?:expected|expects?|guidance|outlook).{{0,120}}?{about}", rf"{about}.{{0,40}}?(?:is|are)\s+expected")

    def groups(pattern: str, *want: int) -> list[Column]:
        return [F.nullif(F.regexp_extract(text, FLAGS + pattern, g), F.lit("")) for g in want]

    none = F.lit(None).cast("double")
    make = lambda lo, hi, mid, kind: F.struct(lo.alias("low"), hi.alias("high"), mid.alias("mid"), F.lit(kind).alias("kind"))
    tries = []
    for lead, gap in zip(leads, (80, 40)):
        a, ua, b, ub = groups(rf"{lead}.{{0,{gap}}}?between\s+{number}{unit}\s+and\s+{number}{unit}", 1, 2, 3, 4)
        low, high = in_billions(parsed(a), ua), in_billions(parsed(b), ub)
        tries.append(F.when(a.isNotNull(), make(low, high, (low + high) / 2, "range")))
    v, u, t = groups(rf"{leads[1]}.{{0,40}}?{number}{unit}\s*,?\s*(?:plus\s+or\s+minus|±)\s*([0-9]+(?:\.[0-9]+)?|zero|one|two|three|four|five|six|seven|eight|nine|ten)\s*%", 1, 2, 3)
    point, share = in_billions(parsed(v), u), percent_token(t) / 100
    tries.append(F.when(v.isNotNull(), make(point * (1 - share), point * (1 + share), point, "tolerance")))
    for lead, gap in zip(leads, (40, 40)):
        v, u = groups(rf"{lead}.{{0,{gap}}}?{number}{unit}", 1, 2)
        tries.append(F.when(v.isNotNull(), make(none, none, in_billions(parsed(v), u), "point")))
    passage = rf"{FLAGS}(?:expected|expects?|guidance|outlook).{{0,220}}"
    at, piece = F.regexp_instr(text, F.lit(passage)), F.regexp_extract(text, passage, 0)
    begin = F.greatest(at - 20, F.lit(1))
    around = F.substring(text, begin, (at - begin + F.length(piece) + 180).cast("int"))
    tries.append(F.when((at > 0) & guidance_signal(around), make(none, none, none, "context")))
    return F.when(text.rlike("(?i)expect|guidance|outlook"), F.coalesce(*tries))  # each of them has one of these


# ---- structures ----------------------------------------------------------------------------------------------------------


def segment_metric(text: Column, labels: list[str], table_first: Column) -> Column:
    """struct<value, yoy>: by table, then sentences, for filings; the other way round for others."""
    row = metric(text, labels)
    table = F.when(row.isNotNull(), F.struct(row["value"].alias("value"), row["yoy"].alias("yoy")))
    told = F.coalesce(*(x for label in labels for s in (segment_narrative(text, label),) for x in (F.when(s["yoy"].isNull() | (F.abs(s["yoy"]) <= 500), s), narrative(text, quoted(label)))))
    return F.when(table_first, F.coalesce(table, told)).otherwise(F.coalesce(told, table))


def structures(materials: DataFrame, labels: DataFrame) -> DataFrame:
    """The value of each name by the first material and label that has it. materials: company, quarter_index, material_rank, text; labels: company, name, label_rank, label.

    The registry is joined by company, so an issuer's labels meet its own texts only.
    """
    gap, number = r"[\s$]*", r"\(?\$?\s*\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?(?![0-9]|[.,][0-9])"
    pattern = F.concat(F.lit(r"(?is)\b"), F.regexp_replace("label", r"\s+", r"\\s+"), F.lit(rf"{gap}({number}){gap}({number})"))
    met = materials.join(labels, "company").withColumn("_p", pattern)
    value, prior = (parsed(F.nullif(F.expr(f"regexp_extract(text, _p, {g})"), F.lit(""))) * 0.001 for g in (1, 2))
    found = met.select("company", "quarter_index", "name", "material_rank", "label_rank", value.alias("value"), prior.alias("prior")).where("value IS NOT NULL")
    own = Window.partitionBy("company", "quarter_index", "name").orderBy("material_rank", "label_rank")
    return found.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k", "material_rank", "label_rank")


def best_profile(found: DataFrame, profiles: DataFrame) -> DataFrame:
    """The geography profile that fits best: ten points a name found and the whole part of their sum. found: company, quarter_index, name, value; profiles: profile, name."""
    met = found.join(profiles, "name")
    sums = met.groupBy("company", "quarter_index", "profile").agg((10 * F.count("*") + F.floor(F.sum("value"))).alias("score"), F.count("*").alias("names"))
    own = Window.partitionBy("company", "quarter_index").orderBy(F.desc("score"), "profile")
    return sums.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")


#: Labels of the generic parser; an issuer's registry row may put others first.
GENERIC = {
    "revenue": ["Total net sales", "Total revenues", "Total revenue", "Net revenue", "Net sales", "Revenues", "Revenue"],
    "operating_income": ["Income from operations", "Operating income", "Operating profit"],
    "net_income": ["Net income", "Net earnings", "Net profit"],
    "gross_profit": ["Gross profit", "Gross margin"],
}
#: Patterns of the same in sentences.
SUBJECTS = {"revenue": r"(?:total\s+)?(?:net\s+)?(?:revenues?|sales)", "operating_income": r"operating\s+income", "net_income": r"net\s+(?:income|earnings)", "gross_profit": r"gross\s+profit"}


def material_metrics(materials: DataFrame, registry: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """materials with their metrics as columns: issuer labels first, then the generic ones, then sentences."""
    registry = registry or {}
    own = materials
    for name, labels in GENERIC.items():
        cases = None
        for company, rows in registry.items():
            if name in rows:
                mine = metric(F.col("text"), rows[name])
                cases = F.when(F.col("company") == company, mine) if cases is None else cases.when(F.col("company") == company, mine)
        told = bound(F.coalesce(company_narrative(F.col("text"), SUBJECTS[name]), narrative(F.col("text"), SUBJECTS[name])), lambda t: F.when(t.isNotNull(), F.struct(t["value"].alias("value"), _none().alias("prior"), t["yoy"].alias("yoy")).cast(METRIC)))
        general = F.coalesce(metric(F.col("text"), labels), told)
        own = own.withColumn(name, general if cases is None else F.coalesce(cases, general))
    return own.withColumns({"eps": per_share(F.col("text")), "equity": ending_equity(F.col("text")), "guidance": guidance(F.col("text"))})


def parse_materials(materials: DataFrame, registry: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """company, quarter_index, and by metric value and change; issuer labels first, then the generic ones, then sentences.

    materials: company, quarter_index, material_rank, text. A quarter's metric comes from its first material that has it. What no
    pattern finds is null; no constants stand in.
    """
    own = material_metrics(materials, registry)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("material_rank"))).alias(c)
    return own.groupBy("company", "quarter_index").agg(*(first(c) for c in (*GENERIC, "eps", "equity", "guidance")))
