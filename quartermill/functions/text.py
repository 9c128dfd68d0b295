"""Text: cleaning, tokens, excerpts, topic counts, quality gates, transcripts."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks at which an excerpt may end.
ENDS = (". ", "! ", "? ", "; ", "。", "！", "？", "；", ", ", "，")
#: Phrases of unusable pages, the first that stands there counts; kinds and roles of official material; words of one.
ERROR_PHRASES = ("access denied", "forbidden", "page not found", "404 not found", "request unsuccessful", "temporarily unavailable", "enable javascript", "javascript is disabled", "please turn javascript on", "are you a robot", "captcha")
OFFICIAL_KINDS = ("official_release", "presentation", "call_summary", "sec_filing")
OFFICIAL_ROLES = ("earnings_release", "earnings_commentary", "earnings_presentation", "earnings_call", "sec_filing")
MATERIAL_WORDS = ("revenue", "earnings", "financial results", "quarterly results", "guidance", "margin", "operator", "question-and-answer", "prepared remarks", "cash flow", "net income", "conference call", "webcast replay")
#: Accounting terms, two of which make a passage noise, and business terms of guidance.
GUIDANCE_NOISE = ("income tax", "tax positions", "financial instruments", "balance sheet", "cash equivalents", "adoption", "disclosures", "note 2", "note 3", "note 4", "accounting", "fair value")
GUIDANCE_SIGNAL = ("revenue", "sales", "demand", "orders", "backlog", "margin", "inventory", "pricing", "shipments", "capex", "utilization", "growth", "expect", "outlook", "guidance")
#: Terms of a call, and who speaks in one.
CALL_WORDS = ("question-and-answer", "question and answer", "prepared remarks", "conference call", "earnings call", "operator", "analyst")
SPEAKERS = r"(?i)\b(?:Operator|Analyst|Question(?:er)?|CEO|CFO|COO|President|Chief Executive Officer|Chief Financial Officer)\b"
#: Institutions by their aliases, the first that stands in a text counts; stances by pattern; ratings by word.
INSTITUTIONS = {
    "Goldman Sachs": ("goldman sachs", "goldman"), "Morgan Stanley": ("morgan stanley",), "JPMorgan": ("jpmorgan", "jp morgan", "jpm"), "UBS": ("ubs",),
    "Bank of America": ("bank of america", "bofa", "bofa securities"), "Citi": ("citi", "citigroup"), "Bernstein": ("bernstein", "sanford c. bernstein"), "Barclays": ("barclays",),
    "Evercore ISI": ("evercore", "evercore isi"), "Jefferies": ("jefferies",), "Wells Fargo": ("wells fargo",), "Deutsche Bank": ("deutsche bank",), "Mizuho": ("mizuho",),
    "RBC Capital": ("rbc", "royal bank of canada"), "Raymond James": ("raymond james",), "Oppenheimer": ("oppenheimer",), "Wedbush": ("wedbush",), "Needham": ("needham",),
    "Piper Sandler": ("piper sandler",), "Baird": ("baird",), "HSBC": ("hsbc",), "BMO Capital": ("bmo", "bmo capital"), "KeyBanc": ("keybanc",), "Wolfe Research": ("wolfe", "wolfe research"),
    "Cowen": ("cowen",), "Stifel": ("stifel",), "Susquehanna": ("susquehanna",), "Canaccord": ("canaccord", "canaccord genuity"), "Credit Suisse": ("credit suisse",), "Cantor": ("cantor", "cantor fitzgerald"),
}
STANCES = (
    ("positive", r"(?i)\bupgrade[sd]?\b|\boutperform\b|\boverweight\b|\bbuy\b|\bbullish\b|\b(?:raise[sd]?|lifts?)\b.{0,30}\btarget\b|\bprice target (?:raised|lifted)\b"),
    ("negative", r"(?i)\bdowngrade[sd]?\b|\bunderperform\b|\bunderweight\b|\bsell\b|\bbearish\b|\b(?:cuts?|lowers?)\b.{0,30}\btarget\b|\bprice target lowered\b"),
    ("neutral", r"(?i)\b(?:neutral|equal weight|hold|market perform)\b"),
)
RATINGS = ("outperform", "overweight", "buy", "neutral", "equal weight", "hold", "underweight", "underperform", "sell")
#: Words of the themes that views come back to.
VIEW_THEMES = {
    "cloud": ("ai", "cloud", "azure", "aws", "copilot", "hpc", "inference"), "guidance": ("guidance", "outlook", "forecast", "expectation", "boundary"),
    "profit": ("margin", "profit", "earnings", "cash flow", "fcf"), "valuation": ("price target", "target", "valuation", "multiple"), "supply": ("capex", "capacity", "supply", "shipment", "yield"),
}


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in the text, inside other words too."""
    return reduce(or_, (text.contains(w) for w in words))


def number_of(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words stand in the text."""
    return reduce(add, (text.contains(w).cast("int") for w in words))


def collapsed(text: Column) -> Column:
    """Quotes and dashes made plain, white space single."""
    plain = F.translate(text, "‘’“”–— ", "''\"\"-- ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def token(text: Column) -> Column:
    """Letters and digits in lower case, CJK kept."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿]+", "")


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿]+", "-"), F.lit("-"))


def excerpt(text: Column, limit: int, least: int = 36) -> Column:
    """At most `limit` characters, up to the last mark that isn't before max(least, 55 %); else cut hard."""
    head = F.substring(text, 1, limit)
    back = F.reverse(head)
    ends = [F.when(F.locate(e.strip()[::-1], back) > 0, F.length(head) - F.locate(e.strip()[::-1], back) + 1) for e in ENDS]
    cut = F.greatest(*(F.coalesce(e, F.lit(0)) for e in ends))
    return F.when(F.length(text) <= limit, text).when(cut >= max(least, int(0.55 * limit)), F.substring(text, F.lit(1), cut)).otherwise(head)


def around(text: Column, pattern: str, before: int = 60, after: int = 120) -> Column:
    """The first match with so many characters before and after its start; null for none."""
    at = F.regexp_instr(text, F.lit(pattern))
    begin = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, begin, at + after - begin))


def count_of(text: Column, word: str) -> Column:
    """Non-overlapping occurrences, inside words too."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word))


def topic_scores(low: Column, topics: dict[str, tuple[str, ...]], most: int = 4) -> Column:
    """array<struct<score, topic>>: twelve points an occurrence, 100 at most, the highest first, topics without any left out.

    low: the text in lower case; hand over a column that is computed once, since it is searched for every word.
    """
    scored = [F.struct(F.least(F.lit(100), reduce(add, (count_of(low, w) for w in words)) * 12).cast("int").alias("score"), F.lit(-n).alias("order"), F.lit(name).alias("topic")) for n, (name, words) in enumerate(topics.items())]
    kept = F.filter(F.array(*scored), lambda s: s["score"] > 0)
    return F.transform(F.slice(F.sort_array(kept, asc=False), 1, most), lambda s: F.struct(s["score"].alias("score"), s["topic"].alias("topic")))


def quality_issue(text: Column, title: Column, kind: Column, role: Column, suffix: Column, content_type: Column) -> Column:
    """What is wrong with a material's text, or an empty string: nothing in it, an error page's phrase in title or text, or an
    official one of less than 180 characters, HTML or plain, without a word of finance."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    low = F.trim(F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit(" "), F.lower(bare)))
    phrase = F.coalesce(*(F.when(low.contains(p), p) for p in ERROR_PHRASES))
    official = F.coalesce(F.lower(kind).isin(*OFFICIAL_KINDS), F.lit(False)) | F.coalesce(F.lower(role).isin(*OFFICIAL_ROLES), F.lit(False))
    written = F.coalesce(suffix.isin(".html", ".htm", ".txt"), F.lit(False)) | F.coalesce(F.lower(content_type).rlike("html|text"), F.lit(False))
    thin = official & (F.length(bare) < 180) & written & ~has_any(low, MATERIAL_WORDS)
    return (
        F.when(bare == "", "empty extracted text")
        .when(phrase.isNotNull(), F.concat(F.lit("unusable source page: "), phrase))
        .when(thin, F.concat(F.lit("insufficient extracted text ("), F.length(bare).cast("string"), F.lit(" chars)")))
        .otherwise("")
    )


def implausible_year(text: Column, year: Column, current_year: Column, gap: int = 3) -> Column:
    """Whether it names a year more than `gap` years after the report's; reports of the current year and the one before may."""
    beyond = F.exists(F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int") > year + gap)
    return F.coalesce((year < current_year - 1) & beyond, F.lit(False))


def guidance_signal(text: Column) -> Column:
    """Less than two accounting terms, and a business one."""
    low = F.lower(text)
    return F.coalesce((number_of(low, GUIDANCE_NOISE) < 2) & has_any(low, GUIDANCE_SIGNAL), F.lit(False))


def transcript_like(text: Column, label: Column) -> Column:
    """By its label, or two terms of a call, or four mentions of speakers."""
    low = F.lower(text)
    return F.coalesce(has_any(F.lower(label), ("transcript", "prepared remarks")), F.lit(False)) | F.coalesce((number_of(low, CALL_WORDS) >= 2) | (F.regexp_count(text, F.lit(SPEAKERS)) >= 4), F.lit(False))


#: Space characters, those beyond ASCII too.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def chunks(text: Column, least: int = 220) -> Column:
    """Paragraphs; of a text without blank lines, its lines joined until each has `least` characters."""
    bare = lambda p: F.trim(p, F.lit(SPACES))  # noqa: E731 - of one argument: transform hands a function of two the place as well, which F.trim would take for letters to cut
    paragraphs = F.filter(F.transform(F.split(text, r"\n[\t\n\f\r ]*\n+"), bare), lambda p: p != "")
    lines = F.filter(F.transform(F.split(text, r"\n+"), bare), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, line: Column) -> Column:
        own = F.when(a["open"] == "", line).otherwise(F.concat(a["open"], F.lit(" "), line))
        full = F.length(own) >= least
        return F.struct(F.when(full, F.concat(a["done"], F.array(own))).otherwise(a["done"]).alias("done"), F.when(full, F.lit("")).otherwise(own).alias("open"))

    merged = F.aggregate(lines, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return F.when(F.size(paragraphs) > 1, paragraphs).otherwise(merged)


def quotes(text: Column, most: int = 2) -> Column:
    """array<struct<speaker, quote>>: '"...," said Name', 'Name said, "..."' and 'Name: "..."', in that order, each once.

    A quote has 40 to 320 characters; operators, questioners and analysts aren't quoted.
    """
    verbs, open_, close = r"(?:said|stated|noted|added|commented|remarked|explained)", r"[“\"]", r"[”\"]"
    said = rf"([^\"”]{{40,320}}){close}"
    group = lambda m, p, g: collapsed(F.regexp_extract(m, "(?is)" + p, g))
    pair = lambda p, s, q: F.transform(F.regexp_extract_all(text, F.lit("(?is)" + p), F.lit(0)), lambda m: F.struct(group(m, p, s).alias("speaker"), group(m, p, q).alias("quote")))  # noqa: E731 - searched once, both groups from what was found
    none = F.array().cast("array<struct<speaker:string,quote:string>>")
    where = lambda mark, found: F.when(text.rlike("(?i)" + mark), found).otherwise(none)
    every = F.concat(
        pair(rf"{open_}{said},?\s+{verbs}\s+([^.,\n]+)", 2, 1),
        where(rf"{verbs}[:,]?\s+{open_}", pair(rf"([^.,\n]+?)\s+{verbs}[:,]?\s+{open_}{said}", 1, 2)),
        where(rf":\s*{open_}", pair(rf"([^:\n]{{3,120}}+):\s*{open_}{said}", 1, 2)),
    )
    fit = F.filter(every, lambda x: ~F.lower(x["speaker"]).isin("operator", "question", "analyst") & (F.length(x["quote"]) >= 40))
    return F.slice(F.array_distinct(fit), 1, most)


def label_variants(name: Column) -> Column:
    """With '&' for 'and' and back, without hyphens and commas; each once, the name first."""
    return F.array_distinct(F.array(name, F.replace(name, F.lit("&"), F.lit("and")), F.regexp_replace(name, r"\band\b", "&"), F.replace(name, F.lit("-"), F.lit(" ")), F.replace(name, F.lit(","), F.lit(""))))


def stance(text: Column) -> Column:
    """positive, negative or neutral by the first pattern that fits, else reference."""
    return F.coalesce(*(F.when(text.rlike(pattern), name) for name, pattern in STANCES), F.lit("reference"))


def institution(text: Column) -> Column:
    """The first of the institutions with an alias in the text; null for none."""
    low = F.lower(text)
    return F.coalesce(*(F.when(has_any(low, aliases), name) for name, aliases in INSTITUTIONS.items()))


def ratings(text: Column) -> Column:
    """array<string> of the ratings that stand in the text."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.contains(r), r.title()) for r in RATINGS)))


def action(text: Column) -> Column:
    """What a view does: upgrade, downgrade, target cut, target raise, target, keep, cautious, positive or mention, the first that holds."""
    low, target = F.lower(text), price_target(text).isNotNull()
    on_target = target & low.contains("target")
    return (
        F.when(low.contains("upgrade"), "upgrade")
        .when(low.contains("downgrade"), "downgrade")
        .when(on_target & has_any(low, ("lower", "cut")), "target cut")
        .when(on_target & has_any(low, ("raise", "lift")), "target raise")
        .when(on_target, "target")
        .when(has_any(low, ("maintain", "keep", "reiterate")) & (F.size(ratings(text)) > 0), "keep")
        .when(low.contains("pessimistic forecast") | (stance(text) == "negative"), "cautious")
        .when(stance(text) == "positive", "positive")
        .otherwise("mention")
    )


def view_themes(text: Column) -> Column:
    """array<string> of the themes a view touches."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(has_any(low, words), name) for name, words in VIEW_THEMES.items())))


def price_target(text: Column) -> Column:
    return F.regexp_extract(text, r"\$([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def signal_bucket(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("margin|profit|cost"), "margin").when(low.rlike("segment|mix|geograph|region"), "structure").otherwise("growth")


def html_text(html: Column) -> Column:
    """Without scripts, styles and tags, entities resolved, white space single."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, letter in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
