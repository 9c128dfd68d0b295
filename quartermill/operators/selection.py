"""Choosing among candidates: nearest filings, scored sources, merged lists, fuzzy names."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from quartermill.functions.extract import bound
from quartermill.functions.periods import ORDINALS
from quartermill.functions.text import has_any, number_of, transcript_like


def nearest_annual(quarters: DataFrame, annual: DataFrame, reach: int = 5) -> DataFrame:
    """Each quarter with the latest annual_index of 0 to `reach` quarters before. The range is unrolled, so the join is on equal keys."""
    tried = quarters.withColumn("annual_index", F.explode(F.sequence(F.col("quarter_index") - reach, F.col("quarter_index"))))
    found = tried.join(annual.withColumn("_found", F.lit(True)), ["company", "annual_index"], "left")
    return found.groupBy("company", "quarter_index").agg(F.max(F.when(F.col("_found"), F.col("annual_index"))).alias("annual_index"))


def effective_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule whose `through` isn't before the row's quarter; rows: company, quarter_index; rules: company, through, ordinal, value, default_value."""
    packed = rules.groupBy("company").agg(F.sort_array(F.collect_list(F.struct("ordinal", "through", "value"))).alias("_rules"), F.max("default_value").alias("_default"))
    hit = F.get(F.filter("_rules", lambda r: r["through"] >= F.col("quarter_index")), F.lit(0))
    return rows.join(packed, "company", "left").withColumn("value", F.coalesce(hit["value"], "_default")).drop("_rules", "_default")


def document_tokens(*parts: Column) -> Column:
    """The parts in lower case, each followed by its words: letters and digits apart, dashes, underscores and slashes as spaces."""
    out = []
    for part in parts:
        low = F.trim(F.lower(F.coalesce(part.cast("string"), F.lit(""))))
        words = F.regexp_replace(F.regexp_replace(low, r"(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)", " "), r"[-_/]+", " ")
        words = F.trim(F.regexp_replace(F.regexp_replace(words, r"[^a-z0-9.% ]+", " "), r"\s+", " "))
        out += [F.when(low != "", low), bound(words, lambda w: F.when((w != "") & (w != low), w))]  # noqa: B023
    return F.concat_ws(" ", *out)


def hint_score(tokens: Column, hints: Column, excludes: Column) -> Column:
    """35 for each hint that the tokens hold, less 80 if they hold an exclusion. hints, excludes: arrays."""
    return F.size(F.filter(hints, lambda h: tokens.contains(h))) * 35 - F.when(F.exists(excludes, lambda x: tokens.contains(x)), 80).otherwise(0)


def filing_score(tokens: Column, hints: Column, excludes: Column, form_rank: Column, filed: Column, report_date: Column, period_end: Column) -> Column:
    """The score of a filing for a period; form_rank: the form's place among the wanted ones.

    200 less 30 a rank, 160 less a day's distance and 12 if filed on the period's end or later, 120 less two a day between the
    report's date and the period's end and 80 if they are one, the score of hints, less 120 if none of them is there and 160 for an exclusion.
    """
    floor = lambda x: F.greatest(F.lit(0), x)
    gap, report = F.datediff(filed, period_end), F.datediff(report_date, period_end)
    near = F.coalesce(floor(160 - F.abs(gap)) + F.when(gap >= 0, 12).otherwise(0), F.lit(0))
    same = F.coalesce(floor(120 - 2 * F.abs(report)) + F.when(report == 0, 80).otherwise(0), F.lit(0))
    unhinted = (F.size(hints) > 0) & ~F.exists(hints, lambda h: tokens.contains(h))
    return floor(200 - 30 * form_rank) + near + same + hint_score(tokens, hints, excludes) - F.when(unhinted, 120).otherwise(0) - F.when(F.exists(excludes, lambda x: tokens.contains(x)), 160).otherwise(0)


def best_filing(filings: DataFrame, wanted: DataFrame, days_before: int = 45, days_after: int = 130) -> DataFrame:
    """The filing of each company and period with the best score, the first of equals.

    filings: company, period_end, form, filed, report_date, items, document, description, ordinal. wanted: company, forms (array in
    order), hints, excludes (arrays), release_mode: an 8-K must then name item 2.02. Filings outside the days around the period's
    end, and those of other forms, don't count.
    """
    met = filings.join(wanted, "company")
    gap = F.datediff("filed", "period_end")
    rank = F.array_position("forms", F.col("form")).cast("int") - 1
    met = met.where((rank >= 0) & (gap.isNull() | gap.between(-days_before, days_after)) & ~(F.col("release_mode") & (F.col("form") == "8-K") & ~F.coalesce(F.col("items").contains("2.02"), F.lit(False))))
    met = met.withColumn("tokens", document_tokens(F.col("document"), F.col("description")))
    scored = met.withColumn("score", filing_score(F.col("tokens"), F.col("hints"), F.col("excludes"), rank, F.col("filed"), F.col("report_date"), F.col("period_end"))).where("score > -1000")
    return best_by(scored, ["company", "period_end"], F.desc("score"), F.col("ordinal")).drop("tokens", "forms", "hints", "excludes", "release_mode")


#: Suffixes of attachments that aren't read, and what names of files say: words, points.
BINARY_SUFFIXES = (".csv", ".gif", ".jpeg", ".jpg", ".js", ".json", ".png", ".svg", ".xbrl", ".xml", ".xsd", ".xls", ".xlsx", ".zip")
NAME_POINTS = (
    (("header", "xbrl", "schema", "instance", "ex101", "graphic", "image"), -120),
    (("pressrelease", "earningsrelease", "financialresults", "results", "withguidance"), 28),
    (("quarterlyresul", "q1results", "q2results", "q3results", "q4results"), 24),
    (("exhibit991", "exhibit99", "99-1", "99_1", "ex99"), 24),
    (("presentation", "slides", "deck"), 22),
    (("presentat", "presq", "presq1", "presq2", "presq3", "presq4"), 22),
    (("commentary", "cfo", "supplement"), 26),
    (("exhibit992", "99-2", "99_2"), 18),
)
INDEX_NAMES = ("index.html", "index.htm", "index.json")
QUARTER_WORDS = ("quarter", "result", "financial", "q1", "q2", "q3", "q4", "presentation", "commentary", "supplement", "webcast", "transcript")


def file_name(address: Column) -> Column:
    """The last part of an address' path, in lower case."""
    return F.lower(F.regexp_extract(F.regexp_replace(address, r"[?#].*$", ""), r"([^/]*)/*$", 1))


def attachment_score(href: Column, text: Column, kind: Column, hints: Column, excludes: Column) -> Column:
    """The score of an attachment by its tokens and its file's name and suffix, each computed once."""

    def by_name(name: Column) -> Column:
        points = F.when(name.contains("form6k"), -18).otherwise(0)
        points = points + F.when(name.endswith("-index.html") | name.endswith("-index-headers.html"), -220).otherwise(0) + F.when(name.isin(*INDEX_NAMES), -220).otherwise(0)
        points = points + F.when(name.rlike(r"^\d{10}-\d{2}-\d{6}\.txt$"), -220).otherwise(0)
        for words, n in NAME_POINTS:
            points = points + F.when(has_any(name, words), n).otherwise(0)
        points = points + F.when(name.rlike(r"d[a-z0-9]+dex99(?:1|01)\b"), 24).otherwise(0) + F.when(name.rlike(r"d[a-z0-9]+dex99(?:2|02)\b"), 18).otherwise(0)
        plain = ~name.contains("exhibit99") & ~name.contains("ex99")
        return points + bound(F.regexp_extract(name, r".(\.[^.]*)$", 1), lambda x: F.when(x.isin(*BINARY_SUFFIXES), -220).otherwise(0) + F.when(x.isin(".htm", ".html", ".pdf", ".txt"), 8).otherwise(0) + F.when((x == ".txt") & plain, -120).otherwise(0))

    return bound(document_tokens(href, text, kind), lambda t: hint_score(t, hints, excludes)) + bound(file_name(href), by_name)


def slug_text(address: Column) -> Column:
    """The last part of an address' path as words."""
    last = F.regexp_extract(F.regexp_replace(address, r"[?#].*$", ""), r"([^/]*)/*$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"(?<=\d)(?=[A-Za-z])", " "), r"[-_]+", " "), r"\s+", " "))


def wrapper_score(address: Column, hints: Column, excludes: Column) -> Column:
    """The score of the page that lists the attachments."""

    def scored(name: Column) -> Column:
        points = bound(document_tokens(address, slug_text(address), name), lambda t: hint_score(t, hints, excludes))
        points = points + F.when(name.rlike(r"\.(htm|html|pdf|txt)$"), 8).otherwise(0) + F.when(name.rlike(r"(-index\.html|-index-headers\.html|index\.html|index\.htm|index\.json)$"), -220).otherwise(0)
        return points + F.when(has_any(name, NAME_POINTS[0][0]), NAME_POINTS[0][1]).otherwise(0)

    return bound(file_name(address), scored)


def attachment_choice(attachments: DataFrame, wrappers: DataFrame, margin: int = 6) -> DataFrame:
    """filing, url, score: the attachment that beats the wrapper page, or the wrapper page.

    attachments: filing, listing ('directory' or 'page'), ordinal, href, text, kind; wrappers: filing, wrapper_url, hints, excludes
    (arrays). The best of the directory comes first, then the best of the page; either must beat the wrapper by more than `margin`, or
    equal it where its name is that of a result and the wrapper's that of a cover form. A numbered exhibit from the page without a word
    of a quarter doesn't replace a wrapper that has hints.
    """
    pages = wrappers.select("*", F.explode(F.array(wrapper_score(F.col("wrapper_url"), F.col("hints"), F.col("excludes")))).alias("wrapper"))
    scored = attachment_score(F.col("href"), F.col("text"), F.col("kind"), F.col("hints"), F.col("excludes"))
    rows = attachments.join(pages, "filing").select("*", F.explode(F.array(scored)).alias("score"))  # a generator, so that no predicate repeats its expression
    best = best_by(rows, ["filing", "listing"], F.desc("score"), F.col("ordinal"))
    base = F.regexp_extract("wrapper_url", r"^(.*/)[^/]*$", 1)
    address = F.when(F.col("href").rlike("(?i)^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(F.regexp_extract("wrapper_url", r"^(https?://[^/]+)", 1), "href")).otherwise(F.concat(base, "href"))
    best = best.select("filing", "listing", "text", "wrapper_url", "wrapper", "score", F.explode(F.array(address)).alias("url"))
    best = best.select("*", F.explode(F.array(F.struct(file_name(F.col("url")).alias("name"), file_name(F.col("wrapper_url")).alias("cover")))).alias("_f"))
    name, cover = F.col("_f.name"), F.col("_f.cover")
    preferred = (F.col("url") != F.col("wrapper_url")) & (F.col("score") >= F.col("wrapper")) & has_any(name, ("pressreleasequarterlyresul", "financialstatements", "presentat", "presq")) & has_any(cover, ("form6k", "quarterlyfilings"))
    vague = (F.col("wrapper") >= 35) & name.rlike(r"d[a-z0-9]+dex99(?:1|01|2|02)\b") & ~bound(document_tokens(F.col("url"), F.col("text"), slug_text(F.col("url"))), lambda t: has_any(t, QUARTER_WORDS))
    ahead = F.col("score") > F.col("wrapper") + margin
    wins = F.when(F.col("listing") == "directory", preferred | (ahead & (F.col("url") != F.col("wrapper_url")))).otherwise(~vague & (preferred | ahead))
    won = best_by(best.select("*", F.explode(F.array(wins)).alias("_wins")).where("_wins"), ["filing"], F.col("listing")).select("filing", F.col("url").alias("_url"), F.col("score").alias("_score"))
    return pages.join(won, "filing", "left").select("filing", F.coalesce("_url", "wrapper_url").alias("url"), F.coalesce("_score", "wrapper").alias("score"))


def best_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


#: Kinds and roles of sources, the best first.
KIND_ORDER = ("official_release", "sec_filing", "call_summary", "presentation", "structured_financials")
ROLE_ORDER = ("earnings_release", "sec_filing", "earnings_call", "earnings_commentary", "earnings_presentation")


def merged_sources(existing: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolved and existing sources of a report by kind and role, one a url; the first of equals, resolved ones before existing.

    An existing page of investor relations goes where anything official with a url was resolved, an existing release or filing
    where one was resolved. Columns: report, kind, role, url, ordinal.
    """
    place = lambda c, order: F.coalesce(*(F.when(F.col(c) == x, len(order) - n) for n, x in enumerate(order)), F.lit(0))
    both = resolved.withColumn("_from", F.lit(0)).unionByName(existing.withColumn("_from", F.lit(1)))
    own = Window.partitionBy("report")
    found = lambda condition: F.coalesce(F.bool_or((F.col("_from") == 0) & condition).over(own), F.lit(False))
    official = found(F.col("kind").isin("official_release", "sec_filing", "presentation") & has_value(F.col("url")))
    both = both.withColumns({"_official": official, "_release": found(F.col("kind") == "official_release"), "_filing": found(F.col("kind") == "sec_filing")})
    dead = (F.col("_from") == 1) & ((F.col("_official") & (F.col("kind") == "investor_relations")) | (F.col("_release") & (F.col("kind") == "official_release")) | (F.col("_filing") & (F.col("kind") == "sec_filing")))
    alive = both.where(~F.coalesce(dead, F.lit(False)) & has_value(F.col("url"))).withColumns({"kind_rank": place("kind", KIND_ORDER), "role_rank": place("role", ROLE_ORDER)})
    return best_by(alive, ["report", "url"], F.desc("kind_rank"), F.desc("role_rank"), F.col("_from"), F.col("ordinal")).drop("_from", "_official", "_release", "_filing")


def with_materials(sources: DataFrame, materials: DataFrame) -> DataFrame:
    """sources with the last material of their url and label, where there is one. materials: url, label, status, ordinal."""
    last = best_by(materials, ["url", "label"], F.desc("ordinal")).drop("ordinal")
    return sources.join(last, ["url", "label"], "left")


def unseen(rows: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """rows whose keys aren't in seen."""
    return rows.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def first_of_two_keys(views: DataFrame, most: int = 4) -> DataFrame:
    """Greedily, in order: views whose link and firm both are new; `most` a report. views: report, ordinal, firm, link."""
    rows = F.sort_array(F.collect_list(F.struct("ordinal", "firm", "link")))
    empty = F.array().cast("array<struct<ordinal:int,firm:string,link:string>>")
    same = lambda k, v, c: F.coalesce(k[c] == v[c], F.lit(False))
    fresh = lambda kept, v: ~F.exists(kept, lambda k: same(k, v, "firm") | same(k, v, "link")) & (F.size(kept) < most)
    kept = F.aggregate("rows", empty, lambda a, v: F.when(fresh(a, v), F.concat(a, F.array(v))).otherwise(a))
    return views.groupBy("report").agg(rows.alias("rows")).select("report", F.inline(kept))


def topped_up(pools: list[Column], least: int = 3) -> Column:
    """The distinct items of the first pool, and of the following ones as far as `least` asks."""
    first, every = F.array_distinct(pools[0]), F.array_distinct(F.concat(*pools))
    return F.slice(every, 1, F.greatest(F.size(first), F.lit(least)))


def ratio(a: str, b: str) -> float:
    """Twice the matching letters over all letters, by longest common blocks."""
    return SequenceMatcher(None, a, b).ratio()


#: The least likeness of a suggestion, of a reference that stands for a company, of a prefix and of a part; hints of an error.
SUGGESTED, RESOLVED, PREFIX, PART, HINTS = 0.55, 0.82, 0.92, 0.84, 3


def normal_token(reference: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(reference)), r"[^a-z0-9一-鿿]+", "")


def _ordinal_letters(token: Column) -> Column:
    """A token's letters as a set: each with its number among its like, later ones first, as they are rarer."""
    places = F.sequence(F.lit(1), F.length(token))
    named = F.transform(places, lambda k: F.concat(F.lpad((999 - (k - F.length(F.replace(F.substring(token, F.lit(1), k), F.substring(token, k, F.lit(1)), F.lit(""))))).cast("string"), 3, "0"), F.substring(token, k, F.lit(1))))
    return F.array_sort(named)


def _near_tokens(own: DataFrame, aliases: DataFrame) -> DataFrame:
    """token, alias: pairs that may be like enough, by joins on equal keys only.

    Likeness is twice the matching letters over all letters, so a pair has SUGGESTED / 2 of both lengths in common as multisets, and
    neither is shorter than SUGGESTED / (2 - SUGGESTED) of the other. Of two such sets the first letters in one order, all but those
    they must share and one more, have a letter in common; what they share as a whole bounds the likeness. Parts are found by
    equal substrings.
    """
    least = SUGGESTED / (2 - SUGGESTED)
    lettered = lambda df, c: df.select(c, _ordinal_letters(F.col(c)).alias(f"{c}_letters"))
    first = lambda c: F.slice(c, F.lit(1), (F.size(c) - F.ceil(F.size(c) * least - 1e-9) + 1).cast("int"))
    a, b = lettered(own, "token"), lettered(aliases, "alias")
    met = a.withColumn("_k", F.explode(first("token_letters"))).join(b.withColumn("_k", F.explode(first("alias_letters"))), "_k").drop("_k")
    shared = F.size(F.array_intersect("token_letters", "alias_letters"))
    like = met.where(2 * shared >= SUGGESTED * (F.size("token_letters") + F.size("alias_letters")) - 1e-9).select("token", "alias")
    parts = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda n: F.substring(F.col(c), k, n))))))
    inside = own.select("token", F.col("token").alias("_k")).join(aliases.select("alias", parts("alias").alias("_k")), "_k").select("token", "alias")
    around = own.select("token", parts("token").alias("_k")).join(aliases.select("alias", F.col("alias").alias("_k")), "_k").select("token", "alias")
    return like.unionByName(inside).unionByName(around).distinct()


def _scored(references: DataFrame, companies: DataFrame) -> DataFrame:
    """token, company_id, score (prefixes and parts raised) and raw likeness of pairs that are suggested, a row a company."""
    own = references.select(normal_token(F.col("reference")).alias("token")).where("token != ''").distinct()
    aliases = companies.select("company_id", F.explode("aliases").alias("alias")).where("alias != ''").distinct()
    near = _near_tokens(own, aliases.select("alias").distinct())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(raw=[ratio(token, alias) for token, alias in zip(batch["token"], batch["alias"])])

    pairs = near.mapInPandas(run, "token string, alias string, raw double")
    prefix = F.col("alias").startswith(F.col("token")) | F.col("token").startswith(F.col("alias"))
    part = F.col("alias").contains(F.col("token")) | F.col("token").contains(F.col("alias"))
    raised = F.greatest("raw", F.when(prefix, F.lit(PREFIX)).when(part, F.lit(PART)).otherwise(F.lit(0.0)))
    return pairs.select("token", "alias", "raw", raised.alias("score")).join(aliases, "alias").groupBy("token", "company_id").agg(F.max("score").alias("score"), F.max("raw").alias("raw")).where(F.col("score") >= SUGGESTED)


def suggested(references: DataFrame, companies: DataFrame, most: int = 5) -> DataFrame:
    """Companies whose alias is like a reference: score (a prefix 0.92 at least, a part 0.84 at least), 0.55 and up, the best `most`.

    references: reference; companies: company_id, aliases (array of normal tokens). Candidates come from joins on equal keys that lose
    none (_near_tokens); only what is left has its likeness worked out in Python.
    """
    own = references.select("reference", normal_token(F.col("reference")).alias("token")).distinct()
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "company_id"))
    best = _scored(references, companies).withColumn("rank", rank).where(F.col("rank") <= most)
    return own.join(best, "token").select("reference", "company_id", "score", "rank")


def company_aliases(names: Column, english: Column) -> Column:
    """Normal tokens by which a company may be named: names (array of id, slug, ticker, names), and the English name without points or commas."""
    more = F.array(F.replace(english, F.lit("."), F.lit("")), F.replace(english, F.lit(","), F.lit("")))
    return F.array_distinct(F.filter(F.transform(F.concat(names, more), normal_token), lambda t: F.coalesce(t != "", F.lit(False))))


def resolved(references: DataFrame, companies: DataFrame) -> DataFrame:
    """reference, company_id, raw, error of each distinct reference.

    companies: company_id, aliases, display_order, english_name, ticker. A company with the reference's token for an alias stands for
    it, the first in display order of several; else the best suggestion, if its own likeness (not raised) is 0.82 at least. Else
    company_id is null and the error names up to three suggestions, or says that the reference is empty or unknown.
    """
    own = references.select("reference", normal_token(F.col("reference")).alias("token")).distinct()
    aliases = companies.select("company_id", "display_order", F.explode("aliases").alias("token")).distinct()
    exact = own.join(aliases, "token").groupBy("reference").agg(F.min_by("company_id", F.struct("display_order", "company_id")).alias("exact"))
    open_ = own.join(exact, "reference", "left_anti").where("token != ''")
    named = _scored(open_, companies).join(companies.select("company_id", F.concat("english_name", F.lit(" ("), "ticker", F.lit(")")).alias("hint")), "company_id")
    best = named.groupBy("token").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "company_id", "raw", "hint"))), 1, HINTS).alias("best"))  # of the companies
    met = own.join(exact, "reference", "left").join(best, "token", "left")
    top = F.get("best", F.lit(0))
    like = F.coalesce(top["raw"] >= RESOLVED, F.lit(False))
    unknown = F.concat(F.lit("Unknown company reference: "), F.col("reference"))
    error = F.when(F.col("token") == "", "Company reference is empty.").when(top.isNotNull(), F.concat(unknown, F.lit(". Closest matches: "), F.array_join(F.transform("best", lambda x: x["hint"]), ", "))).otherwise(unknown)
    return met.select("reference", F.coalesce("exact", F.when(like, top["company_id"])).alias("company_id"), F.when(F.col("exact").isNull(), top["raw"]).alias("raw"), F.when(F.col("exact").isNull() & ~like, error).alias("error"))


def reachable(links: DataFrame, start: DataFrame, depth: int = 2, most: int = 5) -> DataFrame:
    """url and depth of what `start` (url) reaches over links (src, url, score): the best `most` of a page, each url once."""
    best = links.withColumn("_k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "url"))).where(F.col("_k") <= most).select("src", "url")
    level = start.select("url", F.lit(0).alias("depth"))
    seen = level
    for n in range(1, depth + 1):
        level = level.select(F.col("url").alias("src")).join(best, "src").select("url", F.lit(n).alias("depth")).distinct()
        level = level.join(seen.select("url"), "url", "left_anti")
        seen = seen.unionByName(level)
    return seen


def crawled(links: DataFrame, starts: DataFrame, depth: int = 2, most: int = 5, pages: int = 10) -> DataFrame:
    """crawl, url, depth, place: the pages that each crawl fetches, in order, with one budget over all its levels.

    links: src, url, score (0 and less are no pages); starts: crawl, url. A page's best `most` links, ties by the later url, join the
    queue behind those of pages before it; a url is fetched once, where it stands first. The start and `pages` more are fetched; pages
    at the full depth aren't followed. A crawl's queue holds most ** depth pages at most, so its windows are small however
    many crawls there are.
    """
    ranked = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), F.desc("url")))
    best = links.where("score > 0").withColumn("_k", ranked).where(F.col("_k") <= most).select("src", "url", "_k")
    level = starts.select("crawl", "url", F.array(F.lit(0)).alias("_path"))
    queued = level.withColumn("depth", F.lit(0))
    for n in range(1, depth + 1):
        # a page that stands in the queue before isn't fetched, and so not followed, again
        level = level.select("crawl", F.col("url").alias("src"), "_path").join(best, "src").select("crawl", "url", F.concat("_path", F.array("_k")).alias("_path"))
        level = level.withColumn("_first", F.row_number().over(Window.partitionBy("crawl", "url").orderBy("_path"))).where("_first = 1").drop("_first")
        level = level.join(queued.select("crawl", "url"), ["crawl", "url"], "left_anti")
        queued = queued.unionByName(level.withColumn("depth", F.lit(n)))
    place = F.row_number().over(Window.partitionBy("crawl").orderBy("depth", "_path")) - 1
    return queued.withColumn("place", place).where(F.col("place") <= pages).drop("_path")


def has_value(value: Column) -> Column:
    """Whether a string isn't blank."""
    return F.coalesce(value.rlike(r"(?U)\S"), F.lit(False))


def clean_map(entries: Column) -> Column:
    """A map of strings less its blank entries; null is empty."""
    return F.map_filter(F.coalesce(entries, F.create_map().cast("map<string,string>")), lambda _, v: has_value(v))


def kept_value(value: Column, kind: DataType) -> Column:
    """Whether a value of any type says something: not null, a string that isn't blank, an array or map with entries, a struct with a field that does."""
    if isinstance(kind, StringType):
        return has_value(value)
    if isinstance(kind, (ArrayType, MapType)):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    if isinstance(kind, StructType):
        return reduce(or_, (kept_value(value[f.name], f.dataType) for f in kind), F.lit(False))
    return value.isNotNull()


def cleaned(value: Column, kind: DataType) -> Column:
    """value without what says nothing, at any depth: entries of arrays and maps go, fields of structs become null; null for nothing left.

    The walk is over the type, so a value of any depth is one expression that stays in the JVM; strings keep their blanks outside.
    """
    if isinstance(kind, ArrayType):
        value = F.filter(F.transform(value, lambda x: cleaned(x, kind.elementType)), lambda x: kept_value(x, kind.elementType))
    elif isinstance(kind, MapType):
        value = F.map_filter(F.transform_values(value, lambda _, v: cleaned(v, kind.valueType)), lambda _, v: kept_value(v, kind.valueType))
    elif isinstance(kind, StructType):
        value = F.struct(*(cleaned(value[f.name], f.dataType).alias(f.name) for f in kind))
    return F.when(kept_value(value, kind), value)


def _entries_over(old: Column, new: Column, kind: MapType) -> Column:
    said = F.map_filter(new, lambda _, v: kept_value(v, kind.valueType))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(said, k)), said)


def overridden(base: Column, over: Column, kind: StructType, lists: tuple[str, ...] = ()) -> Column:
    """base with what `over` says: a field that says something replaces the base's, maps and structs field by field; of `lists`, arrays of
    strings, the distinct trimmed ones of both, over's first. A null payload says nothing."""
    fields = []
    for f in kind:
        old, new, t = base[f.name], over[f.name], f.dataType
        if f.name in lists:
            both = F.concat(F.coalesce(new, F.array().cast(t)), F.coalesce(old, F.array().cast(t)))
            listed = F.array_distinct(F.filter(F.transform(both, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: has_value(x)))
            made = F.when(kept_value(new, t), listed).otherwise(old)
        elif isinstance(t, MapType):
            made = F.when(~kept_value(new, t), old).when(old.isNull(), new).otherwise(_entries_over(old, new, t))
        elif isinstance(t, StructType):
            inner = F.struct(*(F.when(kept_value(new[g.name], g.dataType), new[g.name]).otherwise(old[g.name]).alias(g.name) for g in t))
            made = F.when(~kept_value(new, t), old).when(old.isNull(), new).otherwise(inner)
        else:
            made = F.when(kept_value(new, t), new).otherwise(old)
        fields.append(made.alias(f.name))
    return F.struct(*fields)



def cascade(primary: DataFrame, fallback: DataFrame, keys: list[str], scalars: list[str], maps: list[str], lists: list[str], preferred: list[str], notes: list[str]) -> DataFrame:
    """Primary payloads filled from fallback ones.

    Scalars and map entries where missing or blank; lists where empty; `preferred` lists also where the fallback's is longer and
    the own has one item at most, or two and the fallback's two more; notes joined, trimmed, each once.
    """
    p, f = primary.alias("p"), fallback.alias("f")
    met = p.join(f, keys, "left")
    a, b = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"f.{c}"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    filled = [F.coalesce(a(c), b(c)).alias(c) for c in scalars]
    added = lambda m, more: F.map_concat(F.map_filter(more, lambda k, _: ~F.array_contains(F.map_keys(m), k)), m)
    filled += [added(clean_map(a(c)), clean_map(b(c))).alias(c) for c in maps]
    filled += [F.when(a(c).isNull() | (size(a(c)) == 0), F.coalesce(b(c), a(c))).otherwise(a(c)).alias(c) for c in lists]
    longer = lambda c: (size(b(c)) > size(a(c))) & ((size(a(c)) <= 1) | ((size(a(c)) <= 2) & (size(b(c)) >= size(a(c)) + 2)))
    filled += [F.when(longer(c), b(c)).otherwise(a(c)).alias(c) for c in preferred]
    empty = F.array().cast("array<string>")
    both = lambda c: F.transform(F.concat(F.coalesce(a(c), empty), F.coalesce(b(c), empty)), lambda x: F.trim(x))
    filled += [F.array_distinct(F.filter(both(c), lambda x: x != "")).alias(c) for c in notes]
    return met.select(*keys, *filled)


def aligned(source_date: Column, period_end: Column, geographies_only: Column) -> Column:
    """Whether a cached snapshot fits its period: 30 days before to 220 after its end; an annual one of geographies 400 before to 820 after."""
    gap = F.datediff(source_date, period_end)
    return F.coalesce(gap.between(-30, 220) | (geographies_only & gap.between(-400, 820)), F.lit(False))


#: Words of a role's links and their points, and parts of a path and theirs.
ROLE_WORDS = {
    "earnings_release": (("earnings", "financial results", "quarterly results", "results", "press release"), 22, ("news-release-details",), 18),
    "earnings_call": (("webcast", "transcript", "earnings call", "conference call", "prepared remarks", "event"), 24, ("/events/",), 30),
    "earnings_presentation": (("presentation", "slides", "deck", "supplement", "pdf"), 22, ("/presentations", "/quarterly-results"), 12),
    "earnings_commentary": (("commentary", "supplement", "prepared remarks"), 20, (), 0),
}
AGAINST = ("annual report", "proxy", "dividend", "esg", "sustainability", "stock information")
LISTING_WORDS = ("quarterly results", "financial news releases", "news releases", "events and presentations", "events + presentations", "events presentations", "past events", "upcoming events", "earnings", "results", "financial reports", "quarterly", "presentations", "events")
LISTING_AGAINST = ("annual report", "proxy", "tax", "stock information", "governance", "esg", "sec filings archive")
UPCOMING = ("to announce", "will host", "will hold", "scheduled to discuss", "scheduled for", "register here", "register now", "upcoming event")
#: Least scores of links from a site's pages, from sitemaps, and from the pages of a source that is known already.
LEAST_SCORES = {"site": 32, "sitemap": 34, "related": 38}


def _mentioned(tokens: Column) -> tuple[Column, Column]:
    """Years and quarters that the tokens name."""
    years = F.array_distinct(F.regexp_extract_all(tokens, F.lit(r"\b(20\d{2})\b"), F.lit(1)))
    quarters = F.array_compact(F.array(*(F.when(tokens.contains(f"q{n}") | tokens.contains(f"{n}q") | tokens.contains(f"{word} quarter"), n) for n, word in enumerate(ORDINALS, 1))))
    return years, quarters


def link_score(tokens: Column, path: Column, role: str, terms: Column, ticker: Column, name: Column) -> Column:
    """The score of a link for a role. terms: periods.reference_terms of the quarter; ticker and first word of the company's name in lower case.

    The role's words and paths; 9 a calendar and 12 a fiscal term; 14 for a wanted year and less 24 for another; 12 for a wanted
    quarter and less 18 for another; 3 each for ticker and name; less 26 for what isn't about a quarter.
    """
    words, points, paths, more = ROLE_WORDS[role]
    held = lambda array: F.size(F.filter(array, lambda t: tokens.contains(t)))
    years, quarters = _mentioned(tokens)
    score = number_of(tokens, words) * points + (F.when(has_any(path, paths), more).otherwise(0) if paths else 0) + held(terms["calendar"]) * 9 + held(terms["fiscal"]) * 12
    score = score + F.when(F.size(years) == 0, 0).when(F.arrays_overlap(years, terms["years"]), 14).when(F.size(terms["years"]) > 0, -24).otherwise(0)
    score = score + F.when(F.size(quarters) == 0, 0).when(F.arrays_overlap(quarters, terms["quarters"]), 12).otherwise(-18)
    own = lambda word: F.when((word != "") & tokens.contains(word), 3).otherwise(0)
    return score + own(ticker) + own(name) - F.when(has_any(tokens, AGAINST), 26).otherwise(0)


def timely(tokens: Column, terms: Column) -> Column:
    """Whether the tokens name no year or quarter but wanted ones."""
    years, quarters = _mentioned(tokens)
    other = lambda named, wanted: (F.size(named) > 0) & (F.size(wanted) > 0) & ~F.arrays_overlap(named, wanted)
    return ~other(years, terms["years"]) & ~other(quarters, terms["quarters"])


def fits_role(tokens: Column, role: str) -> Column:
    """Whether a link's tokens are those of a role."""
    if role == "earnings_call":
        stale = has_any(tokens, UPCOMING) & ~has_any(tokens, ("transcript", "prepared remarks", "replay", "archive"))
        return ~stale & has_any(tokens, ("webcast", "transcript", "earnings call", "conference call", "prepared remarks", "call replay"))
    if role == "earnings_presentation":
        other = has_any(tokens, ("events and presentations", "past events", "upcoming events", "quarterly results", "how to", "tutorial", "template", "training", "pitch deck"))
        asset, context = ("presentation", "slides", "deck", "supplement", ".pdf", "download"), ("earnings", "financial results", "quarterly results", "fiscal", "q1", "q2", "q3", "q4", "investor")
        return ~other & has_any(tokens, asset) & has_any(tokens, context)
    if role == "earnings_commentary":
        return has_any(tokens, ("commentary", "supplement", "prepared remarks"))
    other = ("to announce", "earnings call", "conference call", "webcast", "transcript", "prepared remarks", "presentation", "slides", "deck", "/events/")
    return ~has_any(tokens, other) & has_any(tokens, ("earnings", "financial results", "quarterly results", "press release", "results"))


def listing_score(tokens: Column) -> Column:
    """How much a page's address and label promise lists of reports: 20 a word, less 20 for other pages, 8 for a path of news or events."""
    return number_of(tokens, LISTING_WORDS) * 20 - F.when(has_any(tokens, LISTING_AGAINST), 20).otherwise(0) + F.when(has_any(tokens, ("/news", "/events", "/financial-information")), 8).otherwise(0)


def best_links(links: DataFrame, source: str = "site") -> DataFrame:
    """For each target and role the timely link that fits with the best score, the first of equals, if it reaches the least score.

    links: target, ordinal, url, text, terms (struct), ticker, name.
    """
    tokens = document_tokens(F.col("url"), F.col("text"))
    rows = links.select("*", F.explode(F.array(tokens)).alias("tokens"))
    path = F.lower(F.regexp_extract("url", r"^[a-z+]+://[^/?#]*([^?#]*)", 1))
    by_role = None
    for role in ROLE_WORDS:
        own = rows.where(fits_role(F.col("tokens"), role) & timely(F.col("tokens"), F.col("terms"))).select("target", F.lit(role).alias("role"), "ordinal", "url", link_score(F.col("tokens"), path, role, F.col("terms"), F.col("ticker"), F.col("name")).alias("score"))
        by_role = own if by_role is None else by_role.unionByName(own)
    return best_by(by_role.where(F.col("score") >= LEAST_SCORES[source]), ["target", "role"], F.desc("score"), F.col("ordinal"))


def best_source(sources: DataFrame, kinds: tuple[str, ...] = (), roles: tuple[str, ...] = ()) -> DataFrame:
    """One source a report: by preferred kind, preferred role, readiness (fetched 2, with an address 1), a label for readers, the later date; the first of equals.

    sources: report, ordinal, kind, role, url, label, date, status.
    """
    place = lambda c, order: F.coalesce(*(F.when(F.col(c) == x, len(order) - n) for n, x in enumerate(order)), F.lit(0)) if order else F.lit(0)
    ready = F.when(F.col("status").isin("fetched", "cached"), 2).when(has_value(F.col("url")), 1).otherwise(0)
    readable = F.when(has_any(F.lower(F.coalesce("label", F.lit(""))), (".htm", ".html", ".txt", ".pdf", "ex99", "8-k")), 0).otherwise(1)
    ranked = sources.withColumns({"kind_rank": place("kind", kinds), "role_rank": place("role", roles), "ready_rank": ready, "label_rank": readable, "_day": F.coalesce(F.datediff(F.try_to_date("date", "yyyy-MM-dd"), F.lit("0001-01-01").cast("date")), F.lit(-1))})
    return best_by(ranked, ["report"], *(F.desc(c) for c in ("kind_rank", "role_rank", "ready_rank", "label_rank", "_day")), F.col("ordinal")).drop("_day")


def document_types(kind: Column, role: Column, label: Column, url: Column) -> Column:
    """Types of a submission's documents, the wanted first, by the source they are read for; fixed values."""
    listed = lambda *x: F.array(*map(F.lit, x))
    foreign = F.lower(label).contains("6-k") | F.lower(url).contains("6-k") | F.lower(url).contains("form6k")
    return (
        F.when((role == "earnings_release") | (kind == "official_release"), listed("EX-99.1", "EX-99", "99.1", "99.01", "EX-13", "8-K", "6-K"))
        .when((role == "earnings_call") | (kind == "call_summary"), listed("EX-99.2", "EX-99", "99.2", "8-K", "6-K"))
        .when((kind == "sec_filing") & foreign, listed("EX-99.1", "99.1", "EX-99.2", "99.2", "EX-99.3", "99.3", "6-K", "20-F", "EX-13", "EX-99"))
        .otherwise(listed("10-Q", "10-K", "6-K", "20-F", "8-K", "EX-13", "EX-99"))
    )


def document_choice(documents: DataFrame) -> DataFrame:
    """The document of each submission: by type, then HTML, then what its name promises less its place. documents: key, seq, type, filename, description, body, types (array)."""
    kind, name = F.upper(F.coalesce("type", F.lit(""))), F.lower(F.coalesce("filename", F.lit("")))
    rank = F.array_position(F.transform("types", lambda t: kind.startswith(t)), F.lit(True))
    other = F.when(kind.startswith("EX-99"), 1).when(kind.isin("XML", "GRAPHIC", "ZIP", "JSON", "EX-101.INS", "EX-101.SCH") | name.rlike(r"\.(xml|xsd|jpg|png|gif|zip|xls|xlsx)$"), -10).otherwise(0)
    page = name.contains("htm") | F.lower(F.coalesce("body", F.lit(""))).contains("<html")
    promise = name.contains("earn") | name.contains("result") | F.lower(F.coalesce("description", F.lit(""))).contains("financial")
    scored = documents.withColumns({"priority": F.when(rank > 0, F.size("types") - rank.cast("int") + 1).otherwise(other), "page": page.cast("int"), "bonus": promise.cast("int") - F.col("seq")})
    # a document must beat (-1, -1, -1)
    beats = (F.col("priority") > -1) | ((F.col("priority") == -1) & (F.col("page") >= 0))
    return best_by(scored.where(beats), ["key"], F.desc("priority"), F.desc("page"), F.desc("bonus"), F.col("seq"))


def transcript_choice(materials: DataFrame, least: int = 400) -> DataFrame:
    """The transcript of each report: fetched material of a call that reads like one, by its label, then its length; the first of equals.

    materials: report, ordinal, status, kind, role, label, text.
    """
    text, label = F.trim("text"), F.coalesce("label", F.lit(""))
    call = F.coalesce((F.col("kind") == "call_summary") | (F.col("role") == "earnings_call"), F.lit(False))
    rows = materials.where(F.col("status").isin("fetched", "cached") & call & (F.length(text) >= least) & transcript_like(text, label))
    named = F.when(F.lower(label).contains("transcript"), 3).when(F.lower(label).contains("prepared remarks"), 2).otherwise(1)
    return best_by(rows.withColumns({"label_score": named, "length": F.length(text)}), ["report"], F.desc("label_score"), F.desc("length"), F.col("ordinal"))


def material_tokens(own: Column, materials: Column) -> Column:
    """Sorted distinct tokens: a report's own, and kind and role of each fetched material with text. materials: array<struct<kind, role, status, text_length, text_path>>."""
    read = F.filter(materials, lambda m: m["status"].isin("fetched", "cached") & ((F.coalesce(m["text_length"], F.lit(0)) > 0) | has_value(m["text_path"])))
    every = F.concat(F.coalesce(own, F.array().cast("array<string>")), F.transform(read, lambda m: m["kind"]), F.transform(read, lambda m: m["role"]))
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, F.trim), has_value)))


#: Tokens of official material.
OFFICIAL_TOKENS = ("official_release", "presentation", "sec_filing", "earnings_release", "earnings_presentation", "earnings_commentary")
SYNTHESIZED = ("Management context", "Guidance context")


def provenance(tokens: Column, transcript: Column, speakers: Column) -> Column:
    """struct<qna, management, quotes, inferred>: where a report's narrative comes from.

    tokens: material_tokens; transcript: the transcript summary's source_type or null; speakers: array of the quotes' speakers.
    """
    call, manual = F.coalesce(transcript == "official_call_material", F.lit(False)), F.coalesce(transcript == "manual_transcript", F.lit(False))
    official = F.arrays_overlap(tokens, F.array(*map(F.lit, OFFICIAL_TOKENS)))
    management = F.when(call, "official_call_material").when(official, "official_material_inferred").otherwise("structured_fallback")
    qna = F.when(manual, "manual_transcript").otherwise(management)
    made = F.forall(speakers, lambda s: F.trim(F.coalesce(s, F.lit(""))).isin(*SYNTHESIZED))
    quotes = F.when(F.coalesce(F.size(speakers), F.lit(0)) == 0, "no_quote_excerpt").when(made, "synthesized_quote").otherwise("official_quote_excerpt")
    return F.struct(qna.alias("qna"), management.alias("management"), quotes.alias("quotes"), (~qna.isin("manual_transcript", "official_call_material")).alias("inferred"))


def themes(*rules: tuple[Column, str, Column], most: int = 4) -> Column:
    """array<struct<label, score>> of the rules (condition, label, score) that hold, a label once, the first `most`."""
    from quartermill.functions.numbers import clamped_score

    every = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(label).alias("label"), clamped_score(s).alias("score"))) for c, label, s in rules)))
    return F.slice(F.filter(every, lambda x, i: (i == 0) | ~F.exists(F.slice(every, F.lit(1), i), lambda y: y["label"] == x["label"])), 1, most)


def reconciled(warnings: Column, obsolete: Column) -> Column:
    """Distinct warnings in order, without those that contain an obsolete phrase."""
    return F.array_distinct(F.filter(warnings, lambda w: (F.trim(w) != "") & ~F.exists(obsolete, lambda o: w.contains(o))))


def needs_enrichment(series: DataFrame, runs: DataFrame, most_missing: int = 2, longest: int = 4) -> DataFrame:
    """company, missing, needed: more than `most_missing` quarters without a core metric, or a value repeated `longest` times. runs: company, longest_run."""
    missing = series.groupBy("company").agg(F.count_if(F.col("revenue").isNull() | F.col("earnings").isNull()).alias("missing"))
    return missing.join(runs, "company", "left").select("company", "missing", ((F.col("missing") > most_missing) | (F.coalesce("longest_run", F.lit(1)) >= longest)).alias("needed"))
