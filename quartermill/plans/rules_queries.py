"""Queries of choices by rule: filings, attachments, links, sources, documents, transcripts, narratives, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartermill.functions import numbers as N
from quartermill.functions import periods as P
from quartermill.functions import text as S
from quartermill.operators import history as H
from quartermill.operators import narrative as W
from quartermill.operators import quality as Q
from quartermill.operators import selection as X
from quartermill.operators import series as R
from quartermill.operators import structure as T
from quartermill.plans import sql
from quartermill.plans.base import OVER, SERIES_SQL, gapped, quarterly, rounded, spread, table
from quartermill.sources import dimensions as D
from quartermill.sources import readers as L

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def chosen(words, at):
    """The word at a place, from 0."""
    return F.get(F.array(*map(F.lit, words)), at.cast("int"))


def listed(*words):
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def subsets(spark, d, rows, schema, key):
    """Each part with those of the rows whose bit its key has; n: the row's place."""
    every = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"n int, {schema}")
    return table(spark, d, "part").select(F.col("p_partkey").alias(key)).join(F.broadcast(every), (F.expr(f"shiftright({key}, n)") % 2) == 1)  # a handful of rows


def subsets_sql(rows, names, key):
    return f"e(n, {names}) AS ({sql.values((n, *r) for n, r in enumerate(rows))}), b AS (SELECT p_partkey AS {key}, e.* FROM part JOIN e ON (p_partkey >> e.n) % 2 = 1)"


# ---- filings ---------------------------------------------------------------------------------------------------------------

FORMS = ("8-K", "10-Q", "6-K", "10-K")
DOCUMENTS = ("ex99-results.htm", "agm.htm", "q1results.pdf", "misc.txt", "pressrelease_2024q3.htm")


@query("filing_choice", f"""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS filed, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_end, {sql.pick(FORMS, 'o_orderkey % 4')} AS form, {sql.pick(DOCUMENTS, '(o_orderkey // 3) % 5')} AS document FROM orders),
f AS (SELECT o_custkey AS company, period_end, filed, form, document, o_orderkey AS ordinal, CASE o_orderkey % 6 WHEN 0 THEN period_end WHEN 1 THEN filed END AS report, o_orderkey % 5 = 0 AS named, {sql.all_tokens('document', "'Quarterly filing'")} AS t FROM o),
s AS (SELECT *, greatest(0, 200 - CASE WHEN form = '10-Q' THEN 30 ELSE 0 END) + greatest(0, 160 - abs(filed - period_end)) + CASE WHEN filed >= period_end THEN 12 ELSE 0 END
 + CASE WHEN report IS NULL THEN 0 ELSE greatest(0, 120 - 2 * abs(report - period_end)) + CASE WHEN report = period_end THEN 80 ELSE 0 END END
 + 35 * {sql.number_of('t', ('results', 'press'))} - CASE WHEN contains(t, 'agm') THEN 240 ELSE 0 END - CASE WHEN {sql.any_of('t', ('results', 'press'))} THEN 0 ELSE 120 END AS score
 FROM f WHERE form IN ('8-K', '10-Q') AND filed - period_end BETWEEN -45 AND 130 AND NOT (company % 2 = 0 AND form = '8-K' AND NOT named)),
r AS (SELECT *, row_number() OVER (PARTITION BY company, period_end ORDER BY score DESC, ordinal) AS k FROM s WHERE score > -1000) SELECT company, period_end, form, ordinal, CAST(score AS INTEGER) AS score FROM r WHERE k = 1""")
def filing_choice(spark, d):
    k, date = F.col("o_orderkey"), F.to_date("o_orderdate")
    start = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    filings = table(spark, d, "orders").select(F.col("o_custkey").alias("company"), start.alias("period_end"), chosen(FORMS, k % 4).alias("form"), date.alias("filed"), F.when(k % 6 == 0, start).when(k % 6 == 1, date).alias("report_date"), F.when(k % 5 == 0, "1.01, 2.02").otherwise("").alias("items"), chosen(DOCUMENTS, F.floor(k / 3) % 5).alias("document"), F.lit("Quarterly filing").alias("description"), k.alias("ordinal"))
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("company"), listed("8-K", "10-Q").alias("forms"), listed("results", "press").alias("hints"), listed("agm").alias("excludes"), (F.col("c_custkey") % 2 == 0).alias("release_mode"))
    return X.best_filing(filings, wanted).select("company", "period_end", "form", "ordinal", F.col("score").cast("int").alias("score"))


ATTACHMENTS = (
    ("directory", 0, "ex99-1_q3results.htm", "Press release", "EX-99.1"), ("directory", 1, "slides.pdf", "deck", "EX-99.2"), ("directory", 2, "img1.jpg", "graphic", "GRAPHIC"), ("directory", 3, "0001234567-24-000123.txt", "full text", ""),
    ("page", 4, "d12345dex991.htm", "EX-99.1", ""), ("page", 5, "https://y.org/presentation_q3.pdf", "Q3 presentation", ""), ("page", 6, "/files/pressreleasequarterlyresul.htm?x=1", "results", ""), ("page", 7, "cfo-commentary.htm", "CFO commentary", ""), ("page", 8, "form6k.htm", "", ""),
)
WRAPPERS = ("https://x.gov/a/form6k.htm", "https://x.gov/a/d8k.htm", "https://x.gov/a/earnings-results.htm", "https://x.gov/a/index.html")
_HINTS, _EXCLUDES = ("press release", "results", "ex99"), ("presentation", "deck")


def _hint_sql(t):
    return f"35 * {sql.number_of(t, _HINTS)} - {sql.points(sql.any_of(t, _EXCLUDES), 80)}"


def _name_points(name):
    return " + ".join(sql.points(sql.any_of(name, words), n) for words, n in X.NAME_POINTS)


@query("attachment_choice", rf"""WITH {subsets_sql(ATTACHMENTS, 'listing, ordinal, href, txt, kind', 'filing')}, w AS (SELECT p_partkey AS filing, {sql.pick(WRAPPERS, 'p_partkey % 4')} AS wrapper_url FROM part),
v AS (SELECT *, {sql.file_name('wrapper_url')} AS cover FROM w), v2 AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(wrapper_url, '([^/]*)/*$', 1), '([0-9])([A-Za-z])', '\1 \2', 'g'), '[-_]+', ' ', 'g') AS slug FROM v), v3 AS (SELECT *, {sql.all_tokens('wrapper_url', 'slug', 'cover')} AS t FROM v2),
p AS (SELECT filing, wrapper_url, cover, {_hint_sql('t')} + {sql.points("regexp_matches(cover, '[.](htm|html|pdf|txt)$')", 8)} + {sql.points("regexp_matches(cover, '(-index[.]html|-index-headers[.]html|index[.]html|index[.]htm|index[.]json)$')", -220)} + {sql.points(sql.any_of('cover', X.NAME_POINTS[0][0]), -120)} AS wrapper FROM v3),
n AS (SELECT *, {sql.file_name('href')} AS name, {sql.all_tokens('href', 'txt', 'kind')} AS t FROM b), x AS (SELECT *, regexp_extract(name, '.([.][^.]*)$', 1) AS suffix FROM n),
s AS (SELECT *, {_hint_sql('t')} + {sql.points(f"suffix IN ({', '.join(map(sql.lit, X.BINARY_SUFFIXES))})", -220)} + {sql.points("suffix IN ('.htm', '.html', '.pdf', '.txt')", 8)} + {sql.points("contains(name, 'form6k')", -18)}
 + {sql.points("name LIKE '%-index.html' OR name LIKE '%-index-headers.html'", -220)} + {sql.points("name IN ('index.html', 'index.htm', 'index.json')", -220)} + {sql.points("regexp_full_match(name, '[0-9]{10}-[0-9]{2}-[0-9]{6}[.]txt')", -220)} + {sql.points("suffix = '.txt' AND NOT contains(name, 'exhibit99') AND NOT contains(name, 'ex99')", -120)}
 + {_name_points('name')} + {sql.points(r"regexp_matches(name, 'd[a-z0-9]+dex99(1|01)\b')", 24)} + {sql.points(r"regexp_matches(name, 'd[a-z0-9]+dex99(2|02)\b')", 18)} AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY filing, listing ORDER BY score DESC, ordinal) AS k FROM s),
j AS (SELECT r.filing, listing, score, txt, wrapper, wrapper_url, cover, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN regexp_extract(wrapper_url, '^(https?://[^/]+)', 1) || href ELSE regexp_extract(wrapper_url, '^(.*/)[^/]*$', 1) || href END AS url FROM r JOIN p USING (filing) WHERE k = 1),
q AS (SELECT *, {sql.file_name('url')} AS uname, regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1), '([0-9])([A-Za-z])', '\1 \2', 'g'), '[-_]+', ' ', 'g') AS uslug FROM j), q2 AS (SELECT *, {sql.all_tokens('url', 'txt', 'uslug')} AS ut FROM q),
z AS (SELECT *, url != wrapper_url AND score >= wrapper AND {sql.any_of('uname', ('pressreleasequarterlyresul', 'financialstatements', 'presentat', 'presq'))} AND {sql.any_of('cover', ('form6k', 'quarterlyfilings'))} AS preferred,
 wrapper >= 35 AND regexp_matches(uname, 'd[a-z0-9]+dex99(1|01|2|02)\b') AND NOT {sql.any_of('ut', X.QUARTER_WORDS)} AS vague FROM q2),
g AS (SELECT *, row_number() OVER (PARTITION BY filing ORDER BY listing) AS k FROM z WHERE CASE WHEN listing = 'directory' THEN preferred OR (score > wrapper + 6 AND url != wrapper_url) ELSE NOT vague AND (preferred OR score > wrapper + 6) END)
SELECT p.filing, coalesce(g.url, p.wrapper_url) AS url, CAST(coalesce(g.score, p.wrapper) AS INTEGER) AS score FROM p LEFT JOIN g ON g.filing = p.filing AND g.k = 1""")
def attachment_choice(spark, d):
    rows = spread(subsets(spark, d, ATTACHMENTS, "listing string, ordinal int, href string, text string, kind string", "filing").drop("n"), "filing")
    wrappers = table(spark, d, "part").select(F.col("p_partkey").alias("filing"), chosen(WRAPPERS, F.col("p_partkey") % 4).alias("wrapper_url"), listed(*_HINTS).alias("hints"), listed(*_EXCLUDES).alias("excludes"))
    return X.attachment_choice(rows, wrappers).withColumn("score", F.col("score").cast("int"))


LINKS = (
    ("https://ir.acme.com/news-release-details/acme-q3-2024-results", "Acme third quarter results"), ("https://ir.acme.com/news/2023-q3-results", "Earnings 2023"), ("https://ir.acme.com/events/q3-2024-earnings-call", "Webcast replay"),
    ("https://ir.acme.com/events/q4", "Acme will host a conference call"), ("https://ir.acme.com/static/q3-2024-presentation.pdf", "Investor presentation"), ("https://ir.acme.com/presentations", "Events and presentations"),
    ("https://ir.acme.com/cfo-commentary", "Prepared remarks September quarter 2024"), ("https://ir.acme.com/annual", "Annual report proxy results"), ("https://ir.acme.com/static/deck.pdf", "ACM slides fiscal 2024 q3 supplement"), ("https://ir.acme.com/pr", "Press release financial results"),
)
_CALENDAR = ("q3", "2024 q3", "q3 2024", "2024q3", "third quarter", "third quarter 2024", "2024 third quarter", "3q 2024", "2024")
_FISCAL = ("q3 fy2024", "fy2024 q3", "fy2024q3", "q3 fiscal year 2024", "fiscal year 2024 q3", "third quarter fiscal year 2024", "fiscal year 2024 third quarter", "fy24 q3", "quarter ended september 30, 2024", "quarter ended september 30 2024", "quarter ended september 2024", "quarter ended sep 30 2024", "ended september 30, 2024", "ended september 30 2024", "september quarter 2024", "sep quarter 2024")


def _fit_sql(role):
    a = lambda *w: sql.any_of("t", w)
    return {
        "earnings_call": f"NOT ({sql.any_of('t', X.UPCOMING)} AND NOT {a('transcript', 'prepared remarks', 'replay', 'archive')}) AND {a('webcast', 'transcript', 'earnings call', 'conference call', 'prepared remarks', 'call replay')}",
        "earnings_presentation": f"NOT {a('events and presentations', 'past events', 'upcoming events', 'quarterly results', 'how to', 'tutorial', 'template', 'training', 'pitch deck')} AND {a('presentation', 'slides', 'deck', 'supplement', '.pdf', 'download')} AND {a('earnings', 'financial results', 'quarterly results', 'fiscal', 'q1', 'q2', 'q3', 'q4', 'investor')}",
        "earnings_commentary": a("commentary", "supplement", "prepared remarks"),
        "earnings_release": f"NOT {a('to announce', 'earnings call', 'conference call', 'webcast', 'transcript', 'prepared remarks', 'presentation', 'slides', 'deck', '/events/')} AND {a('earnings', 'financial results', 'quarterly results', 'press release', 'results')}",
    }[role]


def _link_sql(role):
    words, n, paths, more = X.ROLE_WORDS[role]
    path = f" + {sql.points(sql.any_of('path', paths), more)}" if paths else ""
    return f"SELECT target, '{role}' AS role, ordinal, url, {n} * {sql.number_of('t', words)}{path} + common AS score FROM m WHERE timely AND {_fit_sql(role)}"


_QUARTERS = " || ".join(f"CASE WHEN contains(t, 'q{n}') OR contains(t, '{n}q') OR contains(t, '{w} quarter') THEN [{n}] ELSE [] END" for n, w in enumerate(P.ORDINALS, 1))


@query("link_scores", rf"""WITH {subsets_sql(LINKS, 'url, txt', 'target')}, c AS MATERIALIZED (SELECT target, n AS ordinal, url, {sql.all_tokens('url', 'txt')} AS t, regexp_extract(url, '^[a-z+]+://[^/?#]*([^?#]*)', 1) AS path FROM b),
y AS (SELECT *, list_distinct(regexp_extract_all(t, '\b(20[0-9]{{2}})\b', 1)) AS years, {_QUARTERS} AS quarters FROM c),
m AS MATERIALIZED (SELECT *, 9 * {sql.number_of('t', _CALENDAR)} + 12 * {sql.number_of('t', _FISCAL)} + CASE WHEN len(years) = 0 THEN 0 WHEN list_contains(years, '2024') THEN 14 ELSE -24 END + CASE WHEN len(quarters) = 0 THEN 0 WHEN list_contains(quarters, 3) THEN 12 ELSE -18 END
 + {sql.points("contains(t, 'acm')", 3)} + {sql.points("contains(t, 'acme')", 3)} - {sql.points(sql.any_of('t', X.AGAINST), 26)} AS common, (len(years) = 0 OR list_contains(years, '2024')) AND (len(quarters) = 0 OR list_contains(quarters, 3)) AS timely FROM y),
a AS ({' UNION ALL '.join(map(_link_sql, X.ROLE_WORDS))}), r AS (SELECT *, row_number() OVER (PARTITION BY target, role ORDER BY score DESC, ordinal) AS k FROM a WHERE score >= 34)
SELECT target, role, url, CAST(score AS INTEGER) AS score FROM r WHERE k = 1""")
def link_scores(spark, d):
    terms = P.reference_terms(F.lit(2024 * 4 + 2), F.lit("2024-09-30").cast("date"), F.lit(12))
    rows = subsets(spark, d, LINKS, "url string, text string", "target").select("target", F.col("n").alias("ordinal"), "url", "text", terms.alias("terms"), F.lit("acm").alias("ticker"), F.lit("acme").alias("name"))
    return X.best_links(rows, "sitemap").select("target", "role", "url", F.col("score").cast("int").alias("score"))


@query("listing_pages", f"""WITH t AS (SELECT page_id, {sql.tokens('url')} AS t FROM pages) SELECT page_id, CAST(20 * {sql.number_of('t', X.LISTING_WORDS)} - {sql.points(sql.any_of('t', X.LISTING_AGAINST), 20)} + {sql.points(sql.any_of('t', ('/news', '/events', '/financial-information')), 8)} AS INTEGER) AS score FROM t""")
def listing_pages(spark, d):
    return table(spark, d, "pages").select("page_id", X.listing_score(X.document_tokens(F.col("url"))).cast("int").alias("score"))


_ENDS = "last_day(make_date(CAST(q // 4 AS INTEGER), CAST(q % 4 * 3 + 3 AS INTEGER), 1))"


@query("reference_terms", f"""WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS q, {sql.pick((12, 1, 6, 9), 'o_orderkey % 4')} AS m, o_orderkey % 7 != 6 AS dated FROM orders),
e AS (SELECT *, CASE WHEN dated THEN {_ENDS} END AS ends, q // 4 AS y, q % 4 + 1 AS n FROM o),
f AS (SELECT *, year(ends) + CASE WHEN month(ends) > m THEN 1 ELSE 0 END AS fy, ((month(ends) - (m % 12 + 1) + 12) % 12) // 3 + 1 AS fq, {sql.pick(P.ORDINALS, 'n - 1')} AS w, lower(strftime(ends, '%B')) AS mo, lower(strftime(ends, '%b')) AS ms, day(ends) AS dd, year(ends) AS ye FROM e),
g AS (SELECT *, {sql.pick(P.ORDINALS, 'fq - 1')} AS fw, CASE WHEN dated THEN [ye::VARCHAR, fy::VARCHAR] ELSE CAST([] AS VARCHAR[]) END AS years FROM f)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(CASE WHEN m = 12 THEN ['q' || n, y || ' q' || n, 'q' || n || ' ' || y, y || 'q' || n, w || ' quarter', w || ' quarter ' || y, y || ' ' || w || ' quarter', n || 'q ' || y] ELSE CAST([] AS VARCHAR[]) END || years)), '|') AS calendar,
 array_to_string(list_sort(list_distinct(CASE WHEN dated THEN ['q' || fq || ' fy' || fy, 'fy' || fy || ' q' || fq, 'fy' || fy || 'q' || fq, 'q' || fq || ' fiscal year ' || fy, 'fiscal year ' || fy || ' q' || fq, fw || ' quarter fiscal year ' || fy, 'fiscal year ' || fy || ' ' || fw || ' quarter', 'fy' || right(fy::VARCHAR, 2) || ' q' || fq,
  'quarter ended ' || mo || ' ' || dd || ', ' || fy, 'quarter ended ' || mo || ' ' || dd || ' ' || fy, 'quarter ended ' || mo || ' ' || ye, 'quarter ended ' || ms || ' ' || dd || ' ' || ye, 'ended ' || mo || ' ' || dd || ', ' || ye, 'ended ' || mo || ' ' || dd || ' ' || ye, mo || ' quarter ' || ye, ms || ' quarter ' || ye] ELSE CAST([] AS VARCHAR[]) END)), '|') AS fiscal,
 array_to_string(list_sort(list_distinct(CASE WHEN m = 12 THEN [y::VARCHAR] ELSE CAST([] AS VARCHAR[]) END || years)), '|') AS years, array_to_string(list_sort(list_distinct(CASE WHEN m = 12 THEN [n::INTEGER] ELSE CAST([] AS INTEGER[]) END || CASE WHEN dated THEN [fq::INTEGER] ELSE CAST([] AS INTEGER[]) END)), '|') AS quarters FROM g""")
def reference_terms(spark, d):
    k, index = F.col("o_orderkey"), P.index_of_date(F.to_date("o_orderdate"))
    terms = P.reference_terms(index, F.when(k % 7 != 6, P.end_date(index)), chosen((12, 1, 6, 9), k % 4))
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(terms)).alias("t"))
    return rows.select("o_orderkey", *(F.array_join(F.array_sort(F.col(f"t.{c}").cast("array<string>")), "|").alias(c) for c in ("calendar", "fiscal", "years", "quarters")))


@query("period_labels", r"""WITH o AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS q, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 3 = 0 THEN d WHEN k % 3 = 1 AND k % 2 = 0 THEN d ELSE CAST(last_day(make_date(CAST(q // 4 AS INTEGER), CAST(q % 4 * 3 + 3 AS INTEGER), 1)) AS VARCHAR) END AS period_end, k % 4 IN (0, 2) AS annual, CASE WHEN k % 5 = 0 THEN false WHEN k % 5 = 1 THEN true ELSE q < 1996 * 4 + 1 END AS early,
 CASE WHEN k % 6 = 0 THEN '-' WHEN k % 6 = 1 THEN 'Q' || (q % 4 + 1) || ' FY' || CASE WHEN q // 4 >= 2000 THEN right((q // 4)::VARCHAR, 2) ELSE (q // 4)::VARCHAR END ELSE 'quarter' END AS fiscal,
 CASE WHEN k % 3 = 2 THEN 'Official period' ELSE 'Ending ' || (['Jan.', 'Feb.', 'Mar.', 'Apr.', 'May', 'Jun.', 'Jul.', 'Aug.', 'Sept.', 'Oct.', 'Nov.', 'Dec.'])[CAST(substr(d, 6, 2) AS INTEGER)] || ' ' || left(d, 4) END AS badge FROM o""")
def period_labels(spark, d):
    k, index, date = F.col("o_orderkey"), P.index_of_date(F.to_date("o_orderdate")), F.date_format("o_orderdate", "yyyy-MM-dd")
    year, q = F.floor(index / 4).cast("string"), (index % 4 + 1).cast("string")
    end = P.resolved_end(index, F.when(k % 3 == 0, date).otherwise("soon"), F.when((k % 3 == 1) & (k % 2 == 0), date), F.lit(""))
    label = F.when(k % 5 == 0, "").when(k % 5 == 1, "late").otherwise(P.label(index))
    fiscal = F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(F.lit("FY"), year, F.lit(", Q"), q)).otherwise("quarter")
    badge = F.when(k % 3 == 2, "").otherwise(date)
    return table(spark, d, "orders").select("o_orderkey", end.alias("period_end"), P.is_annual(chosen(("Form 10-K 2024", "10-Q", "Annual Report", "release"), k % 4)).alias("annual"), P.before_cutoff(label, "1996Q2").alias("early"), P.compact_fiscal(fiscal).alias("fiscal"), P.period_badge(badge).alias("badge"))


# ---- sources ---------------------------------------------------------------------------------------------------------------

KINDS = ("official_release", "sec_filing", "call_summary", "presentation", "structured_financials", "investor_relations", "news")
ROLES = ("earnings_release", "sec_filing", "earnings_call", "earnings_commentary", "earnings_presentation", "other")


@query("source_merge", f"""WITH r AS (SELECT o_custkey AS report, {sql.pick(KINDS, 'o_orderkey % 7')} AS kind, {sql.pick(ROLES, '(o_orderkey // 2) % 6')} AS role, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'u' || (o_orderkey // 7) % 5 END AS url, o_orderkey AS ordinal, (o_orderkey // 5) % 2 AS src FROM orders),
n AS (SELECT report, bool_or(kind IN ('official_release', 'sec_filing', 'presentation') AND url != '') AS official, bool_or(kind = 'official_release') AS release, bool_or(kind = 'sec_filing') AS filing FROM r WHERE src = 0 GROUP BY report),
a AS (SELECT r.* FROM r LEFT JOIN n USING (report) WHERE url != '' AND NOT (src = 1 AND ((coalesce(official, false) AND kind = 'investor_relations') OR (coalesce(release, false) AND kind = 'official_release') OR (coalesce(filing, false) AND kind = 'sec_filing')))),
k AS (SELECT *, row_number() OVER (PARTITION BY report, url ORDER BY CASE WHEN list_position({sql.items(X.KIND_ORDER)}, kind) > 0 THEN 6 - list_position({sql.items(X.KIND_ORDER)}, kind) ELSE 0 END DESC, CASE WHEN list_position({sql.items(X.ROLE_ORDER)}, role) > 0 THEN 6 - list_position({sql.items(X.ROLE_ORDER)}, role) ELSE 0 END DESC, src, ordinal) AS k FROM a)
SELECT report, kind, role, url, ordinal FROM k WHERE k = 1""")
def source_merge(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("report"), chosen(KINDS, k % 7).alias("kind"), chosen(ROLES, F.floor(k / 2) % 6).alias("role"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("u"), (F.floor(k / 7) % 5).cast("string"))).alias("url"), k.alias("ordinal"), (F.floor(k / 5) % 2).alias("src"))
    return X.merged_sources(rows.where("src = 1").drop("src"), rows.where("src = 0").drop("src")).select("report", "kind", "role", "url", "ordinal")


@query("best_source", f"""WITH r AS (SELECT o_custkey AS report, {sql.pick(KINDS, 'o_orderkey % 7')} AS kind, {sql.pick(ROLES, '(o_orderkey // 2) % 6')} AS role, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'u' END AS url, {sql.pick(('Release', 'ex99-1.htm', '8-K wrapper', 'Deck'), 'o_orderkey % 4')} AS label, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d, {sql.pick(('fetched', 'cached', 'error'), 'o_orderkey % 3')} AS status, o_orderkey AS ordinal FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY CASE kind WHEN 'presentation' THEN 2 WHEN 'sec_filing' THEN 1 ELSE 0 END DESC, CASE role WHEN 'earnings_call' THEN 1 ELSE 0 END DESC, CASE WHEN status IN ('fetched', 'cached') THEN 2 WHEN url != '' THEN 1 ELSE 0 END DESC, CASE WHEN label IN ('ex99-1.htm', '8-K wrapper') THEN 0 ELSE 1 END DESC, CASE WHEN d = 'n/a' THEN '' ELSE d END DESC, ordinal) AS k FROM r)
SELECT report, ordinal, kind, role FROM k WHERE k = 1""")
def best_source(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("report"), k.alias("ordinal"), chosen(KINDS, k % 7).alias("kind"), chosen(ROLES, F.floor(k / 2) % 6).alias("role"), F.when(k % 3 == 0, "").otherwise("u").alias("url"), chosen(("Release", "ex99-1.htm", "8-K wrapper", "Deck"), k % 4).alias("label"), F.when(k % 5 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), chosen(("fetched", "cached", "error"), k % 3).alias("status"))
    return X.best_source(rows, ("presentation", "sec_filing"), ("earnings_call",)).select("report", "ordinal", "kind", "role")


PAPERS = (("10-Q", "main10q.htm", "Quarterly report", "text"), ("EX-99.1", "exhibit.txt", "Press", "<HTML>x"), ("EX-99.2", "earnings.htm", "", "t"), ("GRAPHIC", "a.jpg", "", ""), ("8-K", "cover.htm", "financial statements", ""), ("EX-101.INS", "x.xml", "", ""), ("EX-10", "results.txt", "", "<html>"), ("6-K", "six.htm", "", ""))
_READ_FOR = (("official_release", ""), ("call_summary", ""), ("sec_filing", "6-K filing"), ("sec_filing", "10-Q"))
_TYPES = (("EX-99.1", "EX-99", "99.1", "99.01", "EX-13", "8-K", "6-K"), ("EX-99.2", "EX-99", "99.2", "8-K", "6-K"), ("EX-99.1", "99.1", "EX-99.2", "99.2", "EX-99.3", "99.3", "6-K", "20-F", "EX-13", "EX-99"), ("10-Q", "10-K", "6-K", "20-F", "8-K", "EX-13", "EX-99"))


@query("document_choice", rf"""WITH {subsets_sql(PAPERS, 'kind, filename, description, body', 'key')}, t AS (SELECT *, CASE key % 4 WHEN 0 THEN {sql.items(_TYPES[0])} WHEN 1 THEN {sql.items(_TYPES[1])} WHEN 2 THEN {sql.items(_TYPES[2])} ELSE {sql.items(_TYPES[3])} END AS types FROM b),
p AS (SELECT *, list_position(list_transform(types, lambda y: starts_with(upper(kind), y)), true) AS pos FROM t),
s AS (SELECT *, CASE WHEN pos > 0 THEN len(types) - pos + 1 WHEN starts_with(kind, 'EX-99') THEN 1 WHEN kind IN ('XML', 'GRAPHIC', 'ZIP', 'JSON', 'EX-101.INS', 'EX-101.SCH') OR regexp_matches(filename, '[.](xml|xsd|jpg|png|gif|zip|xls|xlsx)$') THEN -10 ELSE 0 END AS priority,
 CASE WHEN contains(filename, 'htm') OR contains(lower(body), '<html') THEN 1 ELSE 0 END AS page, CASE WHEN contains(filename, 'earn') OR contains(filename, 'result') OR contains(lower(description), 'financial') THEN 1 ELSE 0 END - n AS bonus FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority DESC, page DESC, bonus DESC, n) AS k FROM s WHERE priority > -1) SELECT key, kind AS type, filename FROM k WHERE k = 1""")
def document_choice(spark, d):
    rows = subsets(spark, d, PAPERS, "type string, filename string, description string, body string", "key").withColumnRenamed("n", "seq")
    k = F.col("key") % 4
    types = X.document_types(chosen([x for x, _ in _READ_FOR], k), F.lit(""), chosen([x for _, x in _READ_FOR], k), F.lit("https://x"))
    return X.document_choice(rows.withColumn("types", types)).select("key", "type", "filename")


@query("transcript_choice", rf"""WITH c AS (SELECT conv_id AS report, turn AS ordinal, {sql.pick(('fetched', 'cached', 'error'), 'turn % 3')} AS status, CASE WHEN turn % 2 = 0 THEN 'call_summary' ELSE 'news' END AS kind, CASE WHEN turn % 5 = 1 THEN 'earnings_call' ELSE '' END AS role, {sql.pick(('Q3 transcript', 'Prepared remarks', 'Call', ''), '(conv_id + turn) % 4')} AS label,
  trim(repeat(text || ' ', 6) || CASE WHEN turn % 4 = 0 THEN 'Operator: question-and-answer' ELSE '' END) AS t FROM conversations),
f AS (SELECT *, length(t) AS n, CASE WHEN contains(lower(label), 'transcript') THEN 3 WHEN contains(lower(label), 'prepared remarks') THEN 2 ELSE 1 END AS s FROM c WHERE status IN ('fetched', 'cached') AND (kind = 'call_summary' OR role = 'earnings_call') AND length(t) >= 400
  AND ({sql.any_of('lower(label)', ('transcript', 'prepared remarks'))} OR {sql.number_of('lower(t)', S.CALL_WORDS)} >= 2 OR len(regexp_extract_all(t, {sql.lit(S.SPEAKERS)})) >= 4)),
k AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY s DESC, n DESC, ordinal) AS k FROM f) SELECT report, CAST(ordinal AS INTEGER) AS ordinal, CAST(n AS INTEGER) AS length FROM k WHERE k = 1""")
def transcript_choice(spark, d):
    t = F.col("turn")
    text = F.concat(F.repeat(F.concat("text", F.lit(" ")), 6), F.when(t % 4 == 0, "Operator: question-and-answer").otherwise(""))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("report"), t.cast("int").alias("ordinal"), chosen(("fetched", "cached", "error"), t % 3).alias("status"), F.when(t % 2 == 0, "call_summary").otherwise("news").alias("kind"), F.when(t % 5 == 1, "earnings_call").otherwise("").alias("role"), chosen(("Q3 transcript", "Prepared remarks", "Call", ""), (F.col("conv_id") + t) % 4).alias("label"), text.alias("text"))
    return X.transcript_choice(rows).select("report", "ordinal", F.col("length").cast("int").alias("length"))


def _materials(k):
    """Up to three materials of a key."""
    one = lambda n: F.struct(chosen(KINDS, (k + n) % 7).alias("kind"), chosen(ROLES, (k + 2 * n) % 6).alias("role"), chosen(("fetched", "cached", "error"), (k + n) % 3).alias("status"), ((k + n) % 2 * 900).cast("int").alias("text_length"), F.when((k + n) % 5 == 0, "/t").otherwise("").alias("text_path"))
    return F.slice(F.array(one(0), one(1), one(2)), F.lit(1), (k % 4).cast("int"))


_MATERIALS = f"""m AS (SELECT p_partkey AS k, n, {sql.pick(KINDS, '(p_partkey + n) % 7')} AS kind, {sql.pick(ROLES, '(p_partkey + 2 * n) % 6')} AS role, {sql.pick(('fetched', 'cached', 'error'), '(p_partkey + n) % 3')} AS status, (p_partkey + n) % 2 * 900 AS text_length, (p_partkey + n) % 5 = 0 AS path FROM part, (VALUES (0), (1), (2)) AS s(n) WHERE n < p_partkey % 4),
own AS (SELECT p_partkey AS k, {sql.pick(('earnings_release', ' ', 'call_summary', 'presentation'), 'p_partkey % 4')} AS tok FROM part),
tokens AS (SELECT k, list_sort(list_distinct(list(tok))) AS tokens FROM (SELECT k, trim(tok) AS tok FROM own UNION ALL SELECT k, unnest([kind, role]) FROM m WHERE status IN ('fetched', 'cached') AND (text_length > 0 OR path)) WHERE tok != '' GROUP BY k),
every AS (SELECT own.k, coalesce(tokens, CAST([] AS VARCHAR[])) AS tokens FROM own LEFT JOIN tokens USING (k))"""


@query("material_token_sets", f"WITH {_MATERIALS} SELECT k AS p_partkey, array_to_string(tokens, ',') AS tokens FROM every")
def material_token_sets(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.array_join(X.material_tokens(F.array(chosen(("earnings_release", " ", "call_summary", "presentation"), k % 4)), _materials(k)), ",").alias("tokens"))


@query("provenance_state", f"""WITH {_MATERIALS}, s AS (SELECT *, {sql.pick(('manual_transcript', 'official_call_material', None, None, None), 'k % 5')} AS source, k % 3 AS quoted, len(list_intersect(tokens, {sql.items(X.OFFICIAL_TOKENS)})) > 0 AS official FROM every),
n AS (SELECT *, CASE WHEN source = 'official_call_material' THEN source WHEN official THEN 'official_material_inferred' ELSE 'structured_fallback' END AS management FROM s)
SELECT k AS p_partkey, CASE WHEN source = 'manual_transcript' THEN source ELSE management END AS qna, management, CASE quoted WHEN 0 THEN 'no_quote_excerpt' WHEN 1 THEN 'synthesized_quote' ELSE 'official_quote_excerpt' END AS quotes, CASE WHEN source = 'manual_transcript' THEN source ELSE management END NOT IN ('manual_transcript', 'official_call_material') AS inferred FROM n""")
def provenance_state(spark, d):
    k = F.col("p_partkey")
    tokens = X.material_tokens(F.array(chosen(("earnings_release", " ", "call_summary", "presentation"), k % 4)), _materials(k))
    speakers = F.when(k % 3 == 0, listed()).when(k % 3 == 1, listed("Management context", " Guidance context ")).otherwise(listed("Guidance context", "Jane Roe"))
    rows = table(spark, d, "part").select("p_partkey", F.explode(F.array(X.provenance(tokens, chosen(("manual_transcript", "official_call_material", None, None, None), k % 5), speakers))).alias("p"))
    return rows.select("p_partkey", "p.*")


@query("material_scores", f"""WITH {_MATERIALS}, a AS (SELECT own.k, tok, count(n) AS n, count(CASE WHEN status IN ('fetched', 'cached') AND text_length > 0 THEN 1 END) AS read, coalesce(bool_or(status IN ('fetched', 'cached') AND kind = 'official_release'), false) AS release, coalesce(bool_or(status IN ('fetched', 'cached') AND kind = 'presentation'), false) AS pres FROM own LEFT JOIN m USING (k) GROUP BY own.k, tok)
SELECT k AS p_partkey, CASE WHEN release OR tok = 'earnings_release' THEN 100 ELSE 32 END AS release, CASE WHEN pres OR tok = 'presentation' THEN 92 ELSE 36 END AS presentation, CASE WHEN k % 6 = 0 THEN 100 WHEN tok = 'call_summary' THEN 42 ELSE 18 END AS call, CASE WHEN n = 0 THEN 18 WHEN read = 0 THEN 26 WHEN read = n THEN 100 ELSE 74 END AS extraction,
 CASE WHEN k % 100 >= 82 THEN '高' WHEN k % 100 >= 64 THEN '中' ELSE '低' END AS tone, CASE WHEN k % 100 >= 88 THEN '覆盖完整' WHEN k % 100 >= 60 THEN '部分覆盖' ELSE '待补强' END AS state FROM a""")
def material_scores(spark, d):
    k = F.col("p_partkey")
    scores = Q.material_scores(F.array(chosen(("earnings_release", " ", "call_summary", "presentation"), k % 4)), _materials(k), k % 6 == 0)
    rows = table(spark, d, "part").select("p_partkey", F.explode(F.array(scores)).alias("s"))
    return rows.select("p_partkey", "s.*", N.tone(k % 100).alias("tone"), N.coverage_state(k % 100).alias("state"))


@query("payload_cascade", """WITH p AS (SELECT *, p_partkey % 4 AS a, (p_partkey // 4) % 5 AS b FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 != 0 THEN p_size ELSE p_size * 2 END AS size, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'f' || p_type END AS first, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'g' || p_brand END AS second, CASE WHEN a = 0 THEN b ELSE a END AS n_list,
 CASE WHEN b > a AND (a <= 1 OR (a <= 2 AND b >= a + 2)) THEN b ELSE a END AS n_preferred, CASE WHEN p_partkey % 5 = 0 THEN 'n' ELSE 'n|o' END AS notes FROM p""")
def payload_cascade(spark, d):
    k = F.col("p_partkey")
    some = lambda letter, n: F.transform(F.slice(F.array(*(F.lit(f"{letter}{i}") for i in range(5))), F.lit(1), n.cast("int")), lambda x: x)
    part = table(spark, d, "part")
    a, b = k % 4, F.floor(k / 4) % 5
    primary = part.select("p_partkey", F.when(k % 3 != 0, F.col("p_size")).alias("size"), F.create_map(F.lit("a"), F.when(k % 2 == 0, F.col("p_type")).otherwise(" ")).alias("m"), some("x", a).alias("l"), some("x", a).alias("q"), F.array(F.lit(" n "), F.lit("")).alias("notes"))
    fallback = part.select("p_partkey", (F.col("p_size") * 2).alias("size"), F.create_map(F.lit("a"), F.concat(F.lit("f"), "p_type"), F.lit("b"), F.when(k % 7 != 0, F.concat(F.lit("g"), "p_brand"))).alias("m"), some("y", b).alias("l"), some("y", b).alias("q"), F.array(F.when(k % 5 == 0, "n").otherwise("o")).alias("notes"))
    out = X.cascade(primary, fallback, ["p_partkey"], ["size"], ["m"], ["l"], ["q"], ["notes"])
    return out.select("p_partkey", "size", F.element_at("m", "a").alias("first"), F.try_element_at("m", F.lit("b")).alias("second"), F.size("l").alias("n_list"), F.size("q").alias("n_preferred"), F.array_join("notes", "|").alias("notes"))


# ---- views -----------------------------------------------------------------------------------------------------------------

VIEWS = ("Goldman upgrades to buy, raises price target to $120.5", "UBS cuts target to $80, keeps neutral", "Morgan Stanley downgrades; sell", "Analysts at JP Morgan maintain overweight on cloud and AI", "Barclays: price target $99 ahead of guidance", "No view on margin", "HSBC hold, pessimistic forecast for capex", "Wedbush bullish on earnings", "Citi lowers outlook; market perform")
_VIEW_ACTION = ("upgrade", "target cut", "downgrade", "keep", "target", "mention", "cautious", "positive", "mention")


def _stance_sql(t):
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, {sql.lit(p)}) THEN '{name}'" for name, p in S.STANCES) + " ELSE 'reference' END"


_FIRM_SQL = "CASE " + " ".join(f"WHEN {sql.any_of('low', a)} THEN {sql.lit(n)}" for n, a in S.INSTITUTIONS.items()) + " END"
_THEME_SQL = " UNION ALL ".join(f"SELECT k, {n} AS o, '{name}' AS theme FROM v WHERE {sql.any_of('low', w)}" for n, (name, w) in enumerate(S.VIEW_THEMES.items()))
_VIEW = f"v AS (SELECT p_partkey AS k, p_brand, {sql.pick(VIEWS, 'p_partkey % 9')} || CASE WHEN p_partkey % 11 = 0 THEN ' ' || p_name ELSE '' END AS t, lower({sql.pick(VIEWS, 'p_partkey % 9')} || CASE WHEN p_partkey % 11 = 0 THEN ' ' || p_name ELSE '' END) AS low FROM part)"


def _view():
    return F.concat(chosen(VIEWS, F.col("p_partkey") % 9), F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit(" "), "p_name")).otherwise(""))


@query("institution_views", f"""WITH {_VIEW} SELECT k AS p_partkey, {_FIRM_SQL} AS firm, {_stance_sql('t')} AS stance, TRY_CAST(regexp_extract(t, '\\$([0-9]+([.][0-9]+)?)', 1) AS DOUBLE) AS target, {sql.pick(_VIEW_ACTION, 'k % 9')} AS action,
 array_to_string({' || '.join(f"CASE WHEN contains(low, '{r}') THEN ['{r.title()}'] ELSE [] END" for r in S.RATINGS)}, '/') AS ratings FROM v""")
def institution_views(spark, d):
    t = _view()
    return table(spark, d, "part").select("p_partkey", S.institution(t).alias("firm"), S.stance(t).alias("stance"), S.price_target(t).alias("target"), S.action(t).alias("action"), F.array_join(S.ratings(t), "/").alias("ratings"))


@query("view_digest", f"""WITH {_VIEW}, h AS ({_THEME_SQL}), n AS (SELECT p_brand, theme, count(*) AS n, min(v.k * 10 + o) AS seen FROM h JOIN v USING (k) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, seen) AS rank FROM n),
s AS (SELECT p_brand, count(*) AS views, count(CASE WHEN {_stance_sql('t')} = 'positive' THEN 1 END) AS positive, count(CASE WHEN {_stance_sql('t')} = 'negative' THEN 1 END) AS negative FROM v GROUP BY p_brand)
SELECT s.p_brand, views, positive, negative, coalesce(string_agg(theme, ',' ORDER BY rank), '') AS themes FROM s LEFT JOIN r ON r.p_brand = s.p_brand AND rank <= 2 GROUP BY ALL""")
def view_digest(spark, d):
    """Stances of each brand's views and the two themes most of them touch, the first seen first among equals."""
    v = table(spark, d, "part").select("p_partkey", "p_brand", F.explode(F.array(_view())).alias("t"))
    stances = v.groupBy("p_brand").agg(F.count("*").alias("views"), F.count_if(S.stance(F.col("t")) == "positive").alias("positive"), F.count_if(S.stance(F.col("t")) == "negative").alias("negative"))
    order = F.create_map(*(x for n, name in enumerate(S.VIEW_THEMES) for x in (F.lit(name), F.lit(n))))
    seen = v.select("p_brand", "p_partkey", F.explode(S.view_themes(F.col("t"))).alias("code"))
    top = Q.issue_counts(seen.select(F.col("p_brand").alias("company"), "code", (F.col("p_partkey") * 10 + F.element_at(order, F.col("code"))).alias("seq")), 2)
    themes = top.groupBy(F.col("company").alias("p_brand")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]), ",").alias("themes"))
    return stances.join(themes, "p_brand", "left").select("p_brand", "views", "positive", "negative", F.coalesce("themes", F.lit("")).alias("themes"))


# ---- structures ------------------------------------------------------------------------------------------------------------

NAMES = ("Europe", "Japan", "Cloud", "Devices", "International", "Rest of World")


@query("incomplete_structures", f"""WITH n AS (SELECT p_partkey AS k, {sql.items(NAMES)}[p_partkey % 6 + 1 : p_partkey % 6 + (p_partkey // 6) % 4] AS names, (p_partkey // 24) % 7 AS n FROM part)
SELECT k AS p_partkey, len(names) > 0 AND (len(names) < CASE WHEN n >= 5 THEN 3 WHEN n >= 3 THEN 2 ELSE 1 END OR (n >= 3 AND len(list_filter(names, lambda x: x IN ('Cloud', 'Devices'))) = 0)) AS incomplete FROM n""")
def incomplete_structures(spark, d):
    k = F.col("p_partkey")
    names = F.slice(listed(*NAMES), (k % 6 + 1).cast("int"), (F.floor(k / 6) % 4).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.incomplete(names, F.floor(k / 24) % 7).alias("incomplete"))


PLACES = (("United States", 1.0, 350.0), ("International", 99.0, None), ("Canada", 0.5, 300.0), ("China", 30.0, 5.0), ("Europe", 40.0, -2.0), ("Brazil", 0.0, 1.0), ("Other countries", 3.0, -400.0), ("North America", 150.0, 2.0))
_PLACE_COLUMNS = "name, value, yoy"


def _detail_sql(names):
    return f"CASE WHEN len({names}) = 0 THEN -100 ELSE 10 * len({names}) - CASE WHEN {' OR '.join(f'list_sort({names}) = list_sort({sql.items(a)})' for a in T.AMBIGUOUS)} THEN 12 ELSE 0 END - 2 * len(list_filter({names}, lambda x: {sql.any_of('x', T.COARSE)})) + len(list_filter({names}, lambda x: x NOT IN ({', '.join(map(sql.lit, T.PLAIN))}))) END"


def _suspicious_sql(n, s, whole, revenue):
    return f"CASE WHEN {n} = 0 THEN false WHEN {whole} <= 0 THEN true ELSE (len(list_filter({s}, lambda x: x.share >= 0.95)) > 0 AND len(list_filter({s}, lambda x: x.share <= 0.02)) > 0 AND len(list_filter({s}, lambda x: x.share <= 0.01 AND x.move >= 300)) > 0) OR (len(list_filter({s}, lambda x: x.name IN ({', '.join(map(sql.lit, T.BESIDE_HOME))}))) > 0 AND len(list_filter({s}, lambda x: x.name = 'united states' AND x.share < 0.02)) > 0) OR {whole} / {revenue} < 0.08 END"


_PLACES = f"""{subsets_sql(PLACES, _PLACE_COLUMNS, 'k')}, g AS (SELECT part.p_partkey AS k, coalesce(list(lower(name) ORDER BY n) FILTER (name IS NOT NULL), []) AS names, coalesce(sum(value), 0) AS whole FROM part LEFT JOIN b ON b.k = p_partkey GROUP BY p_partkey),
h AS (SELECT g.*, coalesce((SELECT list({{'name': lower(b.name), 'share': b.value / nullif(g.whole, 0), 'move': abs(coalesce(b.yoy, 0))}}) FROM b WHERE b.k = g.k), []) AS shares FROM g),
f AS (SELECT *, {_detail_sql('names')} AS detail, {_suspicious_sql('len(names)', 'shares', 'whole', '100.0')} AS suspicious FROM h)"""


def _places(spark, d):
    rows = subsets(spark, d, PLACES, "name string, value double, yoy double", "k")
    packed = rows.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name", "value", "yoy"))), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["yoy"].alias("yoy"))).alias("g"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).join(packed, "k", "left").withColumn("g", F.coalesce("g", F.array().cast("array<struct<name:string,value:double,yoy:double>>")))


@query("geography_checks", f"WITH {_PLACES} SELECT k, CAST(detail AS INTEGER) AS detail, suspicious FROM f")
def geography_checks(spark, d):
    return _places(spark, d).select("k", T.geography_detail(F.col("g")).cast("int").alias("detail"), T.suspicious_geographies(F.col("g"), F.lit(100.0)).alias("suspicious"))


@query("richer_geographies", f"""WITH {_PLACES}, c AS (SELECT a.k, len(a.names) AS n, len(b.names) AS m, a.detail AS x, b.detail AS y, a.suspicious AS s, b.suspicious AS t, a.names AS old, b.names AS new FROM f a JOIN f b ON b.k = a.k % 251 + 1)
SELECT k, array_to_string(CASE WHEN m = 0 OR t THEN old WHEN n = 0 OR s THEN new WHEN (m >= 3 AND n <= 2) OR (m >= n + 2 AND y > x) OR y >= x + 8 THEN new ELSE old END, '|') AS names FROM c""")
def richer_geographies(spark, d):
    own = _places(spark, d)
    other = own.select((F.col("k")).alias("_k"), F.col("g").alias("found"))
    met = own.join(other, F.col("k") % 251 + 1 == F.col("_k"))
    return met.select("k", F.array_join(F.transform(T.richer_geographies(F.col("g"), F.col("found"), F.lit(100.0)), lambda x: F.lower(x["name"])), "|").alias("names"))


# ---- history ---------------------------------------------------------------------------------------------------------------


@query("revenue_gates", """WITH p AS (SELECT p_partkey AS k, p_retailprice AS e, p_retailprice * (0.2 + p_partkey % 30 * 0.1) AS f, p_retailprice * (p_partkey // 30 % 7) * 0.151 AS profit FROM part),
c AS (SELECT *, CASE WHEN k % 13 = 0 THEN e WHEN k % 17 = 0 THEN f WHEN f / e BETWEEN 0.45 AND 2.25 THEN f ELSE e END AS own FROM p)
SELECT k AS p_partkey, round(own, 6) AS accepted, round(CASE WHEN k % 17 != 0 AND profit != 0 AND own != e AND profit / own >= 0.75 AND profit / e <= 0.65 AND e >= own * 1.35 THEN e ELSE own END, 6) AS revenue FROM c""")
def revenue_gates(spark, d):
    k, e = F.col("p_partkey"), F.col("p_retailprice")
    existing, found = F.when(k % 17 != 0, e), F.when(k % 13 != 0, e * (0.2 + k % 30 * 0.1))
    existing = F.when((k % 13 == 0) | (k % 17 != 0), e)
    profit = e * (F.floor(k / 30) % 7) * 0.151
    return rounded(table(spark, d, "part").select("p_partkey", N.candidate(existing, found).alias("accepted"), N.revenue_candidate(existing, found, profit).alias("revenue")), "accepted", "revenue", digits=6)


def _history(spark, d):
    """A nation's quarters as history: figures missing in a fifth of them, segments in a third, geographies in a half."""
    s = gapped(quarterly(spark, d)).withColumns({"revenue": F.col("revenue") / 1e6, "earnings": F.col("earnings") / 1e6, "equity": F.when(F.col("quarter_index") % 4 != 0, F.col("equity") / 1e6)})
    k = F.col("company") + F.col("quarter_index")
    item = lambda name, v: F.struct(F.lit(name).alias("name"), v.alias("value"))
    base = F.coalesce("revenue", F.lit(1.0))
    segments = F.when(k % 3 == 0, F.array(item("A", base * 0.6), item("B", base * 0.4))).when(k % 3 == 1, F.array(item("A", base * 0.5))).otherwise(F.array().cast(H.ITEMS))
    none = F.lit(None).cast("double")
    return s.select("company", "quarter_index", "revenue", "earnings", "equity", none.alias("gross_margin"), none.alias("net_margin"), none.alias("revenue_yoy"), none.alias("earnings_yoy"), segments.cast(H.ITEMS).alias("segments"), F.when(k % 2 == 0, F.array(item("Europe", base * 0.5), item("Asia", base * 0.5))).otherwise(F.array().cast(H.ITEMS)).cast(H.ITEMS).alias("geographies"), F.lit("none").alias("basis"), F.lit("structured").alias("source_type"), F.lit("").alias("source_url"), F.lit("").alias("release_date"))


_HISTORY_SQL = SERIES_SQL + """, h AS (SELECT company, quarter_index, company + quarter_index AS k, revenue / 1e6 AS revenue, earnings / 1e6 AS earnings, CASE WHEN quarter_index % 4 != 0 THEN equity / 1e6 END AS equity, coalesce(revenue / 1e6, 1.0) AS base FROM gapped)"""


@query("enriched_history", _HISTORY_SQL + """, t AS (SELECT h.*, s.revenue / 1e6 AS whole FROM h JOIN series s USING (company, quarter_index)),
f AS (SELECT *, whole * (['0.5', '1.1', '3', '0.46'])[k % 4 + 1]::DOUBLE AS fr, whole * 0.05 * (CASE WHEN k % 5 = 0 THEN 40 ELSE 1 END) AS fe, CASE WHEN k % 7 = 0 THEN -1 ELSE whole END AS fq, CASE WHEN k % 9 = 0 THEN 120 ELSE 40 END::DOUBLE AS fm, k % 6 != 5 AS has FROM t),
l AS (SELECT *, has AND (k % 3 = 2 OR k % 2 = 1 OR (company % 2 = 0)) AS looked FROM f),
e AS (SELECT *, CASE WHEN NOT looked THEN earnings WHEN k % 10 = 0 THEN fe WHEN earnings IS NULL OR earnings = 0 THEN fe WHEN fe / earnings BETWEEN 0.25 AND 2.8 THEN fe ELSE earnings END AS ne FROM l),
c AS (SELECT *, CASE WHEN revenue IS NULL THEN fr WHEN fr / revenue BETWEEN 0.45 AND 2.25 THEN fr ELSE revenue END AS c FROM e),
r AS (SELECT *, CASE WHEN NOT looked THEN revenue WHEN revenue IS NOT NULL AND ne != 0 AND c != revenue AND abs(ne) / c >= 0.75 AND abs(ne) / revenue <= 0.65 AND revenue >= c * 1.35 THEN revenue ELSE c END AS nr FROM c),
q AS (SELECT *, CASE WHEN k % 3 = 0 THEN 2 WHEN k % 3 = 1 THEN 1 ELSE 0 END AS hc, CASE WHEN k % 3 = 0 THEN base WHEN k % 3 = 1 THEN base * 0.5 ELSE 0 END / nr AS hv, CASE WHEN k % 8 = 0 THEN 0 WHEN k % 8 < 3 THEN 1 ELSE 2 END AS gc, CASE WHEN k % 8 = 0 THEN 0 WHEN k % 8 < 3 THEN fr * 0.7 ELSE fr END / nr AS gv FROM r),
v AS (SELECT *, hc > 0 AND hv BETWEEN 0.45 AND 1.45 AS hr, gc > 0 AND gv BETWEEN 0.45 AND 1.45 AS gr FROM q), w AS (SELECT *, hr AND hc = 2 AS hw, gr AND gc = 2 AS gw FROM v),
d AS (SELECT *, CASE WHEN gc = 0 THEN false WHEN hc = 0 THEN true WHEN hw != gw THEN gw WHEN gw THEN gc >= hc AND gv >= hv - 0.03 ELSE gc > hc OR gv > hv + 0.08 OR NOT hr END AS p, CASE WHEN gc = 0 THEN false WHEN hc = 0 THEN true WHEN hw != gw THEN gw WHEN gw THEN gc >= hc AND gv >= hv - 0.03 ELSE false END AS s FROM w)
SELECT company, quarter_index, round(nr, 6) AS revenue, round(ne, 6) AS earnings, round(CASE WHEN looked AND fq > 0 THEN fq ELSE equity END, 6) AS equity, CASE WHEN looked AND fm <= 95 THEN fm END AS gross_margin,
 CASE WHEN looked AND gw AND s THEN 'segment' WHEN looked AND gc >= 2 AND gr AND p THEN 'segment_partial' WHEN looked AND k % 4 = 1 AND NOT hw THEN 'geography' ELSE 'none' END AS basis,
 CASE WHEN looked AND gw AND s THEN gc WHEN looked AND gc >= 2 AND gr AND p THEN gc WHEN looked AND k % 4 = 1 AND NOT hw THEN 0 ELSE hc END AS n_segments, CASE WHEN looked AND k % 11 != 0 THEN 'official_release' ELSE 'structured' END AS source_type, CASE WHEN looked THEN '2024-05-01' ELSE '' END AS release_date FROM d""")
def enriched_history(spark, d):
    """The whole flow: what was parsed passes the gates, and its structures replace the known ones or not."""
    history = _history(spark, d)
    whole = quarterly(spark, d).select("company", "quarter_index", (F.col("revenue") / 1e6).alias("whole"))
    k = F.col("company") + F.col("quarter_index")
    item = lambda name, v: F.struct(F.lit(name).alias("name"), v.alias("value"))
    fr = F.col("whole") * chosen((0.5, 1.1, 3.0, 0.46), k % 4)
    segments = F.when(k % 8 == 0, F.array().cast(H.ITEMS)).when(k % 8 < 3, F.array(item("A", fr * 0.7)).cast(H.ITEMS)).otherwise(F.array(item("A", fr * 0.5), item("B", fr * 0.5)).cast(H.ITEMS))
    found = whole.where(k % 6 != 5).select("company", "quarter_index", fr.alias("revenue"), (F.col("whole") * 0.05 * F.when(k % 5 == 0, 40).otherwise(1)).alias("earnings"), F.when(k % 7 == 0, -1.0).otherwise(F.col("whole")).alias("equity"), F.when(k % 9 == 0, 120.0).otherwise(40.0).alias("gross_margin"), F.lit(None).cast("double").alias("revenue_yoy"), F.lit(900.0).alias("earnings_yoy"), segments.alias("segments"), F.when(k % 4 == 1, F.array(item("Europe", fr))).otherwise(F.array().cast(H.ITEMS)).cast(H.ITEMS).alias("geographies"), F.lit("u").alias("source_url"), F.lit("2024-05-01").alias("source_date"), (k % 10 == 0).alias("adjusted"), (k % 11 == 0).alias("stale"))
    needs = table(spark, d, "nation").select(F.col("n_nationkey").alias("company"), (F.col("n_nationkey") % 2 == 0).alias("needed"))
    profile = table(spark, d, "nation").select(F.col("n_nationkey").alias("company"), listed("A", "B").alias("names"), listed("A").alias("cores"), F.lit(2).cast("long").alias("target"))
    out = H.enriched(history, found, needs, profile)
    return rounded(out.select("company", "quarter_index", "revenue", "earnings", "equity", "gross_margin", "basis", F.size("segments").alias("n_segments"), "source_type", "release_date"), "revenue", "earnings", "equity", digits=6)


@query("refreshed_latest", _HISTORY_SQL + f""", m AS (SELECT *, quarter_index = max(quarter_index) OVER (PARTITION BY company) AS last FROM h), n AS (SELECT company, quarter_index, k, last, CASE WHEN last AND company % 3 != 0 THEN 100.0 ELSE revenue END AS revenue, CASE WHEN last THEN coalesce(CASE WHEN company % 4 = 0 THEN 9.0 END, earnings) ELSE earnings END AS earnings FROM m),
t AS (SELECT *, lag(revenue, 1) {OVER} AS r1, lag(earnings, 4) {OVER} AS e4, CASE WHEN count(revenue) OVER (PARTITION BY company ORDER BY quarter_index ROWS 3 PRECEDING) = 4 THEN sum(revenue) OVER (PARTITION BY company ORDER BY quarter_index ROWS 3 PRECEDING) END AS ttm, row_number() {OVER} AS i FROM n), u AS (SELECT *, lag(ttm, 4) {OVER} AS ttm4 FROM t)
SELECT company, quarter_index, round(revenue, 6) AS revenue, round((nullif(revenue, 0) / nullif(r1, 0) - 1) * 100, 4) AS revenue_qoq, round(ttm, 6) AS ttm_revenue, round(CASE WHEN i >= 8 THEN (nullif(ttm, 0) / nullif(ttm4, 0) - 1) * 100 END, 4) AS ttm_growth, round(coalesce((nullif(earnings, 0) / nullif(e4, 0) - 1) * 100, 1.5), 4) AS earnings_yoy, round(earnings / nullif(revenue, 0) * 100, 4) AS net_margin FROM u WHERE last""")
def refreshed_latest(spark, d):
    c = F.col("n_nationkey")
    none = F.lit(None).cast("double")
    latest = table(spark, d, "nation").select(c.alias("company"), F.when(c % 3 != 0, 100.0).alias("revenue"), F.when(c % 4 == 0, 9.0).alias("earnings"), none.alias("equity"), none.alias("gross_margin"), none.alias("revenue_yoy"), F.lit(1.5).alias("earnings_yoy"), F.array().cast(H.ITEMS).alias("segments"), F.array().cast(H.ITEMS).alias("geographies"))
    out = H.refreshed(_history(spark, d), latest).where("is_latest").select("company", "quarter_index", "revenue", "revenue_qoq", "ttm_revenue", "ttm_growth", "earnings_yoy", "net_margin")
    return rounded(rounded(out, "revenue", "ttm_revenue", digits=6), "revenue_qoq", "ttm_growth", "earnings_yoy", "net_margin")


@query("snapshot_replacement", """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS ec, p_partkey // 4 % 4 AS fc, (p_partkey % 13) * 0.1 AS ev, (p_partkey % 11) * 0.12 AS fv, p_partkey % 5 = 0 AS ew, p_partkey % 3 = 0 AS fw FROM part)
SELECT k AS p_partkey, CASE WHEN fc = 0 THEN false WHEN ec = 0 THEN true WHEN ew != fw THEN fw WHEN fw THEN fc >= ec AND fv >= ev - 0.03 ELSE fc > ec OR fv > ev + 0.08 OR ev < 0.45 END AS replace FROM p""")
def snapshot_replacement(spark, d):
    k = F.col("p_partkey")
    ev, fv = k % 13 * 0.1, k % 11 * 0.12
    state = lambda n, v, w: F.struct(n.cast("long").alias("count"), v.alias("coverage"), (v >= 0.45).alias("reasonable"), w.alias("complete"))
    return table(spark, d, "part").select("p_partkey", T.should_replace(state(k % 4, ev, k % 5 == 0), state(F.floor(k / 4) % 4, fv, k % 3 == 0), True).alias("replace"))


@query("concept_union", """WITH o AS (SELECT o_custkey AS company, CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period, o_orderkey % 4 AS m, max(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT company, period, max(CASE WHEN m = 0 THEN v END) AS revenue, max(CASE WHEN m = 1 THEN v END) AS profit, max(CASE WHEN m = 2 THEN v END) AS gross_profit, max(CASE WHEN m = 3 THEN v END) AS equity FROM o GROUP BY ALL""")
def concept_union(spark, d):
    names = ("revenue", "profit", "gross_profit", "equity")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("company"), chosen(names, F.col("o_orderkey") % 4).alias("metric"), P.label(P.index_of_date(F.to_date("o_orderdate"))).alias("period"), F.col("o_totalprice").alias("value"))
    return R.concept_union(rows.groupBy("company", "metric", "period").agg(F.max("value").alias("value")), list(names))


# ---- narrative -------------------------------------------------------------------------------------------------------------


@query("theme_builders", SERIES_SQL + f""", g AS (SELECT *, (revenue / nullif(lag(revenue, 4) {OVER}, 0) - 1) * 100 AS yoy, (revenue / nullif(lag(revenue, 1) {OVER}, 0) - 1) * 100 AS qoq, earnings / revenue * 100 AS margin FROM series), h AS (SELECT company, quarter_index, coalesce(yoy, 0) AS yoy, coalesce(qoq, 0) AS qoq, margin, coalesce(margin - lag(margin, 4) {OVER}, 0) AS mc FROM g),
c AS (SELECT *, greatest(yoy, 0) AS yu, greatest(qoq, 0) AS qu FROM h), s AS (SELECT company, quarter_index, unnest(['收入动能与需求持续性', '利润率与经营杠杆', 'TTM 成长延续性', '研究主线与结构披露', '增长是否可持续', '利润率拐点与兑现', '结构升级与第二曲线', '经营基线与估值锚', '收入增速放缓', '利润率回落', '披露粒度有限', '收入动能延续', '利润率继续改善', 'TTM 周期上修']) AS label,
 unnest([62 + yu * 0.45 + qu * 0.35, 50 + margin * 0.5 + greatest(margin, 0) * 0.25, 48 + yu * 0.6, 58, 58 + yu * 0.45, 50 + abs(mc) * 2.2, 54, 52, 56 + greatest(0, 18 - yoy) * 1.2 + greatest(0, -qoq) * 1.5, 48 + greatest(0, -mc) * 2.5, 62, 54 + yu * 0.6 + qu * 0.45, 48 + greatest(mc, 0) * 2.6, 50 + yu * 0.55]::DOUBLE[]) AS raw FROM c)
SELECT company, quarter_index, label, CAST(greatest(32, least(98, round_even(raw, 0))) AS INTEGER) AS score FROM s""")
def theme_builders(spark, d):
    """Yearly growth stands in for the trailing one."""
    margin = F.col("earnings") / F.col("revenue") * 100
    g = quarterly(spark, d).withColumns({"yoy": N.pct_change(F.col("revenue"), R.before("revenue", 4)), "qoq": N.pct_change(F.col("revenue"), R.before("revenue", 1)), "margin": margin})
    g = g.withColumn("change", F.col("margin") - R.before("margin", 4))
    yoy, qoq, m, c = (F.col(x) for x in ("yoy", "qoq", "margin", "change"))
    every = F.concat(W.focus_themes(yoy, qoq, yoy, m, m), W.question_themes(yoy, c), W.risks(yoy, qoq, c), W.catalysts(yoy, qoq, yoy, c))
    return g.select("company", "quarter_index", F.explode(every).alias("t")).select("company", "quarter_index", "t.label", "t.score")


@query("headlines", """WITH p AS (SELECT *, p_partkey AS k, p_size + 0.5 AS r, CASE WHEN p_partkey % 3 != 0 THEN p_size % 7 + 0.5 END AS e, CASE WHEN p_partkey % 4 != 0 THEN p_size % 9 + 0.5 END AS ry, CASE WHEN p_partkey % 5 != 0 THEN -(p_size % 5 + 0.5) END AS ey FROM part),
t AS (SELECT *, CASE WHEN e IS NOT NULL AND ey IS NOT NULL THEN '净利润 $' || e || 'B，同比 ' || ey || '%。' WHEN e IS NOT NULL THEN '净利润 $' || e || 'B。' WHEN ey IS NOT NULL THEN '净利润同比 ' || ey || '%。' END AS profit FROM p)
SELECT k AS p_partkey, CASE WHEN k % 11 != 0 THEN p_name || ' 2024Q1 收入 $' || r || 'B' || CASE WHEN ry IS NOT NULL THEN '，同比 +' || ry || '%' ELSE '' END || CASE WHEN e IS NOT NULL THEN '；净利润 $' || e || 'B' || CASE WHEN ey IS NOT NULL THEN '，同比 ' || ey || '%' ELSE '' END ELSE '' END || CASE WHEN k % 2 = 0 THEN '；' || p_type ELSE '' END || '。' END AS headline,
 array_to_string((['a'] || CASE WHEN profit IS NULL THEN [] ELSE [profit] END || CASE WHEN profit IS NULL THEN ['净利润 up'] ELSE [] END || ['b', 'c', 'd'])[1:4], '|') AS takeaways FROM t""")
def headlines(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    r, e, ry, ey = F.when(k % 11 != 0, size + 0.5), F.when(k % 3 != 0, size % 7 + 0.5), F.when(k % 4 != 0, size % 9 + 0.5), F.when(k % 5 != 0, -(size % 5 + 0.5))
    line = W.headline(F.col("p_name"), F.lit("2024Q1"), r, ry, e, ey, F.when(k % 2 == 0, F.col("p_type")).otherwise(""))
    return table(spark, d, "part").select("p_partkey", line.alias("headline"), F.array_join(W.takeaways(listed("a", "净利润 up", "b", "c", "d"), W.profit_takeaway(e, ey)), "|").alias("takeaways"))


@query("guidance_changes", SERIES_SQL + f""", g AS (SELECT company, quarter_index, revenue, company + quarter_index AS k FROM series), m AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'official' WHEN k % 5 = 0 THEN 'official_context' ELSE 'proxy' END AS mode, CASE WHEN k % 2 = 0 THEN revenue * 1.1 END AS point, CASE WHEN k % 2 = 1 THEN revenue * 0.9 END AS low, CASE WHEN k % 2 = 1 AND k % 7 != 0 THEN revenue * 1.2 END AS high, CASE WHEN k % 4 != 0 THEN (40.0 + k % 6)::DOUBLE END AS margin FROM g),
l AS (SELECT *, lag(mode) {OVER} AS pm, lag(point) {OVER} AS pp, lag(low) {OVER} AS pl, lag(high) {OVER} AS ph, lag(margin) {OVER} AS pg FROM m)
SELECT company, quarter_index, round(CASE WHEN pp IS NOT NULL THEN (revenue / pp - 1) * 100 END, 4) AS realised, CASE WHEN pp IS NULL AND pl IS NOT NULL AND ph IS NOT NULL THEN revenue BETWEEN pl AND ph END AS in_range, round(CASE WHEN point IS NOT NULL AND pp IS NOT NULL THEN (point / pp - 1) * 100 WHEN low + high + pl + ph IS NOT NULL THEN ((low + high) / (pl + ph) - 1) * 100 END, 4) AS change, pm IS NOT NULL AND mode != pm AS switched, CASE WHEN mode = pm THEN margin - pg END AS margin_delta FROM l""")
def guidance_changes(spark, d):
    k, r = F.col("company") + F.col("quarter_index"), F.col("revenue")
    g = quarterly(spark, d).select("company", "quarter_index", "revenue", F.when(k % 3 == 0, "official").when(k % 5 == 0, "official_context").otherwise("proxy").alias("mode"), F.when(k % 2 == 0, r * 1.1).alias("point"), F.when(k % 2 == 1, r * 0.9).alias("low"), F.when((k % 2 == 1) & (k % 7 != 0), r * 1.2).alias("high"), F.when(k % 4 != 0, 40.0 + k % 6).alias("margin"))
    out = W.guidance_change(g).select("company", "quarter_index", "realised", "in_range", "change", F.coalesce("switched", F.lit(False)).alias("switched"), "margin_delta")
    return rounded(out, "realised", "change")


# ---- dimensions, readers, sinks --------------------------------------------------------------------------------------------


@query("company_filers", "WITH " + f"c(company, cik, month, n) AS ({sql.values((c[0], c[3], c[4], len(c[7])) for c in D.COMPANIES)}), q AS (SELECT DISTINCT CAST(year(o_orderdate) + 20 AS INTEGER) * 4 + quarter(o_orderdate) - 1 AS q FROM orders) SELECT company, CAST(q AS INTEGER) AS quarter_index, CASE WHEN company = 'alphabet' AND q <= 2015 * 4 + 2 THEN '0001288776' ELSE cik END AS cik, month AS year_end_month, n AS n_segments FROM c, q")
def company_filers(spark, d):
    q = table(spark, d, "orders").select(((F.year("o_orderdate") + 20) * 4 + F.quarter("o_orderdate") - 1).cast("int").alias("quarter_index")).distinct()
    grid = D.companies(spark).withColumn("one", F.lit(1)).join(q.withColumn("one", F.lit(1)), "one")
    return grid.select("company", "quarter_index", D.filer(F.col("former_filers"), F.col("cik"), F.col("quarter_index")).alias("cik"), "year_end_month", F.size("segments").alias("n_segments"))


@query("company_cards", f"""WITH c(company, name, n) AS ({sql.values((c[0], c[1], n) for n, c in enumerate(D.COMPANIES, 1))}), s AS (SELECT DISTINCT c_nationkey AS k, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS q FROM orders JOIN customer ON o_custkey = c_custkey), l AS (SELECT company, max(q) AS q, count(*) AS n_quarters FROM s JOIN c ON n = k + 1 WHERE (k + q) % 3 != 0 GROUP BY company)
SELECT company, name, (q // 4) || 'Q' || (q % 4 + 1) AS latest, coalesce(n_quarters, 0) AS n_quarters FROM c LEFT JOIN l USING (company)""")
def company_cards(spark, d):
    dim = D.companies(spark)
    s = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select((F.col("c_nationkey") + 1).alias("display_order"), P.index_of_date(F.to_date("o_orderdate")).alias("quarter_index")).distinct().where("(display_order - 1 + quarter_index) % 3 != 0")
    supported = s.join(dim.select("display_order", "company"), "display_order").select("company", "quarter_index")
    return D.cards(dim, supported).select("company", "name", "latest", F.coalesce(F.greatest(F.size("quarters"), F.lit(0)), F.lit(0)).cast("long").alias("n_quarters"))


@query("sitemap_children", """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS idx FROM part), u AS (SELECT k, idx, n, 'http://x/' || CASE WHEN (k + n) % 4 = 0 THEN 'news' WHEN (k + n) % 4 = 1 THEN 'events-results' ELSE 'p' END || '/' || (n % 9) AS url FROM p, range(12) AS r(n)),
d AS (SELECT k, idx, url, min(n) AS n FROM u GROUP BY ALL), s AS (SELECT *, CASE WHEN contains(url, 'results') THEN 2 WHEN contains(url, 'news') THEN 1 ELSE 0 END AS score FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, n) AS i FROM s) SELECT k AS key, url FROM r WHERE NOT idx OR i <= 8""")
def sitemap_children(spark, d):
    k = F.col("p_partkey")
    part = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda n: F.concat(F.lit("<loc> http://x/"), F.when((k + n) % 4 == 0, "news").when((k + n) % 4 == 1, "events-results").otherwise("p"), F.lit("/"), (n % 9).cast("string"), F.lit(" </loc>")))
    xml = F.concat(F.when(k % 3 == 0, "<sitemapindex>").otherwise("<urlset>"), F.array_join(part, ""))
    score = F.when(F.col("url").contains("results"), 2).when(F.col("url").contains("news"), 1).otherwise(0)
    return L.nested_sitemaps(table(spark, d, "part").select(k.alias("key"), xml.alias("xml")), score).select("key", "url")


@query("directory_index", "SELECT p_partkey AS key, unnest([0, 2]) AS ordinal, unnest(['a' || p_partkey || '.htm', 'b.pdf']) AS href, unnest(['10-Q', '']) AS kind FROM part")
def directory_index(spark, d):
    body = F.concat(F.lit('{"directory":{"item":[{"name":"a'), F.col("p_partkey").cast("string"), F.lit('.htm","type":"10-Q"},{"name":"x/y","type":"d"},{"name":" b.pdf "},{"type":"none"}]}}'))
    return L.directory_rows(table(spark, d, "part").select(F.col("p_partkey").alias("key"), body.alias("body"))).select("key", "ordinal", "href", "kind")


@query("picture_pages", r"""WITH d AS (SELECT doc_id, doc_id % 14 AS n, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS size, string_split(text, chr(10)) AS pages, text FROM documents), l AS (SELECT *, list_transform(pages, lambda p: length(trim(regexp_replace(p, '\s+', ' ', 'g')))) AS sizes FROM d)
SELECT doc_id, n >= 3 AND ((n >= 8 AND size / n < 1300) OR size < greatest(6000, n * 420)) AS by_pictures, len(pages) >= 3 AND (len(list_filter(sizes, lambda x: x < 80)) >= 4 OR (len(list_filter(sizes, lambda x: x < 80)) >= greatest(3, len(pages) // 4) AND list_sum(sizes) < 18000)) AS by_scan, doc_id % 3 != 0 AND length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) <= greatest(40, (length(text) + length('=== page-1 Revenue Margin Guidance ')) // 90) AS usable FROM l""")
def picture_pages(spark, d):
    docs = table(spark, d, "documents")
    images = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 14).cast("int")), lambda n: n.cast("string"))
    images = F.slice(images, F.lit(1), (F.col("doc_id") % 14).cast("int"))
    scan = F.concat(F.when(F.col("doc_id") % 3 == 0, "=== page-1 Revenue Margin ").otherwise("=== page-1 Revenue Margin Guidance "), "text")
    return docs.select("doc_id", L.needs_page_reading(F.col("text"), images).alias("by_pictures"), L.needs_scan_reading(F.split("text", "\n")).alias("by_scan"), L.usable_scan(scan).alias("usable"))


@query("page_series", f"""WITH o AS (SELECT c_nationkey AS company, o_orderkey, CAST(last_day(o_orderdate) AS DATE) AS d, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT company, CAST(year(d - INTERVAL 1 MONTH) * 4 + quarter(d - INTERVAL 1 MONTH) - 1 AS INTEGER) AS q, max(d) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS r FROM o GROUP BY ALL),
s AS (SELECT company, q AS quarter_index, CASE WHEN (company + q) % 5 != 0 THEN CAST(floor(r) AS BIGINT) END AS revenue, CASE WHEN (company + q) % 5 != 0 THEN CAST(floor(floor(r) * 0.1) AS BIGINT) END AS earnings FROM m), l AS (SELECT *, lag(revenue, 4) {OVER} AS r4 FROM s)
SELECT company, (quarter_index // 4) || 'Q' || (quarter_index % 4 + 1) AS period, revenue, earnings, CASE WHEN revenue IS NOT NULL THEN 40.0::DOUBLE END AS gross_margin, round((nullif(revenue, 0) - nullif(r4, 0)) / abs(nullif(r4, 0)) * 100, 4) AS revenue_yoy FROM l""")
def page_series(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("company")), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select("company", F.last_day("o_orderdate").alias("d"), "o_totalprice").groupBy("company", P.majority_index(F.col("d")).alias("q")).agg(F.max("d").alias("d"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("r"))
    known = (F.col("company") + F.col("q")) % 5 != 0
    pages = rows.select("company", F.date_format("d", "yyyy-MM-dd").alias("date_key"), F.when(known, F.floor("r").cast("double")).alias("revenue"), F.when(known, F.floor("r") * 0.1).alias("earnings"), F.when(known, F.floor("r") * 0.4).alias("gross_profit"))
    return rounded(rounded(R.page_series(pages).select("company", "period", "revenue", "earnings", "gross_margin", "revenue_yoy"), "revenue_yoy"), "gross_margin", digits=6)


@query("upserted", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def upserted(spark, d):
    stored = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return L.upsert(stored, stored.where("o_orderkey % 3 = 0").withColumn("status", F.lit("new")), "o_orderkey")


@query("refreshed_materials", """WITH d AS (SELECT doc_id, doc_id % 4 != 0 AS cached, doc_id % 3 = 0 AS off, trim(text) AS t FROM documents) SELECT doc_id, CASE WHEN off AND cached THEN 'cached' WHEN off THEN 'disabled' ELSE 'fetched' END AS status, CASE WHEN cached THEN length(t) ELSE 0 END AS text_length, cached AS from_cache FROM d""")
def refreshed_materials(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.lit("fetched").alias("status"), F.lit("old").alias("excerpt"), F.lit(1).alias("text_length"), F.when(k % 4 != 0, F.col("text")).alias("text"))
    return L.refreshed(rows, k % 3 == 0).select("doc_id", "status", "text_length", "from_cache")


@query("clean_entries", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS n FROM part")
def clean_entries(spark, d):
    k = F.col("p_partkey")
    entries = F.create_map(F.lit("a"), F.when(k % 3 != 0, F.col("p_name")).otherwise("  "), F.lit("b"), F.when(k % 5 != 0, F.col("p_type")))
    return table(spark, d, "part").select("p_partkey", F.size(X.clean_map(entries)).alias("n"))


@query("company_resolution", """WITH r AS (SELECT c_custkey, n_nationkey, translate(lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), '0123456789', 'qwzkvxjpfm') || ' Nation' AS n_name, c_custkey % 9973 AS tag FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT *, length(n_name) - 1 AS n, length(CAST(tag AS VARCHAR)) AS d FROM r)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR 2.0 * n / (2 * n + d) >= 0.82 THEN lower(n_name) END AS company, CASE WHEN c_custkey % 4 != 0 THEN round(2.0 * n / (2 * n + d), 9)::DOUBLE END AS likeness,
       CASE WHEN c_custkey % 4 != 0 AND 2.0 * n / (2 * n + d) < 0.82 THEN 'Unknown company reference: ' || n_name || '-' || tag || '. Closest matches: ' || n_name || ' (' || n_nationkey || ')' END AS error
FROM t UNION ALL SELECT -1, NULL, NULL, 'Company reference is empty.' FROM region WHERE r_regionkey = 0 UNION ALL SELECT -2, NULL, NULL, 'Unknown company reference: 8675309' FROM region WHERE r_regionkey = 0""")
def company_resolution(spark, d):
    """Customers' references to their nation: its name as it is or in small letters and other signs, and the name with a number behind it."""
    spelled = F.concat(F.translate(F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), "0123456789", "qwzkvxjpfm"), F.lit(" Nation"))
    nation = table(spark, d, "nation").withColumn("n_name", spelled)
    name, key = F.col("n_name"), F.col("n_nationkey").cast("string")
    companies = nation.select(F.lower(name).alias("company_id"), X.company_aliases(F.array(name), name).alias("aliases"), F.col("n_nationkey").alias("display_order"), name.alias("english_name"), key.alias("ticker"))
    written = F.when(F.col("c_custkey") % 8 == 0, F.concat(F.lower(name), F.lit(" ."))).when(F.col("c_custkey") % 4 == 0, name).otherwise(F.concat_ws("-", name, F.col("c_custkey") % 9973))
    customers = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", written.alias("reference"))
    odd = table(spark, d, "region").where("r_regionkey = 0").select(F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("c_custkey"), F.lit(" -").alias("reference")), F.struct(F.lit(-2).cast("long").alias("c_custkey"), F.lit("8675309").alias("reference")))).alias("o")).select("o.*")
    asked = customers.unionByName(odd)
    found = X.resolved(asked, companies)
    first = F.regexp_replace("error", r"(Closest matches: [^,]*),.*", "$1")
    return asked.join(found, "reference").select("c_custkey", F.col("company_id").alias("company"), F.round("raw", 9).alias("likeness"), first.alias("error"))


@query("cleaned_payloads", """SELECT p_partkey, p_partkey % 3 != 0 AS has_title, 1 + CAST(p_partkey % 2 = 0 AS INTEGER) AS tags, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS notes, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS deep,
 NOT (p_partkey % 4 = 0 AND p_partkey % 5 = 0) AS has_nested FROM part""")
def cleaned_payloads(spark, d):
    """Structs in arrays in maps in structs: what says nothing goes at every depth."""
    k = F.col("p_partkey")
    deep = F.array(F.struct(F.when(k % 4 != 0, F.col("p_type")).alias("kind"), F.array(F.lit(" "), F.lit(None).cast("string")).alias("none")), F.struct(F.lit("\t ").alias("kind"), F.array().cast("array<string>").alias("none")))
    nested = F.struct(F.create_map(F.lit("a"), F.when(k % 5 != 0, F.array("p_name")).otherwise(F.array(F.lit("  "))), F.lit("b"), F.array().cast("array<string>")).alias("notes"), deep.alias("deep"))
    payload = F.struct(F.when(k % 3 != 0, F.col("p_name")).otherwise("").alias("title"), F.array(F.col("p_brand"), F.when(k % 2 == 0, F.col("p_type")), F.lit(" ")).alias("tags"), nested.alias("nested"))
    rows = table(spark, d, "part").select("p_partkey", payload.alias("p"))
    clean = rows.select("p_partkey", X.cleaned(F.col("p"), rows.schema["p"].dataType).alias("p"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return clean.select("p_partkey", F.col("p.title").isNotNull().alias("has_title"), count("p.tags").alias("tags"), size("p.nested.notes").alias("notes"), size("p.nested.deep").alias("deep"), F.col("p.nested").isNotNull().alias("has_nested"))


@query("overridden_payloads", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'x|base' ELSE ' base ' END AS notes,
 CASE WHEN p_partkey % 5 = 0 THEN 'a=1' ELSE 'a=' || p_brand || '|b=2' END AS facts, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE p_brand END AS inner_name, 7 AS inner_n FROM part""")
def overridden_payloads(spark, d):
    """A payload over another: blank values don't replace, maps and structs merge field by field, notes are joined."""
    k = F.col("p_partkey")
    text = lambda c: F.array(*c).cast("array<string>")
    fact = lambda a, b: F.map_filter(F.create_map(F.lit("a"), a, F.lit("b"), b), lambda _, v: v != "-")
    base = F.struct(F.col("p_name").alias("title"), text([F.lit(" base ")]).alias("notes"), fact(F.lit("1"), F.lit("-")).alias("facts"), F.struct(F.col("p_name").alias("name"), F.lit(7).alias("n")).alias("inner"))
    over = F.struct(F.when(k % 3 == 0, F.lit(" ")).otherwise(F.col("p_type")).alias("title"), F.when(k % 2 == 0, text([F.lit("x "), F.lit("base"), F.lit("")])).otherwise(text([])).alias("notes"), fact(F.when(k % 5 == 0, F.lit("")).otherwise(F.col("p_brand")), F.when(k % 5 == 0, F.lit("-")).otherwise(F.lit("2"))).alias("facts"), F.struct(F.when(k % 7 != 0, F.col("p_brand")).alias("name"), F.lit(None).cast("int").alias("n")).alias("inner"))
    rows = table(spark, d, "part").select("p_partkey", base.alias("base"), over.alias("over"))
    made = rows.select("p_partkey", X.overridden(F.col("base"), F.col("over"), rows.schema["base"].dataType, ("notes",)).alias("p"))
    facts = F.array_join(F.transform(F.array_sort(F.map_entries("p.facts")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return made.select("p_partkey", F.col("p.title").alias("title"), F.array_join("p.notes", "|").alias("notes"), facts.alias("facts"), F.col("p.inner.name").alias("inner_name"), F.col("p.inner.n").alias("inner_n"))
