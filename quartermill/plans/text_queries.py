"""Queries over documents, conversations, pages and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartermill.functions import text as S
from quartermill.operators import selection as X
from quartermill.plans import sql
from quartermill.plans.base import table
from quartermill.sources import readers as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


TOPICS = {"growth": ("tion", "ation"), "margin": ("er", "ing"), "region": ("eau", "ou"), "risk": ("ich", "ber")}


def _count_sql(word: str) -> str:
    return f"((length(t) - length(replace(t, '{word}', ''))) // {len(word)})"


_TOPIC_SQL = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS topic, {k} AS o, least(100, ({' + '.join(map(_count_sql, w))}) * 12) AS score FROM d" for k, (n, w) in enumerate(TOPICS.items()))


@query("keyword_topics", f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), s AS ({_TOPIC_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS k FROM s WHERE score > 0) SELECT doc_id, topic, CAST(score AS INTEGER) AS score FROM r WHERE k <= 3""")
def keyword_topics(spark, d):
    lowered = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lower("text"))).alias("low"))  # once a text
    return lowered.select("doc_id", F.explode(S.topic_scores(F.col("low"), TOPICS, 3)).alias("s")).select("doc_id", "s.topic", "s.score")


def _last_sql(mark: str) -> str:
    m = mark.strip()
    return f"CASE WHEN instr(reverse(h), '{m}') > 0 THEN length(h) - instr(reverse(h), '{m}') + 1 ELSE 0 END"


@query("excerpt_text", f"""WITH d AS (SELECT doc_id, text, left(text, 200) AS h FROM documents), c AS (SELECT *, greatest({', '.join(_last_sql(e) for e in S.ENDS)}) AS c FROM d)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN c >= 110 THEN left(text, c) ELSE h END AS excerpt FROM c""")
def excerpt_text(spark, d):
    return table(spark, d, "documents").select("doc_id", S.excerpt(F.col("text"), 200).alias("excerpt"))


_PHRASE = "CASE " + " ".join(f"WHEN contains(low, {sql.lit(w)}) THEN {sql.lit(w)}" for w in S.ERROR_PHRASES) + " END"


@query("text_quality_gate", rf"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 23 < 11 THEN 'See ' || {sql.pick(S.ERROR_PHRASES, 'doc_id % 11')} || ' here' ELSE 'Report' END AS title, CASE doc_id % 5 WHEN 0 THEN left(text, 120) WHEN 1 THEN left(text, 100) || ' Net Income' WHEN 2 THEN '  ' ELSE text END AS t,
  doc_id % 3 != 1 OR doc_id % 4 = 0 AS official, doc_id % 2 = 0 OR doc_id % 7 = 0 AS written FROM documents), n AS (SELECT *, trim(regexp_replace(t, '\s+', ' ', 'g')) AS bare FROM d), l AS (SELECT *, trim(lower(title) || ' ' || lower(bare)) AS low FROM n)
SELECT doc_id, CASE WHEN bare = '' THEN 'empty extracted text' WHEN {_PHRASE} IS NOT NULL THEN 'unusable source page: ' || {_PHRASE} WHEN official AND length(bare) < 180 AND written AND NOT {sql.any_of('low', S.MATERIAL_WORDS)} THEN 'insufficient extracted text (' || length(bare) || ' chars)' ELSE '' END AS issue FROM l""")
def text_quality_gate(spark, d):
    k = F.col("doc_id")
    phrase = F.get(F.array(*map(F.lit, S.ERROR_PHRASES)), (k % 11).cast("int"))
    title = F.when(k % 23 < 11, F.concat(F.lit("See "), phrase, F.lit(" here"))).otherwise("Report")
    text = F.when(k % 5 == 0, F.substring("text", 1, 120)).when(k % 5 == 1, F.concat(F.substring("text", 1, 100), F.lit(" Net Income"))).when(k % 5 == 2, "  ").otherwise(F.col("text"))
    kind, role = F.when(k % 3 != 1, "official_release").otherwise("news"), F.when(k % 4 == 0, "Earnings_Call").otherwise("x")
    issue = S.quality_issue(text, title, kind, role, F.when(k % 2 == 0, ".html").otherwise(".pdf"), F.when(k % 7 == 0, "TEXT/plain").otherwise("application/pdf"))
    return table(spark, d, "documents").select("doc_id", issue.alias("issue"))


@query("transcript_detect", rf"""WITH c AS (SELECT conv_id, turn, text || CASE conv_id % 4 WHEN 0 THEN ' Operator, CEO, cfo and President' WHEN 1 THEN ' Prepared remarks of the conference call' WHEN 2 THEN ' an analyst' ELSE '' END AS t, CASE WHEN turn % 5 = 0 THEN 'Q3 Transcript' WHEN turn % 5 = 1 THEN 'Earnings call' END AS label FROM conversations)
SELECT conv_id, turn, coalesce({sql.any_of('lower(label)', ('transcript', 'prepared remarks'))}, false) OR {sql.number_of('lower(t)', S.CALL_WORDS)} >= 2 OR len(regexp_extract_all(t, {sql.lit(S.SPEAKERS)})) >= 4 AS transcript FROM c""")
def transcript_detect(spark, d):
    k, t = F.col("conv_id") % 4, F.col("turn") % 5
    text = F.concat("text", F.when(k == 0, " Operator, CEO, cfo and President").when(k == 1, " Prepared remarks of the conference call").when(k == 2, " an analyst").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", S.transcript_like(text, F.when(t == 0, "Q3 Transcript").when(t == 1, "Earnings call")).alias("transcript"))


@query("implausible_year", r"""WITH d AS (SELECT doc_id, text || ' in ' || (2018 + doc_id % 9) AS t, 2019 + doc_id % 6 AS y FROM documents) SELECT doc_id, y < 2023 AND len(list_filter(regexp_extract_all(t, '\b(20\d{2})\b', 1), lambda x: CAST(x AS INTEGER) > y + 3)) > 0 AS implausible FROM d""")
def implausible_year(spark, d):
    k = F.col("doc_id")
    text = F.concat("text", F.lit(" in "), (2018 + k % 9).cast("string"))
    return table(spark, d, "documents").select("doc_id", S.implausible_year(text, 2019 + k % 6, F.lit(2024)).alias("implausible"))


@query("token_slug", r"""SELECT p_partkey, regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '', 'g') AS token, trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def token_slug(spark, d):
    name = F.concat("p_name", F.lit(" & "), "p_brand")
    return table(spark, d, "part").select("p_partkey", S.token(name).alias("token"), S.slug(name).alias("slug"))


def _chunks_sql(text):
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({text}, '\n\s*\n+'), lambda p: trim(p)), lambda p: p != '') AS p, list_filter(list_transform(regexp_split_to_array({text}, '\n+'), lambda p: trim(p)), lambda p: p != '') AS lines FROM documents),
r AS (SELECT doc_id, 1 AS i, CAST([] AS VARCHAR[]) AS done, '' AS held FROM d WHERE len(p) <= 1 UNION ALL
 SELECT doc_id, i + 1, CASE WHEN length(own) >= 220 THEN list_append(done, own) ELSE done END, CASE WHEN length(own) >= 220 THEN '' ELSE own END FROM (SELECT r.*, CASE WHEN held = '' THEN lines[i] ELSE held || ' ' || lines[i] END AS own FROM r JOIN d USING (doc_id) WHERE i <= len(lines))),
m AS (SELECT doc_id, CASE WHEN held = '' THEN done ELSE list_append(done, held) END AS chunks FROM r JOIN d USING (doc_id) WHERE i = len(lines) + 1), a AS (SELECT doc_id, p AS chunks FROM d WHERE len(p) > 1 UNION ALL SELECT * FROM m)
SELECT doc_id, CAST(unnest(range(0, len(chunks))) AS INTEGER) AS seq, md5(unnest(chunks)) AS chunk_md5 FROM a"""


def _chunked(docs):
    return docs.select("doc_id", F.posexplode(S.chunks(F.col("text"))).alias("seq", "chunk")).select("doc_id", "seq", F.md5("chunk").alias("chunk_md5"))


@query("paragraph_chunks", _chunks_sql("CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END"))
def paragraph_chunks(spark, d):
    """Every second text with blank lines between its own."""
    return _chunked(table(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))))


@query("merged_lines", _chunks_sql("text"))
def merged_lines(spark, d):
    return _chunked(table(spark, d, "documents"))


@query("page_links", r"""WITH a AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o, regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"''#]+)[^>]*>(.*?)</a\s*>', 1) AS h FROM pages),
r AS (SELECT page_id, o, generate_subscripts(h, 1) - 1 AS seq, trim(unnest(h)) AS h FROM a),
l AS (SELECT page_id, seq, o, CASE WHEN regexp_matches(h, '(?i)^https?://') THEN h WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, '/') THEN o || h END AS link FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY seq) AS k FROM l WHERE link IS NOT NULL)
SELECT page_id, CAST(seq AS INTEGER) AS seq, link, lower(regexp_extract(link, '^https?://([^/:?#]+)', 1)) = lower(regexp_extract(o, '^https?://([^/:?#]+)', 1)) AS same_host FROM k WHERE k = 1""")
def page_links(spark, d):
    return R.page_links(table(spark, d, "pages")).select("page_id", "seq", "link", "same_host")


@query("page_text", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_md5 FROM a""")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(S.html_text(F.col("html"))).alias("text_md5"))


@query("link_reach", """WITH l AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS url FROM orders JOIN lineitem ON o_orderkey = l_orderkey), b AS (SELECT src, url FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY url) AS k FROM l) WHERE k <= 5),
z AS (SELECT 1::BIGINT AS url, 0 AS depth), one AS (SELECT DISTINCT b.url, 1 AS depth FROM b JOIN z ON b.src = z.url WHERE b.url NOT IN (SELECT url FROM z)), two AS (SELECT DISTINCT b.url, 2 AS depth FROM b JOIN one ON b.src = one.url WHERE b.url NOT IN (SELECT url FROM z UNION SELECT url FROM one))
SELECT * FROM z UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two""")
def link_reach(spark, d):
    """A crawl's bounded breadth-first search as unrolled joins."""
    links = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("url")).distinct().withColumn("score", F.lit(1))
    return X.reachable(links, spark.createDataFrame([(1,)], "url long"))


@query("crawl_budget", """WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS url, (o_custkey * 7 + l_suppkey) % 6 AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
b AS (SELECT * FROM (SELECT src, url, row_number() OVER (PARTITION BY src ORDER BY score DESC, url DESC) AS k FROM l WHERE score > 0) WHERE k <= 5),
c(crawl, url, path, depth) AS (SELECT c_custkey, c_custkey, '0', 0 FROM customer UNION ALL SELECT c.crawl, b.url, c.path || b.k, c.depth + 1 FROM c JOIN b ON b.src = c.url WHERE c.depth < 2),
f AS (SELECT *, row_number() OVER (PARTITION BY crawl, url ORDER BY depth, path) AS first FROM c), p AS (SELECT crawl, url, depth, row_number() OVER (PARTITION BY crawl ORDER BY depth, path) - 1 AS place FROM f WHERE first = 1)
SELECT * FROM p WHERE place <= 10""")
def crawl_budget(spark, d):
    """A crawl from every customer: breadth first, best links first, ten pages over all levels."""
    met = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    links = met.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("url")).distinct().withColumn("score", (F.col("src") * 7 + F.col("url")) % 6)
    return X.crawled(links, table(spark, d, "customer").select(F.col("c_custkey").alias("crawl"), F.col("c_custkey").alias("url")))


@query("sliding_windows", """WITH s AS (SELECT *, unnest([0, 15, 30, 45]) AS back FROM events), w AS (SELECT time_bucket(INTERVAL '15 minutes', ts) - to_minutes(back) AS start, event_type, value FROM s)
SELECT start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM w GROUP BY ALL""")
def sliding_windows(spark, d):
    from quartermill.streaming.events import tumbling

    return tumbling(table(spark, d, "events"), "1 hour", slide="15 minutes")


@query("job_progress", """WITH e AS (SELECT user_id AS job, event_id AS seq, event_type AS stage, least(1, greatest(0, value / 100)) AS p FROM events), m AS (SELECT *, max(p) OVER (PARTITION BY job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
r AS (SELECT * FROM m WHERE before IS NULL OR p > before), k AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq DESC) AS k FROM r)
SELECT k.job, round(k.p, 9) AS progress, k.stage, n, k.p >= 1 AS done FROM k JOIN (SELECT job, count(*) AS n FROM e GROUP BY job) USING (job) WHERE k = 1""")
def job_progress(spark, d):
    """Progress of jobs by their events: never back, the stage that last brought it on."""
    from quartermill.streaming.jobs import folded

    events = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), (F.col("value") / 100).alias("progress"))
    return folded(events).select("job", F.round("progress", 9).alias("progress"), "stage", "n", "done")


@query("event_windows", """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def event_windows(spark, d):
    from quartermill.streaming.events import tumbling

    return tumbling(table(spark, d, "events"))


@query("event_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    from quartermill.streaming.events import sessions

    return sessions(table(spark, d, "events"))


@query("grouping_sets", "SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY CUBE (event_type, CAST(date_trunc('day', ts) AS DATE))")
def grouping_sets(spark, d):
    """An addition: the cube of types and days."""
    return table(spark, d, "events").cube("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


_STANCE = "CASE " + " ".join(f"WHEN regexp_matches(text, {sql.lit(p)}) THEN '{name}'" for name, p in S.STANCES) + " ELSE 'reference' END"


@query("stance_counts", f"""SELECT {_STANCE} AS stance, role, count(*) AS n FROM conversations GROUP BY ALL""")
def stance_counts(spark, d):
    return table(spark, d, "conversations").groupBy(S.stance(F.col("text")).alias("stance"), "role").agg(F.count("*").alias("n"))


@query("set_operations", """(SELECT c_nationkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2""")
def set_operations(spark, d):
    a = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("k"))
    return a.intersect(table(spark, d, "supplier").select("s_nationkey")).exceptAll(table(spark, d, "nation").where("n_regionkey = 2").select("n_nationkey")).distinct()


@query("topped_up_lists", """SELECT p_partkey, array_to_string(list_distinct([p_type] || [])[1:1] || CASE WHEN p_brand = p_type THEN [] ELSE [p_brand] END || CASE WHEN p_name IN (p_type, p_brand) THEN [] ELSE [p_name] END, '|') AS items FROM part""")
def topped_up_lists(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(X.topped_up([F.array("p_type"), F.array("p_brand"), F.array("p_name")]), "|").alias("items"))


@query("first_of_two_keys", """WITH RECURSIVE e AS (SELECT user_id AS report, CAST(event_id AS INTEGER) AS ordinal, event_type AS firm, json_extract_string(props, '$.k') AS link, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT report, 0 AS i, CAST([] AS INTEGER[]) AS kept, CAST([] AS VARCHAR[]) AS firms, CAST([] AS VARCHAR[]) AS links FROM e WHERE i = 1 UNION ALL
 SELECT r.report, e.i, CASE WHEN fresh THEN list_append(kept, ordinal) ELSE kept END, CASE WHEN fresh THEN list_append(firms, firm) ELSE firms END, CASE WHEN fresh THEN list_append(links, link) ELSE links END
 FROM r JOIN e ON e.report = r.report AND e.i = r.i + 1, LATERAL (SELECT len(kept) < 4 AND NOT coalesce(list_contains(firms, firm), false) AND NOT coalesce(list_contains(links, link), false) AS fresh)),
f AS (SELECT report, arg_max(kept, i) AS kept FROM r GROUP BY report), k AS (SELECT report, unnest(kept) AS ordinal FROM f) SELECT report, ordinal, firm, link FROM k JOIN e USING (report, ordinal)""")
def first_of_two_keys(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("report"), F.col("event_id").cast("int").alias("ordinal"), F.col("event_type").alias("firm"), F.get_json_object("props", "$.k").alias("link"))
    return X.first_of_two_keys(rows)
