"""Readers: wrapped JSON, CSV, company facts, page blocks, submissions, feeds, links, and keyed tables with freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartermill.functions.text import collapsed, excerpt, html_text

FACTS = "facts map<string, map<string, struct<units: map<string, array<struct<start: string, end: string, val: bigint, form: string, filed: string, frame: string, fp: string, accn: string>>>>>>"
RECENT = "filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, reportDate: array<string>, items: array<string>, primaryDocument: array<string>>>"
DATASET = "periods array<string>, companies map<string, map<string, map<string, double>>>"


def wrapped_json(spark: SparkSession, path: str, schema: str = DATASET) -> DataFrame:
    """A script that assigns one JSON object to a name; fields of `schema`."""
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)^.*?=\s*(?=\{)", ""), r";\s*$", "")
    return text.select(F.from_json(body, schema).alias("d")).select("d.*")


def long_series(dataset: DataFrame) -> DataFrame:
    """company, quarter, metric, value of a wrapped dataset; nulls left out."""
    by_company = dataset.select(F.explode("companies").alias("company", "metrics"))
    by_metric = by_company.select("company", F.explode("metrics").alias("metric", "values"))
    return by_metric.select("company", "metric", F.explode("values").alias("quarter", "value")).where("value IS NOT NULL")


def segment_history(spark: SparkSession, path: str, names: list[str], periods: DataFrame) -> DataFrame:
    """Columns of values (thousandths) and <name>_share unpivoted; rows aligned by position to the last periods. periods: quarter_index."""
    kinds = ", ".join(["quarter_end string", *(f"`{n}` double, `{n}_share` double" for n in names)])
    rows = spark.read.option("header", True).schema(kinds).csv(path)
    ordered = rows.withColumns({"file": F.col("_metadata.file_path"), "_k": F.row_number().over(Window.partitionBy("_metadata.file_path").orderBy(F.desc("quarter_end")))})
    last = periods.groupBy().agg(F.reverse(F.array_sort(F.collect_set("quarter_index"))).alias("_q"))  # one row: a file's quarters
    stacked = ", ".join(f"'{n}', `{n}` / 1000, `{n}_share`" for n in names)
    placed = ordered.join(F.broadcast(last)).withColumn("quarter_index", F.get("_q", F.col("_k") - 1)).where("quarter_index IS NOT NULL")
    return placed.selectExpr("quarter_index", f"stack({len(names)}, {stacked}) AS (name, value, share)").where("value IS NOT NULL")


def company_facts(json: DataFrame, preferred: str = "USD") -> DataFrame:
    """company and a row for each fact: concept, unit, unit_rank (the preferred unit 0), ordinal, fields. json: company, body. Units that aren't currencies go."""
    parsed = json.select("company", F.from_json("body", FACTS).alias("j")).select("company", F.explode("j.facts").alias("taxonomy", "concepts"))
    units = parsed.select("company", F.explode("concepts").alias("concept", "c")).select("company", "concept", F.explode("c.units").alias("unit", "items")).where(F.col("unit").rlike("^[A-Z]{3}$"))
    rows = units.select("company", "concept", "unit", F.when(F.col("unit") == preferred, 0).otherwise(1).alias("unit_rank"), F.posexplode("items").alias("ordinal", "i")).where("i IS NOT NULL")
    return rows.select("company", "concept", "unit", "unit_rank", "ordinal", "i.*").withColumn("days", F.datediff(F.try_to_date("end"), F.try_to_date("start")) + 1)


def quarterly_facts(facts: DataFrame) -> DataFrame:
    """Facts over 70 to 110 days, and those at a day."""
    return facts.where(F.col("days").between(70, 110) | F.col("start").isNull())


def annual_facts(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("days") >= 320)


def financial_block(pages: DataFrame) -> DataFrame:
    """company, period, revenue, earnings of a page's financialData block; parallel arrays cut to the shortest, null words null. pages: company, html."""
    raw = lambda key: F.regexp_extract("html", rf'(?s)financialData.*?"?{key}"?\s*:\s*\[(.*?)\]', 1)
    words = lambda key: F.transform(F.split(raw(key), r"\s*,\s*"), lambda x: F.btrim(x, F.lit('"\' \n\t')))
    numbers = lambda key: F.transform(words(key), lambda x: x.try_cast("double"))
    zipped = F.arrays_zip(words("datekey").alias("period"), numbers("revenue").alias("revenue"), numbers("netinc").alias("earnings"))
    n = F.least(*(F.size(words(k)) for k in ("datekey", "revenue", "netinc")))
    return pages.where(F.col("html").contains("financialData")).select("company", F.inline(F.slice(zipped, F.lit(1), n))).where("period != ''")


def submissions(json: DataFrame) -> DataFrame:
    """company and a row for each filing of columnar submissions; missing tail cells are empty. json: company, body."""
    names = ("accessionNumber", "form", "filingDate", "reportDate", "items", "primaryDocument")
    r = json.select("company", F.from_json("body", RECENT).alias("j")).select("company", "j.filings.recent.*")
    rows = r.select("company", F.inline(F.arrays_zip(*(F.col(n) for n in names))))
    return rows.select("company", *(F.coalesce(n, F.lit("")).alias(n) for n in names))


def plain_text(rows: DataFrame) -> DataFrame:
    """title: the first line, if it has 120 characters at most. rows: text."""
    first = F.trim(F.substring_index("text", "\n", 1))
    return rows.withColumn("title", F.when(F.length(first) <= 120, first).otherwise(""))


def by_format(suffix: Column, content_type: Column) -> Column:
    """'html', 'pdf' or 'txt'."""
    low = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(low.contains("pdf") | (F.lower(suffix) == ".pdf"), "pdf").when(low.contains("html") | F.lower(suffix).isin(".html", ".htm"), "html").otherwise("txt")


def submission_documents(rows: DataFrame) -> DataFrame:
    """seq, type, filename, description, body of each <DOCUMENT> block. rows: key, text."""
    blocks = rows.select("key", F.posexplode(F.regexp_extract_all("text", F.lit("(?is)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))).alias("seq", "b"))
    field = lambda n: F.trim(F.regexp_extract("b", rf"(?i)<{n}>([^\r\n<]*)", 1)).alias(n.lower())
    return blocks.select("key", "seq", field("TYPE"), field("FILENAME"), field("DESCRIPTION"), F.regexp_replace(F.regexp_extract("b", r"(?is)<TEXT>(.*?)</TEXT>", 1), r"^\s+|\s+$", "").alias("body"))


def feed_items(rows: DataFrame) -> DataFrame:
    """seq, title, description, link, published of a feed's items; without title or link an item goes. rows: key, xml."""
    blocks = rows.select("key", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("seq", "b"))
    field = lambda n: html_text(F.regexp_replace(F.regexp_extract("b", rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    items = blocks.select("key", "seq", field("title").alias("title"), field("description").alias("description"), field("link").alias("link"), field("pubDate").alias("published"))
    return items.where("title != '' AND link != ''")


def sitemap_urls(rows: DataFrame) -> DataFrame:
    """Distinct locations of a sitemap. rows: key, xml."""
    return rows.select("key", F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url")).distinct()


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, seq, link, label, same_host: a page's links to http addresses, relative ones resolved, the first of each. pages: page_id, url, html."""
    anchor = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"'#]+)[^>]*>(.*?)</a\s*>"
    pairs = F.zip_with(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)), lambda h, t: F.struct(h.alias("h"), t.alias("t")))
    rows = pages.select("page_id", "url", F.posexplode(pairs).alias("seq", "p"))
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    href = F.trim("p.h")
    link = F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(origin, href))
    own = rows.select("page_id", "seq", link.alias("link"), collapsed(html_text(F.col("p.t"))).alias("label"), origin.alias("_o")).where("link IS NOT NULL")
    host = lambda c: F.lower(F.regexp_extract(c, r"^https?://([^/:?#]+)", 1))
    own = own.withColumn("same_host", host("link") == host("_o")).drop("_o")
    return own.withColumn("_k", F.row_number().over(Window.partitionBy("page_id", "link").orderBy("seq"))).where("_k = 1").drop("_k")


def anchors_by_link(links: DataFrame) -> DataFrame:
    """One row a link with the distinct labels joined in order; a label contained in what stands already is left out. links: page_id, seq, link, label."""
    labels = F.transform(F.sort_array(F.collect_list(F.struct("seq", "label"))), lambda x: x["label"])
    joined = F.aggregate("labels", F.lit(""), lambda a, t: F.when((t == "") | F.lower(a).contains(F.lower(t)), a).when(a == "", t).otherwise(F.concat(a, F.lit(" "), t)))
    return links.groupBy("page_id", "link").agg(labels.alias("labels")).select("page_id", "link", joined.alias("label"))


def latest(rows: DataFrame, keys: list[str], version: int) -> DataFrame:
    """The latest row of each key at or above a schema version. rows: keys, schema_version, created_at."""
    rest = [c for c in rows.columns if c not in (*keys, "created_at")]
    own = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("schema_version"), F.xxhash64(*rest))  # rows alike in time: reruns agree
    return rows.where(F.col("schema_version") >= version).withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")


def is_fresh(created: Column, release: Column, now: Column, version: Column, least_version: int, changed: Column | None = None) -> Column:
    """Of the current schema, not older than what it depends on, and within 6 hours if released in the last 180 days, else 30 days."""
    age = F.unix_timestamp(now) - F.unix_timestamp(created)
    ttl = F.when(F.datediff(F.to_date(now), release) <= 180, 6 * 3600).otherwise(30 * 86400)
    fresh = (version >= least_version) & (age <= ttl)
    return fresh if changed is None else fresh & (F.coalesce(created >= changed, F.lit(True)))


def directory_rows(json: DataFrame) -> DataFrame:
    """key, ordinal, href, text, kind of a filing's index; names with a slash go. json: key, body."""
    schema = "directory struct<item: array<struct<name: string, type: string>>>"
    items = json.select("key", F.posexplode(F.from_json("body", schema)["directory"]["item"]).alias("ordinal", "i"))
    name = F.trim(F.coalesce("i.name", F.lit("")))
    return items.select("key", "ordinal", name.alias("href"), name.alias("text"), F.coalesce("i.type", F.lit("")).alias("kind")).where("href != '' AND NOT contains(href, '/')")


def nested_sitemaps(rows: DataFrame, score: Column, most: int = 8) -> DataFrame:
    """key, url: a sitemap's own pages, or for an index the `most` best child sitemaps, by `score` over the column url, the first of equals. rows: key, xml."""
    index = F.col("xml").rlike("(?i)<sitemapindex")
    urls = rows.select("key", index.alias("is_index"), F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("ordinal", "url"))
    urls = urls.groupBy("key", "is_index", "url").agg(F.min("ordinal").alias("ordinal")).withColumn("score", F.when(F.col("is_index"), score).otherwise(0))
    ranked = urls.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "ordinal")))
    return ranked.where(~F.col("is_index") | (F.col("_k") <= most)).select("key", "url", "is_index")


def needs_page_reading(text: Column, images: Column) -> Column:
    """Whether a page is mostly pictures: three and more, with little text beside them. images: array of addresses."""
    n, length = F.size(images), F.length(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return (n >= 3) & (((n >= 8) & (length / n < 1300)) | (length < F.greatest(F.lit(6000), n * 420)))


def needs_scan_reading(pages: Column) -> Column:
    """Whether a document of pages (array of their texts) is mostly scanned: four pages under 80 characters, or three and a quarter of all with little text in all."""
    lengths = F.transform(pages, lambda p: F.length(F.trim(F.regexp_replace(p, r"\s+", " "))))
    sparse = F.size(F.filter(lengths, lambda n: n < 80))
    whole = F.aggregate(lengths, F.lit(0), lambda a, n: a + n)
    return (F.size(pages) >= 3) & ((sparse >= 4) | ((sparse >= F.greatest(F.lit(3), F.floor(F.size(pages) / 4))) & (whole < 18000)))


#: Words that a page read from a picture has.
SCAN_WORDS = ("Revenue", "Margin", "Application", "Technology", "Communication", "Computer", "Consumer", "Balance Sheets", "Cash Flows", "Guidance")


def usable_scan(text: Column) -> Column:
    """Whether text read from pictures has three of the words and few odd characters."""
    part = F.regexp_extract(text, r"(?s)(=== page-.*)$", 1)
    odd = F.length(part) - F.length(F.regexp_replace(part, r"[^\x00-\x7F]", ""))
    return (part != "") & (sum((part.contains(w).cast("int") for w in SCAN_WORDS[1:]), part.contains(SCAN_WORDS[0]).cast("int")) >= 3) & (odd <= F.greatest(F.lit(40), F.floor(F.length(part) / 90)))


def uploads(files: DataFrame, allowed: tuple[str, ...] = (".pdf", ".txt", ".html", ".htm")) -> DataFrame:
    """id, filename, suffix, text of accepted uploads. files: as spark.read.format('binaryFile') gives them. A PDF's text isn't read here and is null."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    text = F.decode("content", "UTF-8")
    own = files.select(F.sha2("content", 256).alias("id"), name.alias("filename"), suffix.alias("suffix"), F.when(suffix.isin(".html", ".htm"), html_text(text)).when(suffix != ".pdf", text).alias("text"))
    return own.where(F.col("suffix").isin(*allowed))


def refreshed(materials: DataFrame, disabled: Column) -> DataFrame:
    """Cached materials with excerpt and length of the text they have now; without one, a placeholder that says why. materials: label, url, kind, role, status, excerpt, text_length, text."""
    cached = F.col("text").isNotNull()
    status = F.when(cached, F.when(disabled, "cached").otherwise(F.col("status"))).otherwise(F.when(disabled, "disabled").otherwise(F.col("status")))
    text = F.trim("text")
    return materials.withColumns({"excerpt": F.when(cached, excerpt(collapsed(text), 240)).otherwise(""), "text_length": F.when(cached, F.length(text)).otherwise(0), "from_cache": cached, "status": status}).drop("text")


def upsert(stored: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """stored with the rows of `rows` in place of those with their keys."""
    return stored.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows)


def store(df: DataFrame, path: str, *partitions: str) -> None:
    """Adds rows to a table of Parquet files."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def pending(targets: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Targets not done yet: a run resumes where the last one stopped."""
    return targets.join(done.select(*keys).distinct(), list(keys), "left_anti")
