"""Queries of readers and extraction over texts that are written from the tables, so that SQL knows the answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartermill.functions import extract as E
from quartermill.functions import geographies as G
from quartermill.functions import issuers as I
from quartermill.functions import numbers as N
from quartermill.functions import periods as P
from quartermill.functions import tables as H
from quartermill.functions import text as S
from quartermill.operators import quality as Q
from quartermill.operators import structure as T
from quartermill.plans import sql
from quartermill.plans.base import spread, table
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


def said(*parts):
    """A text from columns and strings."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def whole(name: str):
    return F.floor(F.col(name)).cast("long")


@query("parse_numbers", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN -floor(o_totalprice) WHEN 2 THEN NULL ELSE floor(o_totalprice) / 100 END AS value, CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice) / 1000 WHEN 1 THEN -floor(o_totalprice) WHEN 3 THEN floor(o_totalprice) / 100 / 1000 END AS billions FROM orders""")
def parse_numbers(spark, d):
    k, v = F.col("o_orderkey") % 4, F.format_number(whole("o_totalprice"), 0)
    token = F.when(k == 0, F.concat(F.lit("$ "), v)).when(k == 1, F.concat(F.lit("("), v, F.lit(")"))).when(k == 2, "—").otherwise(F.concat((whole("o_totalprice") / 100).cast("decimal(18,2)").cast("string"), F.lit("%")))
    value = N.parsed(token)
    return table(spark, d, "orders").select("o_orderkey", value.alias("value"), N.in_billions(value, F.when(k % 2 == 0, "million").when(k == 3, "millions")).alias("billions"))


@query("row_metric", """SELECT o_orderkey, floor(o_totalprice) * 0.001::DOUBLE AS value, (o_custkey + 1) * 0.001::DOUBLE AS prior, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 90)::DOUBLE
 WHEN abs((floor(o_totalprice) / (o_custkey + 1) - 1) * 100) <= 500 THEN (floor(o_totalprice) / (o_custkey + 1) - 1) * 100 END AS yoy FROM orders""")
def row_metric(spark, d):
    v = F.format_number(whole("o_totalprice"), 0)
    text = F.when(F.col("o_orderkey") % 2 == 0, said("Other 1 2\nTotal revenue $ ", v, " $ ", F.col("o_custkey") + 1, " ", F.col("o_orderkey") % 90, "%\n")).otherwise(said("Total revenue ", v, "  ", F.col("o_custkey") + 1, "\nEnd"))
    found = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(E.metric(text, ["Net sales", "Total revenue"]))).alias("m"))  # computed once for three fields
    return found.select("o_orderkey", "m.value", "m.prior", "m.yoy")


@query("narrative_metric", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 900 + 10) / 10.0::DOUBLE ELSE (o_orderkey % 900 + 10) / 10.0::DOUBLE * 0.001 END AS value, CASE o_orderkey % 3 WHEN 0 THEN (o_custkey % 50)::DOUBLE WHEN 1 THEN -(o_custkey % 50)::DOUBLE END AS yoy FROM orders""")
def narrative_metric(spark, d):
    k = F.col("o_orderkey")
    amount, pct = ((k % 900 + 10) / 10).cast("decimal(10,1)"), F.col("o_custkey") % 50
    text = F.when(k % 3 == 0, said("Revenue was $", amount, " billion, up ", pct, "% from a year ago.")).when(k % 3 == 1, said("The quarter's $", amount, " million of total revenue was down ", pct, "%.")).otherwise(said("Revenues were $", amount, " million, relatively unchanged."))
    found = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(E.narrative(text, r"(?:total\s+)?revenues?"))).alias("m"))
    return found.select("o_orderkey", "m.value", "m.yoy")


@query("company_narrative", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 90 + 10 AS a, o_custkey % 90 + 10 AS b FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 3 = 0 THEN b WHEN k % 3 = 1 THEN a ELSE a * 0.001 END::DOUBLE AS value, CASE WHEN k % 3 = 0 THEN 7 WHEN k % 3 = 1 THEN -4 END::DOUBLE AS yoy FROM o""")
def company_narrative(spark, d):
    """A year's figure before a quarter's; two alike; one sentence in another order."""
    k, a, b = F.col("o_orderkey") % 3, F.col("o_orderkey") % 90 + 10, F.col("o_custkey") % 90 + 10
    far = " x" * 120
    text = F.when(k == 0, said("Revenue was $", a, " billion for the fiscal year." + far + ". Total revenue for the quarter was $", b, " billion, up 7% from before.")).when(k == 1, said("Revenue was $", a, " billion, down 4%." + far + ". Revenue was $", b, " billion.")).otherwise(said("We are pleased. Reported $", a, " million of revenue."))
    found = spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", F.explode(F.array(E.company_narrative(text, "(?:total )?revenue"))).alias("m"))
    return found.select("o_orderkey", "m.value", "m.yoy")


@query("segment_narrative", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN (o_custkey % 90 + 10) * 0.001::DOUBLE ELSE (o_custkey % 90 + 10)::DOUBLE END AS value, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 40)::DOUBLE WHEN 1 THEN -(o_orderkey % 40)::DOUBLE WHEN 2 THEN (o_orderkey % 40)::DOUBLE END AS yoy FROM orders""")
def segment_narrative(spark, d):
    k, v, pct = F.col("o_orderkey") % 4, F.col("o_custkey") % 90 + 10, F.col("o_orderkey") % 40
    text = F.when(k == 0, said("Cloud revenue increased ", pct, "% to $", v, " billion.")).when(k == 1, said("Cloud revenues of last year declined ", pct, "% from a peak to $", v, " billion.")).when(k == 2, said("Cloud revenue was $", v, " million and grew ", pct, "%.")).otherwise("Cloud matters.")
    found = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(E.segment_narrative(text, "Cloud"))).alias("m"))
    return found.select("o_orderkey", "m.value", "m.yoy")


@query("row_layouts", """WITH o AS (SELECT o_orderkey AS k, o_custkey + 1000 AS v, o_orderkey % 50 AS p FROM orders)
SELECT k AS o_orderkey, v * 0.001::DOUBLE AS pair, 2.0::DOUBLE AS pair_prior, round((v / 2000.0::DOUBLE - 1) * 100, 6) AS pair_yoy, v * 0.001::DOUBLE AS noted, p::DOUBLE AS noted_yoy, 5.0::DOUBLE AS last_quarter, 1.0::DOUBLE AS year_ago, (v + 10) * 0.001::DOUBLE AS three, -(p::DOUBLE) AS three_yoy, p::DOUBLE AS share, 1.25::DOUBLE AS eps FROM o""")
def row_layouts(spark, d):
    """One text with rows in each layout."""
    k, v, p = F.col("o_orderkey"), F.col("o_custkey") + 1000, F.col("o_orderkey") % 50
    number = F.format_number(v, 0)
    text = said("Cost 7 8\nSales ", number, " 2,000\nFees (1) (in millions) $ ", number, " $ 900 ", p, " %\nDeliveries 1,000 2,000 — 4,000 5,000 (3)%\nPlatform ", F.format_number(v + 10, 0), " 50 60 Up 4% Down ", p, "%\nMargin rate ", p, " % 40 %\nDiluted EPS $ 1.25 $ 1.00\n")
    fields = F.struct(E.metric(text, ["Nothing", "Sales"]).alias("a"), E.metric(text, ["Fees"]).alias("b"), E.row_five_quarters(text, "Deliveries").alias("c"), E.row_both_changes(text, "Platform").alias("e"), E.percent_metric(text, ["Margin rate"]).alias("f"), E.row_per_share(text, "Diluted EPS").alias("g"))
    rows = spread(table(spark, d, "orders"), "o_orderkey").select(k, F.explode(F.array(fields)).alias("r"))
    return rows.select("o_orderkey", F.col("r.a.value").alias("pair"), F.col("r.a.prior").alias("pair_prior"), F.round("r.a.yoy", 6).alias("pair_yoy"), F.col("r.b.value").alias("noted"), F.col("r.b.yoy").alias("noted_yoy"), F.col("r.c.value").alias("last_quarter"), F.col("r.c.prior").alias("year_ago"), F.col("r.e.value").alias("three"), F.col("r.e.yoy").alias("three_yoy"), F.col("r.f").alias("share"), F.col("r.g.value").alias("eps"))


@query("profit_signals", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS m, (o_custkey % 40 + 10) / 10.0::DOUBLE AS r, (o_orderkey % 60 + 10) / 10.0::DOUBLE AS a, 20.3::DOUBLE AS rev FROM orders),
s AS (SELECT *, m != 2 AS special, CASE WHEN m IN (0, 1, 2) THEN r END AS rep, CASE WHEN m != 1 THEN a END AS adj FROM o)
SELECT k AS o_orderkey, special, round(rep, 6) AS reported, round(adj, 6) AS adjusted, CASE WHEN adj IS NULL THEN false WHEN rep IS NULL THEN special ELSE special AND abs(adj - rep) >= greatest(0.35, rev * 0.08) AND (adj / rep >= 1.35 OR (rep / rev <= 0.12 AND adj / rev >= rep / rev + 0.08)) END AS prefers FROM s""")
def profit_signals(spark, d):
    m = F.col("o_orderkey") % 4
    r, a = F.col("o_custkey") % 40 + 10, F.col("o_orderkey") % 60 + 10
    money = lambda x: (x / 10).cast("decimal(8,1)")
    rows = lambda x: F.format_number(x * 100, 0)
    text = (
        F.when(m == 0, said("Restructuring. Net income, as reported (1) $ ", rows(r), " 900\nNet income, as adjusted ", rows(a), " 800"))
        .when(m == 1, said("An impairment was taken. GAAP net income was $", money(r), " billion, or $1.20 per share."))
        .when(m == 2, said("Net income was $", money(r), " billion, and 1.10 per share. Non-GAAP net income was $", money(a), " billion or $2.00 per share."))
        .otherwise(said("One-time items. Adjusted quarterly net income of $", money(a), " billion or $3.10 per share"))
    )
    found = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(E.profit_signal(text))).alias("s"))
    return found.select("o_orderkey", "s.special", F.round("s.reported", 6).alias("reported"), F.round("s.adjusted", 6).alias("adjusted"), E.prefers_adjusted(F.col("s"), F.lit(20.3)).alias("prefers"))


@query("equity_scale", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 4 = 3 THEN NULL ELSE round(floor(o_totalprice) * CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.001 ELSE 0.000001 END::DOUBLE, 6) END AS equity FROM orders""")
def equity_scale(spark, d):
    k = F.col("o_orderkey")
    scale = F.get(F.array(*map(F.lit, ("(in billions)", "(In millions)", "in thousands", "in units"))), (k % 4).cast("int"))
    text = F.concat(F.when(k % 5 != 4, "Consolidated Balance Sheets ").otherwise("Notes "), scale, said(" Total assets 5 6 Total shareholders' equity (a) $ ", F.format_number(whole("o_totalprice"), 0), " 7,000"))
    return table(spark, d, "orders").select("o_orderkey", F.round(E.ending_equity(text), 6).alias("equity"))


@query("guidance_extract", """WITH g AS (SELECT o_orderkey, (o_orderkey % 500 + 10)::DOUBLE AS a, (o_orderkey % 500 + 20)::DOUBLE AS b, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'range' WHEN 1 THEN 'tolerance' WHEN 2 THEN 'point' WHEN 3 THEN 'context' WHEN 5 THEN 'range' END AS kind, round(CASE k WHEN 0 THEN a WHEN 5 THEN a * 0.001 WHEN 1 THEN a * 0.98 END, 6) AS low, round(CASE k WHEN 0 THEN b WHEN 5 THEN b * 0.001 WHEN 1 THEN a * 1.02 END, 6) AS high, round(CASE k WHEN 0 THEN (a + b) / 2 WHEN 5 THEN (a + b) / 2000 WHEN 1 THEN a WHEN 2 THEN a END, 6) AS mid FROM g""")
def guidance_extract(spark, d):
    k, a, b = F.col("o_orderkey") % 6, F.col("o_orderkey") % 500 + 10, F.col("o_orderkey") % 500 + 20
    text = (
        F.when(k == 0, said("We expect revenue between $", a, " billion and $", b, " billion next quarter."))
        .when(k == 1, said("Net revenue is expected to be $", a, " billion, plus or minus two %."))
        .when(k == 2, said("We expect revenue of about US$", a, " billion."))
        .when(k == 3, "Our outlook is unchanged.")
        .when(k == 4, "We expect adoption of note 2 to change the accounting; outlook unchanged.")
        .otherwise(said("Sales are expected to come in between EUR ", a, " million and EUR ", b, " million."))
    )
    found = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(E.guidance(text))).alias("g"))
    return found.select("o_orderkey", "g.kind", "g.low", "g.high", "g.mid")


def statement(spark, d):
    row = lambda *cells: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.lit(c) if isinstance(c, str) else c.cast("string"), F.lit("</td>")) for c in cells), F.lit("</tr>"))
    v, w = F.format_number(whole("o_totalprice"), 0), F.col("o_custkey") + 1
    head = "<tr><td>(In millions)</td></tr><tr><th>Nine Months Ended</th><th>Three Months Ended</th></tr><tr><th>September 30, 2024</th><th>September 30, 2023</th><th>September 30, 2024</th><th>September 30, 2023</th></tr>"
    body = F.concat(row("Cost", "5", "6", "7", "8"), row("Total revenue", F.lit("9"), F.lit("8"), F.concat(F.lit("$"), v), w), row("Margin", "1", "%", "2", "%", "3", "%", "4", "%"))
    return spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", F.concat(F.lit("<html><table>" + head), body, F.lit("</table></html>")).alias("html"))


@query("html_statement_metric", "SELECT o_orderkey, round(floor(o_totalprice) * 0.001::DOUBLE, 3) AS value, round((o_custkey + 1) * 0.001::DOUBLE, 3) AS prior FROM orders")
def html_statement_metric(spark, d):
    pages = statement(spark, d)
    rows = pages.select("o_orderkey", F.explode(H.html_tables(F.col("html"))).alias("t"))
    m = H.statement_metric(F.col("t"), ["Revenue", "Total revenue"], F.lit(2024 * 4 + 2))
    found = rows.select("o_orderkey", F.explode(F.array(m)).alias("m"))  # computed once for both fields
    return found.select("o_orderkey", "m.value", "m.prior")


@query("html_table_cells", """WITH o AS (SELECT o_orderkey, unnest([['(In millions)'], ['Nine Months Ended', 'Three Months Ended'], ['September 30, 2024', 'September 30, 2023', 'September 30, 2024', 'September 30, 2023'], ['Cost', '5', '6', '7', '8'], ['Total revenue', '9', '8', '$' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), (o_custkey + 1)::VARCHAR], ['Margin', '1%', '2%', '3%', '4%']]) AS cells, unnest(range(6)) AS place FROM orders) SELECT o_orderkey, CAST(place AS INTEGER) AS place, array_to_string(cells, '|') AS cells FROM o""")
def html_table_cells(spark, d):
    rows = statement(spark, d).select("o_orderkey", F.explode(H.html_tables(F.col("html"))).alias("t"))
    return rows.select("o_orderkey", F.posexplode("t").alias("place", "cells")).select("o_orderkey", "place", F.array_join("cells", "|").alias("cells"))


@query("quarter_input", """SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 AND o_orderkey % 8 NOT IN (5, 7) THEN year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR END AS label FROM orders""")
def quarter_input(spark, d):
    """Years before 2000 aren't read."""
    y, q, k = F.year("o_orderdate"), F.quarter("o_orderdate"), F.col("o_orderkey") % 8
    spelled = F.get(F.array(*map(F.lit, "一二三四")), q - 1)
    text = F.when(k == 0, said(y, "Q", q)).when(k == 1, said("Q", q, " ", y)).when((k == 2) & (y >= 2000), said(q, "Q", F.substring(y.cast("string"), 3, 2))).when(k == 2, said(y, "-Q", q)).when(k == 3, said("FY", y, " Q", q)).when(k == 4, said(y, "年第", q, "季度")).when(k == 6, F.concat(y.cast("string"), F.lit("年"), spelled, F.lit("季度"))).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", P.normal_quarter(text).alias("label"))


@query("company_facts", """SELECT o_custkey AS company, 'Revenues' AS concept, 'USD' AS unit, 0 AS unit_rank, o_orderkey AS val, CAST(70 + o_orderkey % 60 + 1 AS INTEGER) AS days FROM orders WHERE 70 + o_orderkey % 60 + 1 BETWEEN 70 AND 110
UNION ALL SELECT o_custkey, 'StockholdersEquity', 'EUR', 1, o_orderkey + 5, NULL FROM orders""")
def company_facts(spark, d):
    """Facts over a quarter, and at a day."""
    end = F.date_add(F.lit("2024-01-01").cast("date"), (70 + F.col("o_orderkey") % 60).cast("int"))
    fact = said('{"start":"2024-01-01","end":"', F.date_format(end, "yyyy-MM-dd"), '","val":', F.col("o_orderkey"), ',"form":"10-Q"}')
    body = F.concat(F.lit('{"facts":{"us-gaap":{"Revenues":{"units":{"USD":['), fact, said('],"shares":[{"val":1}]}},"StockholdersEquity":{"units":{"EUR":[{"end":"2024-03-31","val":', F.col("o_orderkey") + 5, "}]}}}}}"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("company"), body.alias("body"))
    return R.quarterly_facts(R.company_facts(rows)).select("company", "concept", "unit", "unit_rank", "val", "days")


@query("submission_rows", """SELECT o_orderkey AS company, 'a' || o_orderkey AS "accessionNumber", '10-Q' AS form, '2024-05-01' AS "filingDate", '' AS items FROM orders UNION ALL SELECT o_orderkey, 'b' || o_orderkey, '8-K', '2024-06-01', '2.02' FROM orders""")
def submission_rows(spark, d):
    k = F.col("o_orderkey")
    body = said('{"filings":{"recent":{"accessionNumber":["b', k, '","a', k, '"],"form":["8-K","10-Q"],"filingDate":["2024-06-01","2024-05-01"],"items":["2.02"],"reportDate":[],"primaryDocument":[]}}}')
    return R.submissions(table(spark, d, "orders").select(k.alias("company"), body.alias("body"))).select("company", "accessionNumber", "form", "filingDate", "items")


@query("feed_items", """WITH o AS (SELECT o_orderkey AS key, o_custkey AS c, CAST(unnest(range(0, 4)) AS INTEGER) AS seq FROM orders) SELECT key, seq, CASE seq WHEN 0 THEN 'Order ' || key || ' & more' ELSE 'Plain ' || seq END AS title, 'http://x/' || c AS link FROM o WHERE seq != (key + 1) % 4 AND (seq = 0 OR (key + seq) % 3 != 0)""")
def feed_items(spark, d):
    """Of four items one has no link, and some of the others no title."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    item = lambda n, title: F.concat(F.lit("<item>"), title, F.when((k + 1) % 4 != n, said("<link>http://x/", c, "</link>")).otherwise("<link></link>"), F.lit("<pubDate>Mon</pubDate></item>"))
    plain = lambda n: F.when((k + n) % 3 != 0, F.lit(f"<title>Plain  {n}</title>")).otherwise("<title> </title>")
    xml = F.concat(F.lit("<rss><channel>"), item(0, said("<title><![CDATA[Order ", k, " &amp; more]]></title>")), *(item(n, plain(n)) for n in (1, 2, 3)), F.lit("</channel></rss>"))
    return R.feed_items(table(spark, d, "orders").select(k.alias("key"), xml.alias("xml"))).select("key", "seq", "title", "link")


@query("submission_documents", """WITH o AS (SELECT o_orderkey AS key, o_custkey AS c, CAST(unnest(range(0, 1 + o_orderkey % 3)) AS INTEGER) AS seq FROM orders) SELECT key, seq, CASE WHEN seq = 0 THEN '10-Q' ELSE 'EX-99.' || seq END AS type, CASE WHEN seq = 0 THEN 'a.htm' ELSE '' END AS filename, CASE WHEN seq = 0 THEN 'main ' || key ELSE 'text ' || c || ' ' || seq END AS body FROM o""")
def submission_documents(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    exhibit = lambda n: F.when(k % 3 >= n, said(f"<DOCUMENT>\n<TYPE>EX-99.{n}\n<TEXT>text ", c, f" {n}</TEXT></DOCUMENT>")).otherwise("")
    text = F.concat(said("<SEC><DOCUMENT>\n<TYPE>10-Q\n<FILENAME>a.htm\n<TEXT>\nmain ", k, "\n</TEXT>\n</DOCUMENT>"), exhibit(1), exhibit(2))
    return R.submission_documents(table(spark, d, "orders").select(k.alias("key"), text.alias("text"))).select("key", "seq", "type", "filename", "body")


@query("page_block", "SELECT o_orderkey AS company, unnest(['2024-03-31', '2023-12-31']) AS period, unnest([o_custkey::DOUBLE, NULL]) AS revenue, unnest([1.5::DOUBLE, 2.5::DOUBLE]) AS earnings FROM orders")
def page_block(spark, d):
    html = said('<script>x = {financialData:{datekey:["2024-03-31","2023-12-31","2023-09-30"],revenue:[', F.col("o_custkey"), ",null,7],netinc:[1.5,2.5]}}</script>")
    return R.financial_block(table(spark, d, "orders").select(F.col("o_orderkey").alias("company"), html.alias("html")))


@query("material_structures", "SELECT company, quarter_index, name, value, prior FROM (SELECT o_orderkey AS company, CAST(8000 AS INTEGER) AS quarter_index, unnest(['Cloud', 'Devices']) AS name, unnest([(o_custkey + 100) * 0.001::DOUBLE, 1.5::DOUBLE]) AS value, unnest([0.2::DOUBLE, 1.25::DOUBLE]) AS prior FROM orders)")
def material_structures(spark, d):
    orders = table(spark, d, "orders")
    first = orders.select(F.col("o_orderkey").alias("company"), F.lit(8000).alias("quarter_index"), F.lit(0).alias("material_rank"), said("Cloud services ", F.col("o_custkey") + 100, " 200 rest").alias("text"))
    second = orders.select(F.col("o_orderkey").alias("company"), F.lit(8000).alias("quarter_index"), F.lit(1).alias("material_rank"), F.lit("Cloud services 1 2\nDevices 1,500 1,250").alias("text"))
    labels = orders.select(F.col("o_orderkey").alias("company"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("label_rank"), F.lit(x).alias("label")) for n, r, x in (("Cloud", 0, "Cloud"), ("Cloud", 1, "Cloud services"), ("Devices", 0, "Devices"))))).alias("l")).select("company", "l.*")
    return E.structures(first.unionByName(second), labels)


@query("parsed_materials", "SELECT o_orderkey AS company, floor(o_totalprice) * 0.001::DOUBLE AS revenue, 2.5::DOUBLE AS net_income, 1.23::DOUBLE AS eps, CASE WHEN o_orderkey % 2 = 0 THEN 7.5 END::DOUBLE AS equity, CASE WHEN o_orderkey % 3 = 0 THEN 30.0 END::DOUBLE AS guided FROM orders")
def parsed_materials(spark, d):
    """Two materials of a quarter: what the first lacks comes from the second."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(k.alias("company"), F.lit(8000).alias("quarter_index"), "o_totalprice")
    a = orders.select("company", "quarter_index", F.lit(0).alias("material_rank"), F.concat(said("Total revenue ", F.format_number(whole("o_totalprice"), 0), " 10\nNet income was $2.5 billion, up 4%."), F.when(F.col("company") % 3 == 0, "\nWe expect revenue of $30 billion.").otherwise("")).alias("text"))
    b = orders.select("company", "quarter_index", F.lit(1).alias("material_rank"), F.concat(F.lit("Total revenue 9 9\nDiluted earnings per share 1.23 1.10\n"), F.when(F.col("company") % 2 == 0, "Balance sheet (in millions)\n").otherwise("\n"), F.lit("Total shareholders' equity 7,500 7,000")).alias("text"))
    every = E.parse_materials(a.unionByName(b))
    return every.select("company", F.col("revenue.value").alias("revenue"), F.col("net_income.value").alias("net_income"), "eps", "equity", F.col("guidance.mid").alias("guided"))


@query("quote_cards", """WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS k, 'We shipped ' || o_custkey || ' units and customers asked for more of them' AS q FROM orders), e AS (SELECT o_orderkey, unnest([{'s': 'Jane Roe', 'q': q || ','}, {'s': CASE k WHEN 0 THEN 'Chief of Staff' WHEN 2 THEN 'Jane Roe' END, 'q': CASE k WHEN 0 THEN 'Another ' || q ELSE q END}]) AS e FROM o)
SELECT o_orderkey, e.s AS speaker, e.q AS quote FROM e WHERE e.s IS NOT NULL""")
def quote_cards(spark, d):
    """Words before the speaker, after one, and after a colon, at times an operator's."""
    k = F.col("o_orderkey") % 3
    quote = said("We shipped ", F.col("o_custkey"), " units and customers asked for more of them")
    other = F.when(k == 0, F.concat(F.lit('Chief of Staff: "Another '), quote, F.lit('"'))).when(k == 1, F.concat(F.lit('Operator: "Another '), quote, F.lit('"'))).otherwise(F.concat(F.lit('Jane Roe said, "'), quote, F.lit('"')))
    text = F.concat(F.lit('Intro.\n"'), quote, F.lit('," said Jane Roe.\n'), other)
    return spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", F.explode(S.quotes(text)).alias("q")).select("o_orderkey", "q.speaker", "q.quote")


@query("payload_quality", """WITH p AS (SELECT o_orderkey, o_orderkey % 5 = 0 AS no_revenue, o_orderkey % 3 AS qna, o_orderkey % 4 AS mgmt FROM orders), i AS (SELECT *, CASE WHEN no_revenue THEN 1 ELSE 0 END AS critical, CASE WHEN qna < 2 THEN 1 ELSE 0 END AS major, CASE WHEN mgmt < 2 THEN 1 ELSE 0 END AS minor FROM p)
SELECT o_orderkey, critical, major, minor, 100 - 25 * critical - 10 * major - 4 * minor AS score, CASE WHEN critical > 0 THEN 'fail' WHEN 100 - 10 * major - 4 * minor < 82 THEN 'review' ELSE 'pass' END AS status FROM i""")
def payload_quality(spark, d):
    k = F.col("o_orderkey")
    items = F.array(F.struct(F.col("o_totalprice").alias("value"), F.lit("segment").alias("scope")))
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k % 5 != 0, F.col("o_totalprice")).alias("revenue"), F.lit(1.0).alias("net_income"), F.lit(40.0).alias("gross_margin"), F.lit(10.0).alias("net_margin"), items.alias("segments"), F.array().cast("array<struct<value:double,scope:string>>").alias("geographies"),
        F.lit("segment").alias("structure"), F.lit(12).alias("history_count"), F.lit(12).alias("history_window"), F.lit(0).alias("missing_revenue"), F.lit(0).alias("missing_net_income"), F.lit(1.0).alias("segment_coverage"), F.lit(0.0).alias("geography_coverage"),
        (k % 3).cast("int").alias("qna"), (k % 4).cast("int").alias("management"), F.lit(3).alias("evidence"), F.lit(2).alias("quotes"), F.array(F.struct(F.lit("fetched").alias("status"), F.lit(900).alias("text_length"), F.lit("sec_filing").alias("role"))).alias("materials"), F.lit(0).alias("fallback_lines"))
    return Q.evaluate(rows).select("o_orderkey", "critical", "major", "minor", "score", "status")


@query("promoted_structures", """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS s, (p_partkey // 3) % 4 AS g FROM part), e AS (SELECT k, CASE WHEN s = 0 AND g >= 2 THEN 'geo_proxy' ELSE 'segment' END AS scope, unnest(range(0, CASE WHEN s = 0 AND g >= 2 THEN g ELSE s END)) AS n FROM p)
SELECT k AS p_partkey, CASE WHEN scope = 'segment' THEN 's' ELSE 'g' END || n AS name, (k + n)::DOUBLE AS value, scope FROM e""")
def promoted_structures(spark, d):
    k = F.col("p_partkey")
    own = lambda letter, n: F.slice(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.concat(F.lit(letter), i.cast("string")).alias("name"), (k + i).cast("double").alias("value"))), F.lit(1), n.cast("int"))
    rows = table(spark, d, "part").select("p_partkey", own("s", k % 3).alias("segments"), own("g", F.floor(k / 3) % 4).alias("geographies"))
    return T.promoted(rows).select("p_partkey", F.explode("segments").alias("s")).select("p_partkey", "s.*")


# ---- issuers ---------------------------------------------------------------------------------------------------------------


def materials(spark, d, text, **more):
    """One material of each order: company the order, quarter 8000."""
    orders = spread(table(spark, d, "orders"), "o_orderkey")
    return orders.select(F.col("o_orderkey").alias("company"), F.lit(8000).alias("quarter_index"), F.lit(0).alias("material_rank"), text.alias("text"), *(v.alias(k) for k, v in more.items()))


def flat(out, *metrics):
    """company, metrics and the segments as one text."""
    items = F.array_join(F.transform("segments", lambda s: F.concat(s["name"], F.lit("="), F.round(s["value"], 3).cast("decimal(18,3)").cast("string"), F.lit("/"), F.coalesce(F.round(s["yoy"], 1).cast("decimal(9,1)").cast("string"), F.lit("-")))), "; ")
    return out.select("company", *(F.round(F.col(m), 6).alias(m.replace(".", "_")) for m in metrics), items.alias("segments"))


def _seg(name, value, yoy):
    """SQL of a segment's text; value in billions."""
    return f"'{name}=' || CAST(CAST(round({value}, 3) AS DECIMAL(18,3)) AS VARCHAR) || '/' || {yoy}"


def _yoy(now, before):
    return f"CAST(CAST(round(({now} / ({before})::DOUBLE - 1) * 100, 1) AS DECIMAL(9,1)) AS VARCHAR)"


def amount():
    return F.col("o_custkey") + 2000


def spoken():
    return F.format_number(amount(), 0)


@query("issuer_microsoft", f"""WITH o AS (SELECT o_orderkey AS company, (o_custkey + 2000)::DOUBLE AS v FROM orders) SELECT company, round(v * 0.001, 6) AS revenue_value, round((v - 1000) / v * 100, 6) AS gross_margin, 2.5::DOUBLE AS net_income_value,
 CASE WHEN 2000 / v BETWEEN 0.55 AND 1.35 THEN {_seg('Intelligent Cloud', '1.2::DOUBLE', "'20.0'")} || '; ' || {_seg('More Personal Computing', '0.8::DOUBLE', "'5.0'")} ELSE '' END AS segments FROM o""")
def issuer_microsoft(spark, d):
    text = said("Total revenue $ ", spoken(), " $ 1,900\nTotal cost of revenue 1,000 900\nIntelligent Cloud 1,200 1,000\nMore Personal Computing 800 700 5 %\nNet income was $2.5 billion, up 3%.")
    return flat(I.parse_issuer(materials(spark, d, text), "microsoft"), "revenue.value", "gross_margin", "net_income.value")


@query("issuer_apple", f"""WITH o AS (SELECT o_orderkey AS company, o_orderkey % 2 = 0 AS old, (o_custkey + 2000)::DOUBLE AS v FROM orders) SELECT company, round(v * 0.001, 6) AS revenue_value, CASE WHEN old THEN 38.5 ELSE 44.1 END::DOUBLE AS gross_margin,
 CASE WHEN NOT (round(floor(v / 2) * 0.001, 3) + 1) / (v * 0.001) BETWEEN 0.55 AND 1.35 THEN '' ELSE {_seg('iPhone', 'floor(v / 2) * 0.001', _yoy('floor(v / 2)', '500'))} || '; ' || CASE WHEN old THEN {_seg('Mac', '1.0::DOUBLE', "'100.0'")} ELSE {_seg('Services', '1.0::DOUBLE', "'100.0'")} END END AS segments FROM o""")
def issuer_apple(spark, d):
    """Labels of earlier years where a text has them."""
    half = F.format_number(F.floor(amount() / 2), 0)
    old = said("Total net sales ", spoken(), " 1,000\nGross margin percentage 38.5 % 37.0 %\niPhone and related products and services ", half, " 500\nTotal Mac net sales 1,000 500\n")
    new = said("Total net sales ", spoken(), " 1,000\nTotal gross margin percentage 44.1 % 43.0 %\niPhone ", half, " 500\nServices 1,000 500\n")
    return flat(I.parse_issuer(materials(spark, d, F.when(F.col("o_orderkey") % 2 == 0, old).otherwise(new)), "apple"), "revenue.value", "gross_margin")


@query("issuer_alphabet", f"""WITH o AS (SELECT o_orderkey AS company, o_orderkey % 2 = 0 AS old, (o_custkey + 2000)::DOUBLE AS v FROM orders) SELECT company, round(v * 0.001, 6) AS revenue_value, CASE WHEN old THEN {_seg('Google properties', 'v * 0.001 - 0.5', _yoy('(v - 500)', '1000'))} || '; ' || {_seg('Other Bets', '0.3::DOUBLE', "'50.0'")} ELSE {_seg('Google Search & other', 'v * 0.001 - 0.5', _yoy('(v - 500)', '1000'))} || '; ' || {_seg('Google Cloud', '0.4::DOUBLE', "'100.0'")} END AS segments FROM o""")
def issuer_alphabet(spark, d):
    """The year before stands first."""
    rest = F.format_number(amount() - 500, 0)
    old = said("Revenues 1,500 ", spoken(), "\nGoogle properties revenues $ 1,000 $ ", rest, "\nOther Bets revenues 200 300\n")
    new = said("Revenues 1,500 ", spoken(), "\nGoogle Search & other $ 1,000 $ ", rest, "\nGoogle Cloud 200 400\n")
    return flat(I.parse_issuer(materials(spark, d, F.when(F.col("o_orderkey") % 2 == 0, old).otherwise(new)), "alphabet"), "revenue.value")


@query("issuer_amazon", f"""WITH o AS (SELECT o_orderkey AS company, (o_custkey + 2000)::DOUBLE AS v FROM orders) SELECT company, round(v * 0.001, 6) AS revenue_value, {_seg('North America', 'v * 0.001 - 0.5', _yoy('(v - 500)', '1000'))} || '; ' || {_seg('AWS', '0.4::DOUBLE', "'100.0'")} AS segments FROM o""")
def issuer_amazon(spark, d):
    text = said("Total net sales 1,500 ", spoken(), "\nNorth America Net sales 1,000 ", F.format_number(amount() - 500, 0), " 3 4\nAWS Net sales 200 400 5 6\n")
    return flat(I.parse_issuer(materials(spark, d, text), "amazon"), "revenue.value")


@query("issuer_nvidia", f"""WITH o AS (SELECT o_orderkey AS company, o_orderkey % 2 = 0 AS old, (o_custkey + 2000)::DOUBLE AS v, o_orderkey % 60 AS p FROM orders) SELECT company, round(v * 0.001, 6) AS revenue_value, CASE WHEN old THEN -p ELSE p END::DOUBLE AS revenue_yoy, 61.5::DOUBLE AS gross_margin,
 CASE WHEN old THEN {_seg('Gaming', 'v * 0.001 - 0.4', "'7.0'")} || '; ' || {_seg('Data Center', '0.4::DOUBLE', "'12.0'")} ELSE CASE WHEN 2.1 / (v * 0.001) BETWEEN 0.55 AND 1.35 THEN 'Data Center=2.000/70.0; Gaming=0.100/9.0' ELSE '' END END AS segments FROM o""")
def issuer_nvidia(spark, d):
    """Rows with directions in words before, with percentages and sentences now."""
    p = F.col("o_orderkey") % 60
    old = said("Revenue by Market Platform Revenue $ ", spoken(), " $ 1,900 $ 1,800 Up 3% Down ", p, "%\nGross margin 61.5 % 60 % 59 %\nGaming ", F.format_number(amount() - 400, 0), " 1 2 Up 3% Up 7%\nDatacenter 400 300 200 Up 4% Up 12%\n")
    new = said("Revenue $", spoken(), " $1,900 $1,800 3 % ", p, " %\nGross margin 61.5 % 60 % 59 %\nData Center Fourth-quarter revenue was a record $2.0 billion, up 20% from the previous quarter and up 70% from a year ago. Fourth-quarter Gaming revenue was $0.1 billion, up 9% from a year ago.")
    return flat(I.parse_issuer(materials(spark, d, F.when(F.col("o_orderkey") % 2 == 0, old).otherwise(new)), "nvidia"), "revenue.value", "revenue.yoy", "gross_margin")


@query("issuer_tesla", f"""WITH o AS (SELECT o_orderkey AS company, (o_custkey + 2000)::DOUBLE AS v, o_orderkey % 60 AS p FROM orders) SELECT company, round(v * 0.001, 6) AS revenue_value, p::DOUBLE AS revenue_yoy, 18.2::DOUBLE AS gross_margin, 0.9::DOUBLE AS free_cash_flow_value, {_seg('Automotive', 'v * 0.001 - 0.5', "'-4.0'")} || '; ' || {_seg('Energy Generation and Storage', '0.5::DOUBLE', "'25.0'")} AS segments FROM o""")
def issuer_tesla(spark, d):
    p = F.col("o_orderkey") % 60
    text = said("Total revenues 1,000 1,100 1,200 1,300 ", spoken(), " ", p, "%\nTotal GAAP gross margin 17.0% 17.5% 18.0% 18.1% 18.2% 12 bp\nFree cash flow — 1 2 3 900 5%\nTotal automotive revenues 1 2 3 4 ", F.format_number(amount() - 500, 0), " (4)%\nEnergy generation and storage revenue 400 1 1 1 500 25%\n")
    return flat(I.parse_issuer(materials(spark, d, text), "tsla"), "revenue.value", "revenue.yoy", "gross_margin", "free_cash_flow.value")


@query("issuer_micron", f"""WITH o AS (SELECT o_orderkey AS company, (o_custkey + 2000)::DOUBLE AS v FROM orders) SELECT company, round(v * 0.001, 6) AS revenue_value, round((v / 1000 - 1) * 100, 6) AS revenue_yoy, round(500 / v * 100, 6) AS gross_margin, {_seg('Cloud Memory Business Unit', 'v * 0.001 - 0.5', _yoy('(v - 500)', '1000'))} || '; ' || {_seg('Core Data Center Business Unit', '0.5::DOUBLE', "'25.0'")} AS segments FROM o""")
def issuer_micron(spark, d):
    """The year before stands third."""
    text = said("Cloud Memory Business Unit Revenue $ ", F.format_number(amount() - 500, 0), " $ 900 $ 1,000\nCore Data Center Business Unit Revenue 500 450 400\nRevenue $ ", spoken(), " $ 1,900 $ 1,000\nGross margin 500 400 300\n")
    return flat(I.parse_issuer(materials(spark, d, F.concat(said("Revenue $ ", spoken(), " $ 1,900 $ 1,000\n"), text)), "micron"), "revenue.value", "revenue.yoy", "gross_margin")


@query("issuer_walmart", """WITH o AS (SELECT o_orderkey AS company, o_orderkey % 50 + 100 AS v FROM orders) SELECT company, round((v + 30)::DOUBLE, 6) AS revenue_value, 'Walmart U.S.=' || v || '.500/5.1; Sam''s Club U.S.=22.100/-2.0' AS segments FROM o""")
def issuer_walmart(spark, d):
    v = F.col("o_orderkey") % 50 + 100
    text = said("Total revenues ", F.format_number((v + 30) * 1000, 0), " 120,000\nWalmart U.S. $", v, ".5 $105.1 5.1% x Sam's Club $22.1 $22.5 (2.0)% y")
    return flat(I.parse_issuer(materials(spark, d, text), "walmart"), "revenue.value")


@query("issuer_visa", """WITH o AS (SELECT o_orderkey AS company, o_orderkey % 50 / 10.0 + 5 AS v, o_orderkey % 2 = 0 AS down FROM orders) SELECT company, round(v::DOUBLE, 6) AS revenue_value, 12.0::DOUBLE AS revenue_yoy, CASE WHEN down THEN -7 ELSE 7 END::DOUBLE AS net_income_yoy, CASE WHEN 9.2 / v::DOUBLE BETWEEN 0.55 AND 1.55 THEN 'Service revenue=4.000/8.0; Data processing revenue=4.600/10.0; Other revenue=0.600/14.0' ELSE '' END AS segments FROM o""")
def issuer_visa(spark, d):
    """Sentences only; the pools may exceed revenue by more than others' segments."""
    v = (F.col("o_orderkey") % 50 / 10 + 5).cast("decimal(6,1)")
    way = F.when(F.col("o_orderkey") % 2 == 0, "decrease").otherwise("increase")
    text = said("Net revenue in the fiscal first quarter was $", v, " billion, an increase of 12%. GAAP net income in the fiscal first quarter was $3.0 billion or $1.50 per share, a ", way, " of 7%. Fiscal first quarter service revenue was $4.0 billion, an increase of 8%. Data processing revenue rose 10% over the prior year to $4.6 billion. Other revenue of $0.6 billion rose 14% over the prior year.")
    return flat(I.parse_issuer(materials(spark, d, text), "visa"), "revenue.value", "revenue.yoy", "net_income.yoy")


@query("issuer_jpm", """WITH o AS (SELECT o_orderkey AS company, o_orderkey % 30 + 40 AS v FROM orders) SELECT company, v::DOUBLE AS revenue_value, 14.7::DOUBLE AS net_income_value, CASE WHEN 37.4 / v::DOUBLE BETWEEN 0.55 AND 1.35 THEN 'Consumer & Community Banking=18.400/6.0; Commercial & Investment Bank=19.000/-3.0' ELSE '' END AS segments FROM o""")
def issuer_jpm(spark, d):
    v = F.col("o_orderkey") % 30 + 40
    text = said("NET INCOME OF $14.7 BILLION ($4.63 PER SHARE). Reported revenue of $", v, " billion and managed revenue of $99 billion. Consumer & Community Banking $ 18,400 $ 18,000 17,900 17,800 17,500 2 6 Commercial & Investment Bank 19,000 18,000 17,900 17,800 17,500 — (3) end")
    return flat(I.parse_issuer(materials(spark, d, text), "jpm"), "revenue.value", "net_income.value")


@query("issuer_tsmc", """WITH o AS (SELECT o_orderkey AS company, (o_custkey + 2000)::DOUBLE AS v FROM orders) SELECT company, round(v * 0.001, 6) AS revenue_value, round((v / 1500 - 1) * 100, 6) AS revenue_yoy, round(1100 / v * 100, 6) AS gross_margin, CASE WHEN 1.9 / (v * 0.001) BETWEEN 0.55 AND 1.35 THEN 'HPC=1.100/-; Smartphone=0.800/-' ELSE '' END AS segments FROM o""")
def issuer_tsmc(spark, d):
    """Each amount has its share of revenue behind it."""
    text = said("NET REVENUE ", spoken(), " 100 1,500 100\nGROSS PROFIT 1,100 55 800 53\nRevenue by Platform\nHigh Performance Computing 1,100 0\nSmartphone 800 0\n")
    return flat(I.parse_issuer(materials(spark, d, text), "tsmc"), "revenue.value", "revenue.yoy", "gross_margin")


@query("issuer_asml", """WITH o AS (SELECT o_orderkey AS company, (o_custkey + 2000)::DOUBLE AS v FROM orders) SELECT company, round(v * 0.001, 6) AS revenue_value, 51.2::DOUBLE AS gross_margin, round(v * 0.001 - 1.5, 6) AS system_sales, 0.9::DOUBLE AS net_income_value, '' AS segments FROM o""")
def issuer_asml(spark, d):
    text = said("Net sales of € ", spoken(), " million, Installed Base Management sales of € 1,500 million. Gross margin of 51.2%. Net income 800 900\n")
    return flat(I.parse_issuer(materials(spark, d, text), "asml"), "revenue.value", "gross_margin", "system_sales", "net_income.value")


OTHERS = (
    ("costco", "Total revenue", "Net sales 1,500 1,000\nMembership fees 300 250\n", "Net sales=1.500/50.0; Membership fees=0.300/20.0", 1.8), ("jnj", "Sales to customers", "Pharmaceutical 1,800 1,000\n", "Pharmaceutical=1.800/80.0", 1.8),
    ("oracle", "Total revenues", "Cloud 1,500 1,000\nHardware 500 400\n", "Cloud=1.500/50.0; Hardware=0.500/25.0", 2.0), ("unknown", "Net sales", "", "", 0.0),
)


@query("issuer_others", f"""WITH o AS (SELECT o_orderkey AS company, o_orderkey % 4 AS n, (o_custkey + 2000)::DOUBLE * 0.001 AS v FROM orders) SELECT company, round(v, 6) AS revenue_value, CASE WHEN {sql.pick([x[4] for x in OTHERS], 'n')}::DOUBLE / v BETWEEN 0.55 AND 1.35 THEN {sql.pick([x[3] for x in OTHERS], 'n')} ELSE '' END AS segments FROM o""")
def issuer_others(spark, d):
    """The dispatcher over issuers in one table; without a parser of its own an issuer has the generic one."""
    at = lambda k: F.get(F.array(*(F.lit(x[k]) for x in OTHERS)), (F.col("o_orderkey") % len(OTHERS)).cast("int"))
    rows = materials(spark, d, F.concat(at(1), F.lit(" "), spoken(), F.lit(" 1,000\n"), at(2)), issuer=at(0))
    return flat(I.parse(rows, {x[0]: I.ISSUERS[x[0]] for x in OTHERS[:-1]}), "revenue.value")


#: How each layout writes a row's numbers: now, a year before.
WRITTEN = {
    "pair": lambda now, before: (" ", now, " ", before), "reversed": lambda now, before: (" ", before, " ", now), "five_quarters": lambda now, before: (" ", before, " 1 2 3 ", now, " 900%"), "three_columns": lambda now, before: (" ", now, " 1 ", before),
    "both_changes": lambda now, before: (" ", now, " 1 ", before, " 3% 900%"), "first_of_five": lambda now, before: (" ", now, " 1 2 3 ", before, " 1 900"), "beside_percents": lambda now, before: (" ", now, " 10 ", before, " 10"),
}
#: Revenue of issuers that tell it in sentences, or whose revenue has no label of its own.
TOLD = {"walmart": ("Total revenues ", " 1,000"), "visa": ("Net revenue in the fiscal first quarter was $", " billion, an increase of 12%."), "jpm": ("Reported revenue of $", " billion and managed revenue of $99 billion.")}


def _of_issuers():
    """Of each issuer: the variants that tell revenue and segments, whether revenue is told in billions, whether net income stands there, up to two segments."""
    out = []
    for issuer, variants in I.ISSUERS.items():
        base = next((x for x in variants if "revenue" in x.metrics), None)
        v = next((x for x in variants if x.segments and x.unit == 0.001), None)
        told_in = issuer in TOLD and "billion" in TOLD[issuer][1]
        out.append((issuer, base, v, told_in, base is not None and "net_income" in base.metrics, list(v.segments)[:2] if v and not told_in else []))
    return [*out, ("unknown", None, None, False, True, [])]


SENT = _of_issuers()


def _sent(issuer, base, v, told_in, has_net, names):
    """An issuer's text in its own layout."""
    if issuer == "unknown":
        return said("Net sales ", spoken(), " 1,000. Net income 300 200. ")
    revenue = (TOLD[issuer][0], F.col("o_custkey") % 50 + 40 if told_in else spoken(), TOLD[issuer][1]) if issuer in TOLD else (base.metrics["revenue"][0], *WRITTEN[base.layout](spoken(), "1,000"))
    net = (base.metrics["net_income"][0], *WRITTEN[base.layout]("300", "200"), ". ") if has_net else ()
    amounts = [F.format_number(amount() - 500, 0), "500"] if len(names) == 2 else [spoken()]
    rows = [x for name, now in zip(names, amounts) for x in (v.segments[name][0], *WRITTEN[v.layout](now, "400"), ". ")]
    markers = [m for x in (base, v) if x for m in x.markers]
    return said(*(f"{m}. " for m in dict.fromkeys(markers)), *revenue, ". ", *net, *rows)


@query("issuer_dispatch", f"""WITH o AS (SELECT o_orderkey AS company, o_orderkey % {len(SENT)} AS n, (o_custkey + 2000)::DOUBLE AS v, (o_custkey % 50 + 40)::DOUBLE AS told FROM orders),
i(n, issuer, in_words, has_net, a, b) AS ({sql.values((n, x[0], int(x[3]), int(x[4]), *(x[5] + [None, None])[:2]) for n, x in enumerate(SENT))})
SELECT company, issuer, CASE WHEN in_words = 1 THEN told ELSE round(v / 1000, 6) END AS revenue_value, CASE WHEN has_net = 1 THEN 0.3::DOUBLE END AS net_income_value,
 CASE WHEN b IS NOT NULL THEN a || '=' || CAST(CAST(round((v - 500) / 1000, 3) AS DECIMAL(18,3)) AS VARCHAR) || '; ' || b || '=0.500' WHEN a IS NOT NULL THEN a || '=' || CAST(CAST(round(v / 1000, 3) AS DECIMAL(18,3)) AS VARCHAR) ELSE '' END AS segments FROM o JOIN i USING (n)""")
def issuer_dispatch(spark, d):
    """Texts of all issuers in one table, each in its own layout: one scan, one pass of the label automaton."""
    at = lambda options: F.coalesce(*(F.when(F.col("o_orderkey") % len(SENT) == n, c) for n, c in enumerate(options)))
    issuer = at([F.lit(x[0]) for x in SENT])
    out = I.parse(materials(spark, d, at([_sent(*x) for x in SENT]), issuer=issuer))
    names = table(spark, d, "orders").select(F.col("o_orderkey").alias("company"), issuer.alias("issuer"))
    items = F.array_join(F.transform("segments", lambda s: F.concat(s["name"], F.lit("="), F.round(s["value"], 3).cast("decimal(18,3)").cast("string"))), "; ")
    return out.join(names, "company").select("company", "issuer", F.round("revenue.value", 6).alias("revenue_value"), F.round("net_income.value", 6).alias("net_income_value"), items.alias("segments"))


# ---- geographies -----------------------------------------------------------------------------------------------------------

HEADINGS = {
    "microsoft": "Revenue, classified by the major geographic areas in which our customers were located, was as follows: ", "nvidia": "Geographic Revenue based upon Customer Headquarters Location (1): (In millions) ", "micron": "Geographic Information Revenue based on the geographic location of our customers' headquarters was as follows: ",
    "meta": "revenue and property and equipment, net by geographic area (in millions): Year Ended December 31, 2024 2023 2022 Revenue: ", "tsmc": "NT$ NT$ NT$ Geography (In Millions) (In Millions) (In Millions) ", "asml": "Total net sales and long-lived assets by geographic region were as follows: ",
    "tsla": "revenues by geographic area based on the sales location of our products (in millions): ", "visa": "", "costco": "",
}


def _filed():
    """Issuer and text of a table whose rows are now v + 100 i and were 1000 + 100 i."""
    out = []
    for issuer, heading in HEADINGS.items():
        _, layout, _, rows = G.TABLES[issuer][-1 if issuer == "meta" else 0]
        parts = [heading]
        for i, (_, label) in enumerate(rows):
            cells = ["7"] * layout[0]
            cells[layout[1]], cells[layout[2]] = F.format_number(amount() + 100 * i, 0), f"{1000 + 100 * i:,}"
            parts += [label, *(x for c in cells for x in (" ", c)), " "]
        out.append((issuer, said(*parts)))
    cells = lambda *x: [y for c in x for y in (" $ ", c)]
    block = lambda lead, *totals: said(lead, " Americas Asia Pacific Europe, the Middle East and Africa Total (In millions) Products 1 2 3 4 Subscriptions and services (a) 5 6 7 8 Total", *cells(*totals), " ")
    out.append(("avgo", F.concat(block("Fiscal Quarter Ended May 5, 2024", spoken(), F.format_number(amount() + 100, 0), F.format_number(amount() + 200, 0), "9"), block("Fiscal Quarter Ended May 6, 2023", "1,000", "1,100", "1,200", "9"))))
    row = "Revenues and other income Sales and other operating revenue"
    out.append(("xom", said("Year ended December 31, 2024 ", row, " ", spoken(), " ", F.format_number(amount() + 100, 0), " 0 0 0 0 0 0 9 Income x Year ended December 31, 2023 ", row, " 400 100 600 1,000 0 0 0 0 9 end")))
    out.append(("berkshire", said("Consolidated sales, service and leasing revenues were $ 200 billion in 2024, $ 100 billion in 2023. Sales, service and leasing revenues attributable to the United States were ", F.col("o_custkey") % 50 + 40, "% in 2024, 80% in 2023")))
    out.append(("jpm", said(*(x for i, name in enumerate(("North America", "Europe/Middle East/Africa", "Asia-Pacific", "Latin America/Caribbean")) for x in (name, " $ ", F.format_number(amount() + 100 * i, 0), " ")), "then ", *(f"{name} {1000 + 100 * i:,} " for i, name in enumerate(("North America", "Europe/Middle East/Africa", "Asia-Pacific", "Latin America/Caribbean"))))))
    return out


_PLACED = [(issuer, i, name, "annual_filing" if table_[2] else None) for issuer in HEADINGS for table_ in (G.TABLES[issuer][-1 if issuer == "meta" else 0],) for i, (name, _) in enumerate(table_[3])]
_PLACED += [("avgo", i, name, None) for i, name in enumerate(("Americas", "Asia Pacific", "Europe, the Middle East and Africa"))] + [("xom", i, name, "annual_filing") for i, name in enumerate(("U.S.", "Non-U.S."))] + [("jpm", i, name, "annual_filing") for i, (name, _) in enumerate(G.STACKED["jpm"])]
_FILED = [*HEADINGS, "avgo", "xom", "berkshire", "jpm"]


@query("issuer_geographies", f"""WITH o AS (SELECT o_orderkey AS company, {sql.pick(_FILED, f'o_orderkey % {len(_FILED)}')} AS issuer, (o_custkey + 2000)::DOUBLE AS v, (o_custkey % 50 + 40)::DOUBLE AS p FROM orders), r(issuer, i, name, scope) AS ({sql.values(_PLACED)})
SELECT company, name, round((v + 100 * i) / 1000, 3) AS value, round_even(((v + 100 * i) / (1000 + 100 * i) - 1) * 100, 1) AS yoy, scope FROM o JOIN r USING (issuer)
UNION ALL SELECT company, unnest(['United States', 'Other']), unnest([round(2 * p, 3), round(200 - 2 * p, 3)]), unnest([round((2 * p / 80 - 1) * 100, 1), round(((200 - 2 * p) / 20 - 1) * 100, 1)]), 'annual_filing' FROM o WHERE issuer = 'berkshire'""")
def issuer_geographies(spark, d):
    filed = _filed()
    orders = table(spark, d, "orders")
    out = None
    for n, (issuer, text) in enumerate(filed):
        own = orders.where(F.col("o_orderkey") % len(filed) == n).select(F.col("o_orderkey").alias("company"), F.explode(G.issuer_geographies(text, issuer)).alias("g"))
        out = own if out is None else out.unionByName(own)
    return out.select("company", "g.name", "g.value", "g.yoy", "g.scope")


@query("profile_geographies", """WITH o AS (SELECT o_orderkey AS company, o_orderkey % 4 AS k, (o_custkey + 2000)::DOUBLE AS v FROM orders), i AS (
 SELECT company, k, v, unnest(['Americas', 'Europe', 'Greater China', 'Japan', 'Rest of Asia Pacific']) AS name, unnest([v, 500, 400, 300, 200]) AS now, unnest([1000, 400, 400, 200, 100]) AS before FROM o WHERE k IN (0, 1)
 UNION ALL SELECT company, k, v, unnest(['United States', 'International']), unnest([v, 600]), unnest([1000, 500]) FROM o WHERE k = 3)
SELECT company, name, round(now / 1000, 3) AS value, round((now / before::DOUBLE - 1) * 100, 1) AS yoy, CASE WHEN k = 1 THEN 'annual_filing' END AS scope FROM i""")
def profile_geographies(spark, d):
    """A quarter's five regions; a year's, which don't fit revenue; two names that say little without context, and with it."""
    k = F.col("o_orderkey") % 4
    five = said("Americas ", spoken(), " 1,000\nEurope 500 400\nGreater China 400 400\nJapan 300 200\nRest of Asia Pacific 200 100\n")
    two = said("United States ", spoken(), " 1,000\nInternational 600 500\n")
    text = F.when(k < 2, five).when(k == 2, two).otherwise(F.concat(F.lit("Revenue by geographic area\n"), two))
    revenue = F.when(k == 1, 0.1).when(k == 0, (amount() + 1400) / 1000).otherwise((amount() + 600) / 1000)
    rows = materials(spark, d, text, kind=F.lit("sec_filing"), label=F.when(k == 1, "Form 10-K").otherwise("10-Q"), revenue=revenue)
    return G.profile_geographies(rows).select("company", F.explode("geographies").alias("g")).select("company", "g.name", "g.value", "g.yoy", "g.scope")


@query("legacy_geographies", """WITH o AS (SELECT o_orderkey AS company, (o_custkey + 2000)::DOUBLE AS v FROM orders WHERE o_orderkey % 2 = 0), i AS (SELECT company, unnest(['Americas', 'Europe', 'Japan', 'Asia-Pacific', 'Retail']) AS name, unnest([v, 500, 300, 200, 400]) AS now, unnest([1000, 400, 200, 100, 400]) AS before FROM o)
SELECT company, name, round(now / 1000, 3) AS value, round((now / before::DOUBLE - 1) * 100, 1) AS yoy FROM i""")
def legacy_geographies(spark, d):
    """Five regions whose sum fits revenue in every other quarter."""
    text = said("Americas net sales ", spoken(), " 1,000\nEurope net sales 500 400\nJapan revenue 300 200\nAsia Pacific net sales 200 100\nRetail net sales 400 400\n")
    rows = materials(spark, d, text, kind=F.lit("sec_filing"), label=F.lit("10-Q"), revenue=F.when(F.col("o_orderkey") % 2 == 1, 0.1).otherwise((amount() + 1400) / 1000))
    return G.legacy_geographies(rows).select("company", F.explode("geographies").alias("g")).select("company", "g.name", "g.value", "g.yoy")


@query("table_geographies", """WITH o AS (SELECT o_orderkey AS company, (o_custkey + 2000)::DOUBLE AS v, o_orderkey % 3 = 0 AS annual FROM orders) SELECT company, unnest(['United States', 'Canada', 'Europe', 'Other countries']) AS name, round(unnest([v, 900, 800, 700]) / 1000, 3) AS value, round((unnest([v / 1000, 900 / 450.0, 800 / 1000.0, 700 / 700.0]) - 1) * 100, 1) AS yoy, CASE WHEN annual THEN 'annual_filing' END AS scope FROM o""")
def table_geographies(spark, d):
    """Two tables, of which the one with more regions is taken."""
    row = lambda *cells: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.lit(c) if isinstance(c, str) else c, F.lit("</td>")) for c in cells), F.lit("</tr>"))
    head = "<tr><td>(In millions)</td></tr><tr><th>Three Months Ended</th></tr><tr><th>September 30, 2024</th><th>September 30, 2023</th></tr>"
    small = F.concat(F.lit("<table>" + head), row("United States", spoken(), "1,000"), row("International", "900", "450"), F.lit("</table>"))
    large = F.concat(F.lit("<table>" + head), row("United States", spoken(), "1,000"), row("Canada", "900", "450"), row("Europe", "800", "1,000"), row("Other countries", "700", "700"), F.lit("</table>"))
    rows = spread(table(spark, d, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("company"), F.when(F.col("o_orderkey") % 3 == 0, "Annual report").otherwise("10-Q").alias("label"), ((amount() + 2400) / 1000).alias("revenue"), F.explode(F.array(H.html_tables(F.concat(small, large)))).alias("t"))
    return rows.select("company", F.explode(G.table_geographies(F.col("t"), F.col("label"), F.col("revenue"), F.lit(2024 * 4 + 2))).alias("g")).select("company", "g.name", "g.value", "g.yoy", "g.scope")


@query("annual_geographies", """WITH o AS (SELECT o_orderkey AS company, o_orderkey % 8 AS gap, o_orderkey % 3 = 0 AS own, o_orderkey % 5 AS n FROM orders) SELECT company, CASE WHEN own THEN 1 WHEN gap <= 5 AND n >= 2 THEN n ELSE 0 END AS n FROM o""")
def annual_geographies(spark, d):
    """What a quarter lacks comes from the annual report of up to five quarters before."""
    k = F.col("o_orderkey")
    items = lambda n: F.transform(F.slice(F.sequence(F.lit(1), F.lit(4)), F.lit(1), n.cast("int")), lambda i: F.struct(i.cast("string").alias("name"), i.cast("double").alias("value"), F.lit(None).cast("double").alias("yoy"), F.lit("a").alias("scope")))
    orders = table(spark, d, "orders")
    quarters = orders.select(k.alias("company"), F.lit(8008).alias("quarter_index"), items(F.when(k % 3 == 0, 1).otherwise(0)).alias("geographies"))
    annual = orders.select(k.alias("company"), (8008 - k % 8).cast("int").alias("quarter_index"), items(k % 5).alias("geographies"))
    return G.with_annual(quarters, annual).select("company", F.size("geographies").alias("n"))
