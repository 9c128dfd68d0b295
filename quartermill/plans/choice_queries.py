"""Queries of choices, labels, dates and payload merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartermill.functions import numbers as N
from quartermill.functions import periods as P
from quartermill.functions import text as S
from quartermill.operators import selection as X
from quartermill.operators import series as R
from quartermill.operators import structure as T
from quartermill.plans import sql
from quartermill.plans.base import OVER, SERIES_SQL, gapped, quarterly, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("snapshot_alignment", """SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1998-06-30' BETWEEN -30 AND 220 OR (o_orderkey % 2 = 0 AND CAST(o_orderdate AS DATE) - DATE '1998-06-30' BETWEEN -400 AND 820) AS aligned FROM orders""")
def snapshot_alignment(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.aligned(F.to_date("o_orderdate"), F.lit("1998-06-30").cast("date"), F.col("o_orderkey") % 2 == 0).alias("aligned"))


@query("material_pick", """WITH m AS (SELECT o_custkey AS company, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS rank, length(o_orderpriority) AS size FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY rank, size DESC, o_orderkey) AS k FROM m) SELECT company, o_orderkey FROM r WHERE k = 1""")
def material_pick(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("company"), "o_orderkey", rank.alias("rank"), F.length("o_orderpriority").alias("size"))
    return X.best_by(rows, ["company"], F.col("rank"), F.desc("size"), F.col("o_orderkey")).select("company", "o_orderkey")


@query("theme_list", SERIES_SQL + f""", g AS (SELECT *, (revenue / lag(revenue, 1) {OVER} - 1) * 100 AS qoq FROM series),
u AS (SELECT company, quarter_index, 1 AS o, 'growth' AS label, CAST(greatest(32, least(98, round_even(60 + qoq, 0))) AS INTEGER) AS score FROM g WHERE qoq > 0 UNION ALL SELECT company, quarter_index, 2, 'decline', CAST(greatest(32, least(98, round_even(60 - qoq, 0))) AS INTEGER) FROM g WHERE qoq < 0
 UNION ALL SELECT company, quarter_index, 3, 'loss', 70 FROM g WHERE earnings < 0) SELECT company, quarter_index, label, score FROM u""")
def theme_list(spark, d):
    g = quarterly(spark, d).withColumn("qoq", N.pct_change(F.col("revenue"), R.before("revenue", 1)))
    own = X.themes((F.col("qoq") > 0, "growth", 60 + F.col("qoq")), (F.col("qoq") < 0, "decline", 60 - F.col("qoq")), (F.col("earnings") < 0, "loss", F.lit(70.0)))
    return g.select("company", "quarter_index", F.explode(own).alias("t")).select("company", "quarter_index", "t.label", "t.score")


@query("warnings_reconciled", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || '|' || p_brand ELSE p_type END AS warnings FROM part")
def warnings_reconciled(spark, d):
    k = F.col("p_partkey")
    own = X.reconciled(F.array("p_type", F.lit(" "), "p_type", "p_brand"), F.when(k % 2 == 1, F.array(F.lit("Brand"))).otherwise(F.array(F.lit("zzz"))))
    return table(spark, d, "part").select("p_partkey", F.array_join(own, "|").alias("warnings"))


@query("enrichment_needed", SERIES_SQL + """ SELECT company, count(CASE WHEN revenue IS NULL OR earnings IS NULL THEN 1 END) AS missing, count(CASE WHEN revenue IS NULL OR earnings IS NULL THEN 1 END) > 5 AS needed FROM gapped GROUP BY company""")
def enrichment_needed(spark, d):
    s = gapped(quarterly(spark, d))
    return X.needs_enrichment(s, R.longest_run(s, "revenue"), 5, 4)


@query("geography_names", """SELECT n_nationkey, n_regionkey IN (0, 1) AS alike FROM nation""")
def geography_names(spark, d):
    lits = lambda *x: F.array(*map(F.lit, x))
    names = F.when(F.col("n_regionkey") == 0, lits("Europe", "Asia")).when(F.col("n_regionkey") == 1, lits("Greater China region", "EMEA region")).when(F.col("n_regionkey") == 2, lits("Europe", "Cloud")).otherwise(lits("Asia"))
    return table(spark, d, "nation").select("n_nationkey", T.geography_like(names, lits("europe", "asia"), lits("region"), F.when(F.col("n_regionkey") > 2, lits("asia")).otherwise(lits("cloud"))).alias("alike"))


@query("date_functions", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN d WHEN 1 THEN d END AS parsed, CAST(d - INTERVAL 70 DAY AS DATE) AS opens, CAST(d + INTERVAL 100 DAY AS DATE) AS closes, strftime(d - INTERVAL 2 MONTH, '%Y-%m') AS first_month,
 CASE WHEN month(d) <= 3 THEN (year(d) - 1)::VARCHAR ELSE year(d)::VARCHAR END || 'Q4' AS fiscal FROM o""")
def date_functions(spark, d):
    k, date = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.when(k % 3 == 0, F.date_format(date, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(date, "MMMM d, yyyy")).otherwise("n/a")
    opens, closes = P.search_window(P.index_of_date(date), date)
    months = P.coverage_months(P.majority_index(date), date)
    return table(spark, d, "orders").select("o_orderkey", P.parsed_date(text).alias("parsed"), opens.alias("opens"), closes.alias("closes"), F.get(months, F.lit(0)).alias("first_month"), P.fiscal_label(date, F.lit("Q4")).alias("fiscal"))


@query("month_majority", """SELECT o_orderkey, CAST(year(p) * 4 + quarter(p) - 1 AS INTEGER) AS q FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS p FROM orders)""")
def month_majority(spark, d):
    to = F.trunc("o_orderdate", "month")
    tokens = F.transform(F.sequence(F.lit(-2), F.lit(0)), lambda n: F.date_format(F.add_months(to, n), "yyyy-MM"))
    return table(spark, d, "orders").select("o_orderkey", P.majority_of_months(tokens).cast("int").alias("q"))


@query("formats", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '$' || (o_orderkey % 97)::VARCHAR || '.5B' END AS money, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END || (o_orderkey % 13 + 1)::VARCHAR || '.5%' AS pct,
 CASE WHEN o_custkey % 3 = 0 THEN 0 WHEN o_custkey % 3 = 1 THEN -7 ELSE 7 END::DOUBLE AS directed, CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE 12.5 END::DOUBLE AS worded FROM orders""")
def formats(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    money = N.money(F.when(k % 5 != 0, (k % 97 + 0.5).cast("double")))
    pct = N.percent(((k % 13 + 1.5) * F.when(c % 2 == 0, 1).otherwise(-1)).cast("double"), signed=True)
    directed = N.directional(F.when(c % 3 == 0, "Unchanged").when(c % 3 == 1, "decreased").otherwise("grew"), F.lit(7.0))
    return table(spark, d, "orders").select("o_orderkey", money.alias("money"), pct.alias("pct"), directed.alias("directed"), N.percent_token(F.when(c % 2 == 0, "three percent").otherwise("12.5%")).alias("worded"))


PASSAGES = ("We expect demand to continue", "Accounting for income tax positions and growth", "Adoption of note 2, fair value", "non-GAAP margin reconciliation", "A mix of things", "Deferred income tax, revenue up", "Outlook unchanged", "")


@query("guidance_filter", f"""WITH t AS (SELECT o_orderkey, {sql.pick(PASSAGES, 'o_orderkey % 8')} || ' ' || {sql.pick(PASSAGES, 'o_orderkey // 8 % 8')} AS t FROM orders), l AS (SELECT *, lower(t) AS low FROM t)
SELECT o_orderkey, {sql.number_of('low', S.GUIDANCE_NOISE)} < 2 AND {sql.any_of('low', S.GUIDANCE_SIGNAL)} AS signal, CASE WHEN regexp_matches(low, 'margin|profit|cost') THEN 'margin' WHEN regexp_matches(low, 'segment|mix|geograph|region') THEN 'structure' ELSE 'growth' END AS bucket FROM l""")
def guidance_filter(spark, d):
    k = F.col("o_orderkey")
    part = lambda at: F.get(F.array(*map(F.lit, PASSAGES)), at.cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(F.concat(part(k % 8), F.lit(" "), part(F.floor(k / 8) % 8)))).alias("t"))
    return rows.select("o_orderkey", S.guidance_signal(F.col("t")).alias("signal"), S.signal_bucket(F.col("t")).alias("bucket"))


@query("match_excerpts", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{2,}') THEN md5(substr(text, greatest(1, length(regexp_extract(text, '(?s)^(.*?)[0-9]{2,}', 1)) + 1 - 20), length(regexp_extract(text, '(?s)^(.*?)[0-9]{2,}', 1)) + 1 + 40 - greatest(1, length(regexp_extract(text, '(?s)^(.*?)[0-9]{2,}', 1)) + 1 - 20))) END AS excerpt_md5 FROM documents""")
def match_excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.around(F.col("text"), "[0-9]{2,}", 20, 40)).alias("excerpt_md5"))
