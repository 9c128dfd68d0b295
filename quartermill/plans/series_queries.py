"""Queries over quarterly series, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartermill.functions import periods as P
from quartermill.operators import series as S
from quartermill.plans.base import OVER, SERIES_SQL, frame, gapped, lines, net, quarterly, rounded, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("quarterly_revenue", SERIES_SQL + " SELECT company, quarter_index, (quarter_index // 4)::VARCHAR || 'Q' || (quarter_index % 4 + 1)::VARCHAR AS quarter, revenue, earnings, equity FROM series")
def quarterly_revenue(spark, d):
    return quarterly(spark, d).withColumn("quarter", P.label(F.col("quarter_index")))


@query("revenue_qoq_yoy", SERIES_SQL + f""", g AS (SELECT *, lag(revenue, 4) {OVER} AS r4, lag(revenue, 1) {OVER} AS r1, lag(earnings, 4) {OVER} AS e4 FROM gapped)
SELECT company, quarter_index, round((revenue - r4) / abs(nullif(r4, 0)) * 100, 4) AS revenue_yoy, round((revenue / nullif(r1, 0) - 1) * 100, 4) AS revenue_qoq,
       round((nullif(earnings, 0) / nullif(e4, 0) - 1) * 100, 4) AS earnings_yoy FROM g""")
def revenue_qoq_yoy(spark, d):
    return rounded(S.growth(gapped(quarterly(spark, d))).select("company", "quarter_index", "revenue_yoy", "revenue_qoq", "earnings_yoy"), "revenue_yoy", "revenue_qoq", "earnings_yoy")


_TTM = f"""t AS (SELECT *, CASE WHEN count(revenue) {frame(3)} = 4 THEN sum(revenue) {frame(3)} END AS ttm_revenue, CASE WHEN count(earnings) {frame(3)} = 4 THEN sum(earnings) {frame(3)} END AS ttm_earnings FROM series)"""


@query("ttm_growth", SERIES_SQL + f", {_TTM} SELECT company, quarter_index, round(ttm_revenue, 5) AS ttm_revenue, round(ttm_earnings, 5) AS ttm_earnings, round((ttm_revenue / nullif(lag(ttm_revenue, 4) {OVER}, 0) - 1) * 100, 4) AS ttm_growth FROM t")
def ttm_growth(spark, d):
    out = S.trailing(quarterly(spark, d)).select("company", "quarter_index", "ttm_revenue", "ttm_earnings", "ttm_growth")
    return rounded(rounded(out, "ttm_growth"), "ttm_revenue", "ttm_earnings", digits=5)


@query("ttm_roe", SERIES_SQL + f""", {_TTM}, e AS (SELECT *, count(nullif(equity, 0)) {frame(4)} AS n, avg(nullif(equity, 0)) {frame(4)} AS m FROM t),
r AS (SELECT company, quarter_index, CASE WHEN n >= 2 AND m > 0 THEN ttm_earnings / m * 100 END AS roe FROM e)
SELECT company, quarter_index, round(CASE WHEN roe > -100 AND roe < 250 THEN roe END, 4) AS ttm_roe FROM r""")
def ttm_roe(spark, d):
    return rounded(S.trailing_roe(quarterly(spark, d)).select("company", "quarter_index", "ttm_roe"), "ttm_roe")


@query("trailing_mean", SERIES_SQL + f" SELECT company, quarter_index, round(avg(revenue) {frame(3)}, 4) AS mean_revenue FROM gapped")
def trailing_mean(spark, d):
    return rounded(gapped(quarterly(spark, d)).select("company", "quarter_index", S.trailing_mean("revenue").alias("mean_revenue")), "mean_revenue")


@query("report_ready_quarters", SERIES_SQL + f""", c AS (SELECT company, quarter_index, count(CASE WHEN revenue IS NOT NULL AND earnings IS NOT NULL THEN 1 END) {frame(3)} AS n, row_number() {OVER} AS k FROM gapped)
SELECT company, quarter_index FROM c WHERE n = 4 AND k >= 4""")
def report_ready_quarters(spark, d):
    return S.report_ready(gapped(quarterly(spark, d)), 4).select("company", "quarter_index")


@query("core_metric_filter", SERIES_SQL + " SELECT company, quarter_index FROM gapped WHERE revenue IS NOT NULL AND earnings IS NOT NULL")
def core_metric_filter(spark, d):
    return gapped(quarterly(spark, d)).where(S.has_core()).select("company", "quarter_index")


@query("ready_map_gate", SERIES_SQL + """ SELECT company, quarter_index FROM series WHERE company % 3 = 0 OR quarter_index % 2 = 0""")
def ready_map_gate(spark, d):
    series = quarterly(spark, d).select("company", "quarter_index")
    audited = series.where("quarter_index % 2 = 0").withColumns({"complete": F.col("company") % 3 != 0, "history_window": F.lit(12)})
    return S.gated(series, audited, 12)


@query("dense_window", SERIES_SQL + """, s AS (SELECT * FROM series WHERE (company + quarter_index) % 3 != 0), t AS (SELECT company, max(quarter_index) AS target_index FROM s GROUP BY company),
g AS (SELECT company, target_index, CAST(unnest(range(target_index - 11, target_index + 1)) AS INTEGER) AS quarter_index FROM t)
SELECT company, quarter_index, target_index, revenue FROM g LEFT JOIN s USING (company, quarter_index)""")
def dense_window(spark, d):
    s = quarterly(spark, d).where("(company + quarter_index) % 3 != 0").select("company", "quarter_index", "revenue")
    return S.dense_window(s, s.groupBy("company").agg(F.max("quarter_index").alias("target_index")))


def _gap_sql(c: str) -> str:
    w0 = "OVER (PARTITION BY company ORDER BY quarter_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    w1 = "OVER (PARTITION BY company ORDER BY quarter_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"last_value({c} IGNORE NULLS) {w0} AS v0, last_value(CASE WHEN {c} IS NOT NULL THEN k END IGNORE NULLS) {w0} AS k0, first_value({c} IGNORE NULLS) {w1} AS v1, first_value(CASE WHEN {c} IS NOT NULL THEN k END IGNORE NULLS) {w1} AS k1"


def _fill_sql(c: str) -> str:
    return f"coalesce({c}, CASE WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * (k - k0) / (k1 - k0) END, v0, CASE WHEN k1 - k = 1 THEN v1 END) AS {c}_filled, {c} IS NULL AND coalesce(v0, CASE WHEN k1 - k = 1 THEN v1 END) IS NOT NULL AS {c}_inferred"


@query("gap_fill_linear", SERIES_SQL.replace("gapped AS", "gapped0 AS") + f""", gapped AS (SELECT company, quarter_index, revenue, CASE WHEN quarter_index % 4 != 1 THEN earnings END AS earnings, equity FROM gapped0), n AS (SELECT *, row_number() {OVER} AS k FROM gapped), f AS (SELECT *, {_gap_sql('revenue')} FROM n), r AS (SELECT company, quarter_index, {_fill_sql('revenue')} FROM f), g AS (SELECT *, {_gap_sql('earnings')} FROM n), e AS (SELECT company, quarter_index, {_fill_sql('earnings')} FROM g)
SELECT company, quarter_index, round(revenue_filled, 4) AS revenue_filled, round(earnings_filled, 4) AS earnings_filled, round(coalesce(earnings_filled / nullif(revenue_filled, 0) * 100, 1.0), 4) AS net_margin, revenue_inferred OR earnings_inferred AS inferred FROM r JOIN e USING (company, quarter_index)""")
def gap_fill_linear(spark, d):
    s = gapped(quarterly(spark, d)).withColumn("earnings", F.when(F.col("quarter_index") % 4 != 1, F.col("earnings"))).withColumn("net_margin", F.lit(1.0))
    filled = S.with_margin(S.interpolated(s, "revenue", "earnings"))
    return rounded(filled.select("company", "quarter_index", "revenue_filled", "earnings_filled", "net_margin", "inferred"), "revenue_filled", "earnings_filled", "net_margin")


@query("metrics_with_data", SERIES_SQL + """ SELECT company, array_to_string((CASE WHEN company % 3 != 0 THEN ['revenue'] ELSE [] END || ['earnings'] || CASE WHEN company % 2 = 0 THEN ['equity'] ELSE [] END || ['quarter_index'])[1:2], ',') AS metrics FROM series GROUP BY company""")
def metrics_with_data(spark, d):
    s = quarterly(spark, d).withColumns({"revenue": F.when(F.col("company") % 3 != 0, F.col("revenue")), "equity": F.when(F.col("company") % 2 == 0, F.col("equity"))})
    return S.metrics_with_data(s, ["revenue", "earnings", "equity", "quarter_index"], 2).select("company", F.array_join("metrics", ",").alias("metrics"))


@query("sparkline_scaled", SERIES_SQL + """, s AS (SELECT company, quarter_index, coalesce(last_value(revenue IGNORE NULLS) OVER (PARTITION BY company ORDER BY quarter_index ROWS UNBOUNDED PRECEDING),
  first_value(revenue IGNORE NULLS) OVER (PARTITION BY company ORDER BY quarter_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS level FROM gapped),
m AS (SELECT *, min(level) OVER (PARTITION BY company) AS a, max(level) OVER (PARTITION BY company) AS b FROM s)
SELECT company, quarter_index, level, round(CASE WHEN a = b THEN 0.5 ELSE (level - a) / (b - a) END, 4) AS scaled FROM m""")
def sparkline_scaled(spark, d):
    return rounded(S.sparkline(gapped(quarterly(spark, d)), "revenue").select("company", "quarter_index", "level", "scaled"), "scaled")


@query("equal_run_length", SERIES_SQL + f""", v AS (SELECT company, quarter_index, CASE WHEN quarter_index % 7 != 0 THEN floor(revenue / 1e6) END AS v FROM series),
n AS (SELECT *, CASE WHEN v = lag(v) {OVER} THEN 0 ELSE 1 END AS new FROM v), i AS (SELECT *, sum(new) {OVER} AS island FROM n), c AS (SELECT company, island, count(v) AS n FROM i GROUP BY ALL)
SELECT company, greatest(1, max(n))::BIGINT AS longest_run FROM c GROUP BY company""")
def equal_run_length(spark, d):
    return S.longest_run(quarterly(spark, d).withColumn("v", F.when(F.col("quarter_index") % 7 != 0, F.floor(F.col("revenue") / 1e6))), "v")


@query("roe_spike_filter", SERIES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_TTM}, e AS (SELECT *, count(nullif(equity, 0)) {frame(4)} AS n, avg(nullif(equity, 0)) {frame(4)} AS m FROM t), r AS (SELECT company, quarter_index, CASE WHEN n >= 2 AND m > 0 THEN ttm_earnings / m * 100 END AS roe FROM e),
s AS (SELECT company, quarter_index, round(CASE WHEN roe > -100 AND roe < 250 THEN roe END * CASE WHEN quarter_index % 5 = 0 THEN 40 WHEN company % 3 = 0 AND quarter_index % 5 = 1 THEN -10 ELSE 10 END, 4) AS v, row_number() {OVER} AS i FROM r),
f AS (SELECT company, 0 AS i, CAST(NULL AS DOUBLE) AS kept, CAST([] AS DOUBLE[]) AS accepted FROM s WHERE i = 1 UNION ALL
 SELECT s.company, s.i, CASE WHEN spike THEN NULL ELSE v END, CASE WHEN spike OR v IS NULL THEN accepted ELSE list_append(accepted, v) END FROM f JOIN s ON s.company = f.company AND s.i = f.i + 1,
 LATERAL (SELECT coalesce(len(accepted) >= 4 AND list_sort(accepted[-4:])[3] > 0 AND v > 20 AND v > 2.2 * list_sort(accepted[-4:])[3] AND v > list_sort(accepted[-4:])[3] + 10, false) AS spike))
SELECT s.company, quarter_index, kept AS roe_kept FROM f JOIN s USING (company, i)""")
def roe_spike_filter(spark, d):
    """Values made to jump every fifth quarter, and to turn negative."""
    q = F.col("quarter_index")
    factor = F.when(q % 5 == 0, 40).when((F.col("company") % 3 == 0) & (q % 5 == 1), -10).otherwise(10)
    return S.despiked(S.trailing_roe(quarterly(spark, d)).withColumn("roe", F.round(F.col("ttm_roe") * factor, 4)), "roe")


@query("best_fact_selection", """WITH f AS (SELECT o_custkey AS company, CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period, o_totalprice AS value, o_orderkey AS ordinal,
  CAST(o_orderdate AS DATE) AS filed, CAST(o_orderkey % 120 + 40 AS INTEGER) AS days, CAST(o_orderkey % 3 AS INTEGER) AS form_rank, o_orderkey % 2 = 0 AS framed FROM orders),
s AS (SELECT *, CAST(CASE WHEN framed THEN 30 ELSE 0 END + greatest(0, 24 - abs(days - 91)) - 3 * form_rank AS INTEGER) AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY company, period ORDER BY score DESC, filed DESC, form_rank, ordinal) AS n FROM s) SELECT company, period, value, score, ordinal FROM r WHERE n = 1""")
def best_fact_selection(spark, d):
    period = P.label(P.index_of_date(F.col("o_orderdate")))
    key = F.col("o_orderkey")
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("company"), F.lit("revenue").alias("metric"), period.alias("period"), F.col("o_totalprice").alias("value"), F.when(key % 2 == 0, F.concat(F.lit("CY"), period)).otherwise("").alias("frame"),
        (key % 120 + 40).cast("int").alias("days"), (key % 3).cast("int").alias("form_rank"), F.to_date("o_orderdate").alias("filed"), F.lit(0).alias("concept_rank"), F.lit(0).alias("unit_rank"), key.alias("ordinal"))
    return S.best_facts(facts).select("company", "period", "value", "score", "ordinal")


@query("annual_delta_fill", SERIES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", y AS (SELECT company, quarter_index, CASE WHEN company % 5 = 4 THEN annual * 0.1 ELSE annual END AS annual FROM (SELECT company, quarter_index, sum(revenue) {frame(3)} AS annual, count(revenue) {frame(3)} AS n FROM series) WHERE n = 4 AND (quarter_index % 4 = 3 OR (company % 3 = 0 AND quarter_index % 4 = 0))),
q AS (SELECT company, quarter_index, CASE WHEN NOT (quarter_index % 4 IN (3, 0) AND company % 2 = 0) THEN revenue END AS revenue FROM series WHERE NOT (company % 7 = 6 AND quarter_index % 4 = 2)),
j AS (SELECT company, quarter_index, revenue, annual, row_number() {OVER} AS i FROM q FULL JOIN y USING (company, quarter_index)),
r AS (SELECT company, 0 AS i, CAST(NULL AS INTEGER) AS quarter_index, CAST(NULL AS DOUBLE) AS v, false AS derived, CAST([] AS STRUCT(q INTEGER, v DOUBLE)[]) AS recent FROM j WHERE i = 1 UNION ALL
 SELECT j.company, j.i, j.quarter_index, coalesce(revenue, d), revenue IS NULL AND d IS NOT NULL, list_append(recent, {{'q': j.quarter_index, 'v': coalesce(revenue, d)}})[-3:]
 FROM r JOIN j ON j.company = r.company AND j.i = r.i + 1, LATERAL (SELECT list_filter(recent, lambda x: x.q >= j.quarter_index - 3 AND x.v IS NOT NULL) AS b), LATERAL (SELECT annual - coalesce(list_sum(list_transform(b, lambda x: x.v)), 0) AS rest),
 LATERAL (SELECT CASE WHEN revenue IS NULL AND len(b) = 3 AND (annual = 0 OR abs(CASE WHEN abs(rest) < 0.5 THEN 0 ELSE rest END) <= 1.4 * abs(annual)) THEN round_even(CASE WHEN abs(rest) < 0.5 THEN 0 ELSE rest END, 0) END AS d))
SELECT company, quarter_index, round(v, 5) AS revenue, derived AS revenue_derived FROM r WHERE i > 0""")
def annual_delta_fill(spark, d):
    """Years that end in the fourth quarter and, in a third of the nations, in the first, so that a filled quarter serves the next."""
    c, q = F.col("company"), F.col("quarter_index")
    series = quarterly(spark, d).select("company", "quarter_index", "revenue")
    annual = series.withColumn("annual", S.trailing_sum("revenue")).where("annual IS NOT NULL AND (quarter_index % 4 = 3 OR (company % 3 = 0 AND quarter_index % 4 = 0))").select("company", "quarter_index", F.when(c % 5 == 4, F.col("annual") * 0.1).otherwise(F.col("annual")).alias("annual"))
    known = series.where("NOT (company % 7 = 6 AND quarter_index % 4 = 2)").withColumn("revenue", F.when(~((q % 4).isin(3, 0) & (c % 2 == 0)), F.col("revenue")))
    return rounded(S.annual_delta(known, annual, "revenue").select("company", "quarter_index", "revenue", "revenue_derived"), "revenue", digits=5)


@query("official_merge", SERIES_SQL + f""", o AS (SELECT company, quarter_index, revenue * 2 AS revenue, earnings * 2 AS earnings, CASE WHEN quarter_index % 2 = 0 THEN equity * 2 END AS equity FROM series WHERE company % 2 = 0), b AS (SELECT * FROM gapped WHERE quarter_index % 3 != 0),
m AS (SELECT company, quarter_index, coalesce(b.revenue, o.revenue) AS revenue, coalesce(b.earnings, o.earnings) AS earnings, coalesce(o.equity, b.equity) AS equity FROM b FULL JOIN o USING (company, quarter_index)),
t AS (SELECT *, CASE WHEN count(earnings) {frame(3)} = 4 THEN sum(earnings) {frame(3)} END AS te, count(nullif(equity, 0)) {frame(4)} AS n, avg(nullif(equity, 0)) {frame(4)} AS a FROM m), r AS (SELECT *, CASE WHEN n >= 2 AND a > 0 THEN te / a * 100 END AS roe FROM t)
SELECT company, quarter_index, revenue, earnings, equity, round(CASE WHEN roe > -100 AND roe < 250 THEN roe END, 4) AS ttm_roe FROM r""")
def official_merge(spark, d):
    s = quarterly(spark, d)
    official = s.where("company % 2 = 0").select("company", "quarter_index", (F.col("revenue") * 2).alias("revenue"), (F.col("earnings") * 2).alias("earnings"), F.when(F.col("quarter_index") % 2 == 0, F.col("equity") * 2).alias("equity"))
    return rounded(S.merged_with_roe(gapped(s).where("quarter_index % 3 != 0"), official), "ttm_roe")


@query("relabelled_quarters", SERIES_SQL + """, r AS (SELECT company, quarter_index - quarter_index % 2 AS q, revenue, quarter_index AS src FROM series) SELECT company, CAST(q AS INTEGER) AS quarter_index, arg_max(revenue, src) AS revenue FROM r GROUP BY company, q""")
def relabelled_quarters(spark, d):
    s = quarterly(spark, d).select("company", "quarter_index", "revenue")
    return S.relabelled(s, (F.col("quarter_index") - F.col("quarter_index") % 2).cast("int"))


@query("growth_recomputed", SERIES_SQL + f""", a AS (SELECT *, (nullif(earnings, 0) / nullif(lag(earnings, 4) {OVER}, 0) - 1) * 100 AS y FROM series), b AS (SELECT company, quarter_index, CASE WHEN quarter_index % 5 != 0 THEN earnings END AS earnings, y FROM a)
SELECT company, quarter_index, round(coalesce((nullif(earnings, 0) / nullif(lag(earnings, 4) {OVER}, 0) - 1) * 100, y), 4) AS earnings_yoy FROM b""")
def growth_recomputed(spark, d):
    first = S.growth(quarterly(spark, d)).withColumn("earnings", F.when(F.col("quarter_index") % 5 != 0, F.col("earnings")))
    return rounded(S.recomputed(first).select("company", "quarter_index", "earnings_yoy"), "earnings_yoy")


@query("series_endpoints", SERIES_SQL + """, l AS (SELECT company, list(revenue ORDER BY quarter_index) AS r FROM series GROUP BY company)
SELECT company, r[1] AS first, r[-1] AS latest, CASE WHEN len(r) >= 2 THEN r[-2] ELSE r[1] END AS previous, CASE WHEN len(r) >= 5 THEN r[-5] ELSE r[1] END AS year_ago, r[len(r) // 2 + 1] AS middle, round((r[-1] / nullif(r[1], 0) - 1) * 100, 4) AS total_change FROM l""")
def series_endpoints(spark, d):
    return rounded(S.endpoints(quarterly(spark, d), "revenue"), "total_change")


@query("period_union", SERIES_SQL + """ SELECT company, quarter_index FROM series WHERE quarter_index % 2 = 0 UNION SELECT company, quarter_index FROM series WHERE quarter_index % 3 = 0""")
def period_union(spark, d):
    s = quarterly(spark, d).select("company", "quarter_index")
    return s.where("quarter_index % 2 = 0").union(s.where("quarter_index % 3 = 0")).distinct()


@query("guidance_baseline", SERIES_SQL + f""", g AS (SELECT *, CASE WHEN quarter_index % 3 = 0 THEN revenue * 1.02 END AS official, avg(revenue) {frame(3)} AS proxy FROM series), r AS (SELECT *, coalesce(official, proxy) AS guidance, CASE WHEN official IS NULL THEN 'proxy' ELSE 'official' END AS mode FROM g)
SELECT company, quarter_index, mode, round(guidance, 4) AS guidance, round((revenue / nullif(lag(guidance) {OVER}, 0) - 1) * 100, 4) AS realised_vs_previous, round((guidance / nullif(lag(guidance) {OVER}, 0) - 1) * 100, 4) AS change, coalesce(mode != lag(mode) {OVER}, false) AS switched FROM r""")
def guidance_baseline(spark, d):
    """Guidance where official, else the trailing mean; against what came before it."""
    official = F.when(F.col("quarter_index") % 3 == 0, F.col("revenue") * 1.02)
    g = quarterly(spark, d).withColumn("official", official).withColumn("guidance", F.coalesce("official", S.trailing_mean("revenue"))).withColumn("mode", F.when(F.col("official").isNull(), "proxy").otherwise("official"))
    last = S.before("guidance", 1)
    out = g.select("company", "quarter_index", "mode", "guidance", S.pct_change(F.col("revenue"), last).alias("realised_vs_previous"), S.pct_change(F.col("guidance"), last).alias("change"), F.coalesce(F.col("mode") != S.before("mode", 1), F.lit(False)).alias("switched"))
    return rounded(out, "guidance", "realised_vs_previous", "change")


@query("period_functions", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS q, CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS p FROM orders)
SELECT o_orderkey, (q // 4)::VARCHAR || 'Q' || (q % 4 + 1)::VARCHAR AS label, ((q - 5) // 4)::VARCHAR || 'Q' || ((q - 5) % 4 + 1)::VARCHAR AS shifted, last_day(make_date(q // 4, (q % 4) * 3 + 3, 1)) AS ends,
       CAST(year(p) * 4 + quarter(p) - 1 AS INTEGER) AS majority, CAST(year(d) + CASE WHEN month(d) > 9 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year, CAST(((month(d) - 10 + 12) % 12) // 3 + 1 AS INTEGER) AS fiscal_quarter FROM o""")
def period_functions(spark, d):
    date = F.to_date("o_orderdate")
    q = P.index_of_date(date)
    year, quarter = P.fiscal_period(date, F.lit(9))
    return table(spark, d, "orders").select("o_orderkey", P.label(q).alias("label"), P.shift(P.label(q), -5).alias("shifted"), P.end_date(q).alias("ends"), P.majority_index(date).alias("majority"), year.alias("fiscal_year"), quarter.alias("fiscal_quarter"))


@query("annual_lookup", """WITH a AS (SELECT DISTINCT c_nationkey AS company, CAST(year(o_orderdate) * 4 + 3 AS INTEGER) AS annual_index FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'),
q AS (SELECT DISTINCT c_nationkey AS company, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS quarter_index FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT q.company, quarter_index, max(annual_index) AS annual_index FROM q LEFT JOIN a ON a.company = q.company AND q.quarter_index - annual_index BETWEEN 0 AND 5 GROUP BY q.company, quarter_index""")
def annual_lookup(spark, d):
    """The nearest annual filing of up to six quarters: the range is unrolled to an equi-join."""
    from quartermill.operators.selection import nearest_annual

    joined = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("company")), F.col("o_custkey") == F.col("c_custkey"))
    annual = joined.where("o_orderpriority = '1-URGENT'").select("company", (F.year("o_orderdate") * 4 + 3).cast("int").alias("annual_index")).distinct()
    return nearest_annual(joined.select("company", P.index_of_date(F.col("o_orderdate")).alias("quarter_index")).distinct(), annual)


@query("income_bridge", """WITH l AS (SELECT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS quarter_index, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS gross_sales,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2)) * 5) AS DOUBLE) AS opex, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT quarter_index, gross_sales AS revenue, round(greatest(cost, 0), 5) AS cost, round(greatest(gross_sales - cost, 0), 5) AS gross_profit, round(greatest(opex, 0), 5) AS opex, round(greatest(gross_sales - cost - opex, 0), 5) AS operating_profit FROM l""")
def income_bridge(spark, d):
    from quartermill.operators.structure import income_bridge as bridge

    dec = lambda c, t: F.col(c).cast(t)
    items = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", P.index_of_date(F.col("o_orderdate")).alias("quarter_index")), F.col("l_orderkey") == F.col("o_orderkey"))
    price = dec("l_extendedprice", "decimal(14,2)")
    sums = items.groupBy("quarter_index").agg(F.sum(price).cast("double").alias("revenue"), F.sum(price * dec("l_tax", "decimal(4,2)")).cast("double").alias("cost"), F.sum(price * dec("l_discount", "decimal(4,2)") * 5).cast("double").alias("opex"))
    return rounded(bridge(sums), "cost", "gross_profit", "opex", "operating_profit", digits=5)


__all__ = ["ORACLES", "QUERIES", "lines", "net"]
