"""Queries over structures, selections and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quartermill.functions import numbers as N
from quartermill.operators import quality as Q
from quartermill.operators import selection as X
from quartermill.operators import structure as T
from quartermill.plans.base import LINES_SQL, OVER, SERIES_SQL, frame, lines, net, quarterly, rounded, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def segments(spark, d):
    """company, quarter_index, name (market segment), value, position, revenue."""
    sums = lines(spark, d, "c_mktsegment").groupBy("company", "quarter_index", F.col("c_mktsegment").alias("name")).agg(F.sum(net()).alias("v"))
    w = Window.partitionBy("company", "quarter_index")
    return sums.select("company", "quarter_index", "name", F.col("v").cast("double").alias("value"), F.row_number().over(w.orderBy("name")).alias("position"), F.sum("v").over(w).cast("double").alias("revenue"))


SEG = f"""WITH {LINES_SQL}, v AS (SELECT company, quarter_index, c_mktsegment AS name, sum(net) AS v FROM lines GROUP BY ALL),
seg AS (SELECT company, quarter_index, name, CAST(v AS DOUBLE) AS value, CAST(row_number() OVER (PARTITION BY company, quarter_index ORDER BY name) AS INTEGER) AS position,
               CAST(sum(v) OVER (PARTITION BY company, quarter_index) AS DOUBLE) AS revenue FROM v)"""


@query("segment_share", SEG + """, p AS (SELECT *, CASE WHEN quarter_index % 2 = 0 THEN revenue ELSE revenue * 3 END AS r, sum(value) OVER (PARTITION BY company, quarter_index) AS s FROM seg WHERE value > 0)
SELECT company, quarter_index, name, round(value / CASE WHEN s / r BETWEEN 0.55 AND 1.35 THEN r ELSE s END * 100, 4) AS share FROM p""")
def segment_share(spark, d):
    s = segments(spark, d).withColumn("revenue", F.when(F.col("quarter_index") % 2 == 0, F.col("revenue")).otherwise(F.col("revenue") * 3))
    return rounded(T.shares(s).select("company", "quarter_index", "name", "share"), "share")


@query("structure_reasonable", SEG + """, s AS (SELECT company, quarter_index, sum(value) / (max(revenue) * (0.6 + company % 4 * 0.3)) AS ratio FROM seg GROUP BY company, quarter_index)
SELECT company, quarter_index, round(ratio, 4) AS ratio, CASE WHEN company % 5 = 0 THEN ratio BETWEEN 0.55 AND 1.55 WHEN company % 5 = 1 THEN ratio BETWEEN 0.7 AND 1.0 ELSE ratio BETWEEN 0.45 AND 1.45 END AS reasonable FROM s""")
def structure_reasonable(spark, d):
    c = F.col("n_nationkey")
    bounds = table(spark, d, "nation").where("n_nationkey % 5 < 2").select(c.alias("company"), F.when(c % 5 == 0, T.RATIO_BOUNDS["visa"][0]).otherwise(0.7).alias("low"), F.when(c % 5 == 0, T.RATIO_BOUNDS["visa"][1]).otherwise(1.0).alias("high"))
    return rounded(T.reasonable(segments(spark, d).withColumn("revenue", F.col("revenue") * (0.6 + F.col("company") % 4 * 0.3)), bounds=bounds), "ratio")


@query("top_n_other", SEG + """, k AS (SELECT *, row_number() OVER (PARTITION BY company, quarter_index ORDER BY value DESC, position) AS k, count(*) OVER (PARTITION BY company, quarter_index) AS n, value / sum(value) OVER (PARTITION BY company, quarter_index) * 100 AS share FROM seg WHERE value > 0),
t AS (SELECT *, n > 4 AND (k > 3 OR share < 20) AS o FROM k), o AS (SELECT company, quarter_index, CASE WHEN o THEN 'Other' ELSE name END AS name, CAST(CASE WHEN o THEN 1 << 30 ELSE position END AS INTEGER) AS position, value FROM t)
SELECT company, quarter_index, name, position, round(sum(value), 5) AS value FROM o GROUP BY ALL""")
def top_n_other(spark, d):
    return rounded(T.top_and_other(segments(spark, d), 4, 20.0), "value", digits=5)


@query("first_n_other", SEG + """, k AS (SELECT *, count(*) OVER (PARTITION BY company, quarter_index) AS n, value / sum(value) OVER (PARTITION BY company, quarter_index) * 100 >= 19 AS large FROM seg), t AS (SELECT *, n > 3 AND NOT (large AND sum(CASE WHEN large THEN 1 ELSE 0 END) OVER (PARTITION BY company, quarter_index ORDER BY position) <= 2) AS o FROM k),
o AS (SELECT company, quarter_index, CASE WHEN o THEN 'Other operating items' ELSE name END AS name, value FROM t) SELECT company, quarter_index, name, round(sum(value), 5) AS value FROM o GROUP BY ALL""")
def first_n_other(spark, d):
    return rounded(T.first_and_other(segments(spark, d), 3, 19.0).select("company", "quarter_index", "name", "value"), "value", digits=5)


@query("delta_contribution", SEG + """, e AS (SELECT company, min(quarter_index) AS a, max(quarter_index) AS b FROM seg GROUP BY company)
SELECT company, name, round(coalesce(sum(CASE WHEN quarter_index = a THEN value END), 0), 5) AS first, round(coalesce(sum(CASE WHEN quarter_index = b THEN value END), 0), 5) AS latest,
       round(coalesce(sum(CASE WHEN quarter_index = b THEN value END), 0) - coalesce(sum(CASE WHEN quarter_index = a THEN value END), 0), 5) AS change FROM seg JOIN e USING (company) WHERE quarter_index IN (a, b) GROUP BY company, name""")
def delta_contribution(spark, d):
    return rounded(T.delta(segments(spark, d)), "first", "latest", "change", digits=5)


@query("delta_leader", SEG + """, e AS (SELECT company, min(quarter_index) AS a, max(quarter_index) AS b FROM seg GROUP BY company),
c AS (SELECT company, name, coalesce(sum(CASE WHEN quarter_index = b THEN value END), 0) - coalesce(sum(CASE WHEN quarter_index = a THEN value END), 0) AS change FROM seg JOIN e USING (company) WHERE quarter_index IN (a, b) GROUP BY company, name)
SELECT company, arg_max(name, change) AS leader, round(max(change), 5) AS change FROM c WHERE change > 0.05 GROUP BY company""")
def delta_leader(spark, d):
    return rounded(T.delta_leader(segments(spark, d)), "change", digits=5)


_PARTIAL = "(company + quarter_index + position) % 4 != 0"


def _canonical(spark, d):
    c = F.col("n_nationkey")
    every = F.array(*map(F.lit, ("MACHINERY", "SPACE", "BUILDING", "AUTOMOBILE", "FURNITURE")))
    return table(spark, d, "nation").where("n_nationkey % 3 != 0").select(c.alias("company"), F.slice(every, F.lit(1), (c % 6).cast("int")).alias("names"))


_PROFILE = SEG + f""", i AS (SELECT company, quarter_index, CASE WHEN position = 1 AND company % 4 = 0 THEN 'Europe' ELSE name END AS name, value, position, revenue FROM seg WHERE {_PARTIAL} AND NOT (company % 4 = 0 AND quarter_index % 3 = 0 AND position != 1)),
u AS (SELECT company, quarter_index FROM i GROUP BY ALL HAVING count(CASE WHEN name != 'Europe' THEN 1 END) > 0), j AS (SELECT i.* FROM i JOIN u USING (company, quarter_index)),
q AS (SELECT company, quarter_index, count(DISTINCT name) AS n FROM j GROUP BY ALL), z AS (SELECT company, count(*) AS quarters, list_sort(list(n))[count(*) // 2 + 1] AS median FROM q GROUP BY company),
y AS (SELECT n_nationkey AS company, ['MACHINERY', 'SPACE', 'BUILDING', 'AUTOMOBILE', 'FURNITURE'][1 : n_nationkey % 6] AS names FROM nation WHERE n_nationkey % 3 != 0), w AS (SELECT company, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS place FROM y),
c AS (SELECT company, name, count(DISTINCT quarter_index) AS quarters, min(quarter_index * 100 + position) AS p FROM j GROUP BY ALL), f AS (SELECT company, name, coalesce(quarters, 0) AS quarters, p, place FROM c FULL JOIN w USING (company, name)),
n AS (SELECT *, count(*) OVER (PARTITION BY company) AS names, coalesce(max(place + 1) OVER (PARTITION BY company), 0) AS m FROM f), r AS (SELECT n.*, CASE WHEN m >= 5 THEN 3 WHEN m >= 3 THEN 2 ELSE 1 END AS required, row_number() OVER (PARTITION BY n.company ORDER BY place NULLS LAST, n.quarters DESC, p, name) AS rank, coalesce(median, 0) AS median, coalesce(z.quarters, 0) AS total FROM n LEFT JOIN z USING (company)),
s AS (SELECT *, total > 0 AND quarters >= greatest(2, round_even(total * 0.4, 0)) AS stable FROM r), t AS (SELECT *, sum(CASE WHEN stable THEN 1 ELSE 0 END) OVER (PARTITION BY company ORDER BY rank) AS k, bool_or(stable) OVER (PARTITION BY company) AS held FROM s),
profile AS (SELECT company, name, quarters, CAST(rank AS INTEGER) AS rank, CASE WHEN held THEN stable AND k <= 2 ELSE rank <= 2 END AS core, CAST(greatest(required, least(names, greatest(2, round_even(greatest(median, required) * 0.8, 0)))) AS BIGINT) AS target FROM t)"""


def _profiled(spark, d):
    regional = F.when((F.col("position") == 1) & (F.col("company") % 4 == 0), "Europe").otherwise(F.col("name"))
    return segments(spark, d).where(_PARTIAL).where("NOT (company % 4 = 0 AND quarter_index % 3 = 0 AND position != 1)").withColumn("name", regional)


@query("core_name_profile", _PROFILE + " SELECT * FROM profile")
def core_name_profile(spark, d):
    """Canonical names for two nations in three; in every fourth nation quarters of a region alone."""
    return T.name_profile(_profiled(spark, d), _canonical(spark, d))


@query("complete_snapshots", _PROFILE + """, m AS (SELECT company, quarter_index, count(core) AS known, count(CASE WHEN core THEN 1 END) AS core FROM i LEFT JOIN profile USING (company, name) WHERE value > 0 GROUP BY ALL), e AS (SELECT company, max(target) AS target, count(CASE WHEN core THEN 1 END) AS cores FROM profile GROUP BY company)
SELECT company, quarter_index, known, m.core, known >= target AND m.core >= least(cores, CASE WHEN target >= 4 THEN 2 ELSE 1 END) AS complete FROM m JOIN e USING (company)""")
def complete_snapshots(spark, d):
    items = _profiled(spark, d)
    return T.complete_snapshots(items, T.name_profile(items, _canonical(spark, d)))


@query("dominant_basis", SERIES_SQL + """, k AS (SELECT company, CASE WHEN (company * 3 + quarter_index) % 5 < 1 + company % 4 THEN 'geography' ELSE 'segment' END AS kind FROM series)
SELECT company, CASE WHEN count(CASE WHEN kind = 'geography' THEN 1 END) > count(CASE WHEN kind = 'segment' THEN 1 END) THEN 'geography' ELSE 'segment' END AS basis FROM k GROUP BY company""")
def dominant_basis(spark, d):
    kind = F.when((F.col("company") * 3 + F.col("quarter_index")) % 5 < 1 + F.col("company") % 4, "geography").otherwise("segment")
    return T.dominant_basis(quarterly(spark, d).select("company", kind.alias("kind")))


@query("harmonised_basis", SERIES_SQL + """, k AS (SELECT company, quarter_index, CASE WHEN (company + quarter_index) % 3 = 0 THEN 'segment' ELSE 'geography' END AS kind, company % 2 = 0 OR quarter_index % 3 != 0 AS valid FROM series),
b AS (SELECT *, bool_or(kind = 'segment' AND valid) OVER (PARTITION BY company) AS s FROM k)
SELECT company, quarter_index, kind, valid, CASE WHEN valid AND kind = CASE WHEN s THEN 'segment' ELSE 'geography' END THEN kind END AS kind_kept FROM b""")
def harmonised_basis(spark, d):
    kind = F.when((F.col("company") + F.col("quarter_index")) % 3 == 0, "segment").otherwise("geography")
    return T.harmonised(quarterly(spark, d).select("company", "quarter_index", kind.alias("kind"), ((F.col("company") % 2 == 0) | (F.col("quarter_index") % 3 != 0)).alias("valid")))


@query("segment_share_inferred", SEG + f""", known AS (SELECT company, quarter_index, name, value / sum(value) OVER (PARTITION BY company, quarter_index) * 100 AS share FROM seg WHERE (company + quarter_index) % 3 = 0),
q AS (SELECT company, quarter_index, max(revenue) AS revenue, row_number() OVER (PARTITION BY company ORDER BY quarter_index) AS r, bool_or((company + quarter_index) % 3 = 0) AS anchor FROM seg GROUP BY company, quarter_index),
n AS (SELECT *, last_value(CASE WHEN anchor THEN quarter_index END IGNORE NULLS) {OVER[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, last_value(CASE WHEN anchor THEN r END IGNORE NULLS) {OVER[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pr,
             first_value(CASE WHEN anchor THEN quarter_index END IGNORE NULLS) {OVER[:-1]} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n, first_value(CASE WHEN anchor THEN r END IGNORE NULLS) {OVER[:-1]} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nr FROM q),
w AS (SELECT *, CASE WHEN p IS NULL THEN 1.0 WHEN n IS NULL THEN 0.0 ELSE (r - pr)::DOUBLE / (nr - pr) END AS w FROM n WHERE NOT anchor AND (p IS NOT NULL OR n IS NOT NULL)),
s AS (SELECT company, quarter_index, revenue, p AS src, 1 - w AS w FROM w WHERE p IS NOT NULL AND 1 - w > 0 UNION ALL SELECT company, quarter_index, revenue, n, w FROM w WHERE n IS NOT NULL AND w > 0),
m AS (SELECT s.company, s.quarter_index, name, sum(share * w) AS v, max(revenue) AS revenue FROM s JOIN known k ON s.company = k.company AND s.src = k.quarter_index GROUP BY ALL),
t AS (SELECT *, v / sum(v) OVER (PARTITION BY company, quarter_index) * 100 AS share FROM m)
SELECT company, quarter_index, name, round(share, 4) AS share, round(share * revenue / 100, 5) AS value FROM t WHERE share >= 10""")
def segment_share_inferred(spark, d):
    s = segments(spark, d)
    known = T.shares(s.where("(company + quarter_index) % 3 = 0")).select("company", "quarter_index", "name", "share")
    quarters = s.groupBy("company", "quarter_index").agg(F.max("revenue").alias("revenue"))
    return rounded(rounded(T.inferred_shares(known, quarters, 10.0), "share"), "value", digits=5)


@query("rescale_to_total", SEG + """, seg7 AS (SELECT company, quarter_index, name, position, value / 7 AS value, revenue / 7 AS revenue FROM seg), r AS (SELECT *, revenue * (0.5 + company % 4 * 0.4) AS t, sum(value) OVER (PARTITION BY company, quarter_index) AS s, quarter_index % 5 != 0 OR position % 2 = 0 AS quarterly, (position * company * 40)::DOUBLE AS y FROM seg7),
b AS (SELECT *, bool_or(quarterly) OVER (PARTITION BY company, quarter_index) AND quarter_index % 7 != 0 AS held FROM r)
SELECT company, quarter_index, name, round_even(CASE WHEN held AND NOT s / t BETWEEN 0.55 AND 1.35 THEN t * value / s ELSE value END, 3) AS scaled, CASE WHEN y <= 500 THEN y END AS yoy FROM b""")
def rescale_to_total(spark, d):
    annual = (F.col("quarter_index") % 7 == 0) | ((F.col("quarter_index") % 5 == 0) & (F.col("position") % 2 == 1))
    s = segments(spark, d).withColumns({"value": F.col("value") / 7, "revenue": F.col("revenue") / 7 * (0.5 + F.col("company") % 4 * 0.4), "scope": F.when(annual, "annual_filing"), "yoy": (F.col("position") * F.col("company") * 40).cast("double")})
    return T.rescaled(s).select("company", "quarter_index", "name", "scaled", "yoy")


@query("flow_items", SEG + """, f AS (SELECT *, revenue * (0.7 + company % 4 * 0.2) AS target, sum(value) OVER (PARTITION BY company, quarter_index) AS s, row_number() OVER (PARTITION BY company, quarter_index ORDER BY position DESC) AS k FROM seg WHERE value > 0.03),
g AS (SELECT *, target - s AS gap, greatest(0.2, target * 0.06) AS tol FROM f)
SELECT company, quarter_index, name, round(CASE WHEN gap < -tol THEN value * target / s WHEN gap <= tol AND k = 1 THEN greatest(value + gap, 0) ELSE value END, 5) AS flow FROM g
UNION ALL SELECT company, quarter_index, 'Rest', round(max(gap), 5) FROM g WHERE gap > tol GROUP BY company, quarter_index""")
def flow_items(spark, d):
    s = segments(spark, d).withColumn("target", F.col("revenue") * (0.7 + F.col("company") % 4 * 0.2))
    return rounded(T.flows(s), "flow", digits=5)


@query("annual_allocation", SEG + """, a AS (SELECT company, (quarter_index // 4)::INTEGER AS y, name, sum(value) AS value FROM seg GROUP BY ALL), q AS (SELECT DISTINCT company, quarter_index, revenue, (quarter_index // 4)::INTEGER AS y FROM seg)
SELECT q.company, quarter_index, name, round(greatest(0.001, revenue * value / sum(value) OVER (PARTITION BY q.company, quarter_index)), 5) AS quarter_value FROM q JOIN a USING (company, y)""")
def annual_allocation(spark, d):
    s = segments(spark, d).withColumn("y", F.floor(F.col("quarter_index") / 4))
    annual = s.groupBy("company", "y", "name").agg(F.sum("value").alias("value"))
    quarters = s.groupBy("company", "quarter_index", "y").agg(F.max("revenue").alias("revenue"))
    return rounded(T.allocated(quarters.join(annual, ["company", "y"])).select("company", "quarter_index", "name", "quarter_value"), "quarter_value", digits=5)


@query("segment_merge_alias", SEG + """, a AS (SELECT company, quarter_index, CASE WHEN name IN ('AUTOMOBILE', 'MACHINERY') THEN 'INDUSTRY' ELSE name END AS name, value, position FROM seg)
SELECT company, quarter_index, name, round(sum(value), 5) AS value, min(position) AS position FROM a GROUP BY ALL""")
def segment_merge_alias(spark, d):
    aliases = spark.createDataFrame([("Automobile", "INDUSTRY"), ("machin-ery", "INDUSTRY")], "alias string, canonical string")
    merged = T.normalised(T.aliased(segments(spark, d).withColumn("note", F.lit(None).cast("string")), aliases))
    return rounded(merged.select("company", "quarter_index", "name", "value", "position"), "value", digits=5)


@query("subset_prune", SEG + """, i AS (SELECT company, quarter_index, revenue * (0.5 + company % 5 * 0.15) AS revenue, position, name, CASE WHEN company % 6 = 5 AND position = 2 THEN 0 ELSE value END AS value, position % 2 = 0 AS business, position = 5 AS aggregate FROM seg), pos AS (SELECT * FROM i WHERE value > 0),
m0 AS (SELECT company, quarter_index, max(revenue) AS revenue FROM pos GROUP BY ALL), m AS (SELECT *, unnest(range(1, 1 << 5)) AS mask FROM m0),
x AS (SELECT m.company, m.quarter_index, m.mask, m.revenue, sum(value) AS s, count(*) AS n, count(CASE WHEN business THEN 1 END) AS b, count(CASE WHEN aggregate THEN 1 END) AS a, sum(1 << (5 - v.position)) AS ord, list(name ORDER BY v.position) AS names, list(name ORDER BY value DESC, v.position) AS by_value
      FROM m JOIN pos v ON m.company = v.company AND m.quarter_index = v.quarter_index AND ((m.mask >> (v.position - 1)) & 1) = 1 GROUP BY ALL),
c AS (SELECT *, round(1 - abs(revenue - s) / greatest(revenue, 1) + CASE WHEN b = n OR b = 0 THEN 0.06 ELSE -0.08 END + n * 0.03 + b * 0.015 - a * 0.09, 9) AS score FROM x WHERE s / revenue BETWEEN 0.45 AND 1.18),
r AS (SELECT *, row_number() OVER (PARTITION BY company, quarter_index ORDER BY score DESC, n, ord DESC) AS k FROM c), w AS (SELECT company, quarter_index, list(name ORDER BY position) AS names FROM pos GROUP BY ALL)
SELECT w.company, w.quarter_index, array_to_string(CASE WHEN r.names IS NULL THEN w.names WHEN w.company % 3 = 0 THEN r.names ELSE by_value END, ',') AS kept FROM w LEFT JOIN r ON r.company = w.company AND r.quarter_index = w.quarter_index AND k = 1""")
def subset_prune(spark, d):
    p = F.col("position")
    s = segments(spark, d).withColumn("value", F.when((F.col("company") % 6 == 5) & (p == 2), 0.0).otherwise(F.col("value")))
    item = lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), (x["position"] % 2 == 0).alias("business"), (x["position"] == 5).alias("aggregate"))
    packed = s.groupBy("company", "quarter_index").agg((F.max("revenue") * (0.5 + F.first("company") % 5 * 0.15)).alias("revenue"), F.transform(F.sort_array(F.collect_list(F.struct("position", "name", "value"))), item).alias("items")).withColumn("ordered", F.col("company") % 3 == 0)
    return T.best_subset(packed).select("company", "quarter_index", F.array_join(F.transform("kept", lambda x: x["name"]), ",").alias("kept"))


@query("overlap_suppression", SEG + """, g AS (SELECT company, quarter_index, lower(name) AS name, value + CASE WHEN position = 1 AND company % 2 = 0 THEN 1 ELSE 0 END AS value FROM seg),
b AS (SELECT g.company, g.quarter_index FROM g JOIN seg s ON g.company = s.company AND g.quarter_index = s.quarter_index AND lower(s.name) = g.name AND abs(s.value - g.value) <= 0.01 JOIN (SELECT company, quarter_index, count(*) AS n FROM g GROUP BY ALL) h ON h.company = g.company AND h.quarter_index = g.quarter_index GROUP BY g.company, g.quarter_index HAVING count(*) = max(h.n))
SELECT company, quarter_index, name FROM g ANTI JOIN b USING (company, quarter_index)""")
def overlap_suppression(spark, d):
    s = segments(spark, d)
    g = s.select("company", "quarter_index", F.lower("name").alias("name"), (F.col("value") + F.when((F.col("position") == 1) & (F.col("company") % 2 == 0), 1).otherwise(0)).alias("value"))
    return T.without_overlap(s, g).select("company", "quarter_index", "name")


@query("share_crosswalk", SEG + """, w(from_name, to_name, weight) AS (VALUES ('AUTOMOBILE', 'A', 0.6), ('AUTOMOBILE', 'B', 0.4), ('BUILDING', 'A', 1.0), ('FURNITURE', 'B', 1.0), ('HOUSEHOLD', 'C', 1.0), ('MACHINERY', 'C', 0.5), ('MACHINERY', 'A', 0.5)),
h AS (SELECT *, value / revenue * 100 AS share FROM seg WHERE (company + position) % 6 != 0), t AS (SELECT *, sum(share) OVER (PARTITION BY company, quarter_index) AS s FROM h)
SELECT company, quarter_index, to_name AS name, round(sum(weight::DOUBLE * share * revenue / 100), 5) AS value FROM t JOIN w ON name = from_name WHERE s >= 85 GROUP BY ALL""")
def share_crosswalk(spark, d):
    weights = spark.createDataFrame([("AUTOMOBILE", "A", 0.6), ("AUTOMOBILE", "B", 0.4), ("BUILDING", "A", 1.0), ("FURNITURE", "B", 1.0), ("HOUSEHOLD", "C", 1.0), ("MACHINERY", "C", 0.5), ("MACHINERY", "A", 0.5)], "from_name string, to_name string, weight double")
    s = segments(spark, d).where("(company + position) % 6 != 0").withColumn("share", F.col("value") / F.col("revenue") * 100)
    return rounded(T.crosswalk(s, F.broadcast(weights), F.col("revenue")), "value", digits=5)


@query("largest_item", SEG + """ SELECT company, quarter_index, arg_max(name, value) AS top, round(max(value) / max(revenue) * 100, 4) AS top_share FROM seg GROUP BY company, quarter_index""")
def largest_item(spark, d):
    out = segments(spark, d).groupBy("company", "quarter_index").agg(F.max_by("name", F.struct(F.col("value"), -F.col("position"))).alias("top"), (F.max("value") / F.max("revenue") * 100).alias("top_share"))
    return rounded(out, "top_share")


@query("outlier_gate", SERIES_SQL + f""", p AS (SELECT *, revenue * CASE WHEN quarter_index % 7 = 0 THEN 3.0 WHEN quarter_index % 7 = 1 THEN 0.4 ELSE 1.02 END AS parsed FROM series)
SELECT company, quarter_index, round(CASE WHEN (parsed / revenue < 0.6 OR parsed / revenue > 1.6) AND abs(parsed - revenue) >= 500000 THEN revenue ELSE parsed END, 4) AS gated, round(CASE WHEN parsed / revenue BETWEEN 0.45 AND 2.25 THEN parsed ELSE revenue END, 4) AS accepted FROM p""")
def outlier_gate(spark, d):
    p = quarterly(spark, d).withColumn("parsed", F.col("revenue") * F.when(F.col("quarter_index") % 7 == 0, 3.0).when(F.col("quarter_index") % 7 == 1, 0.4).otherwise(1.02))
    return rounded(p.select("company", "quarter_index", N.or_history(F.col("parsed"), F.col("revenue"), 0.6, 1.6, 500000.0).alias("gated"), N.candidate(F.col("revenue"), F.col("parsed")).alias("accepted")), "gated", "accepted")


def audit(spark, d):
    """A result for each company and quarter: missing lags, jumps and losses are its issues."""
    from quartermill.operators.series import by_quarter

    s = quarterly(spark, d)
    jump = F.abs(F.col("revenue") / F.lag("revenue").over(by_quarter()) - 1)
    rules = F.array_compact(F.array(
        F.when(F.lag("revenue", 4).over(by_quarter()).isNull(), F.struct(F.lit("major").alias("severity"), F.lit("short").alias("code"))),
        F.when(jump > 0.3, F.struct(F.lit("critical").alias("severity"), F.lit("jump").alias("code"))),
        F.when(jump > 0.1, F.struct(F.lit("minor").alias("severity"), F.lit("move").alias("code"))),
        F.when(F.col("earnings") < 0, F.struct(F.lit("minor").alias("severity"), F.lit("loss").alias("code")))))
    rated = s.select("company", "quarter_index", rules.alias("issues"))
    count = lambda x: F.size(F.filter("issues", lambda i: i["severity"] == x))
    rated = rated.withColumns({x: count(x) for x in Q.WEIGHTS})
    score = F.greatest(F.lit(0), 100 - 25 * F.col("critical") - 10 * F.col("major") - 4 * F.col("minor"))
    return rated.withColumn("score", score).withColumn("status", F.when(F.col("critical") > 0, "fail").when((F.col("major") >= 3) | (F.col("score") < 95), "review").otherwise("pass"))


AUDIT = SERIES_SQL + f""", j AS (SELECT *, abs(revenue / lag(revenue) {OVER} - 1) AS jump, lag(revenue, 4) {OVER} AS r4 FROM series),
c AS (SELECT company, quarter_index, CASE WHEN r4 IS NULL THEN 1 ELSE 0 END AS major, CASE WHEN jump > 0.3 THEN 1 ELSE 0 END AS critical, CASE WHEN jump > 0.1 THEN 1 ELSE 0 END AS moved, CASE WHEN earnings < 0 THEN 1 ELSE 0 END AS loss FROM j),
audit AS (SELECT *, moved + loss AS minor, greatest(0, 100 - 25 * critical - 10 * major - 4 * (moved + loss)) AS score, CASE WHEN critical > 0 THEN 'fail' WHEN major >= 3 OR greatest(0, 100 - 25 * critical - 10 * major - 4 * (moved + loss)) < 95 THEN 'review' ELSE 'pass' END AS status FROM c)"""


@query("quality_rules", AUDIT + " SELECT company, quarter_index, CAST(critical AS INTEGER) AS critical, CAST(major AS INTEGER) AS major, CAST(minor AS INTEGER) AS minor, CAST(score AS INTEGER) AS score, status FROM audit")
def quality_rules(spark, d):
    return audit(spark, d).select("company", "quarter_index", "critical", "major", "minor", "score", "status")


@query("status_rollup", AUDIT + " SELECT company, count(CASE WHEN status = 'pass' THEN 1 END) AS pass, count(CASE WHEN status = 'review' THEN 1 END) AS review, count(CASE WHEN status = 'fail' THEN 1 END) AS fail, 0::BIGINT AS error FROM audit GROUP BY company")
def status_rollup(spark, d):
    return Q.status_counts(audit(spark, d))


@query("issue_top_k", AUDIT + """, i AS (SELECT company, code, sum(n) AS n, min(CASE WHEN n > 0 THEN quarter_index * 10 + k END) AS first_seen FROM (SELECT company, quarter_index, unnest(['short', 'jump', 'move', 'loss']) AS code, unnest([major, critical, moved, loss]) AS n, unnest([0, 1, 2, 3]) AS k FROM audit) GROUP BY ALL HAVING sum(n) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY n DESC, first_seen, code) AS rank FROM i) SELECT company, code, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def issue_top_k(spark, d):
    order = F.create_map(*(x for n, c in enumerate(("short", "jump", "move", "loss")) for x in (F.lit(c), F.lit(n))))
    issues = audit(spark, d).select("company", "quarter_index", F.explode("issues").alias("i")).select("company", (F.col("quarter_index") * 10 + F.element_at(order, F.col("i.code"))).alias("seq"), "i.severity", "i.code")
    return Q.issue_counts(issues, 2).select("company", "code", "n", "rank")


@query("company_snapshot", AUDIT + """, s AS (SELECT company, quarter_index AS q, quarter_index % 2 = 0 AS c, quarter_index % 3 != 0 AS d, quarter_index % 5 != 0 AS w, quarter_index % 10 < 4 OR company % 4 = 3 AS t FROM series),
k AS (SELECT company, count(CASE WHEN c THEN 1 END) AS cached_count, min(CASE WHEN c THEN q END) AS cached_first, max(CASE WHEN c THEN q END) AS cached_last, count(CASE WHEN d THEN 1 END) AS dynamic_count, min(CASE WHEN d THEN q END) AS dynamic_first, max(CASE WHEN d THEN q END) AS dynamic_last, count(CASE WHEN w THEN 1 END) AS window_count, greatest(0, count(CASE WHEN w THEN 1 END) - count(CASE WHEN t THEN 1 END)) AS excluded_count FROM s GROUP BY company),
a AS (SELECT company, count(*) AS audited_count, count(CASE WHEN status = 'pass' THEN 1 END) AS pass, count(CASE WHEN status = 'review' THEN 1 END) AS review, count(CASE WHEN status = 'fail' THEN 1 END) AS fail FROM audit WHERE company % 5 != 4 GROUP BY company)
SELECT k.*, coalesce(audited_count, 0) AS audited_count, coalesce(pass, 0) AS pass, coalesce(review, 0) AS review, coalesce(fail, 0) AS fail, 0::BIGINT AS error FROM k LEFT JOIN a USING (company)""")
def company_snapshot(spark, d):
    q = F.col("quarter_index")
    supported = quarterly(spark, d).select("company", "quarter_index", (q % 2 == 0).alias("cached"), (q % 3 != 0).alias("dynamic"), (q % 5 != 0).alias("in_window"), ((q % 10 < 4) | (F.col("company") % 4 == 3)).alias("target"))
    return Q.snapshots(audit(spark, d).where("company % 5 != 4").select("company", "quarter_index", "status"), supported)


@query("audit_lines", AUDIT + """, p AS (SELECT company, count(CASE WHEN status = 'pass' THEN 1 END) AS pass, count(CASE WHEN status = 'review' THEN 1 END) AS review, count(CASE WHEN status = 'fail' THEN 1 END) AS fail, sum(critical) AS critical, sum(major) AS major, sum(minor) AS minor FROM audit GROUP BY company),
s AS (SELECT *, 1000 * fail + 10 * review + 6 * critical + 2 * major AS pressure FROM p), t AS (SELECT *, row_number() OVER (ORDER BY pressure DESC, company) AS rank FROM s WHERE pressure > 0 ORDER BY rank LIMIT 10),
i AS (SELECT company, code, sum(n) AS n, min(CASE WHEN n > 0 THEN quarter_index * 10 + k END) AS seen FROM (SELECT company, quarter_index, unnest(['short', 'jump', 'move', 'loss']) AS code, unnest([major, critical, moved, loss]) AS n, unnest([0, 1, 2, 3]) AS k FROM audit) GROUP BY ALL HAVING sum(n) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY n DESC, seen, code) AS i FROM i),
top AS (SELECT company, string_agg(code || '(' || n || ')', ', ' ORDER BY i) AS names FROM r WHERE i <= 4 GROUP BY company)
SELECT CAST(rank AS INTEGER) AS rank, rank || '. `' || t.company || '` | pressure=' || pressure || ' | pass=' || pass || ' review=' || review || ' fail=' || fail || ' | issues(c/m/n)=' || critical || '/' || major || '/' || minor || coalesce(' | top: ' || names, '') AS line FROM t LEFT JOIN top USING (company)""")
def audit_lines(spark, d):
    a = audit(spark, d)
    sums = a.groupBy("company").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "error", "review")), *(F.sum(s).alias(s) for s in Q.WEIGHTS))
    order = F.create_map(*(x for n, c in enumerate(("short", "jump", "move", "loss")) for x in (F.lit(c), F.lit(n))))
    issues = a.select("company", "quarter_index", F.explode("issues").alias("i")).select("company", (F.col("quarter_index") * 10 + F.element_at(order, F.col("i.code"))).alias("seq"), "i.severity", "i.code")
    return Q.markdown(Q.pressure(sums), Q.issue_counts(issues, 4))


@query("pressure_rank", AUDIT + """, p AS (SELECT company, 1000 * count(CASE WHEN status = 'fail' THEN 1 END) + 10 * count(CASE WHEN status = 'review' THEN 1 END) + 6 * sum(critical) + 2 * sum(major) AS pressure FROM audit GROUP BY company) SELECT company, CAST(pressure AS BIGINT) AS pressure FROM p WHERE pressure > 0 ORDER BY pressure DESC, company LIMIT 10""")
def pressure_rank(spark, d):
    a = audit(spark, d)
    sums = a.groupBy("company").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("fail", "error", "review")), F.sum("critical").alias("critical"), F.sum("major").alias("major"))
    return Q.pressure(sums).select("company", F.col("pressure").cast("long").alias("pressure"))


@query("worst_quarters", AUDIT + """, r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY CASE status WHEN 'fail' THEN 2 WHEN 'review' THEN 1 ELSE 0 END DESC, score, quarter_index) AS rank FROM audit) SELECT company, quarter_index, status, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def worst_quarters(spark, d):
    return Q.worst_quarters(audit(spark, d)).select("company", "quarter_index", "status", "score", "rank")


@query("audit_sample", SERIES_SQL + """, k AS (SELECT company, quarter_index, row_number() OVER (PARTITION BY company ORDER BY quarter_index) AS k, count(*) OVER (PARTITION BY company) AS n FROM series) SELECT company, quarter_index FROM k WHERE k = least(12, n) OR k = n // 2 + 1 OR k = n""")
def audit_sample(spark, d):
    return Q.sampled(quarterly(spark, d).select("company", "quarter_index"), 12)


@query("ready_map", AUDIT + " SELECT company, coalesce(array_to_string(list_sort(list(quarter_index) FILTER (status = 'pass')), ','), '') AS ready FROM audit GROUP BY company")
def ready_map(spark, d):
    return Q.ready_map(audit(spark, d)).select("company", F.array_join(F.transform("ready", lambda q: q.cast("string")), ",").alias("ready"))


@query("coverage_ratio", AUDIT + " SELECT company, round(avg(CASE WHEN critical + major + minor > 0 THEN 1.0 ELSE 0.0 END), 6) AS covered FROM audit GROUP BY company")
def coverage_ratio(spark, d):
    return rounded(audit(spark, d).groupBy("company").agg(Q.coverage("issues").alias("covered")), "covered", digits=6)


@query("theme_scores", SERIES_SQL + f""", g AS (SELECT *, coalesce((revenue / nullif(lag(revenue, 4) {OVER}, 0) - 1) * 100, 0) AS yoy, coalesce((revenue / nullif(lag(revenue, 1) {OVER}, 0) - 1) * 100, 0) AS qoq FROM series)
SELECT company, quarter_index, CAST(greatest(32, least(98, round_even(60 + yoy * 0.8 + qoq * 0.4, 0))) AS INTEGER) AS score FROM g""")
def theme_scores(spark, d):
    from quartermill.operators.series import before

    g = quarterly(spark, d)
    yoy, qoq = (F.coalesce(N.pct_change(F.col("revenue"), before("revenue", n)), F.lit(0.0)) for n in (4, 1))
    return g.select("company", "quarter_index", N.clamped_score(60 + yoy * 0.8 + qoq * 0.4).alias("score"))


@query("source_material_join", """WITH m AS (SELECT l_partkey % 50 AS url, arg_max(l_linestatus || l_returnflag, l_orderkey * 10 + l_linenumber) AS status FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1) SELECT p_partkey, p_partkey % 50 AS url, status FROM part LEFT JOIN m ON p_partkey % 50 = m.url""")
def source_material_join(spark, d):
    sources = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("url"), F.lit("x").alias("label"))
    materials = table(spark, d, "lineitem").where("l_partkey % 3 = 0").select((F.col("l_partkey") % 50).alias("url"), F.lit("x").alias("label"), F.concat("l_linestatus", "l_returnflag").alias("status"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return X.with_materials(sources, materials).select("p_partkey", "url", "status")


@query("unseen_keys", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000)")
def unseen_keys(spark, d):
    seen = table(spark, d, "customer").where("c_acctbal > 1000").select(F.col("c_custkey").alias("o_custkey"))
    return X.unseen(table(spark, d, "orders").select("o_orderkey", "o_custkey"), seen, "o_custkey").select("o_orderkey")


@query("effective_rule", SERIES_SQL + """ SELECT company, quarter_index, CASE WHEN quarter_index <= 7984 THEN 'a' WHEN quarter_index <= 7990 THEN 'b' ELSE 'z' END AS value FROM series""")
def effective_rule(spark, d):
    rules = table(spark, d, "nation").select(F.col("n_nationkey").alias("company"), F.explode(F.array(F.struct(F.lit(0).alias("ordinal"), F.lit(7984).alias("through"), F.lit("a").alias("value")), F.struct(F.lit(1).alias("ordinal"), F.lit(7990).alias("through"), F.lit("b").alias("value")))).alias("r")).select("company", "r.*", F.lit("z").alias("default_value"))
    return X.effective_rule(quarterly(spark, d).select("company", "quarter_index"), rules)


@query("latest_record", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS k FROM events WHERE event_id % 25 >= 5) SELECT user_id, event_type, event_id FROM r WHERE k = 1")
def latest_record(spark, d):
    from quartermill.sources.readers import latest

    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", F.col("ts").alias("created_at"), (F.col("event_id") % 25).alias("schema_version"))
    return latest(rows, ["user_id", "event_type"], 5).select("user_id", "event_type", "event_id")


@query("fresh_records", """SELECT o_orderkey, epoch(TIMESTAMP '1999-01-01 00:00:00') - epoch(o_orderdate) <= CASE WHEN DATE '1999-01-01' - CAST(o_orderdate AS DATE) <= 180 THEN 21600 ELSE 2592000 END AND o_orderkey % 20 >= 3 AS fresh FROM orders""")
def fresh_records(spark, d):
    from quartermill.sources.readers import is_fresh

    fresh = is_fresh(F.col("o_orderdate"), F.to_date("o_orderdate"), F.to_timestamp(F.lit("1999-01-01 00:00:00")), F.col("o_orderkey") % 20, 3)
    return table(spark, d, "orders").select("o_orderkey", fresh.alias("fresh"))


@query("pending_targets", SERIES_SQL + " SELECT company, quarter_index FROM series WHERE NOT (company % 2 = 0 AND quarter_index < 7985)")
def pending_targets(spark, d):
    from quartermill.sources.readers import pending

    s = quarterly(spark, d).select("company", "quarter_index")
    return pending(s, s.where("company % 2 = 0 AND quarter_index < 7985"), "company", "quarter_index")


@query("fuzzy_resolve")
def fuzzy_resolve(spark, d):
    """Nations by names that are almost theirs. Ratcliff-Obershelp similarity is beyond SQL; tests hold it against the plain loop."""
    nation = table(spark, d, "nation")
    companies = nation.select(F.lower("n_name").alias("company_id"), F.array(F.regexp_replace(F.lower("n_name"), "[^a-z0-9]", "")).alias("aliases"))
    near = F.array(F.col("n_name"), F.concat(F.substring("n_name", 1, 4), F.lit("x")), F.reverse("n_name"))
    return X.suggested(nation.select(F.explode(near).alias("reference")).unionByName(table(spark, d, "customer").select(F.col("c_mktsegment").alias("reference")).distinct()), companies)


@query("window_frames", SERIES_SQL + f" SELECT company, quarter_index, round(sum(revenue) {frame(1)}, 5) AS two FROM series")
def window_frames(spark, d):
    from quartermill.operators.series import by_quarter

    return rounded(quarterly(spark, d).select("company", "quarter_index", F.sum("revenue").over(by_quarter((-1, 0))).alias("two")), "two", digits=5)
