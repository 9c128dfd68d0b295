"""Interval joins and merged sketches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartermill.functions.periods import index_of_date
from quartermill.operators import ranges as R
from quartermill.plans.base import table

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


@query("purchases_nearby", """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
e AS (SELECT p.event_id, count(*) AS n FROM p JOIN events x ON x.event_type = 'error' AND p.ts >= x.ts AND p.ts <= x.ts + INTERVAL '10 minutes' GROUP BY 1),
c AS (SELECT p.event_id, count(*) AS n, max(x.ts) AS t FROM p JOIN events x ON x.event_type = 'click' AND x.user_id = p.user_id AND p.ts >= x.ts AND p.ts <= x.ts + INTERVAL '1 day' GROUP BY 1)
SELECT p.event_id, coalesce(e.n, 0) AS errors, coalesce(c.n, 0) AS clicks, epoch_us(c.t) AS last_click FROM p LEFT JOIN e USING (event_id) LEFT JOIN c USING (event_id)""")
def purchases_nearby(spark, d):
    """Each purchase with the errors of anyone in the ten minutes before it, and its user's clicks in the day before."""
    events = table(spark, d, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    errors = R.around(events.where("event_type = 'error'").select(F.col("ts").alias("at")), "at", "0 minutes", "10 minutes")
    clicks = R.around(events.where("event_type = 'click'").select("user_id", F.col("ts").alias("at")), "at", "0 minutes", "1 day")
    near = R.range_join(bought.select("event_id", "ts"), errors, "ts", "since", "until", closed=True).groupBy("event_id").agg(F.count("*").alias("errors"))
    own = R.range_join(bought, clicks, "ts", "since", "until", keys=("user_id",), closed=True, how="left")
    own = own.groupBy("event_id").agg(F.count("at").alias("clicks"), F.unix_micros(F.max("at").cast("timestamp")).alias("last_click"))
    return own.join(near, "event_id", "left").select("event_id", F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), "clicks", "last_click")


@query("sketched_customers", """SELECT c_nationkey AS company, CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_custkey) AS customers, TRUE AS within
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def sketched_customers(spark, d):
    """Customers of a company's years from sketches of its quarters, held against exact counts: within four deviations."""
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("company"))
    orders = table(spark, d, "orders").select("o_custkey", index_of_date(F.col("o_orderdate")).alias("quarter_index")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    year = F.floor(F.col("quarter_index") / 4).cast("int").alias("year")
    about = R.merged(R.sketched(orders, ["company", "quarter_index"], "o_custkey").select("company", year, "sketch"), ["company", "year"])
    exact = orders.groupBy("company", year).agg(F.countDistinct("o_custkey").alias("customers"))
    return exact.join(about, ["company", "year"]).select("company", "year", "customers", (F.abs(F.col("about") - F.col("customers")) <= 4 * R.ERROR * F.col("customers")).alias("within"))
