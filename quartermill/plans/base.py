"""The driver's tables as quarterly series: a nation is a company, an order's quarter the period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartermill.functions.periods import index_of_date


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over all partitions of a shuffle: texts written from them cost far more than the rows, and a small file is a single task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def net() -> Column:
    return F.col("l_extendedprice").cast("decimal(14,2)") * (F.lit(1).cast("decimal(5,2)") - F.col("l_discount").cast("decimal(4,2)"))


def profit() -> Column:
    return F.col("l_extendedprice").cast("decimal(14,2)") * (F.lit("0.05").cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))


def lines(spark: SparkSession, sf_dir: str, *customer: str) -> DataFrame:
    """Line items with company and quarter; the columns read are those used here and `customer`."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", index_of_date(F.col("o_orderdate")).alias("quarter_index"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("company"), *customer)
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company, quarter_index, revenue, earnings, equity: a row for each nation and quarter."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(net()).alias("_net"), F.sum(profit()).alias("_profit"))  # an order's sums before the joins
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", index_of_date(F.col("o_orderdate")).alias("quarter_index"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("company"))
    met = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    sums = met.groupBy("company", "quarter_index").agg(F.sum("_net").cast("double").alias("revenue"), F.sum("_profit").alias("_profit"))
    running = F.sum("_profit").over(Window.partitionBy("company").orderBy("quarter_index").rowsBetween(Window.unboundedPreceding, 0))
    return sums.select("company", "quarter_index", "revenue", F.col("_profit").cast("double").alias("earnings"), (running.cast("double") + F.lit(1000000.0)).alias("equity"))


def gapped(series: DataFrame) -> DataFrame:
    """Revenue and earnings removed in a fifth of the quarters."""
    gone = (F.col("company") * 7 + F.col("quarter_index")) % 5 == 0
    return series.withColumns({c: F.when(~gone, F.col(c)) for c in ("revenue", "earnings")})


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


LINES_SQL = """lines AS (
  SELECT c_nationkey AS company, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS quarter_index, c_mktsegment, p_type, l_partkey,
         CAST(l_extendedprice AS DECIMAL(14,2)) * (CAST(1 AS DECIMAL(5,2)) - CAST(l_discount AS DECIMAL(4,2))) AS net,
         CAST(l_extendedprice AS DECIMAL(14,2)) * (CAST(0.05 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS profit
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey)"""
SERIES_SQL = f"""WITH {LINES_SQL},
sums AS (SELECT company, quarter_index, CAST(sum(net) AS DOUBLE) AS revenue, sum(profit) AS profit FROM lines GROUP BY ALL),
series AS (SELECT company, quarter_index, revenue, CAST(profit AS DOUBLE) AS earnings,
                  CAST(sum(profit) OVER (PARTITION BY company ORDER BY quarter_index ROWS UNBOUNDED PRECEDING) AS DOUBLE) + 1000000.0::DOUBLE AS equity FROM sums),
gapped AS (SELECT company, quarter_index, CASE WHEN (company * 7 + quarter_index) % 5 != 0 THEN revenue END AS revenue,
                  CASE WHEN (company * 7 + quarter_index) % 5 != 0 THEN earnings END AS earnings, equity FROM series)"""
OVER = "OVER (PARTITION BY company ORDER BY quarter_index)"


def frame(a: int, b: int = 0) -> str:
    return f"OVER (PARTITION BY company ORDER BY quarter_index ROWS BETWEEN {a} PRECEDING AND {'CURRENT ROW' if not b else f'{b} PRECEDING'})"
