"""Audits that resume: a quarter's output is committed as a whole, and a killed run goes on without repeats.

A quarter's rows replace their own partition, then a row of the manifest says that it is done under which settings. A run that dies
between the two writes the quarter again, into the same partition; one that dies before leaves nothing. Results without
their row in the manifest are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartermill.sources.readers import pending

MANIFEST = "quarter_index int, settings string, rows long, at timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


class Commits:
    """A table of results at root/rows, by settings and quarter, and its manifest at root/done."""

    def __init__(self, spark: SparkSession, root: str, settings: str):
        self.spark, self.rows_at, self.done_at, self.settings = spark, f"{root}/rows", f"{root}/done", settings

    def manifest(self) -> DataFrame:
        """quarter_index, rows of the quarters done under these settings, each once."""
        if not exists(self.spark, self.done_at):
            return self.spark.createDataFrame([], MANIFEST).select("quarter_index", "rows")
        done = self.spark.read.schema(MANIFEST).parquet(self.done_at).where(F.col("settings") == self.settings)
        return done.groupBy("quarter_index").agg(F.max_by("rows", "at").alias("rows"))

    def results(self, schema: str) -> DataFrame:
        """The committed rows. schema: of the rows, with quarter_index."""
        if not exists(self.spark, self.rows_at):
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(f"{schema}, settings string").parquet(self.rows_at).where(F.col("settings") == self.settings).drop("settings")
        return stored.join(F.broadcast(self.manifest().select("quarter_index")), "quarter_index", "left_semi").select(*self.spark.createDataFrame([], schema).columns)

    def write(self, quarter: int, rows: DataFrame) -> None:
        """Replaces a quarter's partition; other quarters' stay. An empty quarter clears its own."""
        path = f"{self.rows_at}/settings={self.settings}/quarter_index={quarter}"
        rows.drop("quarter_index").write.mode("overwrite").parquet(path)

    def confirm(self, quarter: int, rows: int) -> None:
        row = self.spark.range(1).select(F.lit(quarter).cast("int").alias("quarter_index"), F.lit(self.settings).alias("settings"), F.lit(rows).cast("long").alias("rows"), F.current_timestamp().alias("at"))
        row.coalesce(1).write.mode("append").parquet(self.done_at)

    def run(self, targets: DataFrame, work: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Works on each quarter that isn't done yet, in order, and commits it; the quarters worked on.

        targets: company, quarter_index and what work needs; work gives a quarter's rows, with quarter_index. Only quarters come to the
        driver: a company's reports have a few dozen, whatever the number of companies.
        """
        left = [r[0] for r in pending(targets.select("quarter_index").distinct(), self.manifest(), "quarter_index").orderBy("quarter_index").collect()]
        for quarter in left:
            self.write(quarter, work(targets.where(F.col("quarter_index") == quarter)))
            written = self.spark.read.parquet(f"{self.rows_at}/settings={self.settings}/quarter_index={quarter}").count()
            self.confirm(quarter, written)
        return left
