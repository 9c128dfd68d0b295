"""Shared plumbing of the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows whose Python objects a worker holds at once.
SLICE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own on a single machine."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quartermill-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, unless it is installed there anyway."""
    here = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (here, known) if x)


class Scratch:
    """Intermediate tables in the shared folder: lineage ends there, and a lost executor costs no earlier stage."""

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0
        target, files = self._files(self.root)
        files.mkdirs(target)
        files.deleteOnExit(target)  # what results still read goes when the driver ends

    def _files(self, path: str) -> tuple:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        """Writes df and reads it again."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        return kept

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that keep() returned and that nothing reads any more."""
        path = self.paths.pop(id(df), None)
        if path:
            target, files = self._files(path)
            files.delete(target, True)


def map_texts(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; fn sees Arrow batches of SLICE rows at most and must hold no more than a batch."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))

    return df.mapInArrow(run, schema)


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def free_name(name: str, columns: list[str]) -> str:
    """name, or name with as many underscores ahead as make it unlike every column's, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Memo(dict):
    """A cache of bounded size that computes what it lacks, in two generations: the older goes when the newer is full."""

    def __init__(self, entries: int, compute: Callable, keep: Callable = lambda key: True):
        super().__init__()
        self.half, self.compute, self.keep, self.old = max(1, entries // 2), compute, keep, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if self.keep(key):
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found
