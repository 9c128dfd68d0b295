"""Joins on intervals and mergeable sketches. An addition beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

#: Widths of buckets are powers of 2**STEP.
STEP = 2
#: HLL sketches have 2**PRECISION registers; counts of merged ones are off by ERROR (one deviation).
PRECISION = 14
ERROR = 1.04 / 2 ** (PRECISION / 2)


def ticks(df: DataFrame, name: str) -> Column:
    """A column of dates in days, of times in microseconds, of whole numbers as it is."""
    kind = df.schema[name].dataType
    if isinstance(kind, DateType):
        return F.unix_date(name).cast("long")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if kind.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{name} is {kind.simpleString()}: dates, times and whole numbers can be joined by range")
    return F.col(name).cast("long")


def level_of(length: Column) -> Column:
    """The least multiple of STEP with 2**level >= length."""
    bits = F.when(length <= 1, F.lit(0)).otherwise(F.length(F.bin(length - 1)))
    return (F.ceil(bits / STEP) * STEP).cast("int")


def bucket(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level)


def range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: tuple[str, ...] = (), closed: bool = False, how: str = "inner") -> DataFrame:
    """Points and the intervals of their keys that hold them: start <= at < end, or <= end if `closed`; how: inner or left (points).

    An equi-join: an interval goes to the one or two buckets that it meets among buckets as wide as itself up to 2**STEP times, a point to
    its bucket of each width that some interval has. So neither a long interval nor a hot span is copied into many buckets, nothing is
    broadcast, and the driver learns the widths that occur alone (33 at most). Null keys, points and bounds meet nothing, nor do
    intervals that hold no point. Repeated rows each count. Columns besides the keys must differ in name.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how}")
    clash = {c.lower() for c in points.columns} & {c.lower() for c in intervals.columns} - {k.lower() for k in keys}
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}")
    first, last = ticks(intervals, start), ticks(intervals, end) - (0 if closed else 1)
    spans = intervals.withColumns({"_qm_first": first, "_qm_last": last}).where("_qm_last >= _qm_first").withColumn("_qm_level", level_of(F.col("_qm_last") - F.col("_qm_first") + 1))
    levels = [r[0] for r in spans.select("_qm_level").distinct().collect()]
    met = [bucket(F.col(x), F.col("_qm_level")) for x in ("_qm_first", "_qm_last")]
    spans = spans.withColumn("_qm_bucket", F.explode(F.array_distinct(F.array(*met))))
    own = points.withColumn("_qm_at", ticks(points, at))
    placed = own.withColumn("_qm_level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]).cast("array<int>"))).withColumn("_qm_bucket", bucket(F.col("_qm_at"), F.col("_qm_level")))
    by = [*keys, "_qm_level", "_qm_bucket"]
    others = [c for c in intervals.columns if c.lower() not in {k.lower() for k in keys}]
    found = placed.join(spans.select(*by, *others, "_qm_first", "_qm_last"), by).where("_qm_at BETWEEN _qm_first AND _qm_last")
    if how == "inner":
        return found.select(*points.columns, *others)
    # what a point meets hangs on its keys and place alone; one that met nothing at any width stands once with nulls
    lone = own.join(found.select(*keys, "_qm_at"), [*keys, "_qm_at"], "left_anti").select(*points.columns, *[F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in others])
    return found.select(*points.columns, *others).unionByName(lone)


def around(df: DataFrame, on: str, before: str, after: str, names: tuple[str, str] = ("since", "until")) -> DataFrame:
    """df with the times from `before` ahead of `on` to `after` behind it (as '10 minutes'), for a band join by range_join."""
    return df.withColumns({names[0]: F.col(on) - F.expr(f"INTERVAL {before}"), names[1]: F.col(on) + F.expr(f"INTERVAL {after}")})


def sketched(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, sketch: a mergeable HLL sketch of the values of each group, a column to keep."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, PRECISION).alias("sketch"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, about: the distinct values under the sketches of each group, off by ERROR; the rows that gave them aren't read."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
