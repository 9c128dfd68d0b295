"""Interval joins against all pairs."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quartermill.operators import ranges as R


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_range_join_equals_all_pairs(spark, closed, how):
    """Short and long, empty, reversed, negative, null and repeated intervals; null and repeated points."""
    rng = random.Random(11)
    points = [(rng.choice([None, 1, 1, 2]), rng.choice([None, rng.randint(-500, 500), rng.randint(-9, 9)])) for _ in range(150)]
    spans = []
    for _ in range(150):
        a = rng.randint(-520, 500)
        spans.append((rng.choice([None, 1, 2]), rng.choice([a, a, None]), rng.choice([a, a + 1, a - 3, a + rng.randint(0, 900), None])))
    spans += spans[:20]
    got = R.range_join(spark.createDataFrame(points, "k int, x long"), spark.createDataFrame(spans, "k int, a long, b long"), "x", "a", "b", ("k",), closed, how)
    want = []
    for k, x in points:
        met = [(k, x, a, b) for j, a, b in spans if None not in (k, j, x, a, b) and j == k and a <= x and (x <= b if closed else x < b)]
        want += met or ([(k, x, None, None)] if how == "left" else [])
    assert sorted(map(tuple, got.select("k", "x", "a", "b").collect()), key=str) == sorted(want, key=str)


def test_range_join_of_times_dates_and_nothing(spark):
    t = datetime(2024, 2, 29, 23, 59, 59, 999999)
    points = spark.createDataFrame([(t,), (t + timedelta(microseconds=1),), (datetime(1969, 12, 31, 1),)], "at timestamp")
    spans = R.around(spark.createDataFrame([(t,)], "t timestamp"), "t", "1 hour", "0 hours")
    assert [r.at for r in R.range_join(points, spans, "at", "since", "until", closed=True).collect()] == [t]
    days = spark.createDataFrame([(date(2024, 1, k),) for k in range(1, 6)], "d date")
    spans = spark.createDataFrame([(date(2024, 1, 2), date(2024, 1, 4))], "a date, b date")
    assert sorted(r.d.day for r in R.range_join(days, spans, "d", "a", "b").collect()) == [2, 3]
    none = spans.where("false")
    assert R.range_join(days, none, "d", "a", "b").count() == 0
    assert R.range_join(days, none, "d", "a", "b", how="left").where("a IS NULL").count() == 5
    assert R.range_join(days.where("false"), spans, "d", "a", "b", how="left").count() == 0
    with pytest.raises(ValueError, match="columns of both sides: d"):
        R.range_join(days, spans.withColumn("D", F.lit(1)), "d", "a", "b")
    with pytest.raises(ValueError, match="double"):
        R.range_join(days.select(F.lit(1.5).alias("x")), spans, "x", "a", "b")


def test_plan_is_an_equi_join(spark):
    points, spans = spark.range(1000).toDF("x"), spark.range(1000).select(F.col("id").alias("a"), (F.col("id") * 3).alias("b"))
    plan = R.range_join(points, spans, "x", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sketches_merge_alike(spark):
    """Merged sketches of parts equal the sketch of all, within the error of the exact count; repeats don't count."""
    df = spark.range(60000).select((F.col("id") % 7).alias("part"), (F.col("id") % 40000).alias("v"))
    parts = R.sketched(df, ["part"], "v").withColumn("all", F.lit(1))
    about = R.merged(parts, ["all"]).first().about
    assert abs(about - 40000) <= 4 * R.ERROR * 40000
    assert R.merged(parts.unionByName(parts), ["all"]).first().about == about
