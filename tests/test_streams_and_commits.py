"""Streams with state against batches, and audits that are stopped and go on."""

import pytest
from pyspark.sql import functions as F

from quartermill.sources.commits import Commits
from quartermill.streaming import events as E
from quartermill.streaming import jobs as J

from .conftest import DATA


def test_progress_of_a_stream_is_the_batch_fold(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), (F.col("value") / 80 - 0.1).alias("progress"))
    source = str(tmp_path / "in")
    events.repartition(6).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    J.run_to_state(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    states = spark.read.parquet(str(tmp_path / "out"))
    assert states.select("batch").distinct().count() == 3
    got = {r.job: tuple(r) for r in J.newest(states).collect()}
    assert got == {r.job: tuple(r) for r in J.folded(events).collect()} and len(got) > 50
    by_job = {}
    for r in states.orderBy("batch").collect():  # never back
        assert r.progress >= by_job.get(r.job, 0)
        by_job[r.job] = r.progress
    assert [round(r[0], 6) for r in spark.range(1).select(J.scaled(F.lit(0.5), 0.2, 0.4)).collect()] == [0.4]


def test_late_rows_are_kept_and_windows_are_the_batch(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/events.parquet")
    days = [table.where("ts >= '2024-01-20'"), table.where("ts < '2024-01-20' AND ts >= '2024-01-05'"), table.where("ts < '2024-01-05'").unionByName(table.limit(1).withColumn("ts", F.lit(None).cast("timestamp")).withColumn("event_id", F.lit(-1).cast("long")))]
    for n, part in enumerate(days):  # the newest days first: what follows is late
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        E.run_with_late(E.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    out = E.read_with_late(spark, str(tmp_path / "out"))
    assert out.count() == table.count() + 1 and out.select("event_id").distinct().count() == table.count() + 1
    late = out.where("late")
    assert late.count() == table.where("ts < '2024-01-20'").count() and out.where("batch = 0 AND late").count() == 0
    newest = {r[0]: r[1] for r in table.groupBy("event_type").agg(F.max("ts").cast("timestamp").cast("double")).collect()}
    r = late.select("event_type", F.col("ts").cast("timestamp").cast("double").alias("t"), "behind_s").first()
    assert abs(newest[r.event_type] - r.t - r.behind_s) < 1e-3
    for slide in (None, "20 minutes"):  # with the late rows, the windows are those of the batch
        key = lambda df: sorted(tuple(r) for r in E.tumbling(df, slide=slide).collect())
        assert key(out.where("ts IS NOT NULL").drop("batch", "late", "behind_s")) == key(table.withColumn("ts", F.col("ts").cast("timestamp")))


SCHEMA = "company int, score long, quarter_index int"


def test_a_stopped_audit_goes_on(spark, tmp_path):
    targets = spark.createDataFrame([(c, q) for c in range(4) for q in range(8000, 8006)], "company int, quarter_index int")
    worked = []

    def work(own, fail_at=None):
        quarter = own.first()["quarter_index"]
        worked.append(quarter)
        if quarter == fail_at:
            raise RuntimeError("stopped")
        return own.select("company", (F.col("company") * 10 + F.col("quarter_index")).cast("long").alias("score"), "quarter_index")

    own = Commits(spark, str(tmp_path / "audit"), "w12")
    assert own.results(SCHEMA).count() == 0 and own.manifest().count() == 0
    with pytest.raises(RuntimeError):
        own.run(targets, lambda t: work(t, 8003))
    assert worked == [8000, 8001, 8002, 8003] and own.manifest().count() == 3
    # killed between rows and manifest: the rows aren't read, and the quarter is written again, once
    own.write(8003, targets.where("quarter_index = 8003").selectExpr("company", "-1L AS score"))
    assert own.results(SCHEMA).count() == 12
    worked.clear()
    assert Commits(spark, str(tmp_path / "audit"), "w12").run(targets, work) == [8003, 8004, 8005] == worked
    rows = own.results(SCHEMA)
    assert rows.count() == 24 and rows.distinct().count() == 24 and rows.where("score < 0").count() == 0
    assert sorted(tuple(r) for r in own.manifest().collect()) == [(q, 4) for q in range(8000, 8006)]
    assert own.run(targets, work) == []
    other = Commits(spark, str(tmp_path / "audit"), "w8")  # other settings have their own quarters
    assert other.manifest().count() == 0 and len(other.run(targets, work)) == 6 and own.results(SCHEMA).count() == 24
