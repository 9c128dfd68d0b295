"""Structured Streaming over the events table: windows, sessions, late data and repeats. An addition beyond the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; with `slide`, windows begin that often and an event counts in each it lies in."""
    w = F.window("ts", size, slide)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what there is and stops; resumes from the checkpoint."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").trigger(availableNow=True).start(path).awaitTermination()


LATE = f"{EVENTS}, behind_s double, late boolean"


def with_lateness(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The events of a stream with behind_s, the seconds that each lies behind the latest of its type in batches before, and late: more than `late`.

    A watermark drops such rows without a word; this operator keeps for each type the latest time seen and gives every row back, so
    that late ones can be counted, stored and added to their windows afterwards. State: a row a type. A null time is never late.
    """
    bound = pd.Timedelta(late).total_seconds()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else None
        newest = seen
        for batch in batches:
            times = (batch["ts"] - pd.Timestamp(0)).dt.total_seconds()
            behind = (seen - times).clip(lower=0.0).fillna(0.0) if seen is not None else pd.Series(0.0, index=batch.index)
            if times.notna().any():
                newest = max(float(times.max()), newest if newest is not None else float("-inf"))
            yield batch.assign(behind_s=behind, late=behind > bound)
        if newest is not None:
            state.update((newest,))

    return events.groupBy("event_type").applyInPandasWithState(run, LATE, "newest double", "append", GroupStateTimeout.NoTimeout)


def run_with_late(stream: DataFrame, path: str, checkpoint: str, late: str = "2 hours") -> None:
    """Writes a stream's events to path/batch=N/late=false|true. A batch that runs again after a failure overwrites its own folders."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{path}/batch={number}")

    with_lateness(stream, late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_with_late(spark: SparkSession, path: str) -> DataFrame:
    """What run_with_late has written, with the batch."""
    return spark.read.schema(f"{LATE}, batch long").parquet(path)
