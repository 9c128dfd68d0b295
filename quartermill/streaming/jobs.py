"""Progress of jobs from their events, as a stream with keyed state and as a batch.

events: job, seq (order within the job), stage, progress. A job's progress lies between 0 and 1 and never goes back; its stage is
that of the first event that brought it as far as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "job long, progress double, stage string, n long, done boolean"
STATE = "progress double, seq long, stage string, n long"


def clipped(progress: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(progress, F.lit(0.0))))


def scaled(progress: Column, start: float, span: float) -> Column:
    """A part's own progress within the whole's."""
    return F.lit(start) + F.lit(span) * clipped(progress)


def folded(events: DataFrame) -> DataFrame:
    """job, progress, stage, n (events), done: a grouped maximum, so partial sums and any order give the same."""
    p = clipped(F.col("progress"))
    best = F.max_by(F.struct(p.alias("progress"), "stage"), F.struct(p, -F.col("seq")))
    return events.groupBy("job").agg(best.alias("b"), F.count("*").alias("n")).select("job", "b.progress", "b.stage", "n", (F.col("b.progress") >= 1).alias("done"))


def progressed(events: DataFrame) -> DataFrame:
    """The same over a stream: a row for each job that a batch brings events of, with its state after the batch.

    State: four values a job.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        progress, seq, stage, n = state.get if state.exists else (-1.0, 0, None, 0)
        for batch in batches:
            own = batch.assign(progress=batch["progress"].fillna(0.0).clip(0.0, 1.0)).sort_values(["progress", "seq"], ascending=[False, True]).iloc[0]
            if (own["progress"], -own["seq"]) > (progress, -seq):
                progress, seq, stage = float(own["progress"]), int(own["seq"]), own["stage"]
            n += len(batch)
        yield pd.DataFrame([(key[0], progress, stage, n, progress >= 1)], columns=["job", "progress", "stage", "n", "done"])
        state.update((progress, seq, stage, n))

    return events.groupBy("job").applyInPandasWithState(run, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_state(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Each batch's rows to path/batch=N; the newest row of a job is its state. A batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    progressed(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest(states: DataFrame) -> DataFrame:
    """job, progress, stage, n, done of the last batch that has the job. states: as run_to_state writes them."""
    return states.groupBy("job").agg(F.max_by(F.struct("progress", "stage", "n", "done"), "batch").alias("s")).select("job", "s.*")
