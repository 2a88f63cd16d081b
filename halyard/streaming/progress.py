"""Progress of long jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from halyard.config import CHECKPOINT_EVERY


def bounded(current: Column, total: Column) -> Column:
    return F.least(current, total)


def percent(current: Column, total: Column) -> Column:
    """Whole percents, a total below one counting as one."""
    return F.floor(bounded(current, total) * 100 / F.greatest(total, F.lit(1))).cast("long")


def is_refresh(current: Column, every: int = CHECKPOINT_EVERY) -> Column:
    """Where a view that follows the job is read anew: at the first item and at each `every`th."""
    return (current == 1) | ((current % every == 0) & (current > 0))


def observed(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """df, and a count of its rows and of those with an error that is there once an action has run."""
    watch = Observation(name)
    errors = F.count("error") if "error" in df.columns else F.lit(0).cast("long")
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), errors.alias("errors")), watch


class ProgressLog(StreamingQueryListener):
    """What each micro-batch of a session's streams has read, as (name, batch, rows); register with
    spark.streams.addListener()."""

    def __init__(self) -> None:
        self.batches: list[tuple[str | None, int, int]] = []

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self.batches.append((p.name, p.batchId, p.numInputRows))

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass


def stage_times(events: DataFrame, stage: str = "stage", ms: str = "ms") -> DataFrame:
    return events.groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.sum(ms).alias("total_ms"))
