"""The work queue: priorities, heartbeats, retries; and event debouncing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_RETRIES, STALE_SECONDS = 3, 600


def is_stale(heartbeat: Column, now: Column, seconds: int = STALE_SECONDS) -> Column:
    return heartbeat < now - F.make_interval(secs=F.lit(seconds))


def claim(queue: DataFrame, n: int, now: Column | None = None) -> DataFrame:
    """The next n items, least priority number first, then oldest: pending ones and, as of `now`, those whose worker
    went silent."""
    free = F.col("status") == "PENDING"
    if now is not None:
        free |= (F.col("status") == "PROCESSING") & is_stale(F.col("heartbeat"), now)
    return queue.filter(free).orderBy("priority", "created", "media_id").limit(n)


def reclaim(queue: DataFrame, now: Column) -> DataFrame:
    """Items whose worker went silent are pending again."""
    orphan = (F.col("status") == "PROCESSING") & is_stale(F.col("heartbeat"), now)
    return queue.withColumn("status", F.when(orphan, "PENDING").otherwise(F.col("status")))


def after_failure(queue: DataFrame, failed: DataFrame, most: int = MAX_RETRIES) -> DataFrame:
    """queue after the items of `failed` failed once more."""
    marks = failed.select("media_id").distinct().withColumn("_failed", F.lit(True))
    rows = queue.join(marks, "media_id", "left")
    retries = F.when(F.col("_failed"), F.col("retries") + 1).otherwise(F.col("retries"))
    status = F.when(F.col("_failed"), F.when(retries > most, "FAILED").otherwise("PENDING")).otherwise(F.col("status"))
    return rows.withColumns({"retries": retries, "status": status}).drop("_failed")


STATUS_STATE = "status string, retries int, heartbeat timestamp"
STATUS_OUT = "media_id long, status string, retries int"


def queue_status(events: DataFrame, *, most: int = MAX_RETRIES, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """A stream of (media_id, event, ts) as each item's status; event is added, claimed, beat, done or failed.

    An item whose beats stop for stale_seconds of event time is pending again.
    """

    def step(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, retries, beat = state.get if state.exists else ("PENDING", 0, pd.Timestamp(0))
        if state.hasTimedOut:
            status = "PENDING" if status == "PROCESSING" else status
        else:
            rows = pd.concat(frames)
            for event, ts in rows.sort_values("ts", kind="stable")[["event", "ts"]].itertuples(index=False):
                beat = max(beat, ts)
                if event in ("claimed", "beat"):
                    status = "PROCESSING"
                elif event == "done":
                    status = "DONE"
                elif event == "failed":
                    retries += 1
                    status = "FAILED" if retries > most else "PENDING"
        state.update((status, int(retries), beat.to_pydatetime() if hasattr(beat, "to_pydatetime") else beat))
        if status == "PROCESSING":
            state.setTimeoutTimestamp(max(int(beat.timestamp() * 1000) + stale_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], status, int(retries))], columns=["media_id", "status", "retries"])

    keyed = events.withWatermark("ts", "1 minute").groupBy("media_id")
    return keyed.applyInPandasWithState(step, STATUS_OUT, STATUS_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def debounced(events: DataFrame, *, key: str, ts: str = "ts", gap: str = "2 seconds", late: str | None = None) -> DataFrame:
    """One row for each burst of a key's events that are less than `gap` apart: how many, and the last one's time.

    Streams need `late`, how far behind events may come.
    """
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(key, F.session_window(ts, gap).alias("burst")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts")).select(key, "n", "last_ts")


def batch_size(thermal: Column, charging: Column, battery: Column) -> Column:
    """How many items to encode at once: few when hot or low, many when charging."""
    return F.when(thermal >= 3, 2).when(~charging & (battery < 20), 4).when(charging, 32).otherwise(16)


