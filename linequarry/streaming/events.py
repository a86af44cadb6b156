"""Task events: folding into the current view (batch and stream), resume states, gaps, liveness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States, what ends a task, what can be resumed, legal transitions.
TERMINAL, RESUMABLE = ("completed", "failed", "cancelled"), ("paused", "recoverable")
TRANSITIONS = {
    "draft": ("queued", "starting", "cancelled"),
    "queued": ("starting", "cancelled", "recoverable"),
    "starting": ("running", "failed", "cancelled", "recoverable"),
    "running": ("pausing", "stopping", "completed", "failed", "recoverable", "stale"),
    "pausing": ("paused", "failed", "stopping", "recoverable"),
    "paused": ("queued", "starting", "cancelled"),
    "stopping": ("cancelled", "failed"),
    "recoverable": ("queued", "starting", "cancelled"),
    "stale": ("recoverable", "failed", "cancelled"),
    "completed": (),
    "failed": ("queued",),
    "cancelled": (),
}
#: Seconds after which a heartbeat is old.
FRESH_SECONDS = 120


def can_move(now: str, to: str) -> bool:
    return to in TRANSITIONS.get(now, ())


def fold(events: DataFrame) -> DataFrame:
    """Current view per task: the first terminal event ends it, what follows does not count. events: task_id, sequence, kind, value."""
    ends = F.min(F.when(F.col("kind").isin(*TERMINAL), F.col("sequence"))).over(Window.partitionBy("task_id"))
    live = events.withColumn("_end", ends).where(F.col("_end").isNull() | (F.col("sequence") <= F.col("_end")))
    return live.groupBy("task_id").agg(F.max_by("kind", "sequence").alias("status"), F.max("sequence").cast("long").alias("last_sequence"), F.count_if(F.col("kind") == "progress").alias("progressed"))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, last, progressed = state.get if state.exists else ("", 0, 0)
    rows = pd.concat(list(batches)).sort_values("sequence")
    for kind, sequence in zip(rows["kind"], rows["sequence"]):
        if sequence <= last or status in TERMINAL:
            continue  # late, repeated or after the end
        status, last, progressed = kind, int(sequence), progressed + (kind == "progress")
    state.update((status, last, progressed))
    yield pd.DataFrame({"task_id": [key[0]], "status": [status], "last_sequence": [last], "progressed": [progressed]})


VIEW = "task_id long, status string, last_sequence long, progressed long"


def fold_stream(events: DataFrame) -> DataFrame:
    """The fold over a stream, one view row per task and micro-batch. Late events are dropped, not put in order; on
    input in sequence order the last row of each task equals fold()."""
    return events.groupBy("task_id").applyInPandasWithState(_advance, VIEW, "status string, last_sequence long, progressed long", "append", GroupStateTimeout.NoTimeout)


def resume_states(done: DataFrame, scope: list[str], page: str) -> DataFrame:
    """Per source: pages done, the highest, and the first positive page not done."""
    pages = done.where(F.col(page) > 0).select(*scope, page).distinct()
    placed = pages.withColumn("_n", F.row_number().over(Window.partitionBy(*scope).orderBy(page)))
    gap = F.min(F.when(F.col(page) != F.col("_n"), F.col("_n")))
    return placed.groupBy(*scope).agg(F.count("*").alias("done"), F.max(page).alias("last_page"), F.coalesce(gap, F.count("*") + 1).cast("long").alias("next_page"))


def liveness(workers: DataFrame, now) -> DataFrame:
    """Adds live: a completed report first, then terminal states, then running with a process and a fresh heartbeat, else stale."""
    fresh = (now.cast("timestamp").cast("double") - F.col("heartbeat").cast("timestamp").cast("double")) <= FRESH_SECONDS
    status = F.col("status")
    live = (
        F.when(F.col("reported"), "completed")
        .when(status.isin(*TERMINAL), status)
        .when((status == "running") & F.col("alive") & F.coalesce(fresh, F.lit(False)), "running")
        .when(status == "running", "stale")
        .when(status.isin("queued", "starting"), status)
        .otherwise("unknown")
    )
    return workers.withColumn("live", live)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Extension: events per kind and time window; works on batches and on streams (with a watermark)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
