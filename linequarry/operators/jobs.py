"""Export jobs, worker generations, checkpoints, removal of tasks and control of scans, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.events import TRANSITIONS

#: What can be exported, states in which an export is under way, those that can be tried again.
FORMATS = ("json", "html", "reviews")
ACTIVE = ("queued", "preparing", "rendering_images", "building", "writing", "cancelling")
RETRYABLE = ("failed", "cancelled", "interrupted")
#: States that a lost process leaves behind.
UNFINISHED = ("starting", "running", "pausing", "stopping")


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE)


def job_view(jobs: DataFrame) -> DataFrame:
    """Jobs as callers see them: no temporary path, flags as booleans, what is missing empty, 0 or pending."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    return jobs.select(
        "export_id", "task_id", "format", "status", text("current_stage"), number("progress_completed"), number("progress_total"), text("output_path"), text("error_code"),
        (F.coalesce("cancel_requested", F.lit(0)) != 0).alias("cancel_requested"), text("retry_of"), F.coalesce("cleanup_status", F.lit("pending")).alias("cleanup_status"), number("cleanup_attempt_count"),
    )


def admitted(requests: DataFrame, jobs: DataFrame, require_idle: bool = False) -> DataFrame:
    """What becomes of requests (request_id in order, task_id, format): queued, or unsupported, conflict or capacity.

    One active job per task and format; of equal requests the first one is taken. require_idle: none while any is active.
    """
    active = jobs.where(is_active(F.col("status")))
    same = active.select("task_id", "format").distinct().withColumn("_same", F.lit(True))
    first = F.row_number().over(Window.partitionBy("task_id", "format").orderBy("request_id")) == 1
    known = F.col("format").isin(*FORMATS)
    busy = F.lit(require_idle and bool(active.take(1)))
    outcome = F.when(~known, "unsupported").when(F.col("_same").isNotNull() | ~F.col("_first"), "conflict").when(busy, "capacity").otherwise("queued")
    return requests.withColumn("_first", first).join(same, ["task_id", "format"], "left").select("request_id", "task_id", "format", outcome.alias("outcome"))


def next_job(jobs: DataFrame) -> DataFrame:
    """The job to start: the queued one that came first, and none while another one runs (queued ones do not count)."""
    running = jobs.where(is_active(F.col("status")) & (F.col("status") != "queued")).select(F.lit(1).alias("_r")).limit(1)
    head = jobs.where(F.col("status") == "queued").orderBy("sequence").limit(1)
    return head.join(running, F.lit(True), "left_anti")


def retried(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """New queued jobs for those of asked (export_id, new_id) that ended without success."""
    return jobs.join(asked, "export_id").where(F.col("status").isin(*RETRYABLE)).select(F.col("new_id").alias("export_id"), "task_id", "format", F.lit("queued").alias("status"), F.col("export_id").alias("retry_of"))


def moved(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """Compare and set: jobs with the status asked for (export_id, expected, target) where they have the one expected."""
    hit = F.col("status") == F.col("expected")
    return jobs.join(asked, "export_id", "left").withColumn("moved", F.coalesce(hit, F.lit(False))).withColumn("status", F.when(hit, F.col("target")).otherwise(F.col("status"))).drop("expected", "target")


def history(exports: DataFrame, limit: int | None = None) -> DataFrame:
    """Exports, the one recorded last first."""
    out = exports.orderBy(F.desc("ingest_seq"))
    return out if limit is None else out.limit(limit)


def needs_cleanup(status: Column, has_temp: Column, task_gone: Column) -> Column:
    """Jobs whose leftovers can go: ended with a temporary file, or of a task that is no more."""
    return (status.isin("failed", "completed", "cancelled", "interrupted") & has_temp) | task_gone


def after_restart(tasks: DataFrame) -> DataFrame:
    """Tasks as they stand when the process comes back: what was under way can be recovered."""
    broken = F.col("status").isin(*UNFINISHED)
    return tasks.withColumn("changed", broken).withColumn("status", F.when(broken, "recoverable").otherwise(F.col("status")))


def legal_moves(moves: DataFrame, before: str = "before", kind: str = "kind") -> DataFrame:
    """Adds legal: whether a task may go from one state to the other."""
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return moves.withColumn("legal", F.coalesce(F.array_contains(F.try_element_at(allowed, F.col(before)), F.col(kind)), F.lit(False)))


def controls(status: Column) -> dict[str, Column]:
    """Whether a task can be started, paused, resumed, cancelled or deleted in its state."""
    to = lambda *s: [k for k, v in TRANSITIONS.items() if set(v) & set(s)]
    return {"startable": status.isin("draft", "queued"), "pausable": status.isin(*to("pausing")), "resumable": status.isin("paused", "recoverable"), "cancellable": status.isin(*to("stopping", "cancelled")), "deletable": status.isin("draft", "completed", "failed", "cancelled")}


def pages_before(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Cooperative stop: pages (task_id, page, begun) that begin before the task's first stop request (task_id, at) run to
    their end, later ones wait. Adds runs."""
    first = requests.groupBy("task_id").agg(F.min("at").alias("_at"))
    return pages.join(first, "task_id", "left").withColumn("runs", F.col("_at").isNull() | (F.col("begun") < F.col("_at"))).drop("_at")


def next_generations(tasks: DataFrame, starts: DataFrame) -> DataFrame:
    """task_id, worker_generation after its starts: one more for each, never less than what workers have reported."""
    grown = starts.groupBy("task_id").agg(F.count("*").alias("_n"), F.max("reported").alias("_seen"))
    value = F.greatest(F.coalesce("worker_generation", F.lit(0)) + F.coalesce("_n", F.lit(0)), F.coalesce("_seen", F.lit(0)))
    return tasks.join(grown, "task_id", "left").select("task_id", value.cast("long").alias("worker_generation"))


def fenced(writes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Writes of the current worker generation; those of an earlier one are late and fall away."""
    return writes.join(tasks.select("task_id", F.col("worker_generation").alias("_now")), "task_id").where(F.col("generation") == F.col("_now")).drop("_now")


def checkpoints(events: DataFrame, processed: DataFrame) -> DataFrame:
    """Per task its newest checkpoint and how far it got: pages done, the highest one. A task without pages has 0."""
    newest = events.groupBy("task_id").agg(F.max_by("checkpoint", F.struct("ts", "checkpoint")).alias("checkpoint"))
    done = processed.groupBy("task_id").agg(F.count_distinct("page_id").alias("pages"), F.max("page_id").alias("last_page"))
    return newest.join(done, "task_id", "left").fillna(0, ["pages"])


def without_tasks(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the tasks that go; all of them or, by the commit of the batch, none."""
    key = gone.select("task_id").distinct()
    return {name: rows.join(key, "task_id", "left_anti") for name, rows in tables.items()}


def merged_payload(payload: Column, more: dict[str, Column]) -> Column:
    """A map payload with entries added; what is added wins."""
    kept = F.map_filter(payload, lambda k, _: ~k.isin(*more))
    return F.map_concat(kept, F.create_map(*[x for k, v in more.items() for x in (F.lit(k), v.cast("string"))]))


def still_wanted(answers: DataFrame, views: DataFrame) -> DataFrame:
    """Answers whose task, generation and sequence are those of a view that is still there."""
    return answers.join(views.where("mounted"), ["view_id", "task_id", "generation", "sequence"], "left_semi")
