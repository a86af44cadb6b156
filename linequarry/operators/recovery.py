"""What a process finds when it comes back: interrupted exports, cleanups to end, sources to go on with, contexts to
rebuild, failures to show. Everything is a join or an aggregate over the tables of all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import is_active, needs_cleanup
from .store import newest

#: How an export ends whose process is gone, the code of a record that could not be deleted.
INTERRUPTED, PROCESS_GONE, NOT_DELETED = "interrupted", "ENGINE_PROCESS_EXITED", "DATABASE_ERROR"
#: Context states that need no rebuild, and the one that is not tried again.
SETTLED, GIVEN_UP = ("ready", "uncertain"), "failed"


class NotReconciled(Exception):
    """An export still counts as running after the restart; the engine must not start."""


def exports_after_restart(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Exports (export_id, task_id, status, current_stage, error_code, has_temp) once nothing runs any more.

    What was under way is interrupted and says so; a null status stays. Adds interrupted, and needs_cleanup for those
    whose temporary files can go now, which is so for every export of a task that is no more.
    """
    broken = F.coalesce(is_active(F.col("status")), F.lit(False))
    ended = lambda name, value: F.when(F.col("interrupted"), value).otherwise(F.col(name))
    after = jobs.withColumn("interrupted", broken).withColumns(
        {"status": ended("status", INTERRUPTED), "current_stage": ended("current_stage", INTERRUPTED), "error_code": ended("error_code", PROCESS_GONE)}
    )
    held = tasks.select("task_id").distinct().withColumn("_held", F.lit(True))
    cleans = F.coalesce(needs_cleanup(F.col("status"), F.coalesce("has_temp", F.lit(False)), F.col("_held").isNull()), F.lit(False))
    return after.join(held, "task_id", "left").withColumn("needs_cleanup", cleans).drop("_held")


def check_reconciled(jobs: DataFrame) -> None:
    """Fail closed: refuse to go on while a stored export looks as if it were running."""
    left = jobs.where(is_active(F.col("status"))).select("export_id").take(1)
    if left:
        raise NotReconciled(f"export {left[0].export_id} is still under way")


def cleanups_after_restart(jobs: DataFrame, tasks: DataFrame, tried: DataFrame) -> DataFrame:
    """Cleanup jobs (task_id, status, attempt_count, last_error_code) after one more try of each pending one.

    tried: task_id, code (null: its folders are gone), deleted (its record went too); a pending job without a row was
    not reached. Adds outcome: kept (not pending, or not reached), forgotten (the task is no more, so the job goes),
    failed (code tells why; attempts count), completed (task and job go). One job's failure leaves the others alone.
    """
    held = tasks.select("task_id").distinct().withColumn("_held", F.lit(True))
    told = tried.groupBy("task_id").agg(F.max("code").alias("_code"), F.bool_and(F.coalesce("deleted", F.lit(False))).alias("_deleted"))
    both = jobs.join(held, "task_id", "left").join(told, "task_id", "left")
    pending = F.coalesce(F.col("status") == "pending", F.lit(False))
    outcome = (
        F.when(~pending, "kept")
        .when(F.col("_held").isNull(), "forgotten")
        .when(F.col("_deleted").isNull(), "kept")
        .when(F.col("_code").isNotNull() | ~F.col("_deleted"), "failed")
        .otherwise("completed")
    )
    was_tried = F.col("outcome").isin("failed", "completed")
    return both.withColumn("outcome", outcome).select(
        "task_id",
        "outcome",
        F.when(F.col("outcome") == "failed", "cleanup_failed").otherwise(F.col("status")).alias("status"),
        (F.coalesce("attempt_count", F.lit(0)) + was_tried.cast("int")).cast("long").alias("attempt_count"),
        F.when(F.col("outcome") == "failed", F.coalesce("_code", F.lit(NOT_DELETED))).when(was_tried, "").otherwise(F.col("last_error_code")).alias("last_error_code"),
    )


def cleanups_left(after: DataFrame) -> DataFrame:
    """The cleanup jobs that remain."""
    return after.where(~F.col("outcome").isin("forgotten", "completed")).drop("outcome")


def tasks_left(tasks: DataFrame, after: DataFrame) -> DataFrame:
    """The tasks that remain."""
    return tasks.join(after.where("outcome = 'completed'").select("task_id"), "task_id", "left_anti")


def task_resume_states(processed: DataFrame, checkpoints: DataFrame, with_pages: bool = False) -> DataFrame:
    """Where each source of each task goes on: pages done, the highest, the first one missing, the worker generation.

    processed: task_id, source_id, page_no; checkpoints: task_id, source_id, worker_generation. A source of either is
    listed, one without name is not; without pages it starts at 1, without checkpoint its generation is 0. The first
    missing page is a page's successor that no row holds: one grouping by page, no window over a source, one pass over
    the pages. with_pages adds the pages themselves, as many as the source has.
    """
    key = ["task_id", "source_id"]
    known = (F.col("source_id") != "") & F.col("task_id").isNotNull()
    page, none = F.col("page_no").cast("long"), F.lit(None).cast("long")
    seen = lambda at, held: F.struct(at.alias("page"), F.lit(held).alias("held"))
    first = seen(F.lit(1).cast("long"), False)
    marks = F.when(page > 0, F.array(seen(page, True), seen(page + 1, False), first)).otherwise(F.array(first))
    done = processed.where(known).select(*key, F.inline(marks)).withColumn("generation", none)
    begun = checkpoints.where(known).select(*key, F.inline(F.array(first)), F.col("worker_generation").cast("long").alias("generation"))
    pages = done.unionByName(begun).groupBy(*key, "page").agg(F.bool_or("held").alias("held"), F.max("generation").alias("generation"))
    whole = F.when(F.col("held"), F.col("page"))
    listed = [F.array_sort(F.collect_list(whole)).alias("processed_page_ids")] if with_pages else []
    return pages.groupBy(*key).agg(
        F.count(whole).alias("done"),
        F.coalesce(F.max(whole), F.lit(0)).alias("last_completed_page"),
        F.min(F.when(~F.col("held"), F.col("page"))).alias("next_page"),
        F.coalesce(F.max("generation"), F.lit(0)).alias("worker_generation"),
        *listed,
    )


def is_stale(version: int) -> Column:
    """A context of another version or one not settled, unless it was given up. Nulls count as neither current nor settled."""
    status = F.coalesce("layout_context_status", F.lit(""))
    return (~F.col("layout_context_version").eqNullSafe(F.lit(version)) | ~status.isin(*SETTLED)) & (status != GIVEN_UP)


def stale_layouts(found: DataFrame, version: int, limit: int = 25, first_source: str = "", first_page: int = 0) -> DataFrame:
    """Of each task the next occurrences whose context is to be rebuilt, those of a page in view first."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 200:
        raise ValueError("limit must be a whole number from 1 to 200")
    order = [F.col("global_sequence")]
    if first_source and first_page > 0:
        order.insert(0, F.when((F.col("source_id") == first_source) & (F.col("page_no") == first_page), 0).otherwise(1))
    return newest(found.where(is_stale(version)), ["task_id"], order, limit)


def task_failures(failures: DataFrame, limit: int = 100) -> DataFrame:
    """The first failures of each task (task_id, sequence, payload as JSON text) as variants; of these, those that are
    no objects or cannot be read fall away, so fewer than limit may come back."""
    parsed = newest(failures, ["task_id"], [F.col("sequence")], limit).withColumn("payload", F.try_parse_json("payload"))
    return parsed.where(F.col("payload").isNotNull() & F.startswith(F.schema_of_variant("payload"), F.lit("OBJECT")))
