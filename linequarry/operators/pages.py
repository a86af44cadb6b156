"""Pages and search sessions written all at once: what a scan of a page leaves behind, committed as one batch.

A batch of page records becomes rows of pages, lines, occurrences, processed marks, events, counters and checkpoints;
readers see all of them or none. A page that is committed already, by whatever batch, is left out, so a replayed epoch
or a page sent twice leaves no double. Numbers of occurrences and events go on from the task's counters as of the state
the batch was worked out from; if another writer commits meanwhile, the batch is worked out again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_starts
from ..sources.corpus import lines
from .numbering import numbered, written
from .store import BatchRefused, Committed, Moved

PAGE = ["task_id", "source_id", "page_no"]
RECORD = "task_id string, source_id string, page_no int, generation long, lines array<struct<line_index:int,line_no:int,raw_text:string,confidence:double>>"


def page_records(docs: DataFrame, generation: int = 1) -> DataFrame:
    """One record per page of the corpus, with its lines in order; a page has a bounded number of them."""
    per = lines(docs).groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("line_index", "line_no", "raw_text", "confidence"))).alias("lines"))
    return per.select(*PAGE, F.lit(generation).cast("long").alias("generation"), "lines")


def _on_top(rows: DataFrame, tops: DataFrame, top: str, number: str) -> DataFrame:
    """Numbers that start anew in each task, moved behind those the task has."""
    return rows.join(tops.select("task_id", F.col(top).alias("_top")), "task_id", "left").withColumn(number, F.coalesce("_top", F.lit(0)) + F.col(number)).drop("_top")


def commit_pages(store: Committed, records: DataFrame, key: str, term: str, between: Callable[[], None] | None = None) -> str:
    """Commit a batch of page records (RECORD) under a key; occurrences are those of the term.

    Of records that repeat a page within the batch the one of the highest generation counts; records of a generation
    below the task's own are a lost worker's and are left out. Null keys are refused.
    """
    records = written(records, "page-records")
    if records.where(" OR ".join(f"{c} IS NULL" for c in PAGE)).limit(1).count():
        raise BatchRefused("a page needs task, source and number")
    while True:
        if key in store.batches():
            return key
        state = store.pin()
        done, counters, checkpoints = state.read("processed"), state.read("counters"), state.read("checkpoints")
        best = records.groupBy(*PAGE).agg(F.max_by(F.struct("generation", "lines"), F.struct("generation", F.xxhash64("lines"))).alias("r"))
        fresh = best.select(*PAGE, "r.generation", "r.lines")
        if done is not None:
            fresh = fresh.join(done, PAGE, "left_anti")
        if checkpoints is not None:
            now = checkpoints.groupBy("task_id").agg(F.max("generation").alias("_now"))
            fresh = fresh.join(now, "task_id", "left").where("_now IS NULL OR generation >= _now").drop("_now")
        fresh = written(fresh, "page-batch")
        if not fresh.limit(1).count():  # all there already: the batch counts as done
            try:
                return store.commit({}, key, seen=state.number)
            except Moved:
                continue
        tops = fresh.sparkSession.createDataFrame([], "task_id string, pages long, lines long, occurrences long")
        if counters is not None:
            tops = counters.groupBy("task_id").agg(*[F.sum(c).alias(c) for c in ("pages", "lines", "occurrences")])
        lined = fresh.select(*PAGE, F.explode("lines").alias("l")).select(*PAGE, "l.*")
        hits = lined.select(*PAGE, "line_no", F.explode(match_starts(F.col("raw_text"), term)).alias("start")).withColumn("end", F.col("start") + len(term))
        hits = _on_top(numbered(hits, ["task_id"], ["source_id", "page_no", "line_no", "start"], "global_sequence"), tops, "occurrences", "global_sequence")
        hits = written(hits, "page-hits")
        events = _on_top(numbered(fresh.select(*PAGE), ["task_id"], ["source_id", "page_no"], "sequence"), tops, "pages", "sequence")
        per_page = fresh.groupBy("task_id").agg(F.count("*").alias("pages"), F.sum(F.size("lines")).cast("long").alias("lines"), F.max("generation").alias("generation"))
        counted = per_page.join(hits.groupBy("task_id").agg(F.count("*").alias("occurrences")), "task_id", "left").fillna(0, ["occurrences"])
        reached = counted.join(tops.select("task_id", F.col("pages").alias("_before")), "task_id", "left")
        tables = {
            "pages": fresh.select(*PAGE, "generation", F.size("lines").alias("n_lines")),
            "lines": lined,
            "occurrences": hits,
            "processed": fresh.select(*PAGE),
            "events": events.withColumn("kind", F.lit("page_completed")),
            "counters": counted.select("task_id", "pages", "lines", "occurrences"),
            "checkpoints": reached.select("task_id", "generation", (F.coalesce("_before", F.lit(0)) + F.col("pages")).alias("pages_done")),
        }
        try:
            return store.commit(tables, key, between=between, seen=state.number)
        except Moved:
            continue


def page_sink(root: str, name: str, term: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each epoch of the stream is a batch; an epoch that is replayed is there already."""

    def put(batch: DataFrame, epoch: int) -> None:
        commit_pages(Committed(batch.sparkSession, root), batch, f"{name}-{epoch}", term)

    return put


def save_session(store: Committed, session: str, query: str, hits: DataFrame, unique: list[str], between: Callable[[], None] | None = None) -> str:
    """Hits of a search session, and the session's row, in one commit; the session must be new and its hits told apart by `unique`."""
    held = written(hits, "session-hits")
    twice = held.groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise BatchRefused("a hit stands in the session twice")
    row = held.agg(F.count("*").alias("n_hits")).select(F.lit(session).alias("session_id"), F.lit(query).alias("query"), "n_hits")
    return store.commit({"session_hits": held.withColumn("session_id", F.lit(session)), "sessions": row}, f"session-{session}", new=True, between=between)
