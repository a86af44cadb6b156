"""Queries over commits of pages and sessions, pinned snapshots, and exports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import export as X
from ..operators import pages as P
from ..operators import review as R
from ..operators.store import AlreadyCommitted, BatchRefused, Committed
from ..sources.corpus import SQL_LINES, table
from ..sources.files import scratch
from .registry import query

TERM = "ring"
SQL_COUNTED = f"""WITH {SQL_LINES}, n AS (SELECT *, (length(raw_text) - length(replace(raw_text, '{TERM}', ''))) // {len(TERM)} AS hits FROM lines),
p AS (SELECT task_id, source_id, page_no, count(*) AS n_lines, sum(hits)::BIGINT AS hits FROM n GROUP BY 1, 2, 3)"""


class _Lost(Exception):
    """Stands for a writer that is lost between its data and its entry."""


def _lost() -> None:
    raise _Lost


def _filed(records: DataFrame, path: str) -> int:
    """Records written as files of a bounded size, three at least; returns how many files a third of them are."""
    records.hint("rebalance").write.parquet(f"{path}-balanced")
    balanced = records.sparkSession.read.schema(P.RECORD).parquet(f"{path}-balanced")
    many = len(balanced.inputFiles())
    (balanced if many >= 3 else balanced.repartition(3)).write.parquet(path)
    return -(-len(records.sparkSession.read.schema(P.RECORD).parquet(path).inputFiles()) // 3)


def _stream(spark: SparkSession, records: str, root: str, name: str, files: int) -> None:
    """All page records below a folder through the sink, so many files an epoch."""
    source = spark.readStream.schema(P.RECORD).option("maxFilesPerTrigger", files).parquet(records)
    q = source.writeStream.foreachBatch(P.page_sink(root, name, TERM)).option("checkpointLocation", f"{scratch(spark)}/pages-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()


@query(f"""{SQL_COUNTED} SELECT task_id, count(*) AS pages, sum(n_lines)::BIGINT AS lines, sum(hits)::BIGINT AS occurrences, sum(hits)::BIGINT AS last_sequence, sum(hits)::BIGINT AS numbers,
count(*) AS last_event, count(*) AS pages_done FROM p GROUP BY 1""")
def b_page_commits(spark: SparkSession, d: str) -> DataFrame:
    """All pages through the committing sink; one writer is lost before its entry, every epoch is replayed under its own and under another name."""
    base = f"{scratch(spark)}/pages-{uuid.uuid4().hex}"
    files = _filed(P.page_records(table(spark, d, "documents")), f"{base}/records")
    store, records = Committed(spark, f"{base}/store"), spark.read.parquet(f"{base}/records")
    try:
        P.commit_pages(store, records, "lost", TERM, between=_lost)
    except _Lost:
        pass
    for name in ("scan", "scan", "again"):
        _stream(spark, f"{base}/records", f"{base}/store", name, files)
    state = store.pin()
    pages = state.read("pages").groupBy("task_id").agg(F.count("*").alias("pages"), F.sum("n_lines").cast("long").alias("lines"))
    hits = state.read("occurrences").groupBy("task_id").agg(F.count("*").alias("occurrences"), F.max("global_sequence").alias("last_sequence"), F.count_distinct("global_sequence").alias("numbers"))
    events = state.read("events").groupBy("task_id").agg(F.max("sequence").alias("last_event"))
    done = state.read("checkpoints").groupBy("task_id").agg(F.max("pages_done").alias("pages_done"))
    out = pages.join(hits, "task_id", "left").join(events, "task_id").join(done, "task_id")
    return out.fillna(0, ["occurrences", "last_sequence", "numbers"])


@query(f"""{SQL_COUNTED} SELECT 'first' AS session_id, sum(hits)::BIGINT AS n_hits, sum(hits)::BIGINT AS held, count(DISTINCT source_id) FILTER (hits > 0) AS sources FROM p""")
def b_search_sessions(spark: SparkSession, d: str) -> DataFrame:
    """A session saved once; its id used again, a session with a double hit and one whose writer is lost leave nothing."""
    store = Committed(spark, f"{scratch(spark)}/sessions-{uuid.uuid4().hex}")
    unique = ["source_id", "line_no", "start"]
    hits = R.matches(table(spark, d, "documents"), TERM).select("task_id", *unique, "matched")
    P.save_session(store, "first", TERM, hits, unique)
    for session, rows, between in (("first", hits.limit(0), None), ("double", hits.unionAll(hits), None), ("lost", hits, _lost)):
        try:
            P.save_session(store, session, TERM, rows, unique, between)
        except (AlreadyCommitted, BatchRefused, _Lost):
            pass
    held = store.read("session_hits").groupBy("session_id").agg(F.count("*").alias("held"), F.count_distinct("source_id").alias("sources"))
    return store.read("sessions").join(held, "session_id").select("session_id", "n_hits", "held", "sources")


@query(f"""WITH {SQL_LINES}, h AS (SELECT task_id, source_id, page_no, line_no, raw_text FROM lines WHERE doc_id % 2 = 0),
m AS (SELECT h.*, i::INT AS start FROM h, range(0, 1000000) r(i) WHERE i <= length(raw_text) - {len(TERM)} AND contains(raw_text, '{TERM}') AND substring(raw_text, i + 1, {len(TERM)}) = '{TERM}')
SELECT task_id, source_id, page_no, line_no, start, count(*) OVER () AS total, (SELECT count(*) FROM (SELECT DISTINCT task_id, source_id, page_no FROM m)) AS pages,
row_number() OVER (PARTITION BY task_id ORDER BY source_id, page_no, line_no, start) AS global_sequence FROM m""")
def b_pinned_export(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences as of a pin, with the pin's totals, while another writer commits the other half of the documents."""
    store, docs = Committed(spark, f"{scratch(spark)}/pinned-{uuid.uuid4().hex}"), table(spark, d, "documents")
    P.commit_pages(store, P.page_records(docs.where("doc_id % 2 = 0")), "even", TERM)
    state = store.pin()
    P.commit_pages(store, P.page_records(docs.where("doc_id % 2 = 1")), "odd", TERM)
    facts = state.totals("occurrences", P.PAGE)
    return state.read("occurrences").select(*P.PAGE, "line_no", "start", F.lit(facts["total"]).cast("long").alias("total"), F.lit(facts["pages"]).cast("long").alias("pages"), "global_sequence")


@query(f"""{SQL_COUNTED}, o AS (SELECT sum(hits)::BIGINT AS n FROM n) SELECT n AS occurrences, n AS distinct_numbers, true AS ascending, n AS stated, true AS whole FROM o""")
def b_json_export(spark: SparkSession, d: str) -> DataFrame:
    """The export of all occurrences as one file, read back line by line: numbers in order, none missing, the integrity block true."""
    folder = X.plain_path(f"{scratch(spark)}/export-{uuid.uuid4().hex}")
    os.makedirs(folder)
    hits = R.matches(table(spark, d, "documents"), TERM)
    hits = hits.select("task_id", "source_id", "page_no", "line_no", "start", "matched", F.struct("doc_id", "line_no", "start").alias("global_sequence"))
    size = X.write_json({"status": "completed"}, hits, f"{folder}/task.json")
    read = spark.read.text(f"file://{folder}/task.json").withColumns({"at": F.monotonically_increasing_id(), "file": F.lit(1)})
    key = F.from_json(F.get_json_object("value", "$.global_sequence"), "doc_id long, line_no int, start int")
    rows = read.where(F.startswith("value", F.lit('{"task_id"'))).select("at", key.alias("k"))
    # lines ascend within each split of the file, and splits follow each other
    from ..operators.numbering import numbered

    both = numbered(rows.select("at", "k.*"), [], ["at"], "by_file").select("doc_id", "line_no", "start", "by_file")
    both = numbered(both, [], ["doc_id", "line_no", "start"], "by_key")
    facts = both.agg(F.count("*").alias("occurrences"), F.count_distinct("doc_id", "line_no", "start").alias("distinct_numbers"), F.coalesce(F.bool_and(F.col("by_file") == F.col("by_key")), F.lit(True)).alias("ascending"))
    last = read.where(F.startswith("value", F.lit('], "integrity"'))).select(F.regexp_extract("value", r'"occurrences": (\d+)', 1).cast("long").alias("stated"), F.lit(size == os.path.getsize(f"{folder}/task.json")).alias("whole"))
    return facts.crossJoin(last)
