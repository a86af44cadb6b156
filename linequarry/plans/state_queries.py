"""Queries over event streams and lifecycle (L operators, G23)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import SQL_EVENTS, table, task_events
from ..streaming import events as E
from .registry import query

SQL_FOLD = f"""WITH {SQL_EVENTS}, t AS (SELECT *, min(sequence) FILTER (kind IN ('completed', 'failed', 'cancelled')) OVER (PARTITION BY task_id) AS stop FROM task_events)
SELECT task_id, arg_max(kind, sequence) AS status, max(sequence) AS last_sequence, count(*) FILTER (kind = 'progress') AS progressed FROM t WHERE stop IS NULL OR sequence <= stop GROUP BY 1"""


@query(SQL_FOLD)
def l_event_fold(spark: SparkSession, d: str) -> DataFrame:
    return E.fold(task_events(table(spark, d, "events")))


@query(SQL_FOLD)
def l_event_fold_stream(spark: SparkSession, d: str) -> DataFrame:
    """Runs the stream over all events to its end (availableNow) and returns each task's last view."""
    from ..sources.files import scratch

    base = f"{scratch(spark)}/fold-{uuid.uuid4().hex}"
    task_events(table(spark, d, "events")).select("task_id", F.col("sequence").cast("long").alias("sequence"), "kind").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("task_id long, sequence long, kind string").parquet(f"{base}/in")
    q = E.fold_stream(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    views = spark.read.schema(E.VIEW).parquet(f"{base}/out")
    return views.groupBy("task_id").agg(F.max_by("status", "last_sequence").alias("status"), F.max("last_sequence").alias("last_sequence"), F.max("progressed").alias("progressed"))


@query("""WITH o AS (SELECT source AS task_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents), p AS (SELECT task_id, page, row_number() OVER (PARTITION BY task_id ORDER BY page) AS n FROM o WHERE doc_id % 7 <> 3)
SELECT task_id, count(*) AS done, max(page) AS last_page, coalesce(min(n) FILTER (page <> n), count(*) + 1) AS next_page FROM p GROUP BY 1""")
def g_first_missing(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sources import page_ordinals

    return E.resume_states(page_ordinals(table(spark, d, "documents"))[1], ["task_id"], "page")


@query("""WITH w AS (SELECT user_id, max(ts) AS heartbeat, arg_max(CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END, (ts, event_id)) AS status, bool_or(event_id % 97 = 0) AS reported FROM events GROUP BY 1)
SELECT user_id, CASE WHEN reported THEN 'completed' WHEN status IN ('completed', 'failed') THEN status WHEN status = 'running' AND user_id % 5 <> 0 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(heartbeat) <= 120 THEN 'running' WHEN status = 'running' THEN 'stale' WHEN status = 'queued' THEN 'queued' ELSE 'unknown' END AS live FROM w""")
def l_liveness(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    workers = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("heartbeat"), F.max_by(kind, F.struct("ts", "event_id")).alias("status"), F.bool_or(F.col("event_id") % 97 == 0).alias("reported"))
    return E.liveness(workers.withColumn("alive", F.col("user_id") % 5 != 0), F.lit("2024-01-31 00:00:00")).select("user_id", "live")


@query(f"WITH {SQL_EVENTS} SELECT date_trunc('day', ts) AS start, kind, count(*) AS n FROM task_events GROUP BY 1, 2")
def x_windowed_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Extension: the engine's own windowed counts, not an operator of the reference."""
    return E.windowed_counts(task_events(table(spark, d, "events"))).withColumn("start", F.col("start").cast("timestamp_ntz"))
