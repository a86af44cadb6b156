"""Queries over projections, job and task predicates, identifiers and exports (the rest of B, C, D, J, K and L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import export as O
from ..operators import jobs as J
from ..operators import sources as S
from ..operators import store as T
from ..sources.corpus import SQL_EVENTS, SQL_LINES, lines, table, task_events, with_boxes
from .registry import query
from .review_queries import SQL_FOUND, _found

#: An event as an export job: status, order of insertion.
_JOB = {"signup": "queued", "view": "preparing", "click": "writing", "purchase": "completed", "error": "failed"}
_SQL_JOB = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'preparing' WHEN 'click' THEN 'writing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for p in _JOB.items() for x in p])
    return table(spark, d, "events").select(F.col("event_id").alias("export_id"), F.col("user_id").alias("task_id"), F.element_at(kinds, F.col("event_type")).alias("status"), (F.col("event_id") % 5 == 0).alias("has_temp"))


@query("SELECT page_id, CASE WHEN n >= 1048576 THEN printf('%.2f MB', round(n / 1048576.0::DOUBLE, 2)) WHEN n >= 1024 THEN printf('%.2f KB', round(n / 1024.0::DOUBLE, 2)) ELSE n || ' B' END AS size FROM (SELECT page_id, length(html) * 64 AS n FROM pages)")
def c_file_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.file_size(F.length("html") * 64).alias("size"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 80 THEN substring(t, 1, 79) || '…' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def c_previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", O.preview(F.col("text")).alias("preview"))


@query(f"""{SQL_FOUND} SELECT task_id, global_sequence, coalesce(decision, 'unreviewed') AS value, CASE coalesce(decision, 'unreviewed') WHEN 'confirmed' THEN 'Confirmed' WHEN 'needs_review' THEN 'Needs review' WHEN 'rejected' THEN 'Rejected' ELSE 'Unreviewed' END AS label,
greatest(0::DOUBLE, least(1::DOUBLE, x1 / 1200)) AS nx1, greatest(0::DOUBLE, least(1::DOUBLE, y1 / 1600)) AS ny1 FROM found""")
def c_hit_projection(spark: SparkSession, d: str) -> DataFrame:
    s = O.status_label(F.col("decision"))
    return _found(spark, d).select("task_id", "global_sequence", s["value"].alias("value"), s["label"].alias("label"), G.clamped(F.col("x1") / 1200).alias("nx1"), G.clamped(F.col("y1") / 1600).alias("ny1"))


@query("""SELECT doc_id, CASE WHEN instr(text, 'the') = 0 THEN text ELSE substring(text, 1, instr(text, 'the') - 1) END AS before, CASE WHEN instr(text, 'the') = 0 THEN '' ELSE 'the' END AS mark, CASE WHEN instr(text, 'the') = 0 THEN '' ELSE substring(text, instr(text, 'the') + 3) END AS after FROM documents""")
def i_highlight(spark: SparkSession, d: str) -> DataFrame:
    h = O.highlight(F.col("text"), F.lit("the"))
    return table(spark, d, "documents").select("doc_id", *[h[c].alias(c) for c in ("before", "mark", "after")])


@query(f"SELECT event_id AS export_id, status FROM (SELECT *, {_SQL_JOB} AS status FROM events) WHERE status IN ('queued', 'preparing', 'writing')")
def d_active_jobs(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).where(J.is_active(F.col("status"))).select("export_id", "status")


@query(f"SELECT event_id AS export_id FROM (SELECT *, {_SQL_JOB} AS status FROM events) WHERE (status = 'failed' AND event_id % 5 = 0) OR (status = 'completed' AND event_id % 5 = 0) OR user_id % 17 = 0")
def d_cleanup_needed(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).where(J.needs_cleanup(F.col("status"), F.col("has_temp"), F.col("task_id") % 17 == 0)).select("export_id")


@query("""WITH t AS (SELECT user_id AS task_id, arg_max(CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'pausing' WHEN 'signup' THEN 'starting' ELSE 'completed' END, (ts, event_id)) AS status FROM events GROUP BY 1)
SELECT task_id, CASE WHEN status IN ('starting', 'running', 'pausing', 'stopping') THEN 'recoverable' ELSE status END AS status, status IN ('starting', 'running', 'pausing', 'stopping') AS changed FROM t""")
def d_reconcile_incomplete(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "pausing").when(F.col("event_type") == "signup", "starting").otherwise("completed")
    tasks = table(spark, d, "events").groupBy(F.col("user_id").alias("task_id")).agg(F.max_by(kind, F.struct("ts", "event_id")).alias("status"))
    return J.after_restart(tasks).select("task_id", "status", "changed")


#: An event as the state of a task.
_STATE = {"signup": "queued", "view": "running", "click": "pausing", "purchase": "completed", "error": "failed"}
_SQL_STATE = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'pausing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"


def _state() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in _STATE.items() for x in p]), F.col("event_type"))


@query(f"""WITH {SQL_EVENTS}, k AS (SELECT task_id, sequence, {_SQL_STATE} AS kind FROM task_events), m AS (SELECT *, lag(kind) OVER (PARTITION BY task_id ORDER BY sequence) AS before FROM k) SELECT task_id, sequence, before, kind,
(before = 'running' AND kind IN ('pausing', 'completed', 'failed')) OR (before = 'pausing' AND kind = 'failed') OR (before = 'failed' AND kind = 'queued') AS legal FROM m WHERE before IS NOT NULL""")
def d_legal_transitions(spark: SparkSession, d: str) -> DataFrame:
    moves = task_events(table(spark, d, "events")).withColumn("kind", _state())
    moves = moves.withColumn("before", F.lag("kind").over(Window.partitionBy("task_id").orderBy("sequence"))).where("before is not null")
    return J.legal_moves(moves).select("task_id", "sequence", "before", "kind", "legal")


@query(f"""WITH j AS (SELECT user_id AS task_id, {_SQL_STATE} AS status FROM events) SELECT task_id, count(*) AS n, count(*) FILTER (status = 'queued') AS startable, count(*) FILTER (status = 'running') AS pausable, 0 AS resumable, count(*) FILTER (status IN ('queued', 'running', 'pausing')) AS cancellable, count(*) FILTER (status IN ('completed', 'failed')) AS deletable FROM j GROUP BY 1""")
def d_batch_preview(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("task_id"), _state().alias("status"))
    return rows.groupBy("task_id").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in J.controls(F.col("status")).items()])


@query(f"{SQL_FOUND} SELECT task_id, global_sequence FROM found WHERE page_no BETWEEN 2 AND 4 AND decision IS NULL AND contains(lower(concat_ws(' ', task_id, source_id, before, matched, after)), 'src1')")
def d_report_filter(spark: SparkSession, d: str) -> DataFrame:
    held = F.lower(F.concat_ws(" ", "task_id", "source_id", "before", "matched", "after"))
    return _found(spark, d).where(F.col("page_no").between(2, 4) & F.col("decision").isNull() & (F.instr(held, "src1") > 0)).select("task_id", "global_sequence")


@query(f"""{SQL_FOUND} SELECT task_id, global_sequence FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN page_no = 1 THEN 0 ELSE 1 END, global_sequence) AS k FROM found WHERE (doc_id % 4 <> 2 OR coalesce(decision, '') NOT IN ('confirmed', 'rejected')) AND doc_id % 9 <> 0) WHERE k <= 30""")
def d_stale_layouts(spark: SparkSession, d: str) -> DataFrame:
    stale = ((F.col("doc_id") % 4 != 2) | ~F.coalesce("decision", F.lit("")).isin("confirmed", "rejected")) & (F.col("doc_id") % 9 != 0)
    return T.newest(_found(spark, d).where(stale), ["task_id"], [F.when(F.col("page_no") == 1, 0).otherwise(1), F.col("global_sequence")], 30).select("task_id", "global_sequence")


@query(f"""WITH {SQL_LINES} SELECT doc_id, line_no, greatest(0, round_even(x0 - 12, 0)::INT) AS cx0, greatest(0, round_even(y0 - 12, 0)::INT) AS cy0, least(1200, round_even(x1 + 12, 0)::INT) AS cx1, least(1600, round_even(y1 + 12, 0)::INT) AS cy1 FROM boxed""")
def j_crop_bounds(spark: SparkSession, d: str) -> DataFrame:
    c = G.crop(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(1200), F.lit(1600))
    return with_boxes(lines(table(spark, d, "documents"))).select("doc_id", "line_no", *[v.alias(k) for k, v in c.items()])


@query(f"""WITH {SQL_LINES} SELECT doc_id, line_no, 'line_' || substring(sha256(task_id || chr(31) || source_id || chr(31) || page_no || chr(31) || line_index), 1, 32) AS line_id FROM lines""")
def j_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    parts = F.concat_ws("\x1f", "task_id", "source_id", F.col("page_no").cast("string"), F.col("line_index").cast("string"))
    return lines(table(spark, d, "documents")).select("doc_id", "line_no", F.concat(F.lit("line_"), F.substring(F.sha2(parts, 256), 1, 32)).alias("line_id"))


@query(f"""WITH {SQL_LINES}, h AS (SELECT doc_id, page_no, x0, y0, x1, y1 FROM boxed) SELECT doc_id, page_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM h GROUP BY 1, 2""")
def f_union_boxes(spark: SparkSession, d: str) -> DataFrame:
    boxed = with_boxes(lines(table(spark, d, "documents")))
    return boxed.groupBy("doc_id", "page_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN event_id % 6 = 0 THEN NULL ELSE props END, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error' AND event_id % 6 <> 0""")
def k_failure_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.when(F.col("event_id") % 6 == 0, "{broken").otherwise(F.col("props")).alias("payload"))
    parsed = rows.withColumn("v", F.try_parse_json("payload")).where("v is not null")
    return parsed.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query(f"""WITH j AS (SELECT event_id AS export_id, {_SQL_JOB} AS status FROM events) SELECT export_id, CASE WHEN status = 'queued' AND export_id % 2 = 0 THEN 'preparing' ELSE status END AS status, status = 'queued' AND export_id % 2 = 0 AS moved FROM j""")
def l_job_transition(spark: SparkSession, d: str) -> DataFrame:
    """Compare and set: jobs asked to move from queued to preparing do so only if they are queued."""
    every = _jobs(spark, d)
    asked = every.where("export_id % 2 = 0").select("export_id", F.lit("queued").alias("expected"), F.lit("preparing").alias("target"))
    return J.moved(every, asked).select("export_id", "status", "moved")


@query("""WITH p AS (SELECT source AS task_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS start, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 + doc_id % 4 AS stop FROM documents)
SELECT task_id, doc_id, unnest(range(start, stop)) AS page_index FROM p""")
def a_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    ranges = table(spark, d, "documents").select(F.col("source").alias("task_id"), "doc_id", first.alias("start")).withColumn("stop", F.col("start") + F.col("doc_id") % 4)
    return S.page_range(ranges).select("task_id", "doc_id", "page_index")


@query(f"{SQL_FOUND} SELECT doc_id, page_no, min(global_sequence) AS first_hit, count(*) AS hits FROM found GROUP BY 1, 2")
def b_export_pages(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).groupBy("doc_id", "page_no").agg(F.min("global_sequence").alias("first_hit"), F.count("*").alias("hits"))
