"""Queries over jobs, generations, removal, projections and contexts without lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as V
from ..operators import jobs as J
from ..operators import projection as P
from ..operators import review as R
from ..operators import search as S
from ..sources.corpus import SQL_LINES, lines, table, with_boxes
from .contract_queries import _SQL_JOB, _jobs
from .registry import query
from .review_queries import SQL_FOUND, SQL_HITS, _found, _hits

_FORMAT = "CASE event_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'html' WHEN 2 THEN 'reviews' ELSE 'docx' END"
_SQL_ACTIVE = "('queued', 'preparing', 'rendering_images', 'building', 'writing', 'cancelling')"



@query(f"""SELECT event_id AS export_id, user_id AS task_id, {_FORMAT} AS format, {_SQL_JOB} AS status, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS current_stage, CASE WHEN event_id % 2 = 0 THEN (event_id % 100)::INT ELSE 0 END AS progress_completed, 100 AS progress_total,
'' AS output_path, CASE WHEN event_type = 'error' THEN 'E' || event_id % 7 ELSE '' END AS error_code, event_id % 5 = 0 AS cancel_requested, '' AS retry_of, CASE WHEN event_id % 6 = 0 THEN 'done' ELSE 'pending' END AS cleanup_status, 0 AS cleanup_attempt_count FROM events""")
def c_job_view(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    raw = _jobs(spark, d).join(table(spark, d, "events").select(e.alias("export_id"), "event_type"), "export_id").select(
        "export_id", "task_id", F.expr(_FORMAT.replace("event_id", "export_id")).alias("format"), "status", F.expr("if(export_id % 3 = 0, null, event_type)").alias("current_stage"), F.expr("if(export_id % 2 = 0, export_id % 100, null)").alias("progress_completed"), F.lit(100).alias("progress_total"),
        F.lit(None).cast("string").alias("output_path"), F.expr("if(event_type = 'error', concat('E', export_id % 7), null)").alias("error_code"), F.expr("if(export_id % 5 = 0, 1, if(export_id % 5 = 1, null, 0))").alias("cancel_requested"), F.lit(None).cast("string").alias("retry_of"),
        F.expr("if(export_id % 6 = 0, 'done', null)").alias("cleanup_status"), F.lit(None).cast("int").alias("cleanup_attempt_count"), F.lit("/tmp/x").alias("temporary_path"),
    )
    return J.job_view(raw)


_SQL_REQUESTS = f"""WITH j AS (SELECT user_id AS task_id, {_FORMAT} AS format, {_SQL_JOB} AS status, event_id FROM events), q AS (SELECT event_id AS request_id, task_id, format FROM j WHERE event_id % 3 = 0),
a AS (SELECT DISTINCT task_id, format FROM j WHERE event_id % 3 <> 0 AND task_id % 4 = 0 AND status IN {_SQL_ACTIVE})"""


@query(f"""{_SQL_REQUESTS} SELECT request_id, q.task_id, q.format, CASE WHEN q.format NOT IN ('json', 'html', 'reviews') THEN 'unsupported' WHEN a.task_id IS NOT NULL OR row_number() OVER (PARTITION BY q.task_id, q.format ORDER BY request_id) > 1 THEN 'conflict' ELSE 'queued' END AS outcome
FROM q LEFT JOIN a ON a.task_id = q.task_id AND a.format = q.format""")
def l_job_admission(spark: SparkSession, d: str) -> DataFrame:
    every = _jobs(spark, d).withColumn("format", F.expr(_FORMAT.replace("event_id", "export_id")))
    requests = every.where("export_id % 3 = 0").select(F.col("export_id").alias("request_id"), "task_id", "format")
    return J.admitted(requests, every.where("export_id % 3 <> 0 and task_id % 4 = 0"))


@query(f"SELECT event_id AS export_id, user_id AS task_id FROM (SELECT *, {_SQL_JOB} AS status FROM events) WHERE status = 'queued' ORDER BY event_id LIMIT 1")
def l_job_fifo(spark: SparkSession, d: str) -> DataFrame:
    waiting = _jobs(spark, d).where("status not in ('preparing', 'writing')").withColumn("sequence", F.col("export_id"))
    return J.next_job(waiting).select("export_id", "task_id")


@query(f"SELECT event_id + 1000000 AS export_id, user_id AS task_id, 'queued' AS status, event_id AS retry_of FROM (SELECT *, {_SQL_JOB} AS status FROM events) WHERE event_id % 7 = 0 AND status = 'failed'")
def l_job_retry(spark: SparkSession, d: str) -> DataFrame:
    every = _jobs(spark, d).withColumn("format", F.lit("json"))
    asked = every.where("export_id % 7 = 0").select("export_id", (F.col("export_id") + 1000000).alias("new_id"))
    return J.retried(every, asked).drop("format")


@query(f"SELECT event_id AS export_id, user_id AS task_id, row_number() OVER (ORDER BY event_id DESC) AS place FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 100")
def b_export_history(spark: SparkSession, d: str) -> DataFrame:
    done = _jobs(spark, d).where("status = 'completed'").withColumn("ingest_seq", F.col("export_id"))
    first = J.history(done, 100)
    from pyspark.sql import Window

    return first.select("export_id", "task_id", F.row_number().over(Window.orderBy(F.desc("ingest_seq"))).cast("long").alias("place"))  # 100 rows


@query("""WITH t AS (SELECT user_id AS task_id, max(event_id % 5) AS g FROM events GROUP BY 1), s AS (SELECT user_id AS task_id, count(*) AS n, max(event_id % 97) AS seen FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT t.task_id, greatest(g + coalesce(n, 0), coalesce(seen, 0)) AS worker_generation FROM t LEFT JOIN s USING (task_id)""")
def l_generations(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("task_id", F.col("user_id"))
    tasks = events.groupBy("task_id").agg(F.max(F.col("event_id") % 5).alias("worker_generation"))
    return J.next_generations(tasks, events.where("event_type = 'signup'").select("task_id", (F.col("event_id") % 97).alias("reported")))


@query("""WITH t AS (SELECT user_id AS task_id, max(event_id % 5) AS g FROM events GROUP BY 1) SELECT event_id FROM events JOIN t ON t.task_id = user_id WHERE event_id % 5 = g""")
def l_fenced_writes(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("task_id", F.col("user_id"))
    tasks = events.groupBy("task_id").agg(F.max(F.col("event_id") % 5).alias("worker_generation"))
    return J.fenced(events.select("task_id", "event_id", (F.col("event_id") % 5).alias("generation")), tasks).select("event_id")


@query("""WITH c AS (SELECT user_id AS task_id, arg_max(event_id, (ts, event_id)) AS checkpoint FROM events GROUP BY 1), p AS (SELECT user_id AS task_id, count(DISTINCT event_id % 40) AS pages, max(event_id % 40) AS last_page FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT c.task_id, checkpoint, coalesce(pages, 0) AS pages, last_page FROM c LEFT JOIN p USING (task_id)""")
def l_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("task_id", F.col("user_id"))
    return J.checkpoints(events.select("task_id", "ts", F.col("event_id").alias("checkpoint")), events.where("event_type = 'view'").select("task_id", (F.col("event_id") % 40).alias("page_id")))


@query(f"""WITH {SQL_LINES}, g AS (SELECT DISTINCT source FROM documents WHERE doc_id % 331 = 5), k AS (SELECT 'lines' AS name, task_id FROM lines UNION ALL SELECT 'sources', source FROM documents UNION ALL SELECT 'labels', source FROM documents JOIN labels USING (doc_id))
SELECT name, count(*) AS n, count(DISTINCT task_id) AS tasks FROM k WHERE task_id NOT IN (SELECT source FROM g) GROUP BY 1""")
def b_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("task_id", F.col("source"))
    tables = {"lines": lines(docs), "sources": docs, "labels": docs.join(table(spark, d, "labels").select("doc_id"), "doc_id")}
    left = J.without_tasks({k: v.select("task_id") for k, v in tables.items()}, docs.where("doc_id % 331 = 5"))
    out = None
    for name, rows in left.items():
        counted = rows.agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("tasks")).where("n > 0").select(F.lit(name).alias("name"), "n", "tasks")
        out = counted if out is None else out.unionAll(counted)
    return out


@query("""SELECT event_id, 'a=' || (event_id % 3) || ',total_pages=' || (event_id % 11) || ',type=' || event_type AS payload FROM events""")
def k_payload_merge(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    before = F.create_map(F.lit("a"), (e % 3).cast("string"), F.lit("total_pages"), F.lit("?"))
    after = J.merged_payload(before, {"type": F.col("event_type"), "total_pages": e % 11})
    said = F.array_join(F.transform(F.array_sort(F.map_entries(after)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return table(spark, d, "events").select("event_id", said.alias("payload"))


@query("""WITH a AS (SELECT event_id, user_id % 7 AS view_id, user_id AS task_id, event_id % 3 AS generation, event_id % 5 AS sequence FROM events), v AS (SELECT DISTINCT user_id % 7 AS view_id, user_id AS task_id, 1 AS generation, 2 AS sequence FROM events WHERE user_id % 2 = 0)
SELECT event_id FROM a SEMI JOIN v ON a.view_id = v.view_id AND a.task_id = v.task_id AND a.generation = v.generation AND a.sequence = v.sequence""")
def d_request_guard(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    answers = events.select("event_id", (F.col("user_id") % 7).alias("view_id"), F.col("user_id").alias("task_id"), (F.col("event_id") % 3).alias("generation"), (F.col("event_id") % 5).alias("sequence"))
    views = events.select((F.col("user_id") % 7).alias("view_id"), F.col("user_id").alias("task_id"), F.lit(1).cast("long").alias("generation"), F.lit(2).cast("long").alias("sequence"), (F.col("user_id") % 2 == 0).alias("mounted")).distinct()
    return J.still_wanted(answers, views).select("event_id")


@query("""WITH s AS (SELECT user_id, min(event_id) AS stopped FROM events WHERE event_type = 'error' GROUP BY 1) SELECT event_id AS page, stopped IS NULL OR event_id < stopped AS runs FROM events e LEFT JOIN s ON s.user_id = e.user_id WHERE event_type = 'view'""")
def l_cooperative_stop(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("task_id", F.col("user_id"))
    pages = events.where("event_type = 'view'").select("task_id", F.col("event_id").alias("page"), F.col("event_id").alias("begun"))
    return J.pages_before(pages, events.where("event_type = 'error'").select("task_id", F.col("event_id").alias("at"))).select("page", "runs")


@query("""SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN event_id % 6 = 0 THEN '{}' ELSE props END, '$.k') AS BIGINT) AS k FROM events""")
def c_decoded_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 6 == 0, "{broken").otherwise(F.col("props")).alias("props"))
    return P.decoded(rows, {"props": "k bigint"}).select("event_id", "props.k")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'ready' ELSE 'uncertain' END END AS status FROM documents""")
def c_context_version(spark: SparkSession, d: str) -> DataFrame:
    stored = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, "ready").otherwise("uncertain").alias("status"), F.lit("horizontal").alias("orientation")))
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("layout_context_version"), stored.alias("layout_context_json"))
    return P.with_context(rows).select("doc_id", "layout_context.status")


@query(f"""{SQL_FOUND} SELECT doc_id, line_no, start, CASE WHEN doc_id % 4 = 0 THEN 'given' ELSE 'made' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'pages/' || page_no || '.png' ELSE '' END AS page_image_relpath, 'crops/' || doc_id || '.png' AS crop_image_relpath, 1200.0::DOUBLE AS page_width FROM found""")
def c_stored_rows(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d).withColumns({"bbox_hash": F.when(F.col("doc_id") % 4 == 0, "given"), "crop_path": F.concat(F.lit("/w/crops/"), "doc_id", F.lit(".png"))})
    pages = found.select("source_id", "doc_id", "page_no").distinct().select("source_id", "page_no", F.concat(F.when(F.col("doc_id") % 3 == 0, "/w").otherwise("/elsewhere"), F.lit("/pages/"), "page_no", F.lit(".png")).alias("image_path"), F.lit(1200.0).alias("page_width"), F.lit(1600.0).alias("page_height"))
    out = P.stored_rows(found, pages, "/w/")
    return out.select("doc_id", "line_no", "start", F.when(F.col("bbox_hash") == "given", "given").when(F.length("bbox_hash") == 40, "made").otherwise("?").alias("kind"), "page_image_relpath", "crop_image_relpath", "page_width")


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN 'a' ELSE 'ab' END AS matched_text, CASE WHEN vec_id % 3 = 1 THEN 'U+0061' WHEN vec_id % 3 = 2 THEN 'U+0061 U+0062' END AS unicode_sequence, CASE WHEN vec_id % 3 = 1 THEN 'a' END AS matched_character,
CASE WHEN vec_id % 3 = 0 THEN 'matched_text is required' WHEN vec_id % 5 = 0 THEN 'bbox_hash is required' END AS refused FROM embeddings""")
def d_recovered_rows(spark: SparkSession, d: str) -> DataFrame:
    v, none = F.col("vec_id"), F.lit(None).cast("string")
    rows = table(spark, d, "embeddings").select("vec_id", F.when(v % 3 == 2, "ab").when(v % 6 == 0, "").alias("matched_text"), F.when(v % 3 == 1, "a").otherwise(none).alias("matched_character"), none.alias("unicode_sequence"), F.when(v % 5 == 0, "").otherwise("h").alias("bbox_hash"))
    return P.recovered(rows).select("vec_id", "matched_text", "unicode_sequence", "matched_character", "refused")


@query(f"""WITH {SQL_HITS}, h AS (SELECT * FROM hits WHERE task_id = 'src3' AND global_sequence = 7), p AS (SELECT doc_id, page_no, count(*) AS page_lines FROM lines GROUP BY 1, 2) SELECT h.doc_id, h.page_no, line_no, start, page_lines FROM h LEFT JOIN p ON p.doc_id = h.doc_id AND p.page_no = h.page_no""")
def e_single_hit(spark: SparkSession, d: str) -> DataFrame:
    pages = lines(table(spark, d, "documents")).groupBy("doc_id", "page_no").agg(F.count("*").alias("page_lines"))
    return P.single_hit(_hits(spark, d).withColumn("hit_id", F.col("global_sequence")), pages, "src3", 7).select("doc_id", "page_no", "line_no", "start", "page_lines")


@query("""WITH s AS (SELECT page_id AS source_order, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'd/' || (page_id % 50) || '.pdf' END AS path, 'f' || (page_id % 3) || '.pdf' AS file_name FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY source_order) AS n FROM s) SELECT source_order, CASE WHEN path <> '' AND n = 1 THEN path ELSE 'source-' || printf('%03d', source_order + 1) || '/' || file_name END AS relative_path FROM k""")
def c_source_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    rows = table(spark, d, "pages").select(p.alias("source_order"), F.when(p % 4 == 0, "").otherwise(F.concat(F.lit("d/"), p % 50, F.lit(".pdf"))).alias("path"), F.concat(F.lit("f"), p % 3, F.lit(".pdf")).alias("file_name"))
    return P.source_paths(rows).select("source_order", "relative_path")


@query("""WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Own ' || page_id WHEN 1 THEN 'box' ELSE '' END AS name, CASE WHEN page_id % 5 = 0 THEN '' ELSE '/data/box' END AS dir, CASE WHEN page_id % 3 = 0 THEN 'term' ELSE '' END AS said, CASE page_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'stale' ELSE 'odd' END AS status, page_id % 2 AS failures FROM pages),
b AS (SELECT *, CASE WHEN dir = '' THEN '' ELSE 'box' END AS base FROM t)
SELECT page_id, CASE WHEN name <> '' AND name <> base THEN name WHEN said <> '' THEN (CASE WHEN base = '' THEN 'Local archive' ELSE base END) || ' · search “' || said || '”' WHEN name <> '' THEN name WHEN base <> '' THEN base ELSE 'Scan task' END AS display_name,
CASE WHEN status = 'completed' AND failures > 0 THEN 'Partly completed (' || failures || ' failed)' WHEN status = 'completed' THEN 'Completed' WHEN status = 'stale' THEN 'Stale' ELSE 'odd' END AS label, CASE WHEN status = 'completed' AND failures = 0 THEN 'PASS' WHEN status = 'stale' THEN 'FAIL' ELSE 'WARN' END AS tone FROM b""")
def c_task_names(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    rows = table(spark, d, "pages").select("page_id", F.when(p % 4 == 0, F.concat(F.lit("Own "), p)).when(p % 4 == 1, " box ").otherwise("").alias("name"), F.when(p % 5 == 0, "").otherwise("/data/box//").alias("source_dir"), F.when(p % 3 == 0, "term").alias("search_text"), F.when(p % 3 == 0, "completed").when(p % 3 == 1, "stale").otherwise("odd").alias("status"), (p % 2).alias("failures"))
    view = P.status_view(F.col("status"), F.col("failures"))
    return P.task_names(rows).select("page_id", "display_name", view["label"].alias("label"), view["tone"].alias("tone"))


@query("""WITH o AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'vertical' ELSE 'horizontal' END AS mode, CASE WHEN vec_id % 2 = 0 THEN [10.0::DOUBLE, 20.0, 10.0 + vec_id % 90, 60.0] ELSE [0.0::DOUBLE, 0.0, 0.0, 0.0] END AS b, CASE WHEN vec_id % 5 = 1 THEN [0.1::DOUBLE, 0.25, 0.5, 0.75] ELSE [0.0::DOUBLE, 0.0, 0.0, 0.0] END AS n FROM embeddings),
s AS (SELECT vec_id, mode, CASE WHEN (b[3] > b[1] AND b[4] > b[2]) OR NOT (n[1] < n[3] AND n[2] < n[4]) THEN b ELSE [n[1] * 1000, n[2] * 2000, n[3] * 1000, n[4] * 2000] END AS b FROM o),
k AS (SELECT vec_id, b, CASE WHEN mode = 'auto' THEN b[4] - b[2] >= b[3] - b[1] ELSE mode = 'vertical' END AS tall, b[3] / 1000 <= b[1] / 1000 OR b[4] / 2000 <= b[2] / 2000 AS none FROM s)
SELECT vec_id, CASE WHEN tall THEN 'vertical' ELSE 'horizontal' END AS orientation, CASE WHEN none THEN CASE WHEN tall THEN 0.45::DOUBLE ELSE 0.1::DOUBLE END ELSE b[1] / 1000 END AS nx0, CASE WHEN none THEN CASE WHEN tall THEN 0.9::DOUBLE * 2000 ELSE 0.55::DOUBLE * 2000 END ELSE b[4] END AS y1 FROM k""")
def j_fallback_context(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    some = lambda ok, x: F.when(ok, x)
    own, share = v % 2 == 0, v % 5 == 1
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.lit("x").alias("matched_text"), F.when(v % 3 == 0, "auto").when(v % 3 == 1, "vertical").otherwise("horizontal").alias("layout_mode"), F.lit(1000.0).alias("width"), F.lit(2000.0).alias("height"), some(own, F.lit(10.0)).alias("x0"), some(own, F.lit(20.0)).alias("y0"), some(own, 10.0 + v % 90).alias("x1"), some(own, F.lit(60.0)).alias("y1"),
        some(share, F.lit(0.1)).alias("nx0"), some(share, F.lit(0.25)).alias("ny0"), some(share, F.lit(0.5)).alias("nx1"), some(share, F.lit(0.75)).alias("ny1"),
    )
    return P.fallback_context(rows).select("vec_id", "orientation", F.col("normalised_box.x0").alias("nx0"), F.col("box.y1").alias("y1"))


@query("""WITH b AS (SELECT vec_id, (vec_id % 13)::DOUBLE / 10 AS x0, (vec_id % 7)::DOUBLE / 10 AS y0, (vec_id % 17)::DOUBLE / 10 AS x1, 0.9::DOUBLE AS y1, CASE WHEN vec_id % 11 = 0 THEN 0 ELSE 1000 END::DOUBLE AS w FROM embeddings)
SELECT vec_id, CASE WHEN x0 <= 1 AND x1 <= 1 AND x1 > x0 AND y1 > y0 AND w > 0 THEN x1 * w END AS x1 FROM b""")
def j_block_box(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    box = P.block_box((v % 13) / 10.0, (v % 7) / 10.0, (v % 17) / 10.0, F.lit(0.9), F.when(v % 11 == 0, 0.0).otherwise(1000.0), F.lit(1600.0))
    return table(spark, d, "embeddings").select("vec_id", box["x1"].alias("x1"))


@query("""WITH h AS (SELECT vec_id, greatest(30.0::DOUBLE, least(68.0::DOUBLE, vec_id % 90)) AS i, greatest(18.0::DOUBLE, least(40.0::DOUBLE, vec_id % 50)) AS l, greatest(18.0::DOUBLE, least(42.0::DOUBLE, vec_id % 60)) AS t FROM embeddings), o AS (SELECT *, 100 - (i + l + t) AS off FROM h),
r AS (SELECT *, CASE WHEN off > 0 THEN 68 - i ELSE i - 30 END AS ri, CASE WHEN off > 0 THEN 40 - l ELSE l - 18 END AS rl, CASE WHEN off > 0 THEN 42 - t ELSE t - 18 END AS rt FROM o)
SELECT vec_id, round(CASE WHEN off = 0 THEN i ELSE i + off * ri / (ri + rl + rt) END, 6) AS image, round(CASE WHEN off = 0 THEN t ELSE t + off * rt / (ri + rl + rt) END, 6) AS detail FROM r""")
def j_pane_ratios(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    held = P.pane_ratios((v % 90).cast("double"), (v % 50).cast("double"), (v % 60).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(held["image"], 6).alias("image"), F.round(held["detail"], 6).alias("detail"))


@query(f"""WITH {SQL_HITS}, o AS (SELECT doc_id, page_no, line_no, raw_text, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY (y0 + y1) / 2, (x0 + x1) / 2, line_no) AS k FROM boxed),
j AS (SELECT h.doc_id, h.line_no, h.start, coalesce((SELECT string_agg(p.raw_text, chr(10) ORDER BY p.k) || chr(10) FROM o p WHERE p.doc_id = h.doc_id AND p.page_no = h.page_no AND p.k < o.k), '') || substring(h.raw_text, 1, h.start) AS ahead,
 substring(h.raw_text, h."end" + 1) || coalesce((SELECT chr(10) || string_agg(p.raw_text, chr(10) ORDER BY p.k) FROM o p WHERE p.doc_id = h.doc_id AND p.page_no = h.page_no AND p.k > o.k), '') AS later FROM hits h JOIN o ON o.doc_id = h.doc_id AND o.line_no = h.line_no)
SELECT doc_id, line_no, start, regexp_replace(regexp_extract(ahead, '((?:\\S\\s*){{0,15}})$', 1), '^\\s+|\\s+$', '', 'g') AS before, regexp_replace(regexp_extract(later, '^(\\s*(?:\\S\\s*){{0,15}})', 1), '^\\s+|\\s+$', '', 'g') AS after FROM j""")
def i_spatial_context(spark: SparkSession, d: str) -> DataFrame:
    return P.spatial_context(_hits(spark, d), with_boxes(lines(table(spark, d, "documents"))))


@query(f"""{SQL_FOUND}, s AS (SELECT *, coalesce(decision, 'unreviewed') AS status, doc_id % 9 AS source_order, 'File ' || doc_id || '.pdf' AS file_name FROM found), k AS (SELECT *, 'file ' || lpad(doc_id::VARCHAR, 18, '0') || '.pdf' AS name, CASE status WHEN 'unreviewed' THEN 0 WHEN 'needs_review' THEN 1 WHEN 'rejected' THEN 2 ELSE 3 END AS rank FROM s)
SELECT task_id, global_sequence, row_number() OVER (PARTITION BY doc_id ORDER BY global_sequence) AS sequence, row_number() OVER (PARTITION BY doc_id ORDER BY source_order, page_no, global_sequence) AS source, row_number() OVER (PARTITION BY lang, page_no ORDER BY name, source_order, page_no, global_sequence) AS file_asc,
row_number() OVER (PARTITION BY lang, page_no ORDER BY name DESC, source_order, page_no, global_sequence) AS file_desc, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, source_order, global_sequence) AS page_asc, row_number() OVER (PARTITION BY doc_id ORDER BY page_no DESC, source_order, global_sequence) AS page_desc,
row_number() OVER (PARTITION BY doc_id ORDER BY confidence, source_order, page_no, global_sequence) AS by_confidence, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY rank, source_order, page_no, global_sequence, task_id) AS by_status FROM k""")
def g_report_orders(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _found(spark, d).withColumns({"status": F.coalesce("decision", F.lit("unreviewed")), "source_order": F.col("doc_id") % 9, "file_name": F.concat(F.lit("File "), "doc_id", F.lit(".pdf"))})
    orders = R.report_orders()
    place = lambda name, *by, more=(): F.row_number().over(Window.partitionBy(*by).orderBy(*orders[name], *more))
    return rows.select(
        "task_id", "global_sequence", place("sequence", "doc_id").alias("sequence"), place("source", "doc_id").alias("source"), place("fileAsc", "lang", "page_no").alias("file_asc"), place("fileDesc", "lang", "page_no").alias("file_desc"),
        place("pageAsc", "doc_id").alias("page_asc"), place("pageDesc", "doc_id").alias("page_desc"), place("confidence", "doc_id").alias("by_confidence"), place("status", F.col("doc_id") % 20, more=(F.col("task_id"),)).alias("by_status"),
    )


@query(f"""{SQL_FOUND}, n AS (SELECT count(*) AS total FROM found WHERE task_id = 'src1') SELECT global_sequence, doc_id, total, total > 60 AS has_more FROM found, n WHERE task_id = 'src1' ORDER BY global_sequence LIMIT 50 OFFSET 10""")
def g_page_with_total(spark: SparkSession, d: str) -> DataFrame:
    rows, about = R.page_of(_found(spark, d).where("task_id = 'src1'"), ["global_sequence"], 50, 10)
    return rows.select("global_sequence", "doc_id", F.lit(about["total"]).cast("long").alias("total"), F.lit(about["has_more"]).alias("has_more"))


_SQL_COUNTED = f"""{SQL_FOUND}, o AS (SELECT source_id AS file_path, page_no AS page_number, CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 1 AND line_no % 2 = 0) THEN 's' WHEN doc_id % 10 = 4 THEN 'x' ELSE 't' END AS m, coalesce(decision, 'needs_review') AS status,
 CASE line_no % 5 WHEN 0 THEN 'pdf_text_layer' WHEN 1 THEN 'djvu_text_layer' WHEN 2 THEN 'pdf_ocr' WHEN 3 THEN 'djvu_ocr' ELSE 'image_ocr' END AS method FROM found),
d AS (SELECT CASE doc_id % 7 WHEN 0 THEN 'PDF' WHEN 1 THEN 'DJVU' WHEN 2 THEN 'DJV' WHEN 3 THEN 'TIFF' WHEN 4 THEN 'JPEG' WHEN 5 THEN 'PNG' ELSE 'TXT' END AS t, n_chars // 1500 + 1 AS page_count FROM documents),
f AS (SELECT bool_or(m = 's') AS s, bool_or(m = 't') AS t, bool_or(m = 'x') AS x FROM o GROUP BY file_path)"""


@query(f"""{_SQL_COUNTED} SELECT a.*, b.*, c.*, (SELECT count(*) FROM documents WHERE doc_id % 13 = 0) AS failure_file_count, (SELECT count(DISTINCT (doc_id, page_no)) FROM found) AS embedded_page_count FROM
(SELECT count(*) FILTER (t = 'PDF') AS pdf_file_count, count(*) FILTER (t = 'DJVU') AS djvu_file_count, count(*) FILTER (t = 'DJV') AS djv_file_count, count(*) FILTER (t = 'TIFF') AS tiff_file_count, count(*) FILTER (t = 'JPEG') AS jpeg_file_count, count(*) FILTER (t = 'PNG') AS png_file_count,
 count(*) FILTER (t IN ('TIFF', 'JPEG', 'PNG')) AS image_file_count, count(*) AS success_file_count, sum(page_count)::BIGINT AS document_total_pages FROM d) a,
(SELECT count(DISTINCT file_path) AS hit_file_count, count(DISTINCT (file_path, page_number)) AS hit_page_count, count(*) FILTER (m = 's') AS simplified_total, count(*) FILTER (m = 't') AS traditional_total, count(*) AS combined_total,
 count(*) FILTER (m = 's' AND status = 'confirmed') AS simplified_confirmed, count(*) FILTER (m = 's' AND status = 'needs_review') AS simplified_needs_review, count(*) FILTER (m = 't' AND status = 'confirmed') AS traditional_confirmed, count(*) FILTER (m = 't' AND status = 'needs_review') AS traditional_needs_review,
 count(*) FILTER (status = 'rejected') AS rejected_total, count(*) FILTER (method IN ('pdf_text_layer', 'djvu_text_layer')) AS text_layer_hits, count(*) FILTER (method LIKE '%ocr') AS ocr_hits, count(*) FILTER (method = 'pdf_ocr') AS pdf_ocr_hits, count(*) FILTER (method = 'djvu_ocr') AS djvu_ocr_hits, count(*) FILTER (method = 'image_ocr') AS image_ocr_hits FROM o) b,
(SELECT count(*) FILTER (s AND NOT t AND NOT x) AS only_simplified_files, count(*) FILTER (t AND NOT s AND NOT x) AS only_traditional_files, count(*) FILTER (s AND t AND NOT x) AS both_variant_files FROM f) c""")
def f_report_counters(spark: SparkSession, d: str) -> DataFrame:
    i, k = F.col("doc_id"), F.col("line_no")
    docs, found = table(spark, d, "documents"), _found(spark, d)
    kinds = F.array(*map(F.lit, ("PDF", "DJVU", "DJV", "TIFF", "JPEG", "PNG", "TXT")))
    methods = F.array(*map(F.lit, ("pdf_text_layer", "djvu_text_layer", "pdf_ocr", "djvu_ocr", "image_ocr")))
    matched = F.when((i % 3 == 0) | ((i % 3 == 1) & (k % 2 == 0)), "s").when(i % 10 == 4, "x").otherwise("t")
    rows = found.select(F.col("source_id").alias("file_path"), F.col("page_no").alias("page_number"), matched.alias("matched"), F.coalesce("decision", F.lit("needs_review")).alias("status"), F.get(methods, k % 5).alias("method"))
    files = docs.select(F.get(kinds, (i % 7).cast("int")).alias("file_type"), F.expr("n_chars div 1500 + 1").alias("page_count"))
    return R.report_counters(files, found.select("doc_id", "page_no").distinct(), rows, docs.where("doc_id % 13 = 0"), "s", "t")


_FOLD = f"replace(translate(%s, '{V.ACCENTED}', '{V.FOLDED}'), 'ß', 'ss')"


@query(f"""WITH {SQL_LINES}, f AS (SELECT doc_id, line_no, raw_text, {_FOLD % 'raw_text'} AS s FROM lines) SELECT doc_id, line_no, s AS simplified, replace(translate(replace(s, 'que', chr(983040)), 'eu', 'éù'), chr(983040), 'qúe') AS traditional, translate(s, 'eo', 'èö') AS taiwan FROM f""")
def i_regional_forms(spark: SparkSession, d: str) -> DataFrame:
    known = V.VariantTable(V.LATIN.to_simple, {"traditional": {"e": "é", "u": "ù"}, "taiwan": {"e": "è", "o": "ö"}}, {"traditional": {"que": "qúe"}, "taiwan": {}})
    return lines(table(spark, d, "documents")).select("doc_id", "line_no", *[V.form_column(F.col("raw_text"), k, known).alias(k) for k in ("simplified", "traditional", "taiwan")])


@query(f"""WITH c AS (SELECT vec_id AS id, lpad((vec_id % 7)::VARCHAR, 1, '0') AS raw, [{{'t': 'é', 'p': vec_id % 2 = 0}}, {{'t': 'e', 'p': false}}, {{'t': 'o', 'p': vec_id % 2 = 1}}] AS top FROM embeddings)
SELECT id, 'ocr_top_k' AS layer, 'candidate_pending_review' AS verification, 0 AS start FROM c""")
def i_topk_layer(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one character that no text layer matches; a candidate that folds to the query brings each up for review."""
    v = F.col("vec_id")
    one = lambda t, p: F.struct(F.lit(t).alias("text"), F.lit(0.5).alias("confidence"), p.alias("is_primary"))
    rows = table(spark, d, "embeddings").select(v.alias("id"), (v % 7).cast("string").alias("raw_text"), (v % 7).cast("string").alias("resolved_text"), F.array(one("é", v % 2 == 0), one("e", F.lit(False)), one("o", v % 2 == 1)).alias("top_k"))
    return S.layered_search(rows, "é").select("id", "layer", "verification", F.col("start").cast("int").alias("start"))


@query(f"""{SQL_FOUND}, b AS (SELECT layer, script, verification FROM (SELECT 'raw_exact' AS layer, 'source_exact' AS verification, CASE WHEN regexp_matches(raw_text, '[{V.ACCENTED}ß]') THEN 'accented' ELSE 'plain' END AS script FROM found))
SELECT layer, script, verification, count(*) AS n, GROUPING(layer, script, verification)::INT AS gid FROM b GROUP BY GROUPING SETS ((layer), (script), (verification), ())""")
def f_hit_counters(spark: SparkSession, d: str) -> DataFrame:
    script = F.when(F.col("raw_text").rlike(f"[{V.ACCENTED}ß]"), "accented").otherwise("plain")
    lined = lines(table(spark, d, "documents")).select("doc_id", "raw_text", F.col("raw_text").alias("resolved_text"), script.alias("script"))
    return S.hit_counts(S.layered_search(lined, "ena").where("layer = 'raw_exact'"), ("layer", "script", "verification"))


