"""Queries over what a restart finds, resume states, stale contexts, stored lines and session pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import projection as P
from ..operators import recovery as Y
from ..operators import review as R
from ..sources.corpus import SQL_LINES, lines, table, with_boxes
from .contract_queries import _SQL_JOB, _jobs
from .registry import query
from .review_queries import SQL_FOUND, SQL_HITS, TERM, _found

#: A task is held if anything was bought in it; cleanup jobs are users with errors, pending if the last error is dear.
_SQL_HELD = "held AS (SELECT DISTINCT user_id AS task_id FROM events WHERE event_type = 'purchase' AND value >= 20)"


def _held(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'purchase' and value >= 20").select(F.col("user_id").alias("task_id")).distinct()


@query(f"""WITH {_SQL_HELD}, j AS (SELECT event_id AS export_id, user_id AS task_id, {_SQL_JOB} AS status, value < 10 AS has_temp FROM events),
k AS (SELECT *, status IN ('queued', 'preparing', 'writing') AS interrupted FROM j)
SELECT export_id, CASE WHEN interrupted THEN 'interrupted' ELSE status END AS status, CASE WHEN interrupted THEN 'interrupted' ELSE 'stage' END AS current_stage, CASE WHEN interrupted THEN 'ENGINE_PROCESS_EXITED' ELSE '' END AS error_code, interrupted,
coalesce(has_temp, false) OR h.task_id IS NULL AS needs_cleanup FROM k LEFT JOIN held h ON k.task_id = h.task_id""")
def l_exports_after_restart(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "events").select(F.col("event_id").alias("export_id"), (F.col("value") < 10).alias("has_temp"))
    jobs = _jobs(spark, d).drop("has_temp").join(values, "export_id").withColumns({"current_stage": F.lit("stage"), "error_code": F.lit("")})
    return Y.exports_after_restart(jobs, _held(spark, d)).select("export_id", "status", "current_stage", "error_code", "interrupted", "needs_cleanup")


@query(f"""WITH {_SQL_HELD}, j AS (SELECT user_id AS task_id, CASE WHEN arg_max(value, (ts, event_id)) >= 20 THEN 'pending' ELSE 'cleanup_failed' END AS status, count(*) AS attempt_count FROM events WHERE event_type = 'error' GROUP BY 1),
t AS (SELECT user_id AS task_id, max(CASE WHEN value < 2 THEN 'FILES_IN_USE' END) AS code, bool_and(value < 120) AS deleted FROM events WHERE event_type = 'click' GROUP BY 1),
o AS (SELECT j.*, code, CASE WHEN status <> 'pending' THEN 'kept' WHEN h.task_id IS NULL THEN 'forgotten' WHEN t.task_id IS NULL THEN 'kept' WHEN code IS NOT NULL OR NOT deleted THEN 'failed' ELSE 'completed' END AS outcome FROM j LEFT JOIN held h ON j.task_id = h.task_id LEFT JOIN t ON j.task_id = t.task_id)
SELECT task_id, outcome, CASE WHEN outcome = 'failed' THEN 'cleanup_failed' ELSE status END AS status, attempt_count + CASE WHEN outcome IN ('failed', 'completed') THEN 1 ELSE 0 END AS attempt_count,
CASE WHEN outcome = 'failed' THEN coalesce(code, 'DATABASE_ERROR') WHEN outcome = 'completed' THEN '' ELSE 'OLD' END AS last_error_code FROM o""")
def l_cleanups_after_restart(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("task_id", F.col("user_id"))
    status = F.when(F.max_by("value", F.struct("ts", "event_id")) >= 20, "pending").otherwise("cleanup_failed")
    jobs = events.where("event_type = 'error'").groupBy("task_id").agg(status.alias("status"), F.count("*").alias("attempt_count")).withColumn("last_error_code", F.lit("OLD"))
    tried = events.where("event_type = 'click'").select("task_id", F.when(F.col("value") < 2, "FILES_IN_USE").alias("code"), (F.col("value") < 120).alias("deleted"))
    return Y.cleanups_after_restart(jobs, _held(spark, d), tried)


@query(f"""WITH {SQL_HITS}, p AS (SELECT DISTINCT task_id, source_id, page_no FROM hits),
c AS (SELECT d.source AS task_id, 'doc-' || d.doc_id AS source_id, count(*) AS worker_generation FROM events e JOIN documents d ON d.doc_id = json_extract(e.props, '$.k')::BIGINT GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY task_id, source_id ORDER BY page_no) AS n FROM p),
s AS (SELECT task_id, source_id, count(*) AS done, max(page_no) AS last_page, coalesce(min(n) FILTER (n <> page_no), count(*) + 1) AS next_page, string_agg(page_no, ',' ORDER BY page_no) AS pages FROM n GROUP BY 1, 2)
SELECT coalesce(s.task_id, c.task_id) AS task_id, coalesce(s.source_id, c.source_id) AS source_id, coalesce(done, 0) AS done, coalesce(last_page, 0) AS last_completed_page, coalesce(next_page, 1) AS next_page, coalesce(worker_generation, 0) AS worker_generation, coalesce(pages, '') AS pages
FROM s FULL JOIN c ON s.task_id = c.task_id AND s.source_id = c.source_id""")
def l_resume_states(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a hit are done; a source's generation grows with each event that names it."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("task_id"), F.concat(F.lit("doc-"), "doc_id").alias("source_id"))
    named = table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("doc_id")).agg(F.count("*").alias("worker_generation"))
    done = R.matches(table(spark, d, "documents"), TERM).select("task_id", "source_id", "page_no")
    states = Y.task_resume_states(done, docs.join(named, "doc_id"), with_pages=True)
    return states.select("task_id", "source_id", "done", "last_completed_page", "next_page", "worker_generation", F.array_join(F.col("processed_page_ids").cast("array<string>"), ",").alias("pages"))


@query(f"""{SQL_FOUND}, v AS (SELECT *, CASE WHEN decision IS NULL THEN 1 ELSE 2 END AS version, CASE WHEN confidence >= 0.9 THEN 'ready' WHEN confidence >= 0.8 THEN 'uncertain' WHEN confidence >= 0.7 THEN 'pending' WHEN confidence >= 0.65 THEN NULL ELSE 'failed' END AS status FROM found)
SELECT task_id, global_sequence FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN source_id = 'doc-40' AND page_no = 2 THEN 0 ELSE 1 END, global_sequence) AS k FROM v WHERE (version <> 2 OR coalesce(status, '') NOT IN ('ready', 'uncertain')) AND coalesce(status, '') <> 'failed') WHERE k <= 25""")
def d_contexts_to_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of reviewed documents are of the current version; how sure the line is tells how its context came out."""
    sure = F.col("confidence")
    status = F.when(sure >= 0.9, "ready").when(sure >= 0.8, "uncertain").when(sure >= 0.7, "pending").when(sure < 0.65, "failed")
    found = _found(spark, d).withColumns({"layout_context_version": F.when(F.col("decision").isNull(), 1).otherwise(2), "layout_context_status": status})
    return Y.stale_layouts(found, 2, 25, "doc-40", 2).select("task_id", "global_sequence")


@query("""WITH f AS (SELECT user_id AS task_id, event_id, value, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type IN ('error', 'click', 'view'))
SELECT task_id, event_id, json_extract(props, '$.k')::BIGINT AS k FROM f WHERE k <= 100 AND value >= 5 AND value < 60""")
def k_task_failures(spark: SparkSession, d: str) -> DataFrame:
    """Cheap events were cut off while they were written, dear ones hold a list; neither is a failure that can be shown."""
    payload = F.when(F.col("value") < 5, F.substring("props", 1, 4)).when(F.col("value") >= 60, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    rows = table(spark, d, "events").where("event_type in ('error', 'click', 'view')").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("sequence"), payload.alias("payload"))
    return Y.task_failures(rows).select("task_id", F.col("sequence").alias("event_id"), F.try_variant_get("payload", "$.k", "bigint").alias("k"))


@query(f"""WITH {SQL_LINES}, w AS (SELECT *, string_split(raw_text, ' ') AS words FROM boxed)
SELECT doc_id, line_no, len(words) AS n_words, words[-1] AS last_word, 50.0::DOUBLE * len(words) - 10 AS last_x, x1 AS line_x1, length(words[1])::DOUBLE / 4 AS first_confidence,
len(list_filter(words, lambda x: length(x) = 1)) AS isolated, CASE WHEN contains(raw_text, 'the') THEN 0 ELSE coalesce(list_sum([i - 1 FOR i IN range(1, len(words) + 1) IF contains(words[i], 'ena')]), 0)::BIGINT END AS reconciled, CASE WHEN confidence < 0.8 THEN confidence END AS corrected,
CASE WHEN contains(raw_text, 'the') THEN 'script_reconciliations' ELSE '' END AS undecodable FROM w""")
def c_stored_lines(spark: SparkSession, d: str) -> DataFrame:
    """All lines as stored, with seven JSON columns, and read back; those that hold `the` have one that broke off."""
    boxed = with_boxes(lines(table(spark, d, "documents"))).withColumn("words", F.split("raw_text", " "))
    corners = lambda a, b, c, e: F.array(F.array(a, b), F.array(c, b), F.array(c, e), F.array(a, e))
    side = lambda n: n.cast("double")
    fixes = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("index"), w.alias("source"), F.replace(w, F.lit("ena"), F.lit("éna")).alias("resolved"))), lambda s: s["source"] != s["resolved"])
    stored = boxed.select(
        "doc_id", "line_no", "raw_text",
        F.to_json(corners(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("bbox_json"),
        F.to_json(F.transform("words", lambda w, i: corners(side(i * 50), F.col("y0"), side(i * 50 + 40), F.col("y1")))).alias("word_boxes_json"),
        F.to_json("words").alias("word_text_json"),
        F.to_json(F.transform("words", lambda w: F.length(w) / F.lit(4.0))).alias("word_confidences_json"),
        F.to_json(F.transform(F.filter("words", lambda w: F.length(w) == 1), lambda w: F.struct(w.alias("text"), F.lit(0.5).alias("confidence")))).alias("isolated_top_k_json"),
        F.when(F.contains("raw_text", F.lit("the")), "[{").otherwise(F.to_json(fixes)).alias("script_reconciliations_json"),
        F.when(F.col("confidence") < 0.8, F.to_json(F.struct(F.lit("vote").alias("method"), "confidence"))).otherwise("").alias("correction_provenance_json"),
    )
    last = lambda c: F.element_at(c, -1)
    return P.decoded_lines(stored).select(
        "doc_id", "line_no", F.size("word_text").cast("long").alias("n_words"), last(F.col("word_text")).alias("last_word"), last(F.col("word_boxes"))[2][0].alias("last_x"), F.col("bbox")[2][0].alias("line_x1"), F.col("word_confidences")[0].alias("first_confidence"),
        F.size("isolated_top_k").cast("long").alias("isolated"), F.aggregate(F.coalesce(F.col("script_reconciliations.index"), F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x).alias("reconciled"),
        F.col("correction_provenance.confidence").alias("corrected"), F.array_join("undecodable", ",").alias("undecodable"),
    )


@query(f"""WITH {SQL_HITS}, s AS (SELECT doc_id AS labelled, CASE WHEN toxic = 1 THEN NULL ELSE 'q' || quality || '/' || doc_id END AS display_path FROM labels),
j AS (SELECT h.*, CASE WHEN matched = 'ena' AND confidence >= 0.8 THEN 0 ELSE 1 END AS layer, coalesce(display_path, source_id) AS path, CASE WHEN lang = 'en' THEN 1200.0::DOUBLE ELSE 0 END AS page_width, CASE WHEN lang = 'en' THEN 1600.0::DOUBLE ELSE 0 END AS page_height, length(raw_text) AS n, (y1 - y0) >= (x1 - x0) AS tall FROM hits h LEFT JOIN s ON h.doc_id = labelled WHERE task_id = 'src3')
SELECT doc_id, line_no, start, layer AS layer_priority, path AS display_path,
CASE WHEN page_width > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN tall THEN x0 ELSE x0 + (x1 - x0) * start / n END) / page_width)) ELSE 0 END AS normalized_x0,
CASE WHEN page_width > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN tall THEN y0 + (y1 - y0) * start / n ELSE y0 END) / page_height)) ELSE 0 END AS normalized_y0,
CASE WHEN page_width > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN tall THEN x1 ELSE x0 + (x1 - x0) * "end" / n END) / page_width)) ELSE 1 END AS normalized_x1,
CASE WHEN page_width > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN tall THEN y0 + (y1 - y0) * "end" / n ELSE y1 END) / page_height)) ELSE 1 END AS normalized_y1
FROM j ORDER BY layer, source_id, page_no, line_index, start, doc_id, line_no LIMIT 100 OFFSET 20""")
def e_session_hits(spark: SparkSession, d: str) -> DataFrame:
    """A page of a task's hits joined to their lines and to the paths of the sources that have one."""
    docs = table(spark, d, "documents").where("source = 'src3'")
    layer = F.when((F.col("matched") == "ena") & (F.col("confidence") >= 0.8), 0).otherwise(1)
    hits = R.matches(docs, TERM).select("task_id", "doc_id", "line_no", "start", "end", layer.alias("layer_priority"))
    wide = lambda n: F.when(F.col("lang") == "en", n).otherwise(0.0)
    lined = with_boxes(lines(docs)).select("doc_id", "line_no", "source_id", "page_no", "line_index", "raw_text", "x0", "y0", "x1", "y1", wide(1200.0).alias("page_width"), wide(1600.0).alias("page_height"))
    path = F.when(F.col("toxic") == 1, None).otherwise(F.concat(F.lit("q"), "quality", F.lit("/"), "doc_id"))
    sources = table(spark, d, "labels").select(F.lit("src3").alias("task_id"), F.concat(F.lit("doc-"), "doc_id").alias("source_id"), path.alias("display_path"))
    out = R.page(P.session_hits(hits, lined, sources), P.SESSION_ORDER, 100, 20)
    return out.select("doc_id", "line_no", "start", "layer_priority", "display_path", *[f"normalized_{c}" for c in ("x0", "y0", "x1", "y1")])
