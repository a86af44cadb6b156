"""Queries over sources, listings and the write path (A and B operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redacted
from ..operators import sources as S
from ..operators import store as T
from ..sources.corpus import SQL_EVENTS, SQL_LINES, SQL_REVIEWS, lines, reviews, table, task_events
from .registry import query


@query(f"WITH {SQL_LINES} SELECT doc_id, line_no, page_no, line_index, raw_text, confidence FROM lines")
def a_lines_explode(spark: SparkSession, d: str) -> DataFrame:
    return lines(table(spark, d, "documents")).select("doc_id", "line_no", "page_no", "line_index", "raw_text", "confidence")


@query("""WITH o AS (SELECT doc_id, source AS task_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents)
SELECT task_id, page FROM o WHERE doc_id % 7 = 3""")
def a_remaining_pages_anti(spark: SparkSession, d: str) -> DataFrame:
    pages, done = S.page_ordinals(table(spark, d, "documents"))
    return S.remaining(pages, done, ["task_id", "page"])


@query("""SELECT split_part(url, '/', 3) AS root, sha256(split_part(url, '/', 3) || chr(10) || string_agg(url || chr(31) || length(html) || chr(31) || page_id, chr(10) ORDER BY url, page_id)) AS token,
  count(*) AS n FROM pages GROUP BY 1""")
def a_manifest_token(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.split("url", "/")[2].alias("root"), F.col("url").alias("rel"), F.length("html").alias("size"), F.col("page_id").alias("mtime"))
    return S.manifest_token(pages)


@query("""WITH k AS (SELECT unnest(['pdf', 'djvu', 'djv', 'tiff', 'jpeg', 'png']) AS fmt),
f AS (SELECT CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'djvu' WHEN 2 THEN 'tiff' WHEN 3 THEN 'jpeg' WHEN 4 THEN 'jpeg' WHEN 5 THEN 'txt' ELSE 'pdf' END AS fmt FROM pages)
SELECT k.fmt, count(f.fmt) AS n FROM k LEFT JOIN f USING (fmt) GROUP BY k.fmt""")
def a_format_histogram(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, [".PDF", ".djvu", ".tif", ".jpg", ".jpeg", ".txt", ".pdf"])), (F.col("page_id") % 7 + 1).cast("int"))
    return S.format_histogram(table(spark, d, "pages").select(F.concat(F.lit("f"), "page_id", suffix).alias("path")))


@query("SELECT doc_id, n_chars, source FROM (SELECT *, row_number() OVER (PARTITION BY n_chars, source ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def a_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return T.first_of(table(spark, d, "documents").select("doc_id", "n_chars", "source"), ["n_chars", "source"], [F.col("doc_id")])


@query("""WITH s AS (SELECT source AS folder, count(*) AS files, sum(n_chars)::BIGINT AS bytes, sum(n_chars // 2000 + 1)::BIGINT AS pages, count(*) FILTER (n_chars % 11 = 0) AS unsupported FROM documents GROUP BY 1),
e AS (SELECT *, CAST(trunc((268435456 + trunc(0.25::DOUBLE * bytes) + 8388608 * pages) * 1.25::DOUBLE) AS BIGINT) AS required FROM s)
SELECT folder, files, bytes, pages, required, array_to_string(list_filter([CASE WHEN files > 40 THEN 'LARGE_FILE_COUNT' END, CASE WHEN pages > 100 THEN 'LARGE_PAGE_COUNT' END,
 CASE WHEN bytes > 150000 THEN 'LARGE_SOURCE_BYTES' END, CASE WHEN unsupported > 4 THEN 'UNSUPPORTED_FILES' END], lambda x: x IS NOT NULL), ',') AS warnings,
 array_to_string(list_filter([CASE WHEN required > 1500000000 THEN 'DISK_SPACE_LOW' END, CASE WHEN files = 0 THEN 'NO_SUPPORTED_FILES' END], lambda x: x IS NOT NULL), ',') AS blocking FROM e""")
def a_threshold_codes(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").groupBy(F.col("source").alias("folder")).agg(
        F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.sum(F.expr("n_chars div 2000 + 1")).alias("pages"), F.count_if(F.col("n_chars") % 11 == 0).alias("unsupported")
    )
    out = S.preflight_codes(per, {"files": 40, "pages": 100, "bytes": 150_000, "unsupported": 4}, free=1_500_000_000)
    return out.select("folder", "files", "bytes", "pages", "required", F.array_join("warnings", ",").alias("warnings"), F.array_join("blocking", ",").alias("blocking"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '[^/\\]*$') AS base, regexp_extract(url, '([^/\\]*)[/\\][^/\\]*$', 1) AS parent FROM pages),
a AS (SELECT *, count(*) OVER (PARTITION BY base) AS n1, count(*) OVER (PARTITION BY parent, base) AS n2 FROM p)
SELECT page_id, CASE WHEN n1 = 1 THEN base WHEN n2 = 1 THEN parent || '/' || base ELSE url END AS name FROM a""")
def a_unique_display_names(spark: SparkSession, d: str) -> DataFrame:
    return S.display_names(table(spark, d, "pages").select("page_id", F.col("url").alias("path"))).select("page_id", "name")


@query("""WITH l AS (SELECT user_id % 20 AS file, event_id AS line, CASE WHEN event_id % 3 = 0 THEN ts END AS ts, event_type FROM events),
f AS (SELECT file, line, event_type, last_value(ts IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS ts FROM l)
SELECT file, line, event_type, ts FROM f ORDER BY ts DESC NULLS LAST, file DESC, line DESC LIMIT 500""")
def a_log_tail_inherit_ts(spark: SparkSession, d: str) -> DataFrame:
    logged = table(spark, d, "events").select((F.col("user_id") % 20).alias("file"), F.col("event_id").alias("line"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("ts"), "event_type")
    return S.log_tail(logged, 500)


@query("""WITH f AS (SELECT page_id, string_split(CASE page_id % 5 WHEN 0 THEN 'runtime/evidence/t' || page_id % 9 || '/a.png' WHEN 1 THEN 'exports/t' || page_id % 9 || '/r.html' WHEN 2 THEN 'db/main.sqlite'
  WHEN 3 THEN 'logs/x.log' ELSE 'misc/y' END, '/') AS seg, length(html) AS bytes FROM pages)
SELECT CASE seg[1] WHEN 'runtime' THEN 'derived' WHEN 'exports' THEN 'exports' WHEN 'db' THEN 'database' WHEN 'logs' THEN 'logs' ELSE 'other' END AS bucket,
  CASE WHEN seg[1] = 'runtime' THEN seg[3] WHEN seg[1] = 'exports' THEN seg[2] END AS task_id, sum(bytes)::BIGINT AS bytes, count(*) AS files FROM f GROUP BY 1, 2""")
def a_storage_buckets(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    task = F.concat(F.lit("t"), (p % 9).cast("string"))
    path = F.when(p % 5 == 0, F.concat(F.lit("runtime/evidence/"), task, F.lit("/a.png"))).when(p % 5 == 1, F.concat(F.lit("exports/"), task, F.lit("/r.html"))).when(p % 5 == 2, "db/main.sqlite").when(p % 5 == 3, "logs/x.log").otherwise("misc/y")
    return S.storage_buckets(table(spark, d, "pages").select(path.alias("path"), F.length("html").alias("bytes")))


@query("""WITH e AS (SELECT url, sha256(html) AS h, page_id FROM pages), done AS (SELECT DISTINCT url, h FROM e WHERE page_id % 3 = 0)
SELECT page_id, h AS content_hash FROM e WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.url = e.url AND done.h = e.h)""")
def a_content_hash_cache(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "pages").select("page_id", "url", F.sha2("html", 256).alias("content_hash"))
    done = hashed.where("page_id % 3 = 0").select("url", "content_hash").distinct()
    return S.remaining(hashed, done, ["url", "content_hash"]).select("page_id", "content_hash")


@query("""WITH p AS (SELECT page_id AS ordinal, lower(CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 4 = 1 THEN url || '.pdf' WHEN page_id % 4 = 2 THEN url || '.PDF' ELSE url || '.txt' END) AS path FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ordinal) AS k FROM p)
SELECT ordinal, path, CASE WHEN path = '' THEN 'empty_path' WHEN NOT regexp_matches(path, '\\.(pdf|djvu|djv|tif|tiff|jpg|jpeg|png)$') THEN 'unsupported_format' END AS reason FROM f WHERE k = 1""".replace("\\\\", "\\"))
def a_file_list_validation(spark: SparkSession, d: str) -> DataFrame:
    p, url = F.col("page_id"), F.col("url")
    path = F.when(p % 4 == 0, "").when(p % 4 == 1, F.concat(url, F.lit(".pdf"))).when(p % 4 == 2, F.concat(url, F.lit(".PDF"))).otherwise(F.concat(url, F.lit(".txt")))
    return S.validated_files(table(spark, d, "pages").select(p.alias("ordinal"), path.alias("path")))


@query("""WITH old AS (SELECT o_custkey AS task_id, o_orderkey AS bkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS global_sequence FROM orders WHERE o_orderkey % 3 = 0),
new AS (SELECT DISTINCT o_custkey AS task_id, o_orderkey AS bkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0),
m AS (SELECT task_id, max(global_sequence) AS top FROM old GROUP BY 1)
SELECT task_id, bkey, global_sequence FROM old UNION ALL
SELECT new.task_id, bkey, coalesce(top, 0) + row_number() OVER (PARTITION BY new.task_id ORDER BY bkey) FROM new LEFT JOIN m ON new.task_id = m.task_id""")
def b_insert_ignore_sequence(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("bkey"))
    old = T.append_numbered(None, orders.where("bkey % 3 = 0"), ["task_id", "bkey"], ["bkey"])
    return T.append_numbered(old, orders.where("bkey % 2 = 0"), ["task_id", "bkey"], ["bkey"])


@query("""WITH c AS (SELECT user_id AS task_id, event_id % 50 AS occurrence_id, event_id AS op, event_id % 3 <> 0 AS sets_decision, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS decision, event_id % 2 = 0 AS sets_note, 'n' || event_id AS note FROM events)
SELECT task_id, occurrence_id, arg_max(struct_pack(v := decision), op) FILTER (sets_decision).v AS decision, arg_max(note, op) FILTER (sets_note) AS note, max(op) AS updated FROM c GROUP BY 1, 2""".replace("arg_max(struct_pack(v := decision), op) FILTER (sets_decision).v", "struct_extract(arg_max(struct_pack(v := decision), op) FILTER (sets_decision), 'v')"))
def b_review_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    log = table(spark, d, "events").select(
        F.col("user_id").alias("task_id"), (e % 50).alias("occurrence_id"), e.alias("op"), (e % 3 != 0).alias("sets_decision"), F.when(e % 7 != 0, F.col("event_type")).alias("decision"), (e % 2 == 0).alias("sets_note"), F.concat(F.lit("n"), e).alias("note")
    )
    return T.latest_reviews(log, ["task_id", "occurrence_id"], "op")


@query(f"""WITH {SQL_REVIEWS}, ch AS (SELECT doc_id * 2 AS doc_id, 'confirmed' AS decision FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'rejected' FROM labels WHERE doc_id % 3 = 1)
SELECT ch.doc_id, ch.decision, r.decision AS previous, d.doc_id IS NULL AS missing, count(*) OVER (PARTITION BY ch.doc_id) > 1 AS duplicate FROM ch LEFT JOIN documents d ON d.doc_id = ch.doc_id LEFT JOIN reviews r ON r.doc_id = ch.doc_id""")
def b_batch_decisions(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    changes = labels.where("doc_id % 3 = 0").select((F.col("doc_id") * 2).alias("doc_id"), F.lit("confirmed").alias("decision")).unionAll(labels.where("doc_id % 3 = 1").select("doc_id", F.lit("rejected")))
    return T.planned_decisions(changes, table(spark, d, "documents").select("doc_id"), reviews(labels), "doc_id")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3")
def b_retention_newest_n(spark: SparkSession, d: str) -> DataFrame:
    return T.newest(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)


@query("""WITH ov AS (SELECT o_custkey % 100 AS page, max(o_orderkey) AS updated FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1),
w AS (SELECT o_orderkey AS id, o_custkey % 100 AS page, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey // 10) * 10 END AS expected FROM orders)
SELECT id, page FROM w WHERE (expected IS NULL AND NOT EXISTS (SELECT 1 FROM ov WHERE ov.page = w.page)) OR (expected IS NOT NULL AND EXISTS (SELECT 1 FROM ov WHERE ov.page = w.page AND ov.updated = w.expected))""")
def b_optimistic_save(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("page"))
    overrides = orders.where("id % 5 = 0").groupBy("page").agg(F.max("id").alias("updated"))
    writes = orders.withColumn("expected", F.when(F.col("id") % 2 == 0, F.expr("id div 10 * 10")))
    return T.optimistic(writes, overrides, ["page"], "expected", "updated").select("id", "page")


@query(f"""WITH {SQL_LINES} SELECT source_id, page_no, count(*) AS n_lines, min(line_index) <> 0 OR max(line_index) + 1 <> count(*) AS gap, bool_or(length(raw_text) > 600) AS long_line, count(DISTINCT confidence) AS kinds FROM lines GROUP BY 1, 2""")
def b_corpus_validation(spark: SparkSession, d: str) -> DataFrame:
    return T.page_violations(lines(table(spark, d, "documents")))


@query("""WITH ov AS (SELECT o_custkey % 50 AS page, arg_max(o_orderkey, o_orderkey) AS version FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT o_orderkey AS id, o_custkey % 50 AS page, version IS NOT NULL AND o_orderkey < version AS stale FROM orders LEFT JOIN ov ON ov.page = o_custkey % 50""")
def b_override_invalidation(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("page"))
    overrides = orders.where("id % 4 = 0").groupBy("page").agg(F.max("id").alias("version"))
    return T.stale_after(orders, overrides, ["page"], "id", "version")


@query(f"""WITH {SQL_EVENTS}, m AS (SELECT task_id, max(sequence) AS top FROM task_events GROUP BY 1), n AS (SELECT user_id AS task_id, count(*) AS k FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT m.task_id, top + unnest(range(1, k + 1)) AS sequence, 'retry' AS kind FROM m JOIN n USING (task_id)""")
def b_event_append(spark: SparkSession, d: str) -> DataFrame:
    known = task_events(table(spark, d, "events"))
    fresh = known.where("kind = 'failed'").select("task_id", F.col("event_id").alias("order"), F.lit("retry").alias("kind"))
    return T.appended_events(known, fresh, "order")


@query("""SELECT user_id AS task_id, event_id, 'new' AS origin FROM events WHERE event_type = 'error' AND user_id % 2 = 0 UNION ALL
SELECT user_id, event_id, 'old' FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 2 = 0)""")
def b_replace_partition(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    row = lambda kind, origin: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("task_id"), "event_id", F.lit(origin).alias("origin"))
    return T.replaced(row("purchase", "old"), row("error", "new").where("task_id % 2 = 0"), ["task_id"])


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '(?i)example', '<user>', 'g'), '(/home/|/Users/)[^/\s]+', '\1<user>', 'g') AS shown FROM pages""")
def i_redaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", redacted(F.col("url"), "example", "").alias("shown"))

