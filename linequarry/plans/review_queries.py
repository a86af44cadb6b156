"""Queries over review, filters, joins, aggregations and ordering (C to H operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import variants as V
from ..operators import review as R
from ..operators import store as T
from ..sources.corpus import SQL_LINES, SQL_REVIEWS, lines, reviews, table, with_boxes
from .registry import query

TERM = "ena"
_FOLD = f"replace(translate(%s, '{V.ACCENTED}', '{V.FOLDED}'), 'ß', 'ss')"
#: Matches of a term with places, as in operators.review.occurrences.
SQL_HITS = f"""{SQL_LINES},
hit0 AS (SELECT *, unnest(list_filter(range(0, greatest(length(raw_text) - {len(TERM)} + 1, 0)), lambda i: substring(raw_text, i + 1, {len(TERM)}) = '{TERM}')) AS start FROM boxed WHERE contains(raw_text, '{TERM}')),
hits AS (SELECT *, start + {len(TERM)} AS "end", substring(raw_text, greatest(start - 15, 0) + 1, start - greatest(start - 15, 0)) AS before, '{TERM}' AS matched, substring(raw_text, start + {len(TERM)} + 1, 15) AS after,
  row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no, start) AS page_occurrence_index, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, start) AS document_occurrence_index,
  row_number() OVER (PARTITION BY task_id ORDER BY doc_id, line_no, start) AS global_sequence FROM hit0)"""
SQL_FOUND = f"WITH {SQL_HITS}, {SQL_REVIEWS}, found AS (SELECT h.*, r.decision FROM hits h LEFT JOIN reviews r USING (doc_id))"


def _found(spark: SparkSession, d: str) -> DataFrame:
    return R.overlay(R.occurrences(table(spark, d, "documents"), TERM), reviews(table(spark, d, "labels")), ["doc_id"])


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return R.occurrences(table(spark, d, "documents"), TERM)


_WIDE = ["task_id", "doc_id", "page_no", "line_no", "start", "before", "matched", "after", "global_sequence", "decision"]


@query(f"{SQL_FOUND} SELECT {', '.join(_WIDE)} FROM found")
def e_review_overlay(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select(*_WIDE)


@query("""SELECT source AS task_id, count(*) AS sources, string_agg(lang, ' / ' ORDER BY lang) AS search_text, min(doc_id) AS first_doc FROM (SELECT DISTINCT source, lang, min(doc_id) OVER (PARTITION BY source) AS doc_id FROM documents) GROUP BY 1""")
def c_task_projection(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "documents").groupBy(F.col("source").alias("task_id")).agg(F.array_sort(F.collect_set("lang")).alias("terms"), F.min("doc_id").alias("first_doc"))
    return terms.select("task_id", F.size("terms").cast("long").alias("sources"), F.array_join("terms", " / ").alias("search_text"), "first_doc")


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'a/../' || page_id WHEN 2 THEN '/abs/x' WHEN 3 THEN 'dir\file' || page_id || '.pdf' ELSE '' END AS path, url FROM pages)
SELECT page_id, CASE WHEN path <> '' AND NOT regexp_matches(replace(path, '\', '/'), '^/|^[A-Za-z]:|(^|/)\.\.(/|$)') THEN replace(path, '\', '/') END AS safe, regexp_extract(path, '[^/\\]*$') AS base, coalesce(nullif(path, ''), nullif(url, ''), 'unknown') AS source FROM p""")
def c_safe_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    path = F.when(p % 5 == 0, F.col("url")).when(p % 5 == 1, F.concat(F.lit("a/../"), p)).when(p % 5 == 2, "/abs/x").when(p % 5 == 3, F.concat(F.lit("dir\\file"), p, F.lit(".pdf"))).otherwise("")
    rows = table(spark, d, "pages").select("page_id", path.alias("path"), "url")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select("page_id", X.safe_relative(F.col("path")).alias("safe"), X.base_name(F.col("path")).alias("base"), F.coalesce(some("path"), some("url"), F.lit("unknown")).alias("source"))


@query(f"""{SQL_FOUND} SELECT task_id, global_sequence, before, decision FROM found WHERE decision IS NULL AND matched = '{TERM}'
AND translate(before || matched || after, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%th_ %' ESCAPE chr(1)""")
def d_occurrence_filter(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).where(R.occurrence_filter(status="unreviewed", matched=TERM, search="TH_ ")).select("task_id", "global_sequence", "before", "decision")


@query("""WITH t AS (SELECT source AS task_id, 'task ' || source AS name, CASE WHEN count(*) % 2 = 0 THEN 'completed' ELSE 'running' END AS status FROM documents GROUP BY 1)
SELECT * FROM t WHERE status = 'completed' AND (contains(name, '99') OR EXISTS (SELECT 1 FROM documents s WHERE s.source = t.task_id AND contains('doc-' || s.doc_id || '.pdf', '99')))""")
def d_task_filter_exists(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    tasks = docs.groupBy(F.col("source").alias("task_id")).agg(F.when(F.count("*") % 2 == 0, "completed").otherwise("running").alias("status")).withColumn("name", F.concat(F.lit("task "), "task_id"))
    sources = docs.select(F.col("source").alias("task_id"), F.concat(F.lit("doc-"), "doc_id", F.lit(".pdf")).alias("display_path"))
    return R.matching_tasks(tasks, sources, "completed", "99").select("task_id", "name", "status")


@query(f"""WITH {SQL_LINES}, o AS (SELECT doc_id AS id, line_no, 'p' || (doc_id % 40) AS page_id, raw_text AS text, {_FOLD % 'raw_text'} AS family, {_FOLD % 'upper(raw_text)'} AS capitals, x0 / 1200 AS x0, y0 / 1600 AS y0, x1 / 1200 AS x1, y1 / 1600 AS y1 FROM boxed),
v AS (SELECT id, list_filter([CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate_id' END, CASE WHEN line_no % 7 = 0 AND contains(text, 'è') THEN 'code_points' END,
 CASE WHEN x0 < 0 OR x0 > 1 OR y0 < 0 OR y0 > 1 OR x1 < 0 OR x1 > 1 OR y1 < 0 OR y1 > 1 THEN 'box_outside' END,
 CASE WHEN x1 <= x0 OR y1 <= y0 THEN 'box_empty' END, CASE WHEN substring(page_id, 2)::INT >= 30 THEN 'page_missing' END, CASE WHEN line_no % 11 = 0 AND capitals <> family THEN 'family' END], lambda r: r IS NOT NULL) AS rules FROM o)
SELECT id, array_to_string(rules, ',') AS rules FROM v WHERE len(rules) > 0""")
def d_validation_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every line: the stored code points are those of the resolved text (every seventh line resolves è to é), every eleventh line was found in capitals."""
    boxed = with_boxes(lines(table(spark, d, "documents")))
    text, every = F.col("raw_text"), lambda n: F.col("line_no") % n == 0
    stored = X.code_points_of_lines(F.when(every(7), F.replace(text, F.lit("è"), F.lit("é"))).otherwise(text))
    terms = F.array(F.when(every(11), F.upper(text)).otherwise(text))
    rows = boxed.select(F.col("doc_id").alias("id"), F.concat(F.lit("p"), F.col("doc_id") % 40).alias("page_id"), text.alias("text"), terms.alias("terms"), stored.alias("code_points"), *[(F.col(c) / s).alias(c) for c, s in (("x0", 1200.0), ("y0", 1600.0), ("x1", 1200.0), ("y1", 1600.0))])
    pages = spark.range(30).select(F.concat(F.lit("p"), "id").alias("page_id"))
    return R.violations(rows, pages).select("id", F.array_join("rules", ",").alias("rules"))


@query(f"""{SQL_FOUND} SELECT found.task_id, global_sequence, decision, 'doc ' || found.doc_id AS display_path, k.total, k.pages
FROM found JOIN (SELECT task_id, count(*) AS total, count(DISTINCT (doc_id, page_no)) AS pages FROM found GROUP BY 1) k ON k.task_id = found.task_id""")
def e_export_snapshot(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)
    pages = found.groupBy("task_id").agg(F.count("*").alias("total"), F.count_distinct("doc_id", "page_no").alias("pages"))
    sources = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc "), "doc_id").alias("display_path"))
    return found.join(sources, "doc_id", "left").join(pages, "task_id").select("task_id", "global_sequence", "decision", "display_path", "total", "pages")


@query(f"""WITH {SQL_LINES}, e AS (SELECT item_id % 40 AS k, sum(length(text) - length(replace(text, ' ', '')))::BIGINT AS expected FROM benchmark GROUP BY 1), a AS (SELECT doc_id % 50 AS k, count(*) AS actual FROM lines GROUP BY 1)
SELECT coalesce(e.k, a.k) AS k, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual FROM e FULL JOIN a ON e.k = a.k WHERE coalesce(expected, 0) <> coalesce(actual, 0)""")
def e_truth_full_outer(spark: SparkSession, d: str) -> DataFrame:
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    expected = table(spark, d, "benchmark").groupBy((F.col("item_id") % 40).alias("k")).agg(F.sum(spaces).alias("expected"))
    actual = lines(table(spark, d, "documents")).groupBy((F.col("doc_id") % 50).alias("k")).agg(F.count("*").alias("actual"))
    return R.truth_differences(expected, actual, "k")


@query(f"""WITH {SQL_HITS} SELECT task_id, doc_id, line_no, start, 'doc-' || doc_id AS display_path, confidence FROM hits WHERE task_id = 'src3'
ORDER BY page_no, line_index, start NULLS FIRST, doc_id LIMIT 100 OFFSET 20""")
def e_hit_page(spark: SparkSession, d: str) -> DataFrame:
    rows = _hits(spark, d).where("task_id = 'src3'").select("task_id", "doc_id", "line_no", "start", F.col("source_id").alias("display_path"), "confidence", "page_no", "line_index")
    return R.page(rows, ["page_no", "line_index", F.asc_nulls_first("start"), "doc_id"], 100, 20).select("task_id", "doc_id", "line_no", "start", "display_path", "confidence")


@query("""WITH s AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal FROM documents WHERE doc_id % 3 <> 0)
SELECT d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY ordinal NULLS LAST, d.doc_id) AS place FROM documents d LEFT JOIN s USING (doc_id)""")
def e_backfill_order(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    known = docs.where("doc_id % 3 <> 0").select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("ordinal"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.asc_nulls_last("ordinal"), "doc_id"))
    return docs.join(known, "doc_id", "left").select("doc_id", place.alias("place"))


@query("""SELECT source AS task_id, count(*) AS n, string_agg('doc-' || doc_id, ',' ORDER BY doc_id) AS sources FROM documents GROUP BY 1 ORDER BY min(doc_id) DESC LIMIT 10""")
def e_task_sources_collect(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").groupBy(F.col("source").alias("task_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return per.orderBy(F.desc("first")).limit(10).select("task_id", "n", F.array_join(F.transform("ids", lambda i: F.concat(F.lit("doc-"), i)), ",").alias("sources"))


@query(f"""WITH {SQL_HITS}, p AS (SELECT doc_id, page_no, count(*) AS page_lines FROM lines GROUP BY 1, 2) SELECT hits.doc_id, hits.page_no, start, line_no, page_lines FROM hits LEFT JOIN p ON p.doc_id = hits.doc_id AND p.page_no = hits.page_no""")
def e_page_lookup(spark: SparkSession, d: str) -> DataFrame:
    pages = lines(table(spark, d, "documents")).groupBy("doc_id", "page_no").agg(F.count("*").alias("page_lines"))
    return _hits(spark, d).join(pages, ["doc_id", "page_no"], "left").select("doc_id", "page_no", "start", "line_no", "page_lines")


@query(f"""{SQL_FOUND} SELECT task_id, count(*) AS total, count(*) FILTER (decision = 'confirmed') AS confirmed, count(*) FILTER (decision = 'needs_review') AS needs_review,
count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision IS NULL) AS unreviewed FROM found GROUP BY 1""")
def f_review_summary(spark: SparkSession, d: str) -> DataFrame:
    found = R.overlay(R.matches(table(spark, d, "documents"), TERM), reviews(table(spark, d, "labels")), ["doc_id"])
    return R.review_summary(found, ["task_id"])


@query(f"""WITH {SQL_HITS}, w AS (SELECT source AS task_id, count(*) AS documents, sum(n_chars)::BIGINT AS characters FROM documents GROUP BY 1),
h AS (SELECT task_id, count(*) AS occurrences, count(DISTINCT doc_id) AS documents_hit, count(DISTINCT (doc_id, page_no)) AS pages_hit, max(page_no) AS last_page, count(*) FILTER (confidence < 0.7::DOUBLE) AS unsure FROM hits GROUP BY 1)
SELECT w.task_id, documents, characters, coalesce(occurrences, 0) AS occurrences, coalesce(documents_hit, 0) AS documents_hit, coalesce(pages_hit, 0) AS pages_hit, last_page, coalesce(unsure, 0) AS unsure FROM w LEFT JOIN h ON w.task_id = h.task_id""")
def f_report_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.report_stats(table(spark, d, "documents"), R.matches(table(spark, d, "documents"), TERM))


@query("""SELECT l_orderkey % 1000 AS path, max(l_linenumber) AS page_count, sum(l_quantity)::BIGINT AS found, count(*) FILTER (l_returnflag = 'R') AS failed, min(l_shipdate) AS started, max(l_shipdate) AS finished FROM lineitem GROUP BY 1""")
def f_worker_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    part = lambda n: rows.where(F.col("l_suppkey") % 4 == n).groupBy((F.col("l_orderkey") % 1000).alias("path")).agg(F.max("l_linenumber").alias("page_count"), F.sum("l_quantity").cast("long").alias("found"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.min("l_shipdate").alias("started"), F.max("l_shipdate").alias("finished"))
    return R.merged_reports([part(n) for n in range(4)])


@query("""SELECT user_id % 50 AS worker, count(*) AS total, count(*) FILTER (event_type <> 'error') AS done, count(*) FILTER (event_type = 'view') AS running, round(100.0::DOUBLE * count(*) FILTER (event_type <> 'error') / count(*), 2) AS pct FROM events GROUP BY 1""")
def f_progress_snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("user_id") % 50).alias("worker"), F.lit(1).alias("total"), F.when(F.col("event_type") != "error", 1).otherwise(0).alias("done"), (F.col("event_type") == "view").alias("running"))
    return R.progress(rows, ["worker"])


@query("""WITH c AS (SELECT o_custkey AS task_id, o_orderpriority AS source, o_orderkey % 30 AS page, o_orderkey AS created, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS prio FROM orders)
SELECT task_id, source, prio FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY prio, page DESC, created DESC, source) AS k FROM c) WHERE k = 1""")
def f_resolve_source_argmax(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderpriority").alias("source"), (F.col("o_orderkey") % 30).alias("page"), F.col("o_orderkey").alias("created"), "o_orderstatus")
    return R.first_source([rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), rows.where("o_orderstatus not in ('F', 'O')")], "task_id")


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS score, generate_subscripts(embedding, 1) - 1 AS class FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS rank FROM e)
SELECT vec_id, rank, class FROM r WHERE rank <= 5""")
def f_topk_matrix(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("class", "score"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "class"))
    return cells.withColumn("rank", rank).where("rank <= 5").select("vec_id", "rank", "class")


@query(f"""WITH {SQL_LINES} SELECT doc_id, count(*) AS boxes, count(*) FILTER (y1 - y0 >= 1.5::DOUBLE * (x1 - x0)) AS tall, count(*) FILTER (y1 - y0 >= 1.5::DOUBLE * (x1 - x0)) >= 2 AND count(*) FILTER (y1 - y0 >= 1.5::DOUBLE * (x1 - x0)) >= 0.15::DOUBLE * count(*) AS retry FROM boxed GROUP BY 1""")
def f_vertical_vote(spark: SparkSession, d: str) -> DataFrame:
    tall = F.count_if((F.col("y1") - F.col("y0")) >= 1.5 * (F.col("x1") - F.col("x0")))
    out = with_boxes(lines(table(spark, d, "documents"))).groupBy("doc_id").agg(F.count("*").alias("boxes"), tall.alias("tall"))
    return out.withColumn("retry", (F.col("tall") >= 2) & (F.col("tall") >= 0.15 * F.col("boxes")))


@query(f"""{SQL_FOUND} SELECT task_id, count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS completed, count(*) FILTER (doc_id % 11 = 0 AND doc_id % 3 <> 0) AS failed, greatest(0, count(*) - count(*) FILTER (doc_id % 3 = 0) - count(*) FILTER (doc_id % 11 = 0 AND doc_id % 3 <> 0)) AS remaining FROM found GROUP BY 1""")
def f_layout_progress(spark: SparkSession, d: str) -> DataFrame:
    done, failed = F.count_if(F.col("doc_id") % 3 == 0), F.count_if((F.col("doc_id") % 11 == 0) & (F.col("doc_id") % 3 != 0))
    out = _found(spark, d).groupBy("task_id").agg(F.count("*").alias("total"), done.alias("completed"), failed.alias("failed"))
    return out.withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("completed") - F.col("failed")))


@query(f"""WITH {SQL_LINES}, e AS (SELECT source AS task_id, sum(n_chars // 1500 + 1) AS expected, count(*) FILTER (doc_id % 13 = 0) AS failures FROM documents GROUP BY 1),
i AS (SELECT task_id, count(DISTINCT (doc_id, page_no)) AS pages, count(*) AS n_lines FROM lines GROUP BY 1)
SELECT e.task_id, coalesce(pages, 0) AS pages, coalesce(n_lines, 0) AS n_lines, CASE WHEN coalesce(pages, 0) = 0 THEN 'failed' WHEN pages >= expected AND failures = 0 THEN 'ready' ELSE 'partial' END AS status FROM e LEFT JOIN i USING (task_id)""")
def f_corpus_finalize(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    expected = docs.groupBy(F.col("source").alias("task_id")).agg(F.sum(F.expr("n_chars div 1500 + 1")).alias("expected"), F.count_if(F.col("doc_id") % 13 == 0).alias("failures"))
    indexed = lines(docs).groupBy("task_id").agg(F.count_distinct("doc_id", "page_no").alias("pages"), F.count("*").alias("n_lines"))
    both = expected.join(indexed, "task_id", "left").fillna(0, ["pages", "n_lines"])
    status = F.when(F.col("pages") == 0, "failed").when((F.col("pages") >= F.col("expected")) & (F.col("failures") == 0), "ready").otherwise("partial")
    return both.select("task_id", "pages", "n_lines", status.alias("status"))


@query(f"""{SQL_FOUND} SELECT doc_id, min(global_sequence) AS first_seen, count(DISTINCT page_no) AS pages, count(*) FILTER (coalesce(CASE WHEN line_no % 9 = 0 THEN 'confirmed' END, decision) = 'confirmed') AS confirmed FROM found GROUP BY 1""")
def f_client_tallies(spark: SparkSession, d: str) -> DataFrame:
    own = F.coalesce(F.when(F.col("line_no") % 9 == 0, "confirmed"), F.col("decision"))
    return _found(spark, d).groupBy("doc_id").agg(F.min("global_sequence").alias("first_seen"), F.count_distinct("page_no").alias("pages"), F.count_if(own == "confirmed").alias("confirmed"))


@query("""WITH e AS (SELECT vec_id % 100 AS grp, vec_id AS idx, label % 4 AS conf, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 't' || vec_id END AS text FROM embeddings) SELECT grp, arg_max(text, conf * 1000000 + idx) AS best FROM e WHERE text <> '' GROUP BY 1""")
def f_best_text(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    rows = table(spark, d, "embeddings").select((v % 100).alias("grp"), v.alias("idx"), (F.col("label") % 4).alias("conf"), F.when(v % 3 == 0, "").otherwise(F.concat(F.lit("t"), v)).alias("text"))
    return R.best_text(rows, "grp")


@query("SELECT user_id, event_type, event_id, CASE WHEN k = 1 THEN 'active' ELSE 'interrupted' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events)")
def g_latest_active_job(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("event_id")))
    return table(spark, d, "events").select("user_id", "event_type", "event_id", F.when(k == 1, "active").otherwise("interrupted").alias("status"))


@query(f"WITH {SQL_HITS} SELECT doc_id, line_no, start, page_occurrence_index, document_occurrence_index, global_sequence FROM hits")
def g_three_level_numbering(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("doc_id", "line_no", "start", "page_occurrence_index", "document_occurrence_index", "global_sequence")


@query("""WITH r AS (SELECT o_custkey AS task_id, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 7 + 1)::INT END AS num FROM orders), c AS (SELECT *, count(*) OVER (PARTITION BY task_id) AS n, row_number() OVER (PARTITION BY task_id, num ORDER BY id) AS k FROM r),
f AS (SELECT *, CASE WHEN num BETWEEN 1 AND n AND k = 1 THEN num END AS keep FROM c), free AS (SELECT g.task_id, g.v, row_number() OVER (PARTITION BY g.task_id ORDER BY g.v) AS r FROM (SELECT task_id, unnest(range(1, max(n) + 1)) AS v FROM f GROUP BY 1) g
 LEFT JOIN (SELECT task_id, keep FROM f WHERE keep IS NOT NULL) u ON u.task_id = g.task_id AND u.keep = g.v WHERE u.keep IS NULL), rest AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY id) AS r FROM f WHERE keep IS NULL)
SELECT task_id, id, keep AS num FROM f WHERE keep IS NOT NULL UNION ALL SELECT rest.task_id, id, v FROM rest JOIN free ON free.task_id = rest.task_id AND free.r = rest.r""")
def g_backfill_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("num"))
    return T.fill_gaps(rows, "task_id", "num", ["id"])


@query("""SELECT conv_id, turn, previous, next, coalesce(np, -1) AS next_pending FROM (SELECT conv_id, turn, lag(text) OVER w AS previous, lead(text) OVER w AS next, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS np FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def g_neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("pending", F.col("role") == "user")
    return R.neighbours(rows, ["conv_id"], "turn", "text").select("conv_id", "turn", "previous", "next", F.coalesce("next_pending", F.lit(-1)).alias("next_pending"))


@query(f"{SQL_FOUND} SELECT global_sequence, doc_id, start, decision FROM found WHERE task_id = 'src0' ORDER BY global_sequence LIMIT 50 OFFSET 10")
def g_page_limit_offset(spark: SparkSession, d: str) -> DataFrame:
    return R.page(_found(spark, d).where("task_id = 'src0'"), ["global_sequence"], 50, 10).select("global_sequence", "doc_id", "start", "decision")


@query(f"{SQL_FOUND} SELECT task_id, global_sequence, page_no FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN page_no = 2 THEN 0 ELSE 1 END, global_sequence) AS k FROM found) WHERE k <= 20")
def g_priority_order(spark: SparkSession, d: str) -> DataFrame:
    return T.newest(_found(spark, d), ["task_id"], [F.when(F.col("page_no") == 2, 0).otherwise(1), F.col("global_sequence")], 20).select("task_id", "global_sequence", "page_no")


@query(f"""{SQL_FOUND}, s AS (SELECT task_id, doc_id, global_sequence, coalesce(CASE decision WHEN 'needs_review' THEN 1 WHEN 'confirmed' THEN 2 WHEN 'rejected' THEN 3 END, 0) AS rank, confidence FROM found)
SELECT task_id, global_sequence, row_number() OVER (PARTITION BY task_id ORDER BY rank, global_sequence) AS by_status, row_number() OVER (PARTITION BY task_id ORDER BY confidence DESC, global_sequence) AS by_confidence, row_number() OVER (PARTITION BY task_id ORDER BY lpad(doc_id::VARCHAR, 12, '0') DESC, global_sequence) AS by_name_desc FROM s""")
def g_sort_modes(spark: SparkSession, d: str) -> DataFrame:
    rank = F.coalesce(F.when(F.col("decision") == "needs_review", 1).when(F.col("decision") == "confirmed", 2).when(F.col("decision") == "rejected", 3), F.lit(0))
    by = lambda *o: F.row_number().over(Window.partitionBy("task_id").orderBy(*o))
    return _found(spark, d).select("task_id", "global_sequence", by(rank, "global_sequence").alias("by_status"), by(F.desc("confidence"), "global_sequence").alias("by_confidence"), by(F.desc(F.lpad(F.col("doc_id").cast("string"), 12, "0")), "global_sequence").alias("by_name_desc"))


@query("SELECT user_id % 30 AS scope, event_type AS query, event_id AS session FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 30, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def g_session_history(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("user_id") % 30).alias("scope"), F.col("event_type").alias("query"), F.col("event_id").alias("session"), "ts")
    return T.first_of(rows, ["scope", "query"], [F.desc("ts"), F.desc("session")]).drop("ts")


@query(f"WITH {SQL_LINES} SELECT source_id, page_no, line_index, doc_id, row_number() OVER (PARTITION BY task_id ORDER BY doc_id, page_no, line_index) AS reading FROM lines")
def g_reading_order(spark: SparkSession, d: str) -> DataFrame:
    lined = lines(table(spark, d, "documents")).withColumn("_place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "line_index")))
    return R.numbered_in(lined, "task_id", "reading", "_place").select("source_id", "page_no", "line_index", "doc_id", "reading")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'signup' ORDER BY event_id LIMIT 25")
def g_fifo_head(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'signup'").orderBy("event_id").limit(25).select("event_id", "user_id", "event_type")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS checkpoint, max(ts) AS at FROM events GROUP BY 1")
def g_latest_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("checkpoint"), F.max("ts").alias("at"))


@query("""SELECT source AS task_id, doc_id FROM documents WHERE doc_id % 7 <> 3 UNION SELECT source, d.doc_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
def h_union_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("task_id"), "doc_id")
    return docs.where("doc_id % 7 <> 3").union(docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select("task_id", "doc_id")).distinct()

