"""Queries over what enters the corpus, word boxes and scan-time matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import intake as I
from ..operators import search as S
from ..operators import sources as O
from ..sources.corpus import SQL_LINES, lines, table, with_boxes
from .registry import query
from .search_queries import _FOLD, _STARTS

_READ = r"'\.(pdf|djvu|djv|tif|tiff|jpg|jpeg|png)$'"
_SUFFIXES = [".PDF", ".djvu", ".tif", ".jpg", ".png", ".txt", ".djv"]
_SQL_PATH = f"'f' || page_id || {_SUFFIXES}[page_id % 7 + 1]"


def _path() -> F.Column:
    return F.concat(F.lit("f"), F.col("page_id"), F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("page_id") % 7 + 1).cast("int")))


_SQL_CHECKED = f"""f AS (SELECT page_id AS ordinal, {_SQL_PATH} AS path, CASE WHEN page_id % 6 = 0 THEN 0 ELSE length(html) END AS inode, page_id % 2 AS device, page_id % 11 <> 0 AS matches, page_id % 13 = 0 AS moved FROM pages),
k AS (SELECT *, regexp_matches(lower(path), {_READ}) AS known FROM f),
c AS (SELECT *, CASE WHEN NOT known THEN 'unsupported' WHEN inode <> 0 AND row_number() OVER (PARTITION BY device, inode, known AND inode <> 0 ORDER BY ordinal) > 1 THEN 'duplicate' WHEN NOT matches THEN 'signature' WHEN moved THEN 'changed' ELSE 'ok' END AS state FROM k)"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    size = F.length("html").cast("long")
    files = table(spark, d, "pages").select(p.alias("ordinal"), _path().alias("path"), size.alias("size"), p.alias("mtime"), (p % 2).alias("device"), F.when(p % 6 == 0, 0).otherwise(size).alias("inode"), (p % 11 != 0).alias("matches"), size.alias("size_after"), F.when(p % 13 == 0, p + 1).otherwise(p).alias("mtime_after"))
    return I.checked_files(files)


@query(f"WITH {_SQL_CHECKED} SELECT ordinal, path, state, length(path) >= 240 AS long_path FROM c")
def a_checked_files(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("ordinal", "path", "state", "long_path")


@query(f"""WITH {_SQL_CHECKED}, b AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY ordinal) AS n FROM c WHERE state IN ('signature', 'changed'))
SELECT state, count(*) AS total, string_agg(path, ',' ORDER BY ordinal) FILTER (n <= 50) AS paths FROM b GROUP BY 1""")
def a_problem_details(spark: SparkSession, d: str) -> DataFrame:
    return I.problem_details(_checked(spark, d)).select("state", "total", F.array_join("paths", ",").alias("paths"))


@query(f"""WITH p AS (SELECT lower({_SQL_PATH}) AS path, page_id AS ordinal FROM pages),
f AS (SELECT path, min(ordinal) AS ordinal FROM p GROUP BY 1), r AS (SELECT *, CASE WHEN NOT regexp_matches(path, {_READ}) THEN 'unsupported_format' END AS reason FROM f),
n AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS k FROM r WHERE reason IS NOT NULL)
SELECT CASE WHEN i > 0 THEN 'invalid' WHEN v = 0 THEN 'none' WHEN v > 200 THEN 'too_many' ELSE 'ok' END AS outcome, v AS valid, i AS invalid,
 coalesce((SELECT string_agg(path || ': ' || reason, '; ' ORDER BY ordinal) FROM n WHERE k <= 5), '') || CASE WHEN i > 5 THEN '; ...' ELSE '' END AS preview
FROM (SELECT count(*) FILTER (reason IS NULL) AS v, count(*) FILTER (reason IS NOT NULL) AS i FROM r)""")
def a_file_list_outcome(spark: SparkSession, d: str) -> DataFrame:
    return I.list_outcome(table(spark, d, "pages").select(F.col("page_id").alias("ordinal"), _path().alias("path")))


@query(f"""SELECT page_id, CASE WHEN regexp_matches(lower(p), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(p), '\\.djvu?$') THEN 'djvu' WHEN regexp_matches(lower(p), '\\.(tif|tiff|jpg|jpeg|png)$') THEN 'raster' END AS backend FROM (SELECT page_id, {_SQL_PATH} AS p FROM pages)""")
def a_backend_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", I.backend(_path()).alias("backend"))


@query(f"""WITH p AS (SELECT page_id, {_SQL_PATH} AS path, CASE WHEN page_id % 5 = 0 THEN 'png' ELSE 'jpeg' END AS actual, CASE WHEN page_id % 9 = 0 THEN 6000 WHEN page_id % 10 = 0 THEN 2 ELSE 1 END AS frames, (page_id * 37) % 31000 AS w, (page_id * 53) % 9000 AS h FROM pages),
e AS (SELECT *, CASE WHEN path LIKE '%.tif' THEN 'tiff' WHEN path LIKE '%.jpg' THEN 'jpeg' WHEN path LIKE '%.png' THEN 'png' END AS fmt, CASE WHEN path LIKE '%.tif' THEN 'tiff' ELSE actual END AS is_a FROM p)
SELECT page_id, CASE WHEN fmt IS NULL THEN 'unsupported' WHEN fmt <> is_a THEN 'format_mismatch' WHEN fmt <> 'tiff' AND frames <> 1 THEN 'several_frames' WHEN frames > 5000 THEN 'too_many_frames'
 WHEN w <= 0 OR h <= 0 THEN 'empty' WHEN w > 30000 OR h > 30000 THEN 'edge' WHEN w * h > 200000000 THEN 'pixels' END AS problem FROM e""")
def a_image_limits(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    actual = F.when(O.file_format(_path()) == "tiff", "tiff").otherwise(F.when(p % 5 == 0, "png").otherwise("jpeg"))
    frames = F.when(p % 9 == 0, 6000).when(p % 10 == 0, 2).otherwise(1)
    return table(spark, d, "pages").select("page_id", I.image_problem(_path(), actual, frames, p * 37 % 31000, p * 53 % 9000).alias("problem"))


_DATA_PATHS = {0: "engine/tasks/t{k}/evidence/a.png", 1: "engine/tasks/t{k}/exports/r.html", 2: "engine/state.db-wal", 3: "logs/x.log", 4: "settings.json", 5: "engine/backups/b{k}.db", 6: "engine/.export-jobs/j{k}", 7: "engine/tasks/t{k}", 8: "engine/x/state.db", 9: "engine/state.db"}
_SQL_DATA = "CASE page_id % 10 " + " ".join(f"WHEN {n} THEN '{p}'" for n, p in _DATA_PATHS.items()) + " END"


@query(f"""WITH f AS (SELECT string_split(replace({_SQL_DATA}, '{{k}}', (page_id % 9)::VARCHAR), '/') AS s, length(html) AS bytes FROM pages),
b AS (SELECT *, CASE WHEN s[1] = 'logs' THEN 'logs' WHEN len(s) = 1 AND s[1] = 'settings.json' THEN 'settings' WHEN s[1] = 'engine' AND s[2] = '.export-jobs' THEN 'temporary_exports' WHEN s[1] = 'engine' AND s[2] = 'backups' THEN 'backups'
 WHEN s[1] = 'engine' AND len(s) = 2 AND (s[2] = 'state.db' OR s[2] LIKE 'state.db-%') THEN 'database' WHEN s[1] = 'engine' AND s[2] = 'tasks' AND s[4] = 'exports' THEN 'exports' WHEN s[1] = 'engine' AND s[2] = 'tasks' THEN 'derived' ELSE 'other' END AS bucket FROM f)
SELECT bucket, CASE WHEN bucket IN ('exports', 'derived') THEN s[3] END AS task_id, sum(bytes)::BIGINT AS bytes, count(*) AS files FROM b GROUP BY 1, 2""")
def a_local_usage(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for p in _DATA_PATHS.items() for x in p])
    path = F.replace(F.element_at(kinds, (F.col("page_id") % 10).cast("int")), F.lit("{k}"), (F.col("page_id") % 9).cast("string"))
    return I.local_usage(table(spark, d, "pages").select(path.alias("path"), F.length("html").alias("bytes")), "state.db")


@query("""SELECT p AS page_no, p - 1 AS page_index, 'occ-' || p AS occurrence_id, t AS matched_text, 0 AS match_start, length(t)::INT AS match_end, 'page-' || p || '-' || t AS context_full
FROM (SELECT p, ['约', '約', 'éna'][(p - 1) % 3 + 1] AS t FROM range(1, 1001) r(p))""")
def a_synthetic_pages(spark: SparkSession, d: str) -> DataFrame:
    return I.synthetic_pages(spark, 1000, ["约", "約", "éna"])


_SHA = "if(page_no % 6 = 0, 'xyz', sha2(if(page_no % 8 = 0, 'n', 'm'), 256))"


@query(f"""WITH {SQL_LINES}, per AS (SELECT source_id, page_no, any_value(task_id) AS task_id, bool_or(doc_id % 9 = 4 AND line_index = 2) AS gap, bool_or(doc_id % 10 = 3 AND line_no % 9 = 8) AS nulls, bool_or(doc_id % 12 = 5 AND line_no % 5 = 1) AS forms, any_value(doc_id) AS doc_id FROM lines GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN page_no % 6 = 0 THEN 'xyz' ELSE sha256(CASE WHEN page_no % 8 = 0 THEN 'n' ELSE 'm' END) END AS sha, task_id LIKE '%a%' AS known FROM per)
SELECT source_id, page_no, array_to_string(list_filter([CASE WHEN doc_id % 17 = 0 THEN 'page_number' END, CASE WHEN page_no % 6 = 0 THEN 'model' END, CASE WHEN NOT known THEN 'task' END, CASE WHEN known AND sha <> sha256('m') THEN 'model_changed' END,
 CASE WHEN gap THEN 'line_index' END, CASE WHEN nulls THEN 'text' END, CASE WHEN forms THEN 'forms' END], lambda x: x IS NOT NULL), ',') AS problems FROM s""")
def b_page_problems(spark: SparkSession, d: str) -> DataFrame:
    all_lines = lines(table(spark, d, "documents"))
    pages = all_lines.groupBy("task_id", "source_id", "page_no").agg(F.any_value("doc_id").alias("_d"))
    pages = pages.select("task_id", "source_id", "page_no", F.when(F.col("_d") % 17 == 0, -1).otherwise(F.col("page_no")).alias("stated_no"), F.lit("rec").alias("model_id"), F.expr(_SHA).alias("model_sha256"))
    kinds = [k for k in I.LINE_FORMS for k in (F.lit(k), F.col("raw_text"))]
    forms = F.when((F.col("doc_id") % 12 == 5) & (F.col("line_no") % 5 == 1), F.create_map(*kinds[:6])).otherwise(F.create_map(*kinds))
    place = F.when((F.col("doc_id") % 9 == 4) & (F.col("line_index") == 2), 7).otherwise(F.col("line_index"))
    lined = all_lines.select("source_id", "page_no", place.alias("line_index"), "raw_text", F.when((F.col("doc_id") % 10 == 3) & (F.col("line_no") % 9 == 8), None).otherwise(F.col("raw_text")).alias("resolved_text"), forms.alias("forms"))
    tasks = all_lines.where("task_id like '%a%'").select("task_id", F.lit("rec").alias("model_id"), F.upper(F.sha2(F.lit("m"), 256)).alias("model_sha256")).distinct()
    return I.page_problems(pages, lined, tasks).select("source_id", "page_no", F.array_join("problems", ",").alias("problems"))


@query("""WITH a AS (SELECT user_id AS doc_id, event_id % 3 AS page_no, arg_max(event_id, event_id) AS e FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2)
SELECT q.event_id, a.e IS NOT NULL AND coalesce(a.e % 4 = q.event_id % 4 AND a.e % 100 * 10 >= q.event_id % 1000, false) AS reuse FROM events q LEFT JOIN a ON a.doc_id = q.user_id AND a.page_no = q.event_id % 3 WHERE q.event_type = 'view'""")
def b_asset_reuse(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    at = [F.col("user_id").alias("doc_id"), (i % 3).alias("page_no"), (i % 4).alias("source_hash")]
    assets = e.where("event_id % 2 = 0").select(*at, (i % 100 * 10).alias("width"), F.lit(100).alias("height"), i.alias("updated"))
    return I.reusable_assets(assets, e.where("event_type = 'view'").select(*at, (i % 1000).alias("width"), F.lit(100).alias("height"), "event_id")).select("event_id", "reuse")


@query("""WITH n AS (SELECT page_id, row_number() OVER (PARTITION BY url ORDER BY page_id) AS k, url FROM pages)
SELECT page_id - 1 AS ordinal, CASE WHEN page_id % 5 <> 0 AND 1 = row_number() OVER (PARTITION BY page_id % 5 = 0, url[:18] ORDER BY page_id) THEN url[:18] ELSE 'source-' || CASE WHEN page_id < 1000 THEN lpad(page_id::VARCHAR, 3, '0') ELSE page_id::VARCHAR END || '/f' END AS relative_path FROM n""")
def c_unique_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    named = table(spark, d, "pages").select((p - 1).alias("ordinal"), F.when(p % 5 != 0, F.substring("url", 1, 18)).alias("path"), F.lit("f").alias("name"))
    return I.unique_paths(named).select("ordinal", "relative_path")


@query(f"""WITH {SQL_LINES}, g AS (SELECT *, {_FOLD % 'raw_text'} AS folded FROM lines),
h AS (SELECT doc_id, line_no, unnest({_STARTS.format(t='raw_text', q='éna')}) AS s, 3 AS n FROM g UNION SELECT doc_id, line_no, unnest({_STARTS.format(t='folded', q='ena')}), 3 FROM g WHERE length(folded) = length(raw_text)
UNION SELECT doc_id, line_no, unnest({_STARTS.format(t='raw_text', q='na')}), 2 FROM g UNION SELECT doc_id, line_no, unnest({_STARTS.format(t='folded', q='na')}), 2 FROM g WHERE length(folded) = length(raw_text))
SELECT doc_id, line_no, s::INT AS start, (s + n)::INT AS "end" FROM h""")
def i_scan_spans(spark: SparkSession, d: str) -> DataFrame:
    found = lines(table(spark, d, "documents")).select("doc_id", "line_no", F.explode(S.scan_spans(F.col("raw_text"), ["éna", "na"])).alias("h"))
    return found.select("doc_id", "line_no", "h.start", "h.end")


@query(f"""WITH {SQL_LINES}, m AS (SELECT *, doc_id % 4 AS a, doc_id % 4 + line_no % 4 AS b, len(string_split(raw_text, ' ')) AS n FROM boxed)
SELECT doc_id, line_no, CASE WHEN a < b AND b <= n THEN (a * 50)::DOUBLE ELSE x0 END AS x0, CASE WHEN a < b AND b <= n THEN y0 - (b - 1) ELSE y0 END AS y0, CASE WHEN a < b AND b <= n THEN (b * 50 - 10)::DOUBLE ELSE x1 END AS x1, y1 FROM m""")
def j_match_box(spark: SparkSession, d: str) -> DataFrame:
    boxed = with_boxes(lines(table(spark, d, "documents")))
    words = F.transform(F.split("raw_text", " "), lambda w, n: F.struct((n * 50).cast("double").alias("x0"), (F.col("y0") - n).alias("y0"), (n * 50 + 40).cast("double").alias("x1"), F.col("y1").alias("y1")))
    start = (F.col("doc_id") % 4).cast("int")
    box = G.match_box(words, F.struct("x0", "y0", "x1", "y1"), start, start + (F.col("line_no") % 4).cast("int"))
    return boxed.select("doc_id", "line_no", box.alias("b")).select("doc_id", "line_no", "b.x0", "b.y0", "b.x1", "b.y1")
