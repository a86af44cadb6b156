"""Queries over page layout and sequential merging (J, E17, E18, G14, G21, L13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import review as R
from ..sources.corpus import SQL_LINES, lines, table, with_boxes
from ..functions.text import code_points
from .registry import query


def _boxed(spark: SparkSession, d: str) -> DataFrame:
    return with_boxes(lines(table(spark, d, "documents")))


@query(f"WITH {SQL_LINES} SELECT doc_id, page_no, median(least(x1 - x0, y1 - y0)) AS median FROM boxed GROUP BY 1, 2")
def f_median_cross_size(spark: SparkSession, d: str) -> DataFrame:
    return L.median_cross_size(_boxed(spark, d))


@query(f"""WITH {SQL_LINES}, t AS (SELECT DISTINCT doc_id AS id, doc_id, page_no, (doc_id % 300)::DOUBLE AS px, (doc_id * 7 % 200)::DOUBLE AS py FROM lines),
b AS (SELECT t.id, t.page_no, line_no, line_index, power(greatest(0::DOUBLE, greatest(x0, px) - least(x1, px)), 2) + power(greatest(0::DOUBLE, greatest(y0, py) - least(y1, py)), 2) AS dist FROM t JOIN boxed b ON b.doc_id = t.doc_id AND b.page_no = t.page_no)
SELECT id, line_no, dist = 0 AS contains, dist FROM (SELECT *, row_number() OVER (PARTITION BY id, page_no ORDER BY dist, line_index) AS k FROM b) WHERE k = 1""")
def e_nearest_line(spark: SparkSession, d: str) -> DataFrame:
    boxed = _boxed(spark, d)
    targets = boxed.select(F.col("doc_id").alias("id"), "doc_id", "page_no", (F.col("doc_id") % 300).cast("double").alias("px"), (F.col("doc_id") * 7 % 200).cast("double").alias("py")).distinct()
    return L.nearest_line(boxed, targets)


@query(f"""WITH {SQL_LINES}, t AS (SELECT doc_id, max(line_no) // 2 AS target FROM lines GROUP BY 1), b AS (SELECT t.doc_id, target, line_no, row_number() OVER (PARTITION BY t.doc_id ORDER BY abs(line_no - target), line_no) AS place FROM t JOIN lines l ON l.doc_id = t.doc_id)
SELECT doc_id, target, line_no, place FROM b WHERE place <= 9""")
def g_nearest_k(spark: SparkSession, d: str) -> DataFrame:
    lined = lines(table(spark, d, "documents"))
    targets = lined.groupBy("doc_id").agg(F.max("line_no").alias("m")).select("doc_id", F.expr("cast(m div 2 as int)").alias("target"))
    return L.nearest_k(lined, targets, 9).select("doc_id", "target", "line_no", "place")


@query(f"""WITH {SQL_LINES} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, line_no) AS ltr, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, -x1, line_no) AS rtl,
row_number() OVER (PARTITION BY doc_id, page_no ORDER BY x0, y0, line_no) AS ttb, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY -x1, y0, line_no) AS btt FROM boxed""")
def g_spatial_order(spark: SparkSession, d: str) -> DataFrame:
    by = lambda *o: F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy(*o, "line_no"))
    return _boxed(spark, d).select("doc_id", "line_no", by("y0", "x0").alias("ltr"), by("y0", -F.col("x1")).alias("rtl"), by("x0", "y0").alias("ttb"), by(-F.col("x1"), "y0").alias("btt"))


@query(f"""WITH RECURSIVE {SQL_LINES}, o AS (SELECT *, 2 * count(*) FILTER (y1 - y0 >= x1 - x0) OVER (PARTITION BY doc_id, page_no) > count(*) OVER (PARTITION BY doc_id, page_no) AS v FROM boxed),
s AS (SELECT doc_id, page_no, line_no, CASE WHEN v THEN y0 ELSE x0 END AS c0, CASE WHEN v THEN y1 ELSE x1 END AS c1, CASE WHEN v THEN x0 ELSE y0 END AS a0, CASE WHEN v THEN x1 ELSE y1 END AS a1,
 median(CASE WHEN v THEN x1 - x0 ELSE y1 - y0 END) OVER (PARTITION BY doc_id, page_no) AS m FROM o),
e AS (SELECT p.doc_id, p.page_no, p.line_no AS a, q.line_no AS b FROM s p JOIN s q ON p.doc_id = q.doc_id AND p.page_no = q.page_no WHERE greatest(least(p.c1, q.c1) - greatest(p.c0, q.c0), 0) >= 0.28::DOUBLE * greatest(least(p.c1 - p.c0, q.c1 - q.c0), 1e-9::DOUBLE)
 AND greatest(greatest(p.a0, q.a0) - least(p.a1, q.a1), 0) <= 2.6::DOUBLE * greatest(p.m, 1)),
r AS (SELECT doc_id, page_no, line_no AS a, line_no AS b FROM s UNION SELECT r.doc_id, r.page_no, r.a, e.b FROM r JOIN e ON e.doc_id = r.doc_id AND e.page_no = r.page_no AND e.a = r.b)
SELECT doc_id, page_no, a AS line_no, min(b) AS block FROM r GROUP BY 1, 2, 3""")
def j_blocks_components(spark: SparkSession, d: str) -> DataFrame:
    return L.page_blocks(_boxed(spark, d))


@query()
def j_layout_context(spark: SparkSession, d: str) -> DataFrame:
    return L.layout_contexts(_boxed(spark, d), R.matches(table(spark, d, "documents"), "ring"))


SQL_CONTEXT = f"""WITH RECURSIVE {SQL_LINES}, o AS (SELECT *, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my, y1 - y0 >= x1 - x0 AS up FROM boxed),
t AS (SELECT o.*, i::INT AS start FROM o, range(0, 1000000) r(i) WHERE contains(raw_text, 'ring') AND i <= length(raw_text) - 4 AND substring(raw_text, i + 1, 4) = 'ring'),
s AS (SELECT doc_id, page_no, line_no, raw_text, up, mx, my, x0, y0, x1, y1, CASE WHEN up THEN y0 ELSE x0 END AS c0, CASE WHEN up THEN y1 ELSE x1 END AS c1, CASE WHEN up THEN x0 ELSE y0 END AS a0, CASE WHEN up THEN x1 ELSE y1 END AS a1,
  2.6::DOUBLE * greatest(median(CASE WHEN up THEN x1 - x0 ELSE y1 - y0 END) OVER (PARTITION BY doc_id, page_no, up), 1) AS far FROM o SEMI JOIN t USING (doc_id, page_no)),
e AS (SELECT p.doc_id, p.page_no, p.up, p.line_no AS a, q.line_no AS b FROM s p JOIN s q ON p.doc_id = q.doc_id AND p.page_no = q.page_no AND p.up = q.up
  WHERE greatest(least(p.c1, q.c1) - greatest(p.c0, q.c0), 0) >= 0.28::DOUBLE * greatest(least(p.c1 - p.c0, q.c1 - q.c0), 1e-9::DOUBLE) AND greatest(greatest(p.a0, q.a0) - least(p.a1, q.a1), 0) <= p.far),
r AS (SELECT doc_id, page_no, up, line_no AS a, line_no AS b FROM s UNION SELECT r.doc_id, r.page_no, r.up, r.a, e.b FROM r JOIN e ON e.doc_id = r.doc_id AND e.page_no = r.page_no AND e.up = r.up AND e.a = r.b),
m AS (SELECT doc_id, page_no, up, a AS line_no, min(b) AS block FROM r GROUP BY 1, 2, 3, 4),
w AS (SELECT s.*, block, lag(raw_text) OVER z AS previous, lead(raw_text) OVER z AS next, count(*) OVER (PARTITION BY s.doc_id, s.page_no, s.up, block) AS own FROM s JOIN m USING (doc_id, page_no, up, line_no)
  WINDOW z AS (PARTITION BY s.doc_id, s.page_no, s.up, block ORDER BY CASE WHEN s.up THEN -mx ELSE my END, CASE WHEN s.up THEN my ELSE mx END, s.line_no)),
g AS (SELECT doc_id, page_no, up, block, count(*) AS n, (min(x0) + max(x1)) / 2 AS bx, (min(y0) + max(y1)) / 2 AS bye, row_number() OVER (PARTITION BY doc_id, page_no, up ORDER BY block) AS k FROM w GROUP BY 1, 2, 3, 4),
c AS (SELECT t.doc_id, t.line_no, t.start, count(*) AS n_blocks, string_agg('block-' || k || ':' || n, ',' ORDER BY g.block <> w.block, sqrt((bx - t.mx) * (bx - t.mx) + (bye - t.my) * (bye - t.my)), k) AS candidates
  FROM t JOIN w ON w.doc_id = t.doc_id AND w.line_no = t.line_no JOIN g ON g.doc_id = t.doc_id AND g.page_no = t.page_no AND g.up = t.up GROUP BY 1, 2, 3),
f AS (SELECT t.doc_id, t.page_no, t.line_no, t.start, t.up, block, own, previous, next, t.raw_text,
  least(1, 0.45::DOUBLE + (CASE WHEN t.up THEN (t.y1 - t.y0) / greatest(t.x1 - t.x0, 1) ELSE (t.x1 - t.x0) / greatest(t.y1 - t.y0, 1) END - 1) / 3) AS sure FROM t JOIN w ON w.doc_id = t.doc_id AND w.line_no = t.line_no),
h AS (SELECT *, CASE WHEN sure < 0.65::DOUBLE THEN 'orientation_uncertain' WHEN own = 1 THEN 'block_uncertain' END AS reason FROM f)
SELECT doc_id, page_no, line_no, start, reason, CASE WHEN up THEN 'vertical' ELSE 'horizontal' END AS orientation, block, CASE WHEN reason IS NULL THEN previous END AS previous, CASE WHEN reason IS NULL THEN next END AS next,
  concat_ws(chr(10), CASE WHEN reason IS NULL THEN previous END, raw_text, CASE WHEN reason IS NULL THEN next END) AS plain_text, n_blocks, candidates FROM h JOIN c USING (doc_id, line_no, start)"""


@query(SQL_CONTEXT)
def j_context_lines(spark: SparkSession, d: str) -> DataFrame:
    """The contexts of j_layout_context without their boxes: lines around each match, its block, the page's blocks in rank order."""
    found = L.layout_contexts(_boxed(spark, d), R.matches(table(spark, d, "documents"), "ring"))
    ranked = F.array_join(F.transform("candidate_blocks", lambda b: F.concat(b["id"], F.lit(":"), b["line_count"].cast("string"))), ",")
    return found.select("doc_id", "page_no", "line_no", "start", "reason", "orientation", "block", "previous", "next", "plain_text", F.col("n_blocks").cast("long").alias("n_blocks"), ranked.alias("candidates"))


@query()
def l_occurrence_merge(spark: SparkSession, d: str) -> DataFrame:
    """Matches found in the text layer and again, a little beside, by recognition: merged where page, range, code points and context agree."""
    hits = R.matches(table(spark, d, "documents"), "ing")
    left, wide = F.col("x0") + 8 * F.col("start"), F.lit(24.0)
    keys = ["doc_id", "page_no", "start", "end", "codepoints", "before", "after"]
    both = []
    for n, (source, aside) in enumerate((("pdf_ocr", F.lit(0.0)), ("pdf_text_layer", (F.col("line_no") % 13).cast("double")))):
        both.append(F.struct((F.col("line_no").cast("long") * 2 + n).alias("ordinal"), F.lit(source).alias("source"), (left + aside).alias("x0"), (left + aside + wide).alias("x1")))
    hits = hits.withColumn("codepoints", code_points(F.col("matched"))).select(*keys, "y0", "y1", F.explode(F.array(*both)).alias("f"))
    return L.greedy_merge(hits.select(*keys, "f.ordinal", "f.source", "f.x0", "y0", "f.x1", "y1"), keys)


@query()
def l_greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    hits = R.matches(table(spark, d, "documents").where("source IS NOT NULL"), "ing")
    spot = F.pmod(F.col("start"), F.lit(3))
    rows = hits.select("doc_id", "page_no", F.col("matched").alias("text"), F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("line_no", "start")).cast("long").alias("ordinal"), F.when(spot == 0, "pdf_text_layer").otherwise("pdf_ocr").alias("source"), (F.col("x0") + 2 * F.col("start")).alias("x0"), "y0", (F.col("x0") + 2 * F.col("start") + 6).alias("x1"), "y1")
    return L.greedy_merge(rows, ["doc_id", "page_no", "text"])
