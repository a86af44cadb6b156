"""Queries over matching, variants and layered search (I operators and their joins and counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions import variants as V
from ..operators import review as R
from ..operators import search as S
from ..sources.corpus import SQL_LINES, lines, table, with_boxes
from .registry import query

TERM = "éna"
_FOLD = f"replace(translate(%s, '{V.ACCENTED}', '{V.FOLDED}'), 'ß', 'ss')"
_STARTS = "list_filter(range(0, greatest(length({t}) - length('{q}') + 1, 0)), lambda i: substring({t}, i + 1, length('{q}')) = '{q}')"
#: Best hits of the layers raw, resolved (every seventh line resolves i to e) and folded.
SQL_BEST = f"""WITH {SQL_LINES}, r AS (SELECT *, CASE WHEN line_no % 7 = 0 THEN replace(raw_text, 'è', 'é') ELSE raw_text END AS resolved_text FROM lines),
f AS (SELECT *, {_FOLD % 'resolved_text'} AS folded_text FROM r),
h AS (SELECT doc_id, lang, line_no, 1 AS priority, 'raw_exact' AS layer, length(raw_text) = length(raw_text) AS same, unnest({_STARTS.format(t='raw_text', q=TERM)}) AS s FROM f
UNION ALL SELECT doc_id, lang, line_no, 2, 'context_resolved', length(raw_text) = length(resolved_text), unnest({_STARTS.format(t='resolved_text', q=TERM)}) FROM f
UNION ALL SELECT doc_id, lang, line_no, 3, 'variant_graph', length(raw_text) = length(folded_text), unnest({_STARTS.format(t='folded_text', q='ena')}) FROM f),
best AS (SELECT doc_id, lang, line_no, layer, CASE WHEN same THEN s END AS start, s AS index_start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, same, s ORDER BY priority) AS k FROM h) WHERE k = 1)"""


def _best(spark: SparkSession, d: str) -> DataFrame:
    lined = lines(table(spark, d, "documents")).select("doc_id", "lang", "line_no", "raw_text")
    resolved = F.when(F.col("line_no") % 7 == 0, F.replace("raw_text", F.lit("è"), F.lit("é"))).otherwise(F.col("raw_text"))
    return S.layered_search(lined.withColumn("resolved_text", resolved), TERM)


@query(f"{SQL_BEST} SELECT doc_id, line_no, layer, coalesce(start, -1) AS start, index_start FROM best")
def g_best_layer(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("doc_id", "line_no", "layer", F.coalesce("start", F.lit(-1)).alias("start"), "index_start")


@query(f"{SQL_BEST} SELECT layer, lang, count(*) AS n, GROUPING(layer, lang)::INT AS gid FROM best GROUP BY GROUPING SETS ((layer), (lang), ())")
def f_hit_counts_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return S.hit_counts(_best(spark, d))


@query(f"WITH {SQL_LINES} SELECT doc_id, line_no FROM lines WHERE contains(raw_text, '{TERM}') OR contains({_FOLD % 'raw_text'}, 'ena')")
def d_candidate_lines(spark: SparkSession, d: str) -> DataFrame:
    lined = lines(table(spark, d, "documents")).withColumn("folded", V.convert_column(F.col("raw_text")))
    return S.candidate_lines(lined, {"raw": TERM, "simplified": "ena"}, {"raw": "raw_text", "simplified": "folded"}).select("doc_id", "line_no")


@query(f"WITH {SQL_LINES} SELECT doc_id, line_no, unnest({_STARTS.format(t='raw_text', q='ana')}) AS start FROM lines")
def i_overlapping_matches(spark: SparkSession, d: str) -> DataFrame:
    return lines(table(spark, d, "documents")).select("doc_id", "line_no", F.explode(X.match_starts(F.col("raw_text"), "ana")).alias("start"))


@query(f"WITH {SQL_LINES} SELECT doc_id, line_no, array_to_string(list_transform(string_split(raw_text, ''), lambda c: printf('U+%04X', unicode(c))), ' ') AS cps FROM lines")
def i_codepoint_sequence(spark: SparkSession, d: str) -> DataFrame:
    return lines(table(spark, d, "documents")).select("doc_id", "line_no", X.code_points_of_lines(F.col("raw_text")).alias("cps"))


@query(f"""WITH {SQL_LINES}, f AS (SELECT doc_id, line_no, raw_text, {_FOLD % 'raw_text'} AS folded FROM lines) SELECT doc_id, line_no, folded, folded <> raw_text AS has_variant, length(folded) = length(raw_text) AS mappable FROM f""")
def i_script_forms(spark: SparkSession, d: str) -> DataFrame:
    folded = lines(table(spark, d, "documents")).withColumn("folded", V.convert_column(F.col("raw_text")))
    return folded.select("doc_id", "line_no", "folded", (F.col("folded") != F.col("raw_text")).alias("has_variant"), (F.length("folded") == F.length("raw_text")).alias("mappable"))


_PLAIN = "".join(sorted({c for c in V.FOLDED}))


@query(f"""WITH {SQL_LINES}, c AS (SELECT doc_id, line_no, regexp_matches(raw_text, '[{V.ACCENTED}ß]') AS t, regexp_matches(raw_text, '[{_PLAIN}]') AS s FROM lines),
k AS (SELECT doc_id, line_no, CASE WHEN t AND s THEN 'mixed' WHEN t THEN 'traditional' WHEN s THEN 'simplified' ELSE 'neutral' END AS script FROM c) SELECT doc_id, line_no, script, script = 'neutral' OR script = 'simplified' AS in_scope FROM k""")
def i_classify_script(spark: SparkSession, d: str) -> DataFrame:
    out = lines(table(spark, d, "documents")).select("doc_id", "line_no", V.classify_column(F.col("raw_text"), V.LATIN).alias("script"))
    return out.withColumn("in_scope", V.in_scope(F.col("script"), "simplified"))


@query(f"""WITH v AS (SELECT unnest(string_split('{V.ACCENTED}', '')) AS variant, unnest(string_split('{V.FOLDED}', '')) AS simple UNION ALL SELECT 'ß', 'ss') SELECT simple, string_agg(variant, '' ORDER BY variant) AS variants, count(*) AS n FROM v GROUP BY 1""")
def i_variant_graph(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(simple, "".join(some), len(some)) for simple, some in V.LATIN.graph().items()], "simple string, variants string, n long")


@query("""WITH e AS (SELECT vec_id AS id, unnest(embedding) AS score, generate_subscripts(embedding, 1) - 1 AS class FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class) AS rank FROM e)
SELECT id, rank, class, 'candidate_pending_review' AS verification FROM r WHERE rank BETWEEN 2 AND 5 AND class IN (3, 17, 40)""")
def i_topk_hits(spark: SparkSession, d: str) -> DataFrame:
    return S.top_k_hits(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("class", "score")), [3, 17, 40])


@query(f"""WITH {SQL_LINES}, h AS (SELECT doc_id, line_no, raw_text, unnest({_STARTS.format(t='raw_text', q='tion')}) AS s FROM lines)
SELECT doc_id, line_no, s AS start, substring(raw_text, greatest(s - 15, 0) + 1, s - greatest(s - 15, 0)) AS before, substring(raw_text, s + 1, 4) AS matched, substring(raw_text, s + 5, 15) AS after FROM h""")
def i_context_window(spark: SparkSession, d: str) -> DataFrame:
    hits = lines(table(spark, d, "documents")).withColumn("start", F.explode(X.match_starts(F.col("raw_text"), "tion")))
    return hits.select("doc_id", "line_no", "start", *[c.alias(n) for n, c in X.context(F.col("raw_text"), F.col("start"), F.col("start") + 4).items()])


@query(f"""WITH {SQL_LINES}, x AS (SELECT doc_id, line_no, confidence AS c, substring(raw_text, 1, 1) AS m, CASE line_no % 3 WHEN 0 THEN '' WHEN 1 THEN substring(raw_text, 1, 2) ELSE 'zz' END AS s FROM lines), y AS (SELECT *, s <> '' AND contains(s, m) AS a FROM x)
SELECT doc_id, line_no, CASE WHEN a AND c >= 0.7::DOUBLE THEN 'confirmed' WHEN s <> '' AND NOT a AND c < 0.7::DOUBLE THEN 'rejected' WHEN s = '' AND c >= 0.9::DOUBLE THEN 'confirmed' ELSE 'needs_review' END AS status,
CASE WHEN a AND c >= 0.7::DOUBLE THEN 'second_reading_agrees' WHEN s <> '' AND NOT a AND c < 0.7::DOUBLE THEN 'second_reading_differs' WHEN s = '' AND c >= 0.9::DOUBLE THEN 'high_confidence' WHEN s <> '' AND NOT a THEN 'readings_conflict' ELSE 'low_confidence' END AS reason FROM y""")
def i_verification_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(table(spark, d, "documents")).select("doc_id", "line_no", "confidence", F.substring("raw_text", 1, 1).alias("m"), F.when(F.col("line_no") % 3 == 0, "").when(F.col("line_no") % 3 == 1, F.substring("raw_text", 1, 2)).otherwise("zz").alias("s"))
    v = X.verification(F.col("m"), F.col("confidence"), F.col("s"))
    return rows.select("doc_id", "line_no", v["status"].alias("status"), v["reason"].alias("reason"))


@query(f"""WITH {SQL_LINES}, z AS (SELECT doc_id, line_no, string_split(raw_text, '') AS cs, confidence AS p FROM lines)
SELECT doc_id, line_no, array_to_string(list_transform(cs, lambda c: CASE WHEN p <= 0.85::DOUBLE AND 0.97::DOUBLE - p >= 0.15::DOUBLE AND c <> translate(c, '{V.ACCENTED}', '{V.FOLDED}') THEN translate(c, '{V.ACCENTED}', '{V.FOLDED}') ELSE c END), '') AS text FROM z""")
def i_reconcile_glyphs(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw_text")
    # each character that may change is a piece of its own, what lies between stays together
    chars = F.filter(F.split(raw, f"(?<=[{V.ACCENTED}])|(?=[{V.ACCENTED}])"), lambda c: c != "")
    alone = F.transform(chars, lambda c: F.translate(c, V.ACCENTED, V.FOLDED))
    same = lambda v: F.transform(chars, lambda c: v)
    out = S.reconciled(chars, same(F.col("confidence")), alone, same(F.lit(0.97)), dict(zip(V.ACCENTED, V.FOLDED)))
    some = F.translate(raw, V.ACCENTED, V.FOLDED) != raw  # else no character can change, and the line need not be taken apart
    return lines(table(spark, d, "documents")).select("doc_id", "line_no", F.when(some, F.array_join(out, "")).otherwise(raw).alias("text"))


@query(f"""WITH {SQL_LINES}, k AS (SELECT doc_id, line_no, unnest([{{'k': 'raw', 't': raw_text}}, {{'k': 'simplified', 't': {_FOLD % 'raw_text'}}}, {{'k': 'upper', 't': upper(raw_text)}}]) AS x FROM lines)
SELECT doc_id, line_no, max(x.t) FILTER (x.k = 'raw') AS raw, max(x.t) FILTER (x.k = 'simplified') AS simplified, count(*) AS kinds FROM k GROUP BY 1, 2""")
def k_map_pivot(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda k, c: F.struct(F.lit(k).alias("kind"), c.alias("text"))
    long = lines(table(spark, d, "documents")).select("doc_id", "line_no", F.explode(F.array(pair("raw", F.col("raw_text")), pair("simplified", V.convert_column(F.col("raw_text"))), pair("upper", F.upper("raw_text")))).alias("x"))
    wide = long.groupBy("doc_id", "line_no").agg(F.map_from_entries(F.collect_list("x")).alias("m"))
    return wide.select("doc_id", "line_no", F.col("m")["raw"].alias("raw"), F.col("m")["simplified"].alias("simplified"), F.size("m").cast("long").alias("kinds"))


@query(f"""WITH {SQL_LINES}, s AS (SELECT doc_id, line_no, unnest({_STARTS.format(t='raw_text', q='an')}) AS s, 2 AS n FROM lines UNION ALL SELECT doc_id, line_no, unnest({_STARTS.format(t='raw_text', q='ana')}), 3 FROM lines UNION ALL SELECT doc_id, line_no, unnest({_STARTS.format(t='raw_text', q='an')}), 2 FROM lines)
SELECT doc_id, line_no, count(DISTINCT (s, n)) AS spans FROM s GROUP BY 1, 2""")
def h_span_union(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw_text")
    every = F.array_distinct(F.flatten(F.array(X.spans(raw, "an"), X.spans(raw, "ana"), X.spans(raw, "an"))))
    return lines(table(spark, d, "documents")).select("doc_id", "line_no", F.size(every).cast("long").alias("spans")).where("spans > 0")


@query(f"""WITH {SQL_LINES}, h AS (SELECT task_id, doc_id, page_no, line_no, raw_text, x0, y0, x1, y1, unnest({_STARTS.format(t='raw_text', q='ring')}) AS s FROM boxed),
n AS (SELECT DISTINCT task_id, doc_id, page_no, line_no, s, length(raw_text) AS n, x0, y0, x1, y1 FROM h)
SELECT task_id, doc_id, line_no, s AS start, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN doc_id % 5 <> 0 OR line_no % 2 = 0 THEN 0 ELSE 1 END, doc_id, line_no, s) AS global_sequence FROM n""")
def l_backfill_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Every match, where those of other than odd lines of every fifth document have their rows already."""
    from ..operators.store import append_numbered

    key, order = ["task_id", "doc_id", "line_no", "start"], ["doc_id", "line_no", "start"]
    found = R.occurrences(table(spark, d, "documents"), "ring").select(*key)
    old = append_numbered(None, found.where("doc_id % 5 <> 0 or line_no % 2 = 0"), key, order)
    return append_numbered(old, found, key, order)


@query(f"""WITH {SQL_LINES}, p AS (SELECT *, length(raw_text) AS n FROM boxed), m AS (SELECT *, n // 3 AS s, n // 3 + (n + 1) // 2 AS e FROM p WHERE n > 0)
SELECT doc_id, line_no, x0 / 1200 AS nx0, y1 / 1600 AS ny1, round(CASE WHEN y1 - y0 >= x1 - x0 THEN x0 ELSE x0 + (x1 - x0) * s / n END, 6) AS mx0, round(CASE WHEN y1 - y0 >= x1 - x0 THEN y0 + (y1 - y0) * e / n ELSE y1 END, 6) AS my1,
round(CASE WHEN least(x1 - x0, 200 - 100) > 0 THEN greatest(0::DOUBLE, least(x1, 200) - greatest(x0, 100)) / least(x1 - x0, 100) ELSE 0 END, 6) AS overlap, greatest(0::DOUBLE, greatest(x0, 400) - least(x1, 500)) AS gap, abs((x0 + x1) / 2 - 300) + abs((y0 + y1) / 2 - 150) AS centre FROM m""")
def j_bbox_ops(spark: SparkSession, d: str) -> DataFrame:
    b = with_boxes(lines(table(spark, d, "documents"))).withColumn("n", F.length("raw_text"))
    c = {k: F.col(k) for k in ("x0", "y0", "x1", "y1")}
    num = lambda v: F.lit(float(v))
    norm = G.normalised(*c.values(), num(1200), num(1600))
    part = G.part_of_box(F.col("n"), F.expr("n div 3"), F.expr("n div 3 + (n + 1) div 2"), *c.values())
    return b.select("doc_id", "line_no", norm["nx0"].alias("nx0"), norm["ny1"].alias("ny1"), F.round(part["mx0"], 6).alias("mx0"), F.round(part["my1"], 6).alias("my1"), F.round(G.overlap_ratio(c["x0"], c["x1"], num(100), num(200)), 6).alias("overlap"), G.gap(c["x0"], c["x1"], num(400), num(500)).alias("gap"), G.centre_distance(tuple(c.values()), (num(250), num(100), num(350), num(200))).alias("centre"))


@query(f"""WITH {SQL_LINES} SELECT doc_id, line_no, CASE WHEN y1 - y0 >= x1 - x0 THEN 'vertical' ELSE 'horizontal' END AS orientation, round(least(1::DOUBLE, 0.45::DOUBLE + (greatest(x1 - x0, y1 - y0) / greatest(least(x1 - x0, y1 - y0), 1e-6::DOUBLE) - 1) / 3), 6) AS confidence FROM boxed""")
def j_orientation(spark: SparkSession, d: str) -> DataFrame:
    kind, sure = G.orientation(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return with_boxes(lines(table(spark, d, "documents"))).select("doc_id", "line_no", kind.alias("orientation"), F.round(sure, 6).alias("confidence"))
