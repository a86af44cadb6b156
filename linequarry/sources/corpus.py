"""The line corpus as DataFrames: tasks, sources, pages, lines with geometry, review decisions and events.

Rules are plain expressions over the input tables, so that every operator can be held against SQL. A line's place
comes from its position in the split text; building the corpus needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines on a page, page size in pixels.
PAGE_LINES, PAGE_WIDTH, PAGE_HEIGHT = 5, 1200.0, 1600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, task_id, source_id, lang, line_no, page_no, line_index, raw_text, confidence: the non-empty lines."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p: p != "")
    out = docs.select("doc_id", F.col("source").alias("task_id"), F.concat(F.lit("doc-"), "doc_id").alias("source_id"), "lang", F.posexplode(parts).alias("line_no", "raw_text"))
    return out.withColumns(
        {
            "page_no": F.expr("line_no div 5 + 1").cast("int"),
            "line_index": F.col("line_no") % PAGE_LINES,
            "confidence": (F.lit(60) + (F.col("doc_id") * 7 + F.col("line_no") * 13) % 41).cast("double") / 100.0,
        }
    )


def with_boxes(lined: DataFrame) -> DataFrame:
    """Adds x0, y0, x1, y1; every fifth document is set vertically (axes swapped)."""
    top, wide = 40.0 + 30.0 * F.col("line_index"), 40.0 + 8.0 * F.length("raw_text")
    upright = F.col("doc_id") % 5 == 0
    pick = lambda a, b: F.when(upright, b).otherwise(a).cast("double")
    return lined.withColumns({"x0": pick(F.lit(40.0), top), "y0": pick(top, F.lit(40.0)), "x1": pick(wide, top + 24.0), "y1": pick(top + 24.0, wide)})


def decision(quality: Column, toxic: Column) -> Column:
    """Review decision of a label; null is unreviewed."""
    return F.when(quality.isNull(), F.lit(None)).when(toxic == 1, "needs_review").when(quality == 1, "confirmed").otherwise("rejected")


def reviews(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", decision(F.col("quality"), F.col("toxic")).alias("decision"))


def task_events(events: DataFrame) -> DataFrame:
    """Events as task events: task_id, sequence, kind, ts, value."""
    from pyspark.sql import Window

    kinds = F.create_map(*[F.lit(x) for p in (("signup", "created"), ("view", "progress"), ("click", "progress"), ("purchase", "completed"), ("error", "failed")) for x in p])
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("user_id").alias("task_id"), place.alias("sequence"), "event_id", F.element_at(kinds, F.col("event_type")).alias("kind"), "event_type", "ts", "value")


#: The same rules in SQL, as common table expressions.
SQL_LINES = """
parts AS (SELECT doc_id, source, lang, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda p: p <> '')) AS raw_text,
  unnest(range(0, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda p: p <> '')))) AS line_no FROM documents),
lines AS (SELECT doc_id, source AS task_id, 'doc-' || doc_id AS source_id, lang, line_no, line_no // 5 + 1 AS page_no, line_no % 5 AS line_index, raw_text,
  (60 + (doc_id * 7 + line_no * 13) % 41)::DOUBLE / 100::DOUBLE AS confidence FROM parts),
boxed AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN top ELSE 40 END AS x0, CASE WHEN doc_id % 5 = 0 THEN 40 ELSE top END AS y0,
  CASE WHEN doc_id % 5 = 0 THEN top + 24 ELSE wide END AS x1, CASE WHEN doc_id % 5 = 0 THEN wide ELSE top + 24 END AS y1
  FROM (SELECT *, (40 + 30 * line_index)::DOUBLE AS top, (40 + 8 * length(raw_text))::DOUBLE AS wide FROM lines))"""
SQL_REVIEWS = "reviews AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'needs_review' WHEN quality = 1 THEN 'confirmed' ELSE 'rejected' END AS decision FROM labels)"
SQL_EVENTS = """task_events AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_id,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS kind, event_type, ts, value FROM events)"""
