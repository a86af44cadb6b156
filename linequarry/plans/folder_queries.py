"""Queries over folders, image headers and snapshots of tables (A01, A03, A11, L14). What is on disk is made from the tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folders as D
from ..operators.export import plain_path
from ..sources.corpus import table
from ..sources.files import scratch
from .registry import query


def _laid_out(files: DataFrame, folder: str) -> int:
    """Files (rel, content) put on disk by tasks; returns their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rel, raw in zip(b.column("rel").to_pylist(), b.column("content").to_pylist()):
                path = os.path.join(folder, rel)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(raw)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    os.makedirs(folder)
    return files.select("rel", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _folder(spark: SparkSession, name: str) -> str:
    return f"{plain_path(scratch(spark))}/{name}-{uuid.uuid4().hex}"


SQL_TREE = """WITH f AS (SELECT doc_id, source || '/' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Part' || doc_id % 2 || '/' END AS folder, CASE WHEN doc_id % 2 = 0 THEN 'F' ELSE 'f' END || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.djvu' WHEN 2 THEN '.png' ELSE '.txt' END AS name,
  strlen(coalesce(text, '')) + 8 AS size FROM documents WHERE source IS NOT NULL)"""


@query(f"""{SQL_TREE} SELECT folder || name AS path, size, row_number() OVER (ORDER BY lower(source_of), source_of, CASE WHEN part = '' THEN 0 ELSE 1 END, lower(part), part, lower(name), name) AS ordinal,
CASE doc_id % 4 WHEN 3 THEN 'unsupported' WHEN 1 THEN 'signature' ELSE 'ok' END AS state FROM (SELECT *, split_part(folder, '/', 1) AS source_of, split_part(folder, '/', 2) AS part FROM f)""")
def a_folder_walk(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a file, in folders by source; a folder of output is not entered. Files in walk order with their state."""
    doc = F.col("doc_id")
    name = F.concat(F.when(doc % 2 == 0, "F").otherwise("f"), doc.cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".djvu", ".png", ".txt")]), (doc % 4 + 1).cast("int")))
    rel = F.concat("source", F.lit("/"), F.when(doc % 3 == 0, "").otherwise(F.concat(F.lit("Part"), (doc % 2).cast("string"), F.lit("/"))), name)
    content = F.concat(F.when(doc % 4 == 0, F.lit(b"%PDF-1.7")).otherwise(F.lit(b"--------")), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    files = table(spark, d, "documents").where("source IS NOT NULL").select(rel.alias("rel"), content.alias("content"))
    folder = _folder(spark, "walk")
    _laid_out(files.unionAll(files.select(F.concat(F.lit("output/"), "rel").alias("rel"), "content")), folder)
    return D.walked(spark, folder, skip=(f"{folder}/output",)).select("path", "size", "ordinal", "state")


SQL_IMAGES = """WITH s AS (SELECT doc_id, n_chars % 40000 + 1 AS w, doc_id % 300 + 1 AS h FROM documents),
h AS (SELECT doc_id, doc_id % 7 AS k, w, h, CASE doc_id % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'tiff' WHEN 3 THEN 'tiff' WHEN 4 THEN 'png' WHEN 5 THEN 'jpeg' END AS actual FROM s)"""


@query(f"""{SQL_IMAGES} SELECT doc_id, actual, CASE k WHEN 2 THEN 2 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 6 THEN NULL ELSE 1 END AS frames, CASE WHEN k IN (3, 4, 6) THEN NULL ELSE w END AS width,
CASE WHEN k IN (3, 4, 6) THEN NULL WHEN k = 2 THEN h + 1 ELSE h END AS height, CASE k WHEN 3 THEN 'cycle' WHEN 4 THEN 'truncated' WHEN 6 THEN 'no_image' END AS flaw,
CASE WHEN k IN (3, 4) THEN 'damaged' WHEN k IN (5, 6) THEN 'format_mismatch' WHEN w > 30000 THEN 'edge' END AS problem FROM h""")
def a_image_headers(spark: SparkSession, d: str) -> DataFrame:
    """An image header per document, sized by it: sound ones, a looping and a cut one, bytes of another format, and text. Read back from files."""
    four, low = lambda c: F.lpad(F.hex(c), 8, "0"), r"(..)(..)(..)(..)"
    turned = lambda c: F.regexp_replace(four(c), low, "$4$3$2$1")
    two = lambda c: F.substring(four(c), 5, 4)
    w, h, k = F.col("n_chars") % 40000 + 1, F.col("doc_id") % 300 + 1, F.col("doc_id") % 7
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    head = text("49484452", four(w), four(h), "0802000000")
    png = text("89504E470D0A1A0A0000000D", head, four(F.crc32(F.unhex(head))), "0000000049454E44AE426082")
    jpeg = text("FFD8FFE000104A46494600010100000100010000FFC0001108", two(h), two(w), "03012200021101031101FFD9")
    frame = lambda wide, tall, after: text("02000001040001000000", turned(wide), "0101040001000000", turned(tall), after)
    tiff = text("49492A0008000000", frame(w, h, "26000000"), frame(w, h + 1, "00000000"))
    loop = text("49492A0008000000", frame(w, h, "08000000"))
    raw = F.element_at(F.array(png, jpeg, tiff, loop, F.substring(png, 1, 80), jpeg, F.lit("74657874")), (k + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".png", ".jpg", ".tif", ".tiff", ".png", ".png", ".jpeg")]), (k + 1).cast("int"))
    folder = _folder(spark, "images")
    _laid_out(table(spark, d, "documents").select(F.concat(F.lit("i"), (F.col("doc_id") % 50).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("rel"), F.unhex(raw).alias("content")), folder)
    return D.image_headers(D.contents(spark, folder)).select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("doc_id"), "actual", "frames", "width", "height", "flaw", "problem")


@query("""SELECT source, count(*) AS rows, sum(n_chars)::BIGINT AS characters, true AS refused, 1::BIGINT AS snapshots FROM documents WHERE source IS NOT NULL GROUP BY 1""")
def l_backup_restore(spark: SparkSession, d: str) -> DataFrame:
    """A table backed up, changed, backed up again and restored from the first snapshot; a damaged snapshot is refused, the older ones go."""
    base = _folder(spark, "backup")
    docs = table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", "source", "n_chars")
    docs.write.partitionBy("source").parquet(f"file://{base}/table")
    first = D.back_up(spark, f"{base}/table", f"{base}/vault")
    docs.write.mode("append").partitionBy("source").parquet(f"file://{base}/table")
    last = D.back_up(spark, f"{base}/table", f"{base}/vault")
    D.restore(spark, f"{base}/vault", first, f"{base}/again")
    D.retain(spark, f"{base}/vault", 1)
    sha = spark.read.parquet(f"file://{base}/vault/lists/{last}").agg(F.min("sha")).first()[0]
    with open(f"{base}/vault/objects/{sha[:2]}/{sha}", "ab") as f:
        f.write(b"damage")
    try:
        D.restore(spark, f"{base}/vault", last, f"{base}/never")
        refused = False
    except D.SnapshotDamaged:
        refused = not os.path.exists(f"{base}/never")
    again = spark.read.option("basePath", f"file://{base}/again").parquet(f"file://{base}/again")
    per = again.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("characters"))
    return per.select("source", "rows", "characters", F.lit(refused).alias("refused"), F.lit(len(D.snapshots(f"{base}/vault"))).cast("long").alias("snapshots"))
