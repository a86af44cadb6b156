"""A cleaning pipeline of five training-data operators, each stage written and read again before the next.

quality keeps what the classifier keeps; exact and near keep one document of each group of copies; secrets masks
every span found; packing cuts and packs what is left. All but the last return the columns of documents.

Decisions reach their rows by doc_id and text together, so a null or repeated doc_id neither loses a clean row nor
keeps a rejected one. Of rows that repeat doc_id and text one stays, of copies without any doc_id too; rows without
doc_id are near copies of nothing. run() removes the tables of a stage once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linequarry.llm.common import removed, saved, tables
from linequarry.llm.exact import exact_dedup, text_digest
from linequarry.llm.jaccard import jaccard_groups
from linequarry.llm.packing import pack_documents
from linequarry.llm.quality import keep_good
from linequarry.llm.secrets import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def _staying(docs: DataFrame, decided: DataFrame, mark: str, of_text) -> DataFrame:
    """One row of docs for each doc_id (nulls alike) and mark of the text that are among those decided.

    Rows that repeat both fold within their tasks first, so none of them, however many, fills a task; the join then
    finds its rows where the folding has put them.
    """
    key = lambda doc_id, of: {"_id": F.coalesce(doc_id.cast("long"), F.lit(0)), "_none": doc_id.isNull(), "_mark": of}
    some = decided.select(*[c.alias(n) for n, c in key(F.col("doc_id"), F.col(mark)).items()]).distinct()
    names = ["_id", "_none", "_mark"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("_row"), *[c.alias(n) for n, c in key(docs["doc_id"], of_text(F.coalesce(docs["text"], F.lit("")))).items()])
    return keyed.groupBy(*names).agg(F.first("_row").alias("_row")).join(some, names, "left_semi").select("_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _staying(docs, exact_dedup(docs).where("kept"), "text_sha256", text_digest)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _staying(docs, jaccard_groups(docs).where("stays"), "text_hash", F.xxhash64)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    masked = mask_secrets(docs, carry=F.struct(*[F.col(f"`{c}`") for c in others]))
    back = {"text": F.col("text"), "doc_id": F.col("doc_id"), "n_chars": F.length("text").cast("long")}
    return masked.select(*[(back[c] if c in back else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]

#: SQL cannot express the classifier or the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        there = tables()
        result = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        used = [t for t in tables() if t not in there and t != result._linequarry_path]  # nothing reads them from here on
        removed(spark, used + ([docs._linequarry_path] if hasattr(docs, "_linequarry_path") else []))
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)
