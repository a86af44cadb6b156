"""Sources and listings: manifests, validation, histograms, log tails, storage buckets."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name

#: Suffixes that are read, by format.
FORMATS = {"pdf": "pdf", "djvu": "djvu", "djv": "djv", "tif": "tiff", "tiff": "tiff", "jpg": "jpeg", "jpeg": "jpeg", "png": "png"}
FORMAT_KEYS = ("pdf", "djvu", "djv", "tiff", "jpeg", "png")
#: First bytes of the formats that have them.
SIGNATURES = {"pdf": b"%PDF-", "djvu": b"AT&TFORM", "djv": b"AT&TFORM"}


def suffix(path):
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_format(path):
    """Format of a path by its suffix, null if it is not read."""
    known = F.create_map(*[F.lit(x) for p in FORMATS.items() for x in p])
    return F.try_element_at(known, suffix(path))


def scan_folder(spark: SparkSession, folder: str, include: Iterable[str] | None = None, skip: Iterable[str] = ()) -> DataFrame:
    """Files of the known formats below a folder, any depth, but not below those in skip (workspace, output): path, length, modificationTime, content; in path order when collected sorted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = found.where(file_format(F.col("path")).isNotNull())
    for s in skip:
        found = found.where(~F.startswith(F.regexp_replace("path", "^file:/+", "/"), F.lit(re.sub("^file:/+", "/", str(s)).rstrip("/") + "/")))
    return found if include is None else found.join(spark.createDataFrame([(p,) for p in include], "path string"), "path", "left_semi")


def signature_matches(path, content):
    """Whether a file begins as its format demands; formats without a fixed beginning always do."""
    out = F.lit(True)
    for fmt, first in SIGNATURES.items():
        out = F.when(suffix(path) == fmt, F.substring(content, 1, len(first)) == F.lit(first)).otherwise(out)
    return out


def frozen_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """An explicit list in place of a scan; its order is kept."""
    return spark.createDataFrame(list(enumerate(paths)), "ordinal int, path string")


def page_ordinals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (task_id, page) by place in the task, and those already processed (all but every seventh document)."""
    placed = docs.select("doc_id", F.col("source").alias("task_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("page"))
    return placed.select("task_id", "page"), placed.where("doc_id % 7 <> 3").select("task_id", "page")


def remaining(pages: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is not done yet."""
    return pages.join(done, keys, "left_anti")


def page_range(pages: DataFrame) -> DataFrame:
    """One row per page index of (start, stop), none for an empty range."""
    return pages.where("stop > start").withColumn("page_index", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))


def manifest_token(files: DataFrame) -> DataFrame:
    """root, digest over its files in path order, n. files: root, rel, size, mtime."""
    row = F.concat_ws("\x1f", "rel", F.col("size").cast("string"), F.col("mtime").cast("string"))
    per = files.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("rel", "mtime", row.alias("row")))).alias("rows"), F.count("*").alias("n"))
    return per.select("root", F.sha2(F.concat_ws("\n", "root", F.array_join(F.transform("rows", lambda r: r["row"]), "\n")), 256).alias("token"), "n")


def format_histogram(files: DataFrame) -> DataFrame:
    """fmt, n for every known format, zero if it has no file."""
    counts = files.select(file_format(F.col("path")).alias("fmt")).where("fmt is not null").groupBy("fmt").agg(F.count("*").alias("k"))
    keys = files.sparkSession.createDataFrame([(k,) for k in FORMAT_KEYS], "fmt string")
    return keys.join(counts, "fmt", "left").select("fmt", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def required_bytes(size, pages):
    """Disk that a scan needs, cut to whole bytes."""
    return ((F.lit(268435456) + (size * 0.25).cast("long") + F.lit(8388608) * pages) * 1.25).cast("long")


def preflight_codes(per: DataFrame, limits: dict[str, int], free: int) -> DataFrame:
    """Adds required, warnings and blocking (arrays of codes). per: files, bytes, pages, unsupported."""
    code = lambda cond, name: F.when(cond, F.lit(name))
    c = F.col
    warn = F.array_compact(F.array(code(c("files") > limits["files"], "LARGE_FILE_COUNT"), code(c("pages") > limits["pages"], "LARGE_PAGE_COUNT"), code(c("bytes") > limits["bytes"], "LARGE_SOURCE_BYTES"), code(c("unsupported") > limits["unsupported"], "UNSUPPORTED_FILES")))
    block = F.array_compact(F.array(code(c("required") > free, "DISK_SPACE_LOW"), code(c("files") == 0, "NO_SUPPORTED_FILES")))
    return per.withColumn("required", required_bytes(c("bytes"), c("pages"))).withColumns({"warnings": warn, "blocking": block})


def display_names(files: DataFrame) -> DataFrame:
    """Adds name: base name, with the parent if it is not unique, the whole path if that isn't either."""
    base = base_name(F.col("path"))
    parent = F.regexp_extract("path", r"([^/\\]*)[/\\][^/\\]*$", 1)
    named = files.withColumns({"_b": base, "_p": parent})
    once = F.count("*").over(Window.partitionBy("_b")) == 1
    twice = F.count("*").over(Window.partitionBy("_b", "_p")) == 1
    return named.withColumn("name", F.when(once, F.col("_b")).when(twice, F.concat("_p", F.lit("/"), "_b")).otherwise(F.col("path"))).drop("_b", "_p")


def log_tail(logged: DataFrame, n: int) -> DataFrame:
    """The newest n lines of all files; a line without time has the last one before it in its file. logged: file, line, ts."""
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return logged.withColumn("ts", F.last("ts", ignorenulls=True).over(before)).orderBy(F.desc_nulls_last("ts"), F.desc("file"), F.desc("line")).limit(n)


def storage_buckets(files: DataFrame) -> DataFrame:
    """bucket, task_id, bytes, files by the segments of the path."""
    seg = F.split("path", "/")
    top = seg[0]
    bucket = F.when(top == "runtime", "derived").when(top == "exports", "exports").when(top == "db", "database").when(top == "logs", "logs").otherwise("other")
    task = F.when(top == "runtime", F.get(seg, 2)).when(top == "exports", F.get(seg, 1))
    return files.groupBy(bucket.alias("bucket"), task.alias("task_id")).agg(F.sum("bytes").cast("long").alias("bytes"), F.count("*").alias("files"))


def validated_files(files: DataFrame) -> DataFrame:
    """First of each path (case ignored) with the reason it can't be read, null if it can. files: ordinal, path."""
    low = files.select("ordinal", F.lower("path").alias("path"))
    first = low.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy("ordinal"))).where("_k = 1").drop("_k")
    return first.withColumn("reason", F.when(F.col("path") == "", "empty_path").when(file_format(F.col("path")).isNull(), "unsupported_format"))


def worker_reports(spark: SparkSession, workspace: str, names: list[str] | None = None) -> DataFrame:
    """The reports of all workers below a workspace, with the worker's name."""
    found = spark.read.option("multiLine", True).json(f"{workspace}/worker_*/run/report.json").withColumn("worker", F.regexp_extract("_metadata.file_path", r"(worker_[^/]+)/run/", 1))
    return found if names is None else found.where(F.col("worker").isin(names))
