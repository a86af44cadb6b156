"""Checks on what enters the corpus: files of a scan, lists of files, images, pages of lines, cached page assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sources import file_format, validated_files

#: Limits of images, of a list of files, of a path, and of the details kept for each problem.
MOST_PIXELS, MOST_EDGE, MOST_FRAMES = 200_000_000, 30_000, 5_000
MOST_FILES, LONG_PATH, MOST_DETAILS = 200, 240, 50
#: Forms that every stored line has.
LINE_FORMS = ("simplified", "traditional", "taiwan", "hong_kong")
#: What reads a file of each format.
BACKENDS = {"pdf": "pdf", "djvu": "djvu", "djv": "djvu", "tiff": "raster", "jpeg": "raster", "png": "raster"}


class ListRefused(ValueError):
    """A list of files with invalid entries, none that are valid, or too many."""


def checked_files(files: DataFrame) -> DataFrame:
    """Adds state: unsupported, duplicate (the same device and inode earlier in the order), signature, changed or ok.

    files: ordinal, path, size, mtime, device, inode, matches (its beginning fits its suffix), size_after, mtime_after.
    Files of unsupported formats do not count as the first of their inode; inode 0 is no identity. Null sizes or times
    after the check count as changed.
    """
    known = file_format(F.col("path")).isNotNull()
    told = F.coalesce(known & (F.col("inode") != 0), F.lit(False))
    # rows without an identity are spread by their ordinal, so that they do not meet in one window
    own = F.struct(F.when(told, F.col("device")).alias("d"), F.when(told, F.col("inode")).alias("i"), F.when(~told, F.col("ordinal")).alias("o"))
    earlier = F.row_number().over(Window.partitionBy(own).orderBy("ordinal")) > 1
    same = F.col("size").eqNullSafe(F.col("size_after")) & F.col("mtime").eqNullSafe(F.col("mtime_after"))
    state = F.when(~known, "unsupported").when(earlier, "duplicate").when(~F.coalesce("matches", F.lit(False)), "signature").when(~same, "changed").otherwise("ok")
    return files.withColumn("state", state).withColumn("long_path", F.length("path") >= LONG_PATH).select(*files.columns, "state", "long_path")


def problem_details(checked: DataFrame, n: int = MOST_DETAILS) -> DataFrame:
    """state, total and the first n paths in order of every state that is a problem; the totals count all of them."""
    bad = checked.where("state in ('signature', 'changed')")
    first = bad.withColumn("_k", F.row_number().over(Window.partitionBy("state").orderBy("ordinal"))).where(F.col("_k") <= n)
    listed = first.groupBy("state").agg(F.array_sort(F.collect_list(F.struct("ordinal", "path"))).alias("_some"))
    return bad.groupBy("state").agg(F.count("*").alias("total")).join(listed, "state").select("state", "total", F.transform("_some", lambda x: x["path"]).alias("paths"))


def list_outcome(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """One row: outcome (invalid before none before too_many, else ok), files taken, files refused, and a preview of the
    first five refused ones. files: ordinal, path."""
    every = validated_files(files)
    wrong = F.col("reason").isNotNull()
    said = F.struct("ordinal", F.concat_ws(": ", "path", "reason").alias("said"))
    marks = every.select((~wrong).alias("v"), wrong.alias("w"), F.lit(None).cast("struct<ordinal:bigint,said:string>").alias("five"))
    five = every.where(wrong).orderBy("ordinal").limit(5).select(F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), said.cast("struct<ordinal:bigint,said:string>"))
    sums = marks.unionAll(five).agg(F.count_if("v").alias("valid"), F.count_if("w").alias("invalid"), F.array_sort(F.collect_list("five")).alias("_s"))
    outcome = F.when(F.col("invalid") > 0, "invalid").when(F.col("valid") == 0, "none").when(F.col("valid") > most, "too_many").otherwise("ok")
    shown = F.concat(F.array_join(F.transform("_s", lambda x: x["said"]), "; "), F.when(F.col("invalid") > 5, "; ...").otherwise(""))
    return sums.select(outcome.alias("outcome"), "valid", "invalid", shown.alias("preview"))


def accepted_files(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """The files of a list in order, or ListRefused."""
    told = list_outcome(files, most).first()
    if told.outcome != "ok":
        raise ListRefused(f"{told.outcome}: {told.preview or told.valid}")
    return validated_files(files).drop("reason")


def backend(path: Column) -> Column:
    """What reads a file, by its suffix; null if nothing does."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in BACKENDS.items() for x in p]), file_format(path))


def image_problem(path: Column, actual: Column, frames: Column, width: Column, height: Column) -> Column:
    """The first rule an image breaks, null if none: actual is the format its bytes have, sizes are its largest frame's."""
    expected = file_format(path)
    return (
        F.when(expected.isNull() | ~expected.isin("tiff", "jpeg", "png"), "unsupported")
        .when(~F.coalesce(expected == actual, F.lit(False)), "format_mismatch")
        .when((expected != "tiff") & (frames != 1), "several_frames")
        .when(frames > MOST_FRAMES, "too_many_frames")
        .when((width <= 0) | (height <= 0), "empty")
        .when((width > MOST_EDGE) | (height > MOST_EDGE), "edge")
        .when(width.cast("long") * height.cast("long") > MOST_PIXELS, "pixels")
    )


def page_problems(pages: DataFrame, lined: DataFrame, tasks: DataFrame) -> DataFrame:
    """source_id, page_no, problems: why a page of lines can't be stored; an empty array if it can.

    pages: task_id, source_id, page_no, stated_no, model_id, model_sha256. lined: source_id, page_no, line_index,
    raw_text, resolved_text, forms (map). tasks: task_id, model_id, model_sha256, null until the first page is stored.
    """
    missing = F.exists(F.array(*map(F.lit, LINE_FORMS)), lambda k: F.try_element_at("forms", k).isNull())
    per = lined.groupBy("source_id", "page_no").agg(
        ((F.min("line_index") != 0) | (F.max("line_index") + 1 != F.count("*")) | (F.count_distinct("line_index") != F.count("*"))).alias("_gap"),
        F.bool_or(F.col("raw_text").isNull() | F.col("resolved_text").isNull()).alias("_text"),
        F.bool_or(F.col("forms").isNull() | missing).alias("_forms"),
    )
    locked = tasks.select("task_id", F.col("model_id").alias("_id"), F.lower("model_sha256").alias("_sha"), F.lit(True).alias("_task"))
    whole = pages.join(locked, "task_id", "left").join(per, ["source_id", "page_no"], "left")
    sha = F.lower(F.coalesce("model_sha256", F.lit("")))
    says = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    found = F.array(
        says(F.coalesce("stated_no", "page_no") != F.col("page_no"), "page_number"),
        says((F.coalesce("model_id", F.lit("")) == "") | ~sha.rlike("^[0-9a-f]{64}$"), "model"),
        says(F.col("_task").isNull(), "task"),
        says(F.col("_id").isNotNull() & (~F.col("_id").eqNullSafe(F.col("model_id")) | (F.coalesce("_sha", F.lit("")) != sha)), "model_changed"),
        says(F.col("_gap"), "line_index"),
        says(F.col("_text"), "text"),
        says(F.col("_forms"), "forms"),
    )
    return whole.select("source_id", "page_no", F.array_compact(found).alias("problems"))


def reusable_assets(assets: DataFrame, asked: DataFrame) -> DataFrame:
    """Every asked page with reuse: whether the asset stored for it is of the same source and at least as large.

    assets: doc_id, page_no, source_hash, width, height, updated; the last one updated counts. asked: doc_id, page_no,
    source_hash, width, height.
    """
    last = assets.groupBy("doc_id", "page_no").agg(F.max_by(F.struct("source_hash", "width", "height"), "updated").alias("_a"))
    fits = (F.col("_a.source_hash") == F.col("source_hash")) & (F.col("_a.width") >= F.col("width")) & (F.col("_a.height") >= F.col("height"))
    return asked.join(last, ["doc_id", "page_no"], "left").withColumn("reuse", F.coalesce(fits, F.lit(False))).drop("_a")


def local_usage(files: DataFrame, database: str) -> DataFrame:
    """bucket, task_id, bytes, files: where the files of a data folder belong, by the segments of their relative paths.

    task_id is set for what belongs to a task (derived and exports). database: name of the state file; files beside it
    whose names go on with a hyphen belong to it. files: path, bytes.
    """
    seg = F.split("path", "/")
    at = lambda n: F.coalesce(F.get(seg, n), F.lit(""))
    engine, state = at(0) == "engine", (at(1) == database) | F.startswith(at(1), F.lit(database + "-"))
    of_task = engine & (at(1) == "tasks") & (at(2) != "")
    bucket = (
        F.when(at(0) == "logs", "logs")
        .when((F.size(seg) == 1) & (at(0) == "settings.json"), "settings")
        .when(engine & (at(1) == ".export-jobs"), "temporary_exports")
        .when(engine & (at(1) == "backups"), "backups")
        .when(engine & (F.size(seg) == 2) & state, "database")
        .when(of_task & (at(3) == "exports"), "exports")
        .when(of_task, "derived")
        .otherwise("other")
    )
    named = files.select(bucket.alias("bucket"), at(2).alias("_t"), "bytes")
    return named.groupBy("bucket", F.when(F.col("bucket").isin("derived", "exports"), F.col("_t")).alias("task_id")).agg(F.sum("bytes").cast("long").alias("bytes"), F.count("*").alias("files"))


def synthetic_pages(spark: SparkSession, n: int, terms: list[str]) -> DataFrame:
    """A made-up source of n pages with one occurrence each: the terms take turns."""
    every = F.array(*map(F.lit, terms))
    page = F.col("page_no")
    term = F.get(every, ((page - 1) % len(terms)).cast("int"))
    made = spark.range(1, n + 1).select(F.col("id").alias("page_no")).withColumn("matched_text", term)
    return made.select("page_no", (page - 1).alias("page_index"), F.concat(F.lit("occ-"), page).alias("occurrence_id"), "matched_text", F.lit(0).alias("match_start"), F.length("matched_text").alias("match_end"), F.concat_ws("-", F.lit("page"), page, "matched_text").alias("context_full"))


def unique_paths(named: DataFrame) -> DataFrame:
    """Adds relative_path, different in every row: the own path for its first holder in order, else a folder of the source.

    named: ordinal (from 0, different in every row), path (null or empty: none), name. Ordinals differ, so do the
    folders; a holder whose own path already looks like such a folder gets its ordinal's folder too.
    """
    made = F.concat(F.lit("source-"), F.lpad((F.col("ordinal") + 1).cast("string"), 3, "0"), F.lit("/"), "name")
    made = F.when(F.col("ordinal") < 999, made).otherwise(F.concat(F.lit("source-"), (F.col("ordinal") + 1).cast("string"), F.lit("/"), "name"))
    own = F.when((F.coalesce("path", F.lit("")) != "") & ~F.col("path").rlike("^source-[0-9]{3,}/"), F.col("path"))
    first = F.row_number().over(Window.partitionBy(F.coalesce("_own", F.col("_made"))).orderBy("ordinal")) == 1
    return named.withColumns({"_own": own, "_made": made}).withColumn("relative_path", F.when(F.col("_own").isNotNull() & first, F.col("_own")).otherwise(F.col("_made"))).drop("_own", "_made")
