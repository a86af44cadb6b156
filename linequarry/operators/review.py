"""Review overlay, filters, summaries, paging and statistics over occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import context, like_ascii, match_starts
from ..sources.corpus import lines, with_boxes


#: Consecutive documents whose rows are counted together when numbers run over a whole task.
BLOCK = 4096


def numbered_in(rows: DataFrame, scope: str, name: str, within: str, group: str = "doc_id", counts: DataFrame | None = None) -> DataFrame:
    """Numbers from 1 over a scope in order of its groups, given a row's number within its group.

    No task sorts a scope's rows: groups are counted, counts are added up over blocks of groups and inside a block, and
    the sum goes back to the rows. rows: scope, group (whole number), within; counts: scope, group, _n where known.
    """
    counts = (rows.groupBy(scope, group).agg(F.count("*").alias("_n")) if counts is None else counts).withColumn("_block", F.floor(F.col(group) / BLOCK))
    past = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy(scope, "_block").agg(F.sum("_n").alias("_n")).select(scope, "_block", past(Window.partitionBy(scope).orderBy("_block")).alias("_before"))
    inside = counts.select(scope, group, "_block", past(Window.partitionBy(scope, "_block").orderBy(group)).alias("_inside"))
    offsets = inside.join(blocks, [scope, "_block"]).select(scope, group, (F.col("_before") + F.col("_inside")).alias("_offset"))
    return rows.join(offsets, [scope, group]).withColumn(name, F.col("_offset") + F.col(within)).drop("_offset")


def matches(docs: DataFrame, term: str, radius: int = 15) -> DataFrame:
    """Located matches of a literal term with context, without numbers: one pass over the text."""
    lined = with_boxes(lines(docs))
    hits = lined.withColumn("start", F.explode(match_starts(F.col("raw_text"), term))).withColumn("end", F.col("start") + len(term))
    return hits.withColumns(context(F.col("raw_text"), F.col("start"), F.col("end"), radius))


def occurrences(docs: DataFrame, term: str, radius: int = 15) -> DataFrame:
    """Matches numbered within page, document and task. No window spans a task's rows.

    What documents hold is counted on whole texts (a term without line feed matches in them as often as in their
    lines), so the lines, boxes and contexts are made once, for the rows themselves.
    """
    hits = matches(docs, term, radius).withColumns(
        {
            "page_occurrence_index": F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("line_no", "start")),
            "document_occurrence_index": F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "start")),
        }
    )
    held = F.size(match_starts(F.coalesce("text", F.lit("")), term)) if "\n" not in term else F.lit(0)
    counts = docs.select(F.col("source").alias("task_id"), "doc_id", held.alias("_n")).where("_n > 0").groupBy("task_id", "doc_id").agg(F.sum("_n").alias("_n"))
    return numbered_in(hits, "task_id", "global_sequence", "document_occurrence_index", counts=counts)


def overlay(found: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """Occurrences with their decision, null if unreviewed; a review without occurrence does not appear."""
    return found.join(reviewed, keys, "left")


def occurrence_filter(document: str | None = None, status: str | None = None, matched: str | None = None, search: str | None = None) -> Column:
    """Conjunction of the filters given; status `unreviewed` is a null decision."""
    out = F.lit(True)
    if document is not None:
        out = out & (F.col("source_id") == document)
    if status is not None:
        out = out & (F.col("decision").isNull() if status == "unreviewed" else F.col("decision") == status)
    if matched is not None:
        out = out & (F.col("matched") == matched)
    if search:
        out = out & like_ascii(F.concat("before", "matched", "after"), search)
    return out


def review_summary(found: DataFrame, by: list[str]) -> DataFrame:
    """Counts by decision."""
    n = lambda d: F.count_if(F.col("decision") == d).alias(d)
    return found.groupBy(*by).agg(F.count("*").alias("total"), n("confirmed"), n("needs_review"), n("rejected"), F.count_if(F.col("decision").isNull()).alias("unreviewed"))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page by offset; for deep pages use after()."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 200:
        raise ValueError("limit must be a whole number from 1 to 200")
    if isinstance(offset, bool) or not isinstance(offset, int) or offset < 0:
        raise ValueError("offset must be a whole number from 0")
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_of(rows: DataFrame, order: list, limit: int, offset: int = 0) -> tuple[DataFrame, dict]:
    """One page and what a caller needs for the next: total rows, and whether more follow."""
    total = rows.count()
    return page(rows, order, limit, offset), {"total": total, "limit": limit, "offset": offset, "has_more": offset + limit < total}


#: Rank of a status in reports.
STATUS_RANK = {"unreviewed": 0, "needs_review": 1, "rejected": 2, "confirmed": 3}


def number_aware(text: Column) -> Column:
    """A key that orders names without letter case and numbers in them by value."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 18, "0")).otherwise(p)), "")


def report_orders() -> dict[str, list[Column]]:
    """The orders of a report by name. rows: source_order, page_no, global_sequence, file_name, confidence, status."""
    source = [F.col("source_order"), F.col("page_no"), F.col("global_sequence")]
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in STATUS_RANK.items() for x in p]), F.coalesce("status", F.lit("unreviewed"))), F.lit(0))
    name = number_aware(F.col("file_name"))
    return {
        "sequence": [F.col("global_sequence"), *source], "source": source, "fileAsc": [name, *source], "fileDesc": [name.desc(), *source],
        "pageAsc": [F.col("page_no"), *source], "pageDesc": [F.col("page_no").desc(), *source], "confidence": [F.col("confidence"), *source], "status": [rank, *source],
    }


#: File types of a report, methods by which an occurrence was located.
FILE_TYPES, IMAGE_TYPES = ("PDF", "DJVU", "DJV", "TIFF", "JPEG", "PNG"), ("TIFF", "JPEG", "PNG")
TEXT_LAYERS, OCR_METHODS = ("pdf_text_layer", "djvu_text_layer"), ("pdf_ocr", "djvu_ocr", "image_ocr")


def report_counters(docs: DataFrame, pages: DataFrame, found: DataFrame, failures: DataFrame, simplified: str, traditional: str) -> DataFrame:
    """One row of the report's counters. docs: file_type, page_count; found: file_path, page_number, matched, status, method.

    Files with only one of the two variants, or with both and no other, are counted by what their occurrences hold.
    """
    n = lambda c, a: F.count_if(c).alias(a)
    kind, m, status, method = F.col("file_type"), F.col("matched"), F.col("status"), F.col("method")
    of_docs = docs.agg(
        *[n(kind == k, f"{k.lower()}_file_count") for k in FILE_TYPES], n(kind.isin(*IMAGE_TYPES), "image_file_count"), F.count("*").alias("success_file_count"), F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("document_total_pages")
    )
    of_found = found.agg(
        F.count_distinct("file_path").alias("hit_file_count"), F.count_distinct("file_path", "page_number").alias("hit_page_count"), n(m == simplified, "simplified_total"), n(m == traditional, "traditional_total"), F.count("*").alias("combined_total"),
        *[n((m == v) & (status == s), f"{k}_{s}") for k, v in (("simplified", simplified), ("traditional", traditional)) for s in ("confirmed", "needs_review")],
        n(status == "rejected", "rejected_total"), n(method.isin(*TEXT_LAYERS), "text_layer_hits"), n(method.isin(*OCR_METHODS), "ocr_hits"), *[n(method == k, f"{k}_hits") for k in OCR_METHODS],
    )
    held = found.groupBy("file_path").agg(F.bool_or(m == simplified).alias("s"), F.bool_or(m == traditional).alias("t"), F.bool_or(~m.isin(simplified, traditional)).alias("o"))
    of_files = held.agg(n(F.col("s") & ~F.col("t") & ~F.col("o"), "only_simplified_files"), n(~F.col("s") & F.col("t") & ~F.col("o"), "only_traditional_files"), n(F.col("s") & F.col("t") & ~F.col("o"), "both_variant_files"))
    out = of_docs.withColumn("_k", F.lit(0))
    for part in (of_found, of_files, failures.agg(F.count("*").alias("failure_file_count")), pages.agg(F.count("*").alias("embedded_page_count"))):
        out = out.join(part.withColumn("_k", F.lit(0)), "_k")  # one row each
    return out.drop("_k")


def after(rows: DataFrame, key: str, last: int, limit: int) -> DataFrame:
    """The page after a key; the filter reaches the scan, so depth costs nothing."""
    return rows.where(F.col(key) > last).orderBy(key).limit(limit)


def matching_tasks(tasks: DataFrame, sources: DataFrame, status: str | None, query: str) -> DataFrame:
    """Tasks of a status whose own text or one of whose sources holds the query (existence join under OR)."""
    named = sources.where(F.instr("display_path", query) > 0).select("task_id").distinct().withColumn("_hit", F.lit(True))
    found = tasks.join(named, "task_id", "left").where((F.instr("name", query) > 0) | F.col("_hit").isNotNull()).drop("_hit")
    return found if status is None else found.where(F.col("status") == status)


def violations(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """id and broken rules of every row that breaks one. rows: id, page_id, text, terms (array), code_points as stored, x0..y1 in shares of the page.

    A text's family is its simplified form; one of the terms must share it. Stored code points that are null are not compared.
    """
    from ..functions.text import code_points_of_lines
    from ..functions.variants import convert_column

    known = pages.select("page_id", F.lit(True).alias("_known")).distinct()
    code = lambda cond, name: F.when(cond, F.lit(name))
    inside = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    family = convert_column(F.col("text"))
    # what looks at a row alone comes first, so that no text is shuffled
    alone = F.array_compact(
        F.array(
            code(F.col("code_points") != code_points_of_lines(F.col("text")), "code_points"),
            code(inside("x0") | inside("y0") | inside("x1") | inside("y1"), "box_outside"),
            code((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), "box_empty"),
        )
    )
    own = rows.select("id", "page_id", alone.alias("_alone"), F.exists("terms", lambda t: (t == F.col("text")) | (convert_column(t) == family)).alias("_family"))
    twice = code(F.count("*").over(Window.partitionBy("id")) > 1, "duplicate_id")
    rest = F.array(code(F.col("_known").isNull(), "page_missing"), code(~F.col("_family"), "family"))
    rules = F.concat(F.array_compact(F.array(twice)), F.col("_alone"), F.array_compact(rest))
    return own.join(known, "page_id", "left").select("id", rules.alias("rules")).where(F.size("rules") > 0)


def report_stats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Per task: documents, characters, occurrences, documents and pages with hits, highest page."""
    whole = docs.groupBy(F.col("source").alias("task_id")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))
    hits = found.groupBy("task_id").agg(F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("documents_hit"), F.count_distinct("doc_id", "page_no").alias("pages_hit"), F.max("page_no").alias("last_page"), F.count_if(F.col("confidence") < 0.7).alias("unsure"))
    zero = ("occurrences", "documents_hit", "pages_hit", "unsure")
    return whole.join(hits, "task_id", "left").fillna(0, zero)


def merged_reports(parts: list[DataFrame]) -> DataFrame:
    """Worker reports put together: pages by maximum, counts by sum, times from first to last."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("path").agg(F.max("page_count").alias("page_count"), F.sum("found").alias("found"), F.sum("failed").alias("failed"), F.min("started").alias("started"), F.max("finished").alias("finished"))


def progress(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Totals and percentage, 0 where there is nothing to do."""
    share = F.when(F.col("total") > 0, F.round(100.0 * F.col("done") / F.col("total"), 2)).otherwise(F.lit(0.0))
    return tasks.groupBy(*by).agg(F.sum("total").alias("total"), F.sum("done").alias("done"), F.count_if("running").alias("running")).withColumn("pct", share)


def first_source(candidates: list[DataFrame], key: str) -> DataFrame:
    """For each key the source of the first list that has one; in a list the highest (page, created), then the least id."""
    every = None
    for n, c in enumerate(candidates):
        c = c.select(key, "source", "page", "created", F.lit(n).alias("prio"))
        every = c if every is None else every.unionAll(c)
    w = Window.partitionBy(key).orderBy("prio", F.desc("page"), F.desc("created"), "source")
    return every.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(key, "source", "prio")


def best_text(rows: DataFrame, by: str) -> DataFrame:
    """Per key the text that is most certain, the later one of equals; an empty text never is."""
    some = F.coalesce("text", F.lit("")) != ""
    return rows.groupBy(by).agg(F.max_by(F.col("text"), F.when(some, F.struct("conf", "idx"))).alias("best")).where("best <> ''")


def neighbours(rows: DataFrame, scope: list[str], order: str, text: str) -> DataFrame:
    """Each row with the text before and after it, and the next pending row's order."""
    w = Window.partitionBy(*scope).orderBy(order)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumns({"previous": F.lag(text).over(w), "next": F.lead(text).over(w), "next_pending": F.min(F.when(F.col("pending"), F.col(order))).over(ahead)})


def truth_differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys whose counts differ; a side that lacks the key has 0."""
    both = expected.join(actual, key, "full_outer").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.where("expected <> actual")
