"""The engine under the names its callers know: tasks, results, search, review, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize_query
from .functions.variants import LATIN, VariantTable
from .operators import export, layout, review, search, store
from .sources import corpus
from .streaming import events


class Engine:
    """A corpus of documents with its reviews and events, and what can be asked of them."""

    def __init__(self, spark: SparkSession, documents: DataFrame, reviews: DataFrame | None = None, task_events: DataFrame | None = None, table: VariantTable = LATIN):
        self.spark, self.documents, self.table = spark, documents, table
        self.reviews = spark.createDataFrame([], "doc_id long, decision string") if reviews is None else reviews
        self.events = task_events
        self.ledger = spark.createDataFrame([], "operation_id string, request_hash string, created_at timestamp")

    def lines(self) -> DataFrame:
        return corpus.with_boxes(corpus.lines(self.documents))

    def tasks_list(self, query: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
        tasks = self.documents.groupBy(F.col("source").alias("task_id")).agg(F.count("*").alias("documents"), F.max("doc_id").alias("newest"))
        found = tasks.where(F.instr("task_id", query) > 0) if query else tasks
        return review.page(found, [F.desc("newest"), "task_id"], limit, offset)

    def tasks_inspect(self) -> DataFrame:
        if self.events is None:
            raise ValueError("no events")
        return events.fold(self.events)

    def corpus_status(self) -> DataFrame:
        return self.lines().groupBy("task_id").agg(F.count("*").alias("lines"), F.count_distinct("doc_id", "page_no").alias("pages"))

    def search_execute(self, query: str, scope: str = "both") -> DataFrame:
        """Best hits of a literal query in all layers."""
        from .functions.variants import classify_column, in_scope

        lined = self.lines().withColumn("resolved_text", F.col("raw_text"))
        hits = search.layered_search(lined, normalize_query(query), self.table)
        return hits.where(in_scope(classify_column(F.col("raw_text"), self.table), scope))

    def search_hits(self, query: str, limit: int = 100, offset: int = 0) -> DataFrame:
        return review.page(self.search_execute(query), ["priority", "source_id", "page_no", "line_index", F.asc_nulls_first("start"), "index_start"], limit, offset)

    def occurrences(self, term: str) -> DataFrame:
        return review.overlay(review.occurrences(self.documents, normalize_query(term)), self.reviews, ["doc_id"])

    def results_query(self, term: str, limit: int = 100, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
        """(one page in sequence order, summary of the whole filtered set)."""
        found = self.occurrences(term).where(review.occurrence_filter(**filters))
        return review.page(found, ["task_id", "global_sequence"], limit, offset), review.review_summary(found, ["task_id"])

    def review_layout_context(self, term: str) -> DataFrame:
        return layout.layout_contexts(self.lines(), self.occurrences(term))

    def review_update_decisions(self, changes: DataFrame, operation_id: str) -> DataFrame:
        """Apply a batch (doc_id, decision), all or nothing; repeating an operation changes nothing."""
        self.reviews, self.ledger = store.apply_decisions(self.reviews, changes, self.documents.select("doc_id"), self.ledger, "doc_id", operation_id)
        return self.reviews

    def export_json(self, term: str, path: str) -> int:
        return export.write_json({"term": term}, self.occurrences(term).select("task_id", "doc_id", "page_no", "start", "end", "before", "matched", "after", "global_sequence", "decision"), path)

    def export_html(self, term: str, path: str) -> int:
        hits = self.occurrences(term).select("doc_id", "page_no", "before", "matched", "after", "global_sequence", F.concat_ws("/", "doc_id", "page_no").alias("page_id"))
        pages = hits.select("page_id", "doc_id", "page_no").distinct()
        return export.write_html(term, hits.drop("doc_id", "page_no"), pages, path)
