"""Layered search over the line corpus: exact, resolved, variant forms and recogniser candidates, best layer per span.

All layers of a line live in one row, so expanding, mapping and choosing the best need no shuffle: hits are arrays
until the very end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import match_starts, spans
from ..functions.variants import LATIN, VariantTable, classify_column, convert_column, form_column, in_scope, like_kind

#: Layers and their priority (lower is stronger), verification of a hit by layer.
LAYERS = {"raw_exact": 1, "context_resolved": 2, "variant_graph": 3, "ocr_top_k": 4}
VERIFICATION = {"raw_exact": "source_exact", "context_resolved": "context_resolved", "variant_graph": "variant_related", "ocr_top_k": "candidate_pending_review"}
_HIT = "array<struct<priority:int,kind_order:int,layer:string,kind:string,start:int,end:int,istart:int,iend:int>>"


def layer_hits(raw: Column, indexed: Column, query: str, layer: str, kind: str, kind_order: int) -> Column:
    """Hits of one layer as an array; a span maps to the source only if the indexed text has the source's length."""
    same = F.length(raw) == F.length(indexed)
    found = F.transform(
        match_starts(indexed, query),
        lambda s: F.struct(
            F.lit(LAYERS[layer]).alias("priority"), F.lit(kind_order).alias("kind_order"), F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), F.when(same, s).alias("start"), F.when(same, s + len(query)).alias("end"), s.alias("istart"), (s + len(query)).alias("iend")
        ),
    )
    return found.cast(_HIT)


def best_hits(hits: Column) -> Column:
    """One hit per source span, the strongest layer and within it the first kind; hits without a source span are told
    apart by their index span. Sorting brings the hits of a span together, so the work stays near linear."""
    key = lambda h: F.struct(F.coalesce(h["start"], F.lit(-1)).alias("s"), F.coalesce(h["end"], F.lit(-1)).alias("e"), F.when(h["start"].isNull(), h["istart"]).otherwise(F.lit(-1)).alias("i"), F.when(h["start"].isNull(), h["iend"]).otherwise(F.lit(-1)).alias("j"))
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(key(h).alias("key"), h.alias("hit"))))  # span, then priority and kind
    first = lambda some: F.filter(some, lambda x, n: (n == 0) | (x["key"] != F.get(some, n - 1)["key"]))
    return F.transform(let(ordered, first), lambda x: x["hit"])


def candidate_filter(queries: dict[str, str], columns: dict[str, str]) -> Column:
    """Whether a line can hold a hit in some layer: a superset that spares the rest the matching."""
    some = F.lit(False)
    for kind, column in columns.items():
        if queries.get(kind):
            some = some | F.contains(F.col(column), F.lit(queries[kind]))
    return some


def candidate_lines(lined: DataFrame, queries: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """Lines that can hold a hit in some layer; a column of recogniser candidates, if there is one, lets its line pass."""
    some = candidate_filter(queries, columns)
    return lined.where(some | (F.size(F.coalesce("top_k", F.array())) > 0) if "top_k" in lined.columns else some)


#: The forms that are searched after the text as read and as resolved, in order.
FORMS = ("simplified", "traditional", "taiwan", "hong_kong")


def top_k_array(raw: Column, candidates: Column, simple_query: str, table: VariantTable) -> Column:
    """Hits on a one-character line through recogniser candidates: any but the primary one whose simplified form is the query."""
    fits = lambda c: ~F.coalesce(c["is_primary"], F.lit(False)) & (F.length(c["text"]) == 1) & (convert_column(c["text"], table) == simple_query)
    hit = lambda c: F.struct(F.lit(LAYERS["ocr_top_k"]).alias("priority"), F.lit(len(FORMS) + 2).alias("kind_order"), F.lit("ocr_top_k").alias("layer"), F.lit("ocr_top_k").alias("kind"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(0).alias("istart"), F.lit(1).alias("iend"))
    return F.when(F.length(raw) == 1, F.transform(F.filter(F.coalesce(candidates, F.array()), fits), hit)).otherwise(F.array()).cast(_HIT)


def layered_search(lined: DataFrame, query: str, table: VariantTable = LATIN) -> DataFrame:
    """One row per best hit, with the kind of index it came from, its verification and its confidence. lined: raw_text,
    resolved_text, optionally top_k (array of text, confidence, is_primary), and whatever shall go along.

    Layers: the text as read, as resolved, its four script forms against the query's, and recogniser candidates.
    """
    forms = table.forms(query)
    known = [c for c in lined.columns if c not in ("raw_text", "resolved_text")]
    # kinds that convert alike find the same spans, of which the first kind's count
    kinds = [k for k in FORMS if like_kind(table, k) == k]
    ready = lined.select(*known, "raw_text", "resolved_text", *[form_column(F.col("resolved_text"), k, table).alias(f"_{k}") for k in kinds])
    queries = {"raw": query, "resolved": query} | {k: forms[k] for k in kinds}
    columns = {"raw": "raw_text", "resolved": "resolved_text"} | {k: f"_{k}" for k in kinds}
    raw = F.col("raw_text")
    maybe = candidate_filter(queries, columns)
    parts = [layer_hits(raw, raw, query, "raw_exact", "raw", 0), layer_hits(raw, F.col("resolved_text"), query, "context_resolved", "resolved", 1)]
    parts += [layer_hits(raw, F.col(f"_{k}"), forms[k], "variant_graph", k, 2 + n) for n, k in enumerate(FORMS) if k in kinds]
    if "top_k" in lined.columns:
        parts.append(top_k_array(raw, F.col("top_k"), forms["simplified"], table))
        maybe = maybe | (F.length(raw) == 1)
    hit = ready.where(maybe).withColumn("hit", F.explode(best_hits(F.concat(*parts))))
    told = F.create_map(*[F.lit(x) for p in VERIFICATION.items() for x in p])
    return hit.select(*lined.columns, "hit.layer", "hit.kind", "hit.priority", "hit.start", "hit.end", F.col("hit.istart").alias("index_start"), F.col("hit.iend").alias("index_end"), F.element_at(told, F.col("hit.layer")).alias("verification"))


def placed_hits(hits: DataFrame, query: str, table: VariantTable = LATIN) -> DataFrame:
    """hits of layered_search with the span at which they are shown: their own (mapping exact_length), else the first
    place where the text that matched stands in the line as read (first_find), else none."""
    forms = {"raw": query, "resolved": query} | {k: table.forms(query)[k] for k in FORMS}
    matched = F.element_at(F.create_map(*[F.lit(x) for p in forms.items() for x in p]), F.col("kind"))
    at = F.when(F.col("kind").isin(*forms), F.instr(F.col("raw_text"), matched)).otherwise(0)
    mapping = F.when(F.col("start").isNotNull(), "exact_length").when(at > 0, "first_find")
    placed = hits.withColumn("mapping", mapping)
    first = F.col("mapping") == "first_find"
    return placed.withColumns({"start": F.when(first, at - 1).otherwise(F.col("start")), "end": F.when(first, at - 1 + F.length(matched)).otherwise(F.col("end"))})


def scan_spans(text: Column, terms: list[str], scope: str = "both", table: VariantTable = LATIN) -> Column:
    """Different spans (start, end), in order, at which a term or one of its forms stands in the text or in the form of
    the same kind. Forms of another length than the text are left out, and so are spans whose own glyphs are out of scope."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    wanted: dict[str, list[str]] = {"original": terms}
    for term in terms:
        for kind in FORMS:
            wanted.setdefault(like_kind(table, kind), []).append(table.forms(term)[kind])

    def look(queries: list[str]) -> Callable[[Column], Column]:
        return lambda indexed: F.when(F.length(indexed) == F.length(text), F.concat(none, *[spans(indexed, q) for q in dict.fromkeys(queries)])).otherwise(none)

    # a form is made once and looked through for all its terms
    found = [none, *[look(queries)(text) if kind == "original" else let(form_column(text, kind, table), look(queries)) for kind, queries in wanted.items()]]
    every = F.sort_array(F.array_distinct(F.concat(*found)))
    return every if scope == "both" else F.filter(every, lambda h: in_scope(classify_column(F.substring(text, h["start"] + 1, h["end"] - h["start"]), table), scope))


def hit_counts(hits: DataFrame, by: tuple[str, ...] = ("layer", "lang")) -> DataFrame:
    """Hits by each column and in all, as grouping sets."""
    return hits.groupingSets([*[[F.col(c)] for c in by], []], *by).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("gid"))


def top_k_hits(cells: DataFrame, wanted: list[int], k: int = 5) -> DataFrame:
    """Rows whose best class is not wanted but one of the next k - 1 is: candidates that await review. cells: id, class, score."""
    from pyspark.sql import Window

    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "class"))).where(F.col("rank") <= k)
    return ranked.where((F.col("rank") > 1) & F.col("class").isin(wanted)).select("id", "rank", "class", F.lit("candidate_pending_review").alias("verification"))


def reconciled(chars: Column, confidence: Column, alone: Column, alone_confidence: Column, simple: dict[str, str], low: float = 0.85, high: float = 0.97, gain: float = 0.15) -> Column:
    """Characters with those replaced that were read with low confidence in context, with high confidence alone,
    with enough gain, and belong to the same family."""
    table = F.create_map(*[F.lit(x) for p in simple.items() for x in p])
    fold = lambda c: F.coalesce(F.try_element_at(table, c), c)
    rows = F.arrays_zip(chars.alias("c"), confidence.alias("p"), alone.alias("a"), alone_confidence.alias("ap"))
    return F.transform(rows, lambda r: F.when((r["p"] <= low) & (r["ap"] >= high) & (r["ap"] - r["p"] >= gain) & (r["c"] != r["a"]) & (fold(r["c"]) == fold(r["a"])), r["a"]).otherwise(r["c"]))
