"""Queries over the variant graph, phrase evidence, query graphs and the layout of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as V
from ..operators import layout as L
from ..operators import search as S
from ..operators.numbering import written
from ..sources.corpus import SQL_LINES, lines, table, with_boxes
from .registry import query

#: A conversion table for the sample texts, with characters of their own and phrases that overlap.
WORDS = V.VariantTable(
    to_simple=V.LATIN.to_simple,
    to_kind={"traditional": {"e": "é", "a": "à", "o": "œu"}, "taiwan": {"e": "è", "a": "à"}, "hong_kong": {"u": "ü"}},
    phrases={"traditional": {"tion": "cion", "nation": "natión", "ona": "önä"}, "taiwan": {"er": "ér", "verd": "vêrd"}, "hong_kong": {"ring": "rîng"}},
)
_FOLD = f"replace(translate(%s, '{V.ACCENTED}', '{V.FOLDED}'), 'ß', 'ss')"


def _sql_form(kind: str, text: str, phrases: bool) -> str:
    """A regional form in SQL: tokens by alternation, the longest phrase first, each converted."""
    some = sorted(WORDS.phrases[kind], key=lambda p: (-len(p), p)) if phrases else []
    chars = WORDS.to_kind[kind]
    cases = " ".join(f"WHEN '{p}' THEN '{WORDS.phrases[kind][p]}'" for p in some) + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in chars.items())
    return f"array_to_string(list_transform(regexp_extract_all({text}, '(?s){'|'.join([*some, '.'])}'), lambda t: CASE t {cases} ELSE t END), '')"


_KIND_ROWS = " UNION ALL ".join(f"SELECT doc_id, line_no, '{k}' AS kind, {_sql_form(k, 'simple', True)} AS phrase_form, {_sql_form(k, 'simple', False)} AS character_form FROM s" for k in V.KINDS[1:])


@query(f"WITH {SQL_LINES}, s AS (SELECT doc_id, line_no, {_FOLD % 'raw_text'} AS simple FROM lines WHERE length(raw_text) > 1), k AS ({_KIND_ROWS}) SELECT * FROM k WHERE phrase_form <> character_form")
def i_phrase_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(table(spark, d, "documents")).select("doc_id", "line_no", F.explode(V.phrase_evidence(F.col("raw_text"), WORDS)).alias("kind", "f"))
    return rows.select("doc_id", "line_no", "kind", "f.phrase_form", "f.character_form")


_EDGES = ", ".join(f"('{s}', '{v}')" for s, v in sorted({(s, v) for v, s in WORDS.to_simple.items()} | {(s, v) for c in WORDS.to_kind.values() for s, v in c.items()}))
_FIRST = ", ".join(f"('{s}', {n}, '{k}', '{v}')" for n, k in enumerate(V.KINDS[1:]) for s, v in WORDS.to_kind[k].items())
SQL_GRAPH = f"""e AS (SELECT * FROM (VALUES {_EDGES}) x(simple, variant)), p AS (SELECT * FROM (VALUES {_FIRST}) x(simple, place, kind, variant)),
g AS (SELECT e.simple, e.variant, min(place) AS place, coalesce(string_agg(kind, '+' ORDER BY place), 'reverse') AS regions FROM e LEFT JOIN p ON p.simple = e.simple AND p.variant = e.variant GROUP BY 1, 2),
v AS (SELECT simple, string_agg(variant, ',' ORDER BY place NULLS LAST, variant) AS variants, string_agg(variant || ':' || regions, ',' ORDER BY place NULLS LAST, variant) AS told FROM g GROUP BY 1)"""


@query(f"""WITH {SQL_LINES}, {SQL_GRAPH}, c AS (SELECT unnest(string_split(raw_text, '')) AS char FROM lines), n AS (SELECT char, count(*) AS n FROM c GROUP BY 1),
f AS (SELECT char, n, {_FOLD % 'char'} AS simple FROM n) SELECT char, n, f.simple, variants, char <> f.simple AS is_variant FROM f JOIN v ON v.simple = f.simple""")
def i_character_variants(spark: SparkSession, d: str) -> DataFrame:
    """Every character of the lines that belongs to a family: how often it stands there, and the family's variants in order."""
    char = lines(table(spark, d, "documents")).select(F.explode(F.split("raw_text", "")).alias("char")).groupBy("char").agg(F.count("*").alias("n"))
    known = char.withColumn("simple", V.convert_column(F.col("char"), WORDS)).join(V.variant_rows(spark, WORDS), "simple")
    return known.select("char", "n", "simple", F.array_join("variants", ",").alias("variants"), (F.col("char") != F.col("simple")).alias("is_variant"))


@query(f"""WITH {SQL_GRAPH}, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM conversations), q AS (SELECT word AS query FROM w UNION SELECT substring(word, 1, 1) FROM w),
s AS (SELECT query, {_FOLD % 'query'} AS simple FROM q), f AS (SELECT query, simple, {", ".join(f"{_sql_form(k, 'simple', True)} AS {k}, {_sql_form(k, 'simple', False)} AS {k}_chars" for k in V.KINDS[1:])} FROM s)
SELECT query, f.simple AS simplified, traditional, taiwan, hong_kong, CASE WHEN length(query) > 1 AND (traditional <> traditional_chars OR taiwan <> taiwan_chars OR hong_kong <> hong_kong_chars) THEN 'phrase_confirmed' ELSE 'glyph_only_unconfirmed' END AS status,
CASE WHEN length(query) = 1 THEN coalesce(told, '') ELSE '' END AS variants FROM f LEFT JOIN v ON v.simple = f.simple""")
def i_query_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graphs of all words of the conversations, and of their first characters, as queries."""
    word = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).alias("query")).distinct()
    graphs = V.query_graphs(word.unionAll(word.select(F.substring("query", 1, 1).alias("query"))).distinct(), WORDS)
    told = F.array_join(F.transform("variants", lambda v: F.concat(v["text"], F.lit(":"), F.array_join(v["regions"], "+"))), ",")
    return graphs.select("query", "forms.simplified", "forms.traditional", "forms.taiwan", "forms.hong_kong", "status", told.alias("variants"))


_SS = "list_filter(range(0, greatest(length({t}) - 1, 0)), lambda i: substring({t}, i + 1, 2) = 'ss')"


@query(f"""WITH {SQL_LINES}, f AS (SELECT *, {_FOLD % 'raw_text'} AS folded FROM boxed),
h AS (SELECT *, 'raw_exact' AS layer, unnest({_SS.format(t='raw_text')}) AS index_start FROM f UNION ALL SELECT *, 'variant_graph' AS layer, unnest({_SS.format(t='folded')}) AS index_start FROM f WHERE length(folded) <> length(raw_text)),
m AS (SELECT *, CASE WHEN layer = 'raw_exact' THEN 'exact_length' WHEN contains(raw_text, 'ss') THEN 'first_find' END AS mapping FROM h)
SELECT doc_id, line_no, layer, index_start, mapping, CASE mapping WHEN 'exact_length' THEN index_start WHEN 'first_find' THEN strpos(raw_text, 'ss') - 1 END AS start,
CASE WHEN mapping IS NOT NULL THEN CASE WHEN y1 - y0 >= x1 - x0 THEN 'vertical' ELSE 'horizontal' END END AS orientation FROM m""")
def e_hit_layout(spark: SparkSession, d: str) -> DataFrame:
    """Hits with their layout: a hit in a form of another length is shown where its text first stands in the line, or has none."""
    boxed = with_boxes(lines(table(spark, d, "documents")))
    hits = S.layered_search(boxed.select("doc_id", "page_no", "line_no", "raw_text", F.col("raw_text").alias("resolved_text")), "ss")
    placed = S.placed_hits(hits, "ss").select("doc_id", "page_no", "line_no", "layer", "index_start", "mapping", "start", "end")
    placed = written(placed, "placed-hits")  # read twice: for the contexts and for the rows
    shown = placed.where("mapping IS NOT NULL").select("doc_id", "page_no", "line_no", "start", "end").distinct()
    contexts = L.layout_contexts(boxed, shown).select("doc_id", "line_no", "start", "orientation")
    return placed.join(contexts, ["doc_id", "line_no", "start"], "left").select("doc_id", "line_no", "layer", "index_start", "mapping", "start", "orientation")
