"""Variant forms, evidence and graphs on columns against the plain table."""

import random

from pyspark.sql import functions as F

from linequarry.functions import variants as V
from linequarry.operators import search as S
from linequarry.plans.variant_queries import WORDS


def _texts(table, r, n=150):
    alphabet = [*sorted({c for p in table.phrases.values() for w in p for c in w}), *list(table.to_simple)[:12], "x", "(", " "]
    words = [w for p in table.phrases.values() for w in p] or ["x"]
    return ["".join(r.choice(words) if r.random() < 0.3 else r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(n)]


OVERLAP = V.VariantTable({"É": "E"}, {"traditional": {"a": "A", "d": "DD", "D": "x"}}, {"traditional": {"ab": "1", "bcd": "2", "abc.": "3", "(c": "4"}})


def test_forms_and_evidence_as_the_plain_table_has_them(spark):
    for table in (V.HAN, V.LATIN, WORDS, OVERLAP):
        texts = _texts(table, random.Random(5))
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = df.select("t", *[V.form_column(F.col("t"), k, table).alias(k) for k in V.KINDS], V.phrase_evidence(F.col("t"), table).alias("e")).collect()
        for r in got:
            assert {"original": r.t} | {k: r[k] for k in V.KINDS} == table.forms(r.t), r.t
            plain = table.phrase_evidence(r.t)
            assert {k: f.phrase_form for k, f in r.e.items()} == plain, r.t
    assert OVERLAP.convert("abcd", "traditional") == "1cDD"  # from the left, not the longest anywhere


def test_graph_rows(spark):
    for table in (V.HAN, WORDS):
        got = {r.simple: r for r in V.variant_rows(spark, table).collect()}
        for simple, row in got.items():
            assert row.variants == table.variants(simple), simple
            for v, regions in zip(row.variants, row.regions):
                assert regions == [k for k in V.KINDS[1:] if table.to_kind.get(k, {}).get(simple) == v]
        assert set(got) == set(table.graph())


def test_query_graphs(spark):
    queries = ["发", "頭", "头发", "頭髮", "x", "说"]
    got = {r["query"]: r for r in V.query_graphs(spark.createDataFrame([(q,) for q in queries], "query string"), V.HAN).collect()}
    assert got["头发"].status == "phrase_confirmed" and got["头发"].evidence["traditional"].character_form == "頭發" and got["头发"].variants == []
    assert [(v.text, v.regions) for v in got["说"].variants] == [("說", ["traditional", "taiwan"]), ("説", ["hong_kong"])]
    assert [(v.text, v.regions) for v in got["发"].variants] == [("發", ["traditional", "taiwan", "hong_kong"]), ("髮", ["reverse"])]
    assert got["x"].variants == [] and got["x"].status == "glyph_only_unconfirmed" and got["頭"].forms.simplified == "头"


def test_family(spark):
    df = spark.createDataFrame([("發", "髮"), ("發", "發"), ("发", "發"), ("发", "头"), (None, "发")], "a string, b string")
    assert [r.f for r in df.select(V.same_family(F.col("a"), F.col("b"), V.HAN).alias("f")).collect()] == [True, False, True, False, None]


def test_unmapped_hits_fall_back(spark):
    df = spark.createDataFrame([(1, "Straße lass"), (2, "Straße"), (3, "lass das")], "id int, raw_text string").withColumn("resolved_text", F.col("raw_text"))
    got = sorted((r.id, r.layer, r.index_start, r.mapping, r.start, r.end) for r in S.placed_hits(S.layered_search(df, "ss"), "ss").fillna("", ["mapping"]).fillna(-1, ["start", "end"]).collect())
    assert got == [(1, "raw_exact", 9, "exact_length", 9, 11), (1, "variant_graph", 4, "first_find", 9, 11), (1, "variant_graph", 10, "first_find", 9, 11), (2, "variant_graph", 4, "", -1, -1), (3, "raw_exact", 2, "exact_length", 2, 4)]
