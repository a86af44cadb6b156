"""What the cost of a query depends on: forms made once, code points told by columns, files read in tasks, batches cut by size."""

from pyspark.sql import functions as F

from linequarry.functions import text as X
from linequarry.functions import variants as V
from linequarry.operators import search as S
from linequarry.queries import QUERIES

TABLES = "/root/testdata/sf0.001"
ODD = ["", "a", "ssß ß", "nation", "natiónational tion", chr(0x10FFFF) + "x" + chr(0xFFFF) + chr(0x10000), "ring\nverderb", chr(0xF1000) + "nation" + chr(0xF2000), "éna na", "\0 ona"]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_page_records_are_cut_by_size(spark, monkeypatch):
    from linequarry.operators import pages as P
    from linequarry.plans import commit_queries as C

    sinks = []
    real = C._stream
    monkeypatch.setattr(C, "_stream", lambda spark, records, *rest: (sinks.append(records), real(spark, records, *rest))[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # stands for rows that fill the shuffle's partitions
    try:
        got = {r.task_id: r.pages for r in C.b_page_commits(spark, TABLES).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = P.page_records(spark.read.parquet(f"{TABLES}/documents.parquet")).groupBy("task_id").count()
    assert got == {r.task_id: r["count"] for r in want.collect()}
    assert len(spark.read.schema(P.RECORD).parquet(sinks[0]).inputFiles()) > 3


def test_code_points_of_lines(spark, monkeypatch):
    df = spark.createDataFrame([(n, t) for n, t in enumerate([*ODD, None] * 3)], "n long, t string").repartition(2)
    for most in (1 << 20, 3):
        monkeypatch.setattr(X, "_AT_ONCE", most)
        for r in df.select("t", X.code_points_of_lines(F.col("t")).alias("c")).collect():
            assert r.c == (None if r.t is None else " ".join(f"U+{ord(c):04X}" for c in r.t))
    assert "regexp_replace" not in _plan(QUERIES["d_validation_rules"](spark, TABLES))


def test_image_headers_are_read_in_tasks(spark):
    got = QUERIES["a_image_headers"](spark, TABLES)
    assert len(got.inputFiles()) < 100 < got.count()


def test_a_form_is_made_once(spark):
    lined = spark.createDataFrame([(t, t) for t in ODD], "raw_text string, resolved_text string")
    text = F.col("raw_text")
    assert _plan(lined.select(S.scan_spans(text, ["éna", "na"]).alias("h"))).count("translate(") == 1
    assert _plan(S.layered_search(lined, "ss")).count("translate(") <= 3


def test_phrase_evidence_of_odd_texts(spark):
    from linequarry.plans.variant_queries import WORDS

    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    told = df.select("t", V.phrase_evidence(F.col("t"), WORDS).alias("e"), *[V.form_column(F.col("t"), k, WORDS).alias(k) for k in V.KINDS])
    for r in told.collect():
        assert {k: f.phrase_form for k, f in r.e.items()} == WORDS.phrase_evidence(r.t)
        assert {k: r[k] for k in V.KINDS} == {k: WORDS.forms(r.t)[k] for k in V.KINDS}
    assert _plan(df.select(V.phrase_evidence(F.col("t"), WORDS).alias("e"))).count("translate(") == 1
