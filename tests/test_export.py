import json

import pytest
from pyspark.sql import functions as F

from linequarry.engine import Engine
from linequarry.functions.text import QueryError
from linequarry.operators import export


@pytest.fixture()
def engine(spark):
    docs = spark.createDataFrame([(1, "Die Straße ist lang\nund Strasse </script>", "de", "s1"), (2, "keine", "de", "s1"), (3, None, "de", "s2")], "doc_id long, text string, lang string, source string")
    return Engine(spark, docs, spark.createDataFrame([(1, "confirmed")], "doc_id long, decision string"))


def test_search_and_results(engine):
    hits = {(r.line_no, r.layer) for r in engine.search_execute("Straße").collect()}
    assert hits == {(0, "raw_exact"), (0, "variant_graph"), (1, "variant_graph")}  # a hit without source span stays beside the exact one
    page, summary = engine.results_query("Strasse", status="confirmed")
    assert [r.before for r in page.collect()] == ["und "] and summary.first().confirmed == 1
    assert engine.search_execute("tras", "simplified").count() <= engine.search_execute("tras").count()
    with pytest.raises(QueryError):
        engine.search_execute("  ")
    assert engine.corpus_status().where("task_id = 's1'").first().lines == 3
    assert [r.task_id for r in engine.tasks_list().collect()] == ["s2", "s1"]


def test_decisions(engine, spark):
    after = engine.review_update_decisions(spark.createDataFrame([(2, "rejected")], "doc_id long, decision string"), "op")
    assert after.count() == 2 and engine.review_layout_context("Strasse").count() == 1


def test_exports(engine, tmp_path):
    path = str(tmp_path / "x.json")
    size = engine.export_json("Stra", path)
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    data = json.loads(raw)
    assert size == len(raw.encode()) and data["integrity"]["occurrences"] == 2 and data["occurrences"][0]["decision"] == "confirmed"
    page = str(tmp_path / "x.html")
    engine.export_html("Strasse", page)
    with open(page, encoding="utf-8") as f:
        text = f.read()
    assert text.count("</script>") == 2 and "\\u003c/script\\u003e" in text


def test_labels(spark):
    s = export.status_label(F.col("d"))
    got = spark.createDataFrame([("confirmed",), (None,), ("other",)], "d string").select(s["value"].alias("v"), s["label"].alias("l")).collect()
    assert [tuple(r) for r in got] == [("confirmed", "Confirmed"), ("unreviewed", "Unreviewed"), ("unreviewed", "Unreviewed")]
