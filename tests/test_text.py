import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linequarry.functions import text as X


def _one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("given_,wanted", [("  é  ", "é"), ("　档案　", "　档案　"), ("a b", "a b"), ("x" * 32, "x" * 32), ("😀" * 32, "😀" * 32)])
def test_query_normalised(given_, wanted):
    assert X.normalize_query(given_) == wanted


@pytest.mark.parametrize("bad", ["", "   ", "a\tb", "\x1cq", "a\r", "\n", "a\x00", "\x1b", "\x7f", "﻿a", "\ud800", "😀" * 33, None, 5])
def test_query_refused(bad):
    with pytest.raises(X.QueryError):
        X.normalize_query(bad)


def test_overlapping_matches(spark):
    assert _one(spark, "aaaa", lambda t: X.match_starts(t, "aa")) == [0, 1, 2]
    assert _one(spark, "😀ab😀ab", lambda t: X.match_starts(t, "ab")) == [1, 4]
    assert _one(spark, "ab", lambda t: X.match_starts(t, "abc")) == []
    assert _one(spark, "ab", lambda t: X.match_starts(t, "")) == []
    assert _one(spark, "Ab", lambda t: X.match_starts(t, "ab")) == []
    assert [tuple(s) for s in _one(spark, "档案档案", lambda t: X.spans(t, "档案"))] == [(0, 2), (2, 4)]


def test_matches_against_plain_loop(spark):
    r = random.Random(4)
    rows = [("".join(r.choice("abé😀") for _ in range(r.randint(0, 30))),) for _ in range(300)]
    for q in ("a", "ab", "bab", "é😀"):
        got = spark.createDataFrame(rows, "t string").select("t", X.match_starts(F.col("t"), q).alias("s")).collect()
        assert all(x.s == [i for i in range(len(x.t) - len(q) + 1) if x.t[i : i + len(q)] == q] for x in got)


@given(st.text(max_size=40))
def test_normalised_text_has_no_outer_spaces(t):
    try:
        out = X.normalize_query(t)
    except X.QueryError:
        return
    assert out == out.strip(" ") and 0 < len(out) <= X.QUERY_LIMIT


def test_code_points(spark):
    assert _one(spark, "a约😀", X.code_points) == "U+0061 U+7EA6 U+1F600"
    assert _one(spark, "", X.code_points) == ""


def test_like_folds_ascii_only(spark):
    yes = lambda t, q: _one(spark, t, lambda c: X.like_ascii(c, q))
    assert yes("xAxbx", "a_B") and not yes("Ä", "ä") and not yes("a%b", r"\%") and yes("a\\", "\\")


def test_context(spark):
    row = spark.createDataFrame([("0123456789",)], "t string").select(*[c.alias(n) for n, c in X.context(F.col("t"), F.lit(2), F.lit(4), 3).items()]).first()
    assert tuple(row) == ("01", "23", "456")


def test_paths_and_sizes(spark):
    assert _one(spark, "a\\b/c.pdf", X.base_name) == "c.pdf"
    assert _one(spark, "a\\b", X.safe_relative) == "a/b"
    for bad in ("/a", "C:\\a", "a/../b", "..", ""):
        assert _one(spark, bad, X.safe_relative) is None
    assert _one(spark, "/a b/ü.pdf", X.file_url) == "file:///a%20b/%C3%BC.pdf"
    size = lambda n: spark.range(1).select(X.file_size(F.lit(n)).alias("x")).first().x
    assert (size(10), size(2048), size(5 << 20)) == ("10 B", "2.00 KB", "5.00 MB")
    assert _one(spark, "<a&b>  ", X.script_safe) == "\\u003ca\\u0026b\\u003e \\u2028"
    assert _one(spark, "C:\\Users\\Ann\\x and ANN", lambda c: X.redacted(c, "ann", "")) == "C:\\Users\\<user>\\x and <user>"


@pytest.mark.parametrize("args,wanted", [(("約", 0.93, "約"), "confirmed"), (("約", 0.95, "约"), "needs_review"), (("約", 0.61, "書"), "rejected"), (("約", 0.95, ""), "confirmed"), (("約", 0.8, None), "needs_review")])
def test_verification(spark, args, wanted):
    df = spark.createDataFrame([args], "m string, c double, s string")
    assert df.select(X.verification(F.col("m"), F.col("c"), F.col("s"))["status"].alias("x")).first().x == wanted


def test_compose(spark):
    assert _one(spark, "é", X.compose) == "\xe9"
