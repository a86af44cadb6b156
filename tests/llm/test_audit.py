"""The filter audit against running every order over the documents."""

import math
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from linequarry.llm.audit import audit, interactions, mask_counts, survivors

from .rows import no_docs, odd_docs

LABELS = "doc_id long, quality int, toxic int, source string"


def _fails(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    return [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text))]


def plain(docs, labels):
    """docs: (doc_id, text, source); every order run on its own."""
    least, marks = {}, {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, q, x in labels:
        old = marks.get(d, (False, False))
        marks[d] = (old[0] or q == 1, old[1] or x == 1)
    parts = {}
    for d, t, s in docs:
        copy = d is not None and d > least[t or ""]
        parts.setdefault(s or "", []).append(([*_fails(t or ""), copy], *(marks.get(d, (False, False)) if d is not None else (False, False))))
    out = []
    for part, rows in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        mine = []
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone = [r for r in left if r[0][k]]
                left = [r for r in left if not r[0][k]]
                removed_by[letter] += len(gone)
                fails = sum(r[0][k] for r in rows)
                alone = sum(r[0][k] and sum(r[0]) == 1 for r in rows)
                mine.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone), letter))
        out += [(*m[:-1], removed_by[m[-1]]) for m in mine]
    return sorted(out)


def _texts(r):
    words = ["alpha", "beta", "gamma", "Delta", "EPS", "zeta", "a&b", "$5"]
    some = [" ".join(r.choices(words[: r.randint(1, 8)], k=r.choice([3, 150, 199, 200, 201, 400]))) for _ in range(40)]
    many = " ".join(f"w{i}" for i in range(250))
    return [*some, many, many, many.upper(), many + " #", None, "", " ", "½" * 98 + "AB", "½" * 98 + "ABC"]


@pytest.mark.parametrize("seed", [1, 2])
def test_orders_run_one_by_one(spark, seed):
    r = random.Random(seed)
    texts = _texts(r)
    docs = [(n if r.random() < 0.95 else None, r.choice(texts), r.choice(["x", "y", None, ""])) for n in range(300)]
    docs += docs[:20] + [(docs[0][0], "other", "x")]  # repeated rows and a repeated id
    labels = [(r.randint(0, 320), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1)]
    got = audit(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3), spark.createDataFrame([(*x, "clash") for x in labels], LABELS))
    assert sorted(tuple(x) for x in got.collect()) == plain(docs, labels)


def test_odd_rows_and_clashing_columns(spark):
    df, rows = odd_docs(spark)
    clash = df.withColumns({c: F.lit(7) for c in ("part", "mask", "n", "good", "toxic", "digest", "first", "is_first", "bit", "step")})
    got = audit(clash, spark.createDataFrame([(5, 1, 1, "s")], LABELS)).collect()
    assert sorted(tuple(x) for x in got) == plain([r[:3] for r in rows], [(5, 1, 1)])


def test_empty(spark):
    assert audit(no_docs(spark), spark.createDataFrame([], LABELS)).collect() == []
    rows = audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string"), spark.createDataFrame([], LABELS)).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}


def test_other_filters_and_every_subset(spark):
    """Any filters, any number: survivors of every subset by looking at each document."""
    r = random.Random(3)
    docs = [(n, "".join(r.choices("abcdef", k=3)), "p") for n in range(200)]
    letters, counts = mask_counts(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([], LABELS), lambda t: {c: t.contains(c) for c in "abc"}, None)
    one = survivors(counts, 3).first()
    assert letters == ["a", "b", "c"]
    assert list(one.n) == [sum(not any(c in t for k, c in enumerate("abc") if s >> k & 1) for _, t, _ in docs) for s in range(8)]
    assert interactions(letters, counts).count() == math.factorial(3) * 3


def test_hot_text(spark):
    """A third of all rows share one text and one source: digests and counts carry them."""
    n = 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("hot").alias("source"))
    row = audit(docs, spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' AND step = 1").first()
    assert (row.removed, row.kept) == (n // 3 - 1, n - n // 3 + 1)
