import random

import pytest

from linequarry.llm.jaccard import jaccard_groups

from .brute import jaccard


def _check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(df.repartition(3)).collect()}
    assert got == jaccard(rows)


def test_edges(spark):
    _check(spark, [(7, None), (3, ""), (9, " \n\t"), (4, "one two"), (2, "ONE  two"), (5, "a b c d e"), (6, "a b c d e"), (8, "é b c d e f"), (1, "É b c d e f")])
    _check(spark, [(1, "x")])


def test_empty(spark):
    assert jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + r.choice("qrs")
    common = " ".join(word() for _ in range(30))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(r.randint(4, 120))]
        if r.random() < 0.5:
            base += common.split()
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w = w[: -r.randint(1, 6)] or w
            rows.append((n, " ".join(w)))
            n += 1
    r.shuffle(rows)
    _check(spark, rows)
