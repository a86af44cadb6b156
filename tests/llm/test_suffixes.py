import hashlib
import random

import numpy as np
import pytest

from linequarry.llm.suffixes import common_prefixes, repeat_removal, suffix_array

from .brute import repeats


def _check(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, uid string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) for r in repeat_removal(df.repartition(3), **how).collect()}
    want = {d: (*v, hashlib.sha256(v[3]).hexdigest()) for d, v in repeats(rows).items()}
    assert got == want


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    data[1200:1700] = data[100:600]
    starts, ends = np.array([0, 900, 901, 2000]), np.array([900, 901, 2000, 3000])
    for length in (8, 20, 200):
        sa = suffix_array(data, starts, ends, length)
        raw = data.tobytes()
        inside = [i for a, b in zip(starts, ends) for i in range(a, b - length + 1)]
        assert sorted(sa.tolist()) == inside
        strings = [raw[i : i + length] for i in sa]
        assert strings == sorted(strings)
        lcp = common_prefixes(data, sa, starts, length)
        for k in range(1, len(sa)):
            n = next((i for i in range(length) if strings[k][i] != strings[k - 1][i]), length)
            assert lcp[k] == n


def test_edges(spark):
    long = "".join(random.Random(5).choice("abcdef ") for _ in range(450))
    _check(spark, [(1, None), (2, ""), (3, "é" * 90), (4, long), (5, long), (6, "x" * 500), (7, long[:199]), (8, long[100:300]), (9, "zz" + long[200:] + "é" + long[:230])])


@pytest.mark.parametrize("limit", [1000, 3])
def test_against_brute_force(spark, limit):
    r = random.Random(limit)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passages = [some(r.randint(100, 700)) for _ in range(6)] + ["ab" * 200, "é" * 150]
    rows = []
    for d in range(80):
        parts = [some(r.randint(0, 300))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            if r.random() < 0.4:
                i = r.randrange(len(p))
                p = p[i:] if r.random() < 0.5 else p[:i]
            parts += [p, some(r.randint(0, 200))]
        rows.append((d, "".join(parts)))
    _check(spark, rows, shard_contexts=limit)


def test_repeated_rows(spark):
    long = " ".join(str(k * k) for k in range(200))
    rows = [(1, long)] * 40 + [(2, long[:150])] * 3 + [(None, long)] * 5 + [(3, "x " + long[100:400] + " y"), (4, None), (4, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in repeat_removal(df).collect())
    n = len(long)
    assert got == sorted([(1, n, n, 1)] * 40 + [(2, 150, 0, 0)] * 3 + [(0, n, n, 1)] * 5 + [(3, 304, 300, 1), (4, 0, 0, 0), (4, 0, 0, 0), (0, 0, 0, 0)])
