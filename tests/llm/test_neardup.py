import numpy as np

from linequarry.llm.neardup import near_vectors, planes_and_tables, signatures

from .brute import components


def _plain(rows):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    c = components([i for i, _ in rows], links)
    return {i: (sum(i in p for p in links), c[i], c[i] == i) for i, _ in rows}


def test_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        base = r.standard_normal(16)
        for _ in range(int(r.integers(1, 8))):
            rows.append((len(rows), [float(x) for x in base + 0.15 * r.standard_normal(16)]))
    rows += [(len(rows) + k, rows[3][1]) for k in range(4)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None, 1.0]), (n + 4, []), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (n + 7, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near_vectors(df.repartition(3), recall=0.9999).collect()}
    assert got == _plain(rows)


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tables_find_pairs_at_the_threshold():
    r = np.random.default_rng(5)
    a = r.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = r.standard_normal((3000, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * side
    bits, tables = planes_and_tables(50_000)
    met = (signatures(a, bits, tables) == signatures(b, bits, tables)).any(axis=1)
    assert met.mean() > 0.97
