"""Mixing against plain loops, and the laws of its parts: targets, permutations, draws, blocks."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linequarry.llm import mixing
from linequarry.llm.mixing import Recipe, drawn, mix, mixture, scrambled, targets

from .rows import no_docs, odd_docs


def reshared(words, weights, most=3):
    """Targets by resharing again and again what is above the bound."""
    total, capped = float(sum(words)), set()
    while True:
        rest = total - sum(most * words[k] for k in capped)
        open_ = [k for k in range(len(words)) if k not in capped]
        share = sum(weights[k] for k in open_)
        out = [most * words[k] if k in capped else rest * weights[k] / share for k in range(len(words))]
        above = {k for k in open_ if out[k] > most * words[k] + 1e-9}
        if not above:
            return out
        capped |= above


def test_targets_are_those_of_resharing():
    r = random.Random(4)
    for _ in range(300):
        words = [r.choice([0, 1, r.randint(1, 50), r.randint(1, 10_000)]) for _ in range(r.randint(1, 12))]
        weights = [mixing.WEIGHTS[k % 3] for k in range(len(words))]
        got = targets(np.array(words), np.array(weights))
        assert np.allclose(got, reshared(words, weights)), words
        assert abs(got.sum() - sum(words)) < 1e-6 * max(1, sum(words))


def test_permutations():
    for n in (1, 2, 3, 4, 5, 63, 64, 65, 1000):
        for key in (0, 1, 99):
            assert sorted(scrambled(np.arange(n), n, key)) == list(range(n))
    assert list(scrambled(np.arange(1000), 1000, 1)) != list(scrambled(np.arange(1000), 1000, 2))
    # neighbours do not stay neighbours
    assert np.mean(np.abs(np.diff(scrambled(np.arange(10_000), 10_000, 5))) < 100) < 0.1


def test_draws_meet_totals_shard_by_shard():
    totals = np.array([1000, 0, 17, 3, 2500])
    n, slots = int(totals.sum()), 100
    shards = -(-n // slots)
    whole = list(drawn(totals, shards, slots, 0, shards, 5))
    seen = np.zeros(len(totals), np.int64)
    for k, (shard, counts, before) in enumerate(whole):
        assert shard == k and (before == seen).all() and counts.sum() == min(slots, n - k * slots)
        seen += counts
    assert (seen == totals).all()
    again = [x for a in range(0, shards, 7) for x in drawn(totals, shards, slots, a, min(a + 7, shards), 5)]
    assert all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(whole, again))


def test_draws_spread_as_multinomial_draws_given_the_totals():
    """Counts of one source in one shard over many seeds: mean and variance of the hypergeometric law."""
    totals, slots, shards = np.array([600, 200, 200]), 100, 10
    got = np.array([next(drawn(totals, shards, slots, 3, 4, seed))[1] for seed in range(3000)])
    p = totals / 1000
    assert np.allclose(got.mean(axis=0), slots * p, atol=0.4)
    assert np.allclose(got.var(axis=0), slots * p * (1 - p) * 900 / 999, rtol=0.1)


def test_wide_ranges_split_by_shares(monkeypatch):
    monkeypatch.setattr(mixing, "EXACT", 500)
    totals = np.array([900, 90, 10, 0, 1])
    rows = list(drawn(totals, 11, 100, 0, 11, 1))
    assert (sum(r[1] for r in rows) == totals).all() and [int(r[1].sum()) for r in rows] == [100] * 10 + [1]


@pytest.mark.parametrize("words", [0, 1, 127, 128, 129, 1000, 1024])
def test_slots_take_the_words_asked(words):
    for other in (0, 5, 500, 100_000):
        recipe = Recipe([words, other], [1, 5])
        for k in (0, 1):
            n = int(recipe.slots[k])
            if not n:
                assert recipe.takes[k] == 0
                continue
            block, size = recipe.taken(k, np.arange(n))
            assert size.sum() == recipe.takes[k] and (size > 0).all() and max(Counter(block.tolist()).values()) <= 3
            whole = np.minimum(128, recipe.words[k] - block * 128)
            assert (size <= whole).all() and (size < whole).sum() <= 1


def brute(rows, block, slots, seed):
    """rows: (doc_id, text, source). Words with their owners, cut into blocks, dealt slot by slot."""
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    totals = [sum(words(t) for _, t, s in rows if s == x) for x in sources]
    weights = [(5, 2, 1)[k % 3] for k in range(len(sources))]
    target = reshared(totals, weights) if sources else []
    recipe = Recipe(totals, weights, block)
    taken = Counter()
    n_shards = -(-int(recipe.slots.sum()) // slots)
    per_source = {k: [] for k in range(len(sources))}
    for _, counts, _ in drawn(recipe.slots, n_shards, slots, 0, n_shards, seed):
        for k, c in enumerate(counts):
            per_source[k] += [None] * int(c)
    for k, x in enumerate(sources):
        stream = [n for n in sorted((n for n, r in enumerate(rows) if r[2] == x), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, words(rows[n][1]))) for _ in range(words(rows[n][1]))]
        for j in range(len(per_source[k])):
            b, size = recipe.taken(k, np.array([j]))
            for n in stream[int(b[0]) * block : int(b[0]) * block + int(size[0])]:
                taken[n] += 1
    return sorted(((d, words(t), totals[sources.index(s)], round(target[sources.index(s)], 6), taken[n]) for n, (d, t, s) in enumerate(rows)), key=repr)


def _rows(r, n):
    return [(d, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice(["a", "b", "B", "é", None, "src10", "src2"])) for d in range(n)]


def _tuples(df):
    return sorted(((x.doc_id, x["size"], x.source_size, round(x.target, 6), x.taken) for x in df.collect()), key=repr)


def test_plain_loops(spark, monkeypatch):
    rows = _rows(random.Random(6), 120)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "SLOTS", 32)
    own, words = mix(df.repartition(3), block=16, slots=32)
    taken = words.groupBy("row").agg(F.sum("words").alias("taken"))
    got = own.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    assert _tuples(got) == brute(rows, 16, 32, mixing.SEED)


def test_query_laws_and_reruns(spark):
    rows = _rows(random.Random(8), 2000) + [(None, "one two three", "a")] * 50 + [(7, "x y", "b")] * 40 + [(7, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("row", "size", "target", "block", "slot", "shard", "start", "said", "source_no", "hash", "range")})
    one, two = _tuples(mixture(df.repartition(2))), _tuples(mixture(df.repartition(7)))
    assert one == two and len(one) == len(rows)
    by = {}
    for _, size, source_size, target, taken in one:
        assert taken <= 3 * size
        at = by.setdefault(source_size, [target, 0])
        at[1] += taken
    assert all(abs(target - taken) <= 0.5 for target, taken in by.values())


def test_small_batches_carry_on(spark):
    """Sums within a range go on from one Arrow batch to the next."""
    rows = _rows(random.Random(9), 300)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = _tuples(mixture(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _tuples(mixture(df)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mix_rows_fill_slots(spark):
    rows = _rows(random.Random(2), 200)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, words = mix(df, block=32, slots=64)
    got = words.collect()
    per_shard = {}
    for x in got:
        per_shard.setdefault(x.shard, {}).setdefault(x.slot, 0)
        per_shard[x.shard][x.slot] += x.words
    assert all(sorted(s) == list(range(len(s))) and max(s.values()) <= 32 for s in per_shard.values())


def test_odd_and_empty(spark):
    df, rows = odd_docs(spark)
    got = _tuples(mixture(df))
    assert len(got) == len(rows) and all(t <= 3 * s for _, s, _, _, t in got)
    assert mixture(no_docs(spark)).collect() == []
    none = mixture(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert sorted((x.doc_id, x["size"], x.target, x.taken) for x in none) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
