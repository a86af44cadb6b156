"""op10 against label propagation written once more over plain lists, with the query's own rounds."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from linequarry.llm import sharding as S

SHARDS = 4


def _groups(seed=3):
    r = random.Random(seed)
    sizes = [260, 90, 40] + [r.randint(2, 9) for _ in range(60)] + [1] * 300
    rows = [f"g{n}" for n, k in enumerate(sizes) for _ in range(k)]
    r.shuffle(rows)
    return rows


def _liked(rows, shards):
    """rows: (group, shard). Of each group of two or more: the fullest shards, as many as it needs."""
    capacity = max(1, len(rows) // shards)
    held = defaultdict(Counter)
    for g, s in rows:
        held[g][s] += 1
    out = {}
    for g, c in held.items():
        n = sum(c.values())
        if n > 1:
            out[g] = sorted(range(shards), key=lambda k: (-c[k], k))[: min(shards, -(-n // capacity))]
    return out


def _round(rows, shards, r):
    """One round: wishes, then for each pair of shards equal numbers both ways, linked rows first."""
    liked = _liked(rows, shards)
    asks = defaultdict(lambda: ([], []))
    for i, (g, s) in enumerate(rows):
        if g not in liked:
            t = r.randrange(shards)
        elif s in liked[g]:
            t = s
        else:
            t = r.choice(liked[g])
        if t != s:
            asks[s, t][g not in liked].append(i)
    rows = list(rows)
    for (a, b), (linked, free) in asks.items():
        back = asks.get((b, a), ([], []))
        goes = min(len(linked) + len(free), len(back[0]) + len(back[1]), max(len(linked), len(back[0])))
        for i in (r.sample(linked, len(linked)) + free)[:goes]:
            rows[i] = (rows[i][0], b)
    return rows


def _cut(rows):
    inside, total = Counter(rows), Counter(g for g, _ in rows)
    pairs = lambda n: n * (n - 1) // 2
    return sum(map(pairs, total.values())) - sum(map(pairs, inside.values()))


def _state(spark, shards=SHARDS):
    rows = [(n, 1, 0, g, n * 7919, n % shards) for n, g in enumerate(_groups())]
    return spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long, grp string, spread long, shard int"), rows


def test_wishes_go_to_the_fullest_shards(spark):
    df, rows = _state(spark)
    got = S._wishes(df, len(rows), 1, SHARDS).collect()
    liked = _liked([(r[3], r[5]) for r in rows], SHARDS)
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    for r in got:
        assert r.linked == (r.grp in liked)
        if r.linked:
            assert r.target in liked[r.grp] and (r.target == r.shard or r.shard not in liked[r.grp])
    assert len({r.target for r in got if r.grp == "g0" and r.shard not in liked["g0"]}) == len(liked["g0"]) > 1 or len(liked["g0"]) == 1
    assert {r.target for r in got if not r.linked} == set(range(SHARDS))


def test_exchanges_are_even_and_take_linked_rows_first(spark):
    df, rows = _state(spark)
    wished = S._wishes(df, len(rows), 1, SHARDS).cache()
    before = {r.doc_id: r for r in wished.collect()}
    after = {r.doc_id: r.shard for r in S._exchange(wished).collect()}
    assert sorted(after) == sorted(before)
    asks = defaultdict(lambda: [0, 0])
    went = defaultdict(lambda: [0, 0])
    for d, r in before.items():
        if r.target != r.shard:
            asks[r.shard, r.target][not r.linked] += 1
        if after[d] != r.shard:
            assert after[d] == r.target
            went[r.shard, r.target][not r.linked] += 1
    for (a, b), (x, free) in asks.items():
        y, other = asks[b, a] if (b, a) in asks else (0, 0)
        goes = min(x + free, y + other, max(x, y))
        assert went[a, b] == [min(x, goes), goes - min(x, goes)]
    assert Counter(after.values()) == Counter(r[5] for r in rows)


def test_cut_is_that_of_plain_rounds(spark):
    texts = _groups()
    out = S.shard_documents(spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").repartition(5), SHARDS)
    got = [(r.grp, r.shard) for r in out.select("grp", "shard").collect()]
    cuts, counts = [], Counter(s for _, s in got)
    for seed in range(8):
        r = random.Random(seed)
        rows = [(t, n % SHARDS) for n, t in enumerate(r.sample(texts, len(texts)))]
        start = _cut(rows)
        for _ in range(S.ROUNDS):
            rows = _round(rows, SHARDS, r)
        cuts.append(_cut(rows))
    assert max(counts.values()) - min(counts.values()) <= 1
    told = S.cut_share(out).agg(F.first("cut")).first()[0]
    assert told == _cut(got) <= 1.1 * max(cuts) < start
