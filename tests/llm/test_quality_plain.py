"""Expectation-maximisation and the scorer written out plainly, and texts of other scripts."""

import math
import random

import numpy as np

from linequarry.llm.quality import BAD_SIGNS, Marks, estimate, posterior, train


def plain_em(patterns, counts, rounds=100, trust=0.01):
    """One labeller after the other, one pattern after the other."""
    m, total = len(patterns[0]), sum(counts)
    bad = [0.25 if k < BAD_SIGNS else 0.5 for k in range(m)]
    good = [0.01 if k < BAD_SIGNS else 0.95 for k in range(m)]
    rate, guess, share, held = list(zip(bad, good)), list(zip(bad, good)), 0.85, trust * total + 1

    def chance(v):
        p, q = share, 1 - share
        for k in range(m):
            p *= rate[k][1] if v[k] else 1 - rate[k][1]
            q *= rate[k][0] if v[k] else 1 - rate[k][0]
        return p / (p + q)

    for _ in range(rounds):
        weight = [chance(v) for v in patterns]
        n_good = sum(c * w for c, w in zip(counts, weight))
        n_bad = total - n_good
        new = []
        for k in range(m):
            fired_good = sum(c * w for v, c, w in zip(patterns, counts, weight) if v[k])
            fired_bad = sum(c * (1 - w) for v, c, w in zip(patterns, counts, weight) if v[k])
            b = (fired_bad + guess[k][0] * held * (1 - share)) / (n_bad + held * (1 - share))
            g = (fired_good + guess[k][1] * held * share) / (n_good + held * share)
            new.append((min(max(b, 1e-4), 1 - 1e-4), min(max(g, 1e-4), 1 - 1e-4)))
        rate, share = new, (n_good + 0.85 * held) / (total + held)
    return share, rate, [chance(v) for v in patterns]


def test_em(spark):
    r = random.Random(7)
    for _ in range(5):
        patterns = sorted({tuple(-(r.random() < 0.3) if k < BAD_SIGNS else int(r.random() < 0.6) for k in range(10)) for _ in range(60)})
        counts = [r.randint(1, 500) for _ in patterns]
        share, rate = estimate(np.array(patterns), np.array(counts, float))
        want_share, want_rate, chances = plain_em(patterns, counts)
        assert abs(share - want_share) < 1e-9 and np.allclose(rate, want_rate, atol=1e-9)
        assert np.allclose(posterior(np.array(patterns), share, rate), chances, atol=1e-9)


def test_scorer():
    r = np.random.default_rng(1)
    x, y = r.uniform(0, 1, (40, 6)).astype(np.float32), r.uniform(0, 1, 40)
    share = y.mean()
    w, seen = [0.0] * 7, [1e-8] * 7
    for _ in range(60):
        g = [1e-5 * v for v in w]
        for row, goal in zip(x, y):
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(row, w)) - w[6]))
            off = (goal / share + (1 - goal) / (1 - share)) / (2 * len(y)) * (p - goal)
            for k in range(6):
                g[k] += off * row[k]
            g[6] += off
        for k in range(7):
            seen[k] += g[k] * g[k]
            w[k] -= 0.3 * g[k] / math.sqrt(seen[k])
    assert np.allclose(train(x, y, 60), w, atol=2e-3)


def test_other_scripts_are_seen():
    texts = ["今天的天气很好，我们一起去公园散步。孩子们在草地上玩耍，老人们坐在树下聊天。", "Сегодня хорошая погода, и мы пошли гулять в парк. Дети играли на траве, а старики сидели под деревом.", "Σήμερα ο καιρός είναι καλός, και πήγαμε βόλτα στο πάρκο. Τα παιδιά έπαιζαν στο γρασίδι.", "КУПИТЕ СЕЙЧАС!!! ДЕШЕВО!!! $$$ ### @@@ !!!", "𠀀𠀁😀", "", "퟿​"]
    m = Marks(texts, True)
    votes = m.votes()
    assert [(v > 0).any() for v in votes[1:3]] == [True, True]  # stops and variety as in Latin texts
    assert (votes[3] < 0).sum() >= 3 and (m.x[:3] > 0).sum(axis=1).min() >= 10
    assert m.words[0] > 12 and m.by_class[0, 5] == 2 and m.by_class[0, 6] == 2
    latin = Marks(["Das Wetter ist heute schön, und wir gehen in den Park."], True)
    assert latin.by_class[0, 1] == 3 and latin.by_class[0, 6] == 1
