"""Plain single-machine versions of the operators, for small inputs."""

import re
from itertools import combinations


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(rows):
    sets = {d: shingles(t) for d, t in rows}
    by = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    shared = {}
    for ds in by.values():
        for p in combinations(sorted(ds), 2):
            shared[p] = shared.get(p, 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    c = components(sets, links)
    return {d: (len(s), c[d]) for d, s in sets.items()}


def repeats(rows, length=200):
    raws = {d: (t or "").encode() for d, t in rows}
    seen = {}
    for r in raws.values():
        for i in range(len(r) - length + 1):
            w = r[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = {}
    for d, r in raws.items():
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[d] = (len(r), sum(gone), spans, bytes(x for x, g in zip(r, gone) if not g))
    return out
