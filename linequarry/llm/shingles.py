"""Word shingles of texts as 64-bit hashes, in numpy over many texts at once."""

from __future__ import annotations

import numpy as np

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finaliser of the usual kind)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(256)
_PLACE = mixed(np.arange(1, 2 * WORDS + 2, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower-cased A-Z, parted by ASCII white space) in order, and how many each text has."""
    global _POWER
    raws = [t.encode("utf-8") for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(raws), np.int64)
    size = last - first
    if size.max() > len(_POWER):
        _POWER = _powers(int(size.max()) * 2)
    at = np.flatnonzero(inside)
    place = at - np.repeat(first, size)
    value = (_LOWER[data[at]] + np.uint64(1)) * _POWER[place]
    begin = np.cumsum(size) - size
    words = mixed(np.add.reduceat(value, begin) + size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    ends = np.cumsum([len(r) + 1 for r in raws])
    upto = np.searchsorted(first, ends, side="right")
    return words, np.diff(upto, prepend=0)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Per text its sorted distinct shingles; of fewer words the whole sequence is one, without words there is none."""
    hashes, counts = word_hashes(texts)
    whole = np.zeros(0, np.uint64)
    if len(hashes) >= words:
        total = np.full(len(hashes) - words + 1, words, np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for k in range(words):
            total = total + hashes[k : len(hashes) - words + 1 + k] * _PLACE[k]
        whole = mixed(total)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(whole[at : at + n - words + 1]))
        elif n:
            one = n * 0x9FB21C651E98DF25 + int((hashes[at : at + n] * _PLACE[:n]).sum(dtype=np.uint64))
            out.append(mixed(np.array([one & (2**64 - 1)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
