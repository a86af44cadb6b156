"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document: each knows one sign of good or of bad text and otherwise
does not vote. How often each combination of votes occurs in the whole corpus is all that expectation-maximisation
needs to estimate, without any true label, how reliable each labeller is and how likely each combination means a good
document. Characters are classed by Unicode category, so signs, capitals and stops count alike in all scripts; only the
list of frequent words knows its languages. These posteriors label a bounded sample (at most TRAIN_ROWS distinct rows, picked by a hash of doc_id and
text however the table is laid out), on which a linear scorer over hashed character-class trigrams and repetition
marks is trained; the scorer judges every document, each by its own row.

Null counts as empty; a text without words scores 0 and is rejected. Repeated rows count in the votes, once in the
sample, and are judged alike; a null doc_id is one like any other. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents, release

#: At most so many documents train the scorer.
TRAIN_ROWS = 6000
#: Hashed features.
WIDTH = 2048
STEPS = 300
#: Documents whose features are held at once.
AT_ONCE = 500
KEEP_FROM = 0.4
#: A shorter text tells less; its score leans to the share of good documents.
ENOUGH_WORDS = 12
#: Frequent short words of the languages the labellers know.
COMMON = frozenset("the of and to in is that it for was on are with as be by at this have from or der die das und in zu den von mit ist des nicht auf für le la les de des et un une que en du pour dans el los las y con por una del se su".split())
_CLASSES = 16
#: The first labellers know signs of bad text, the others signs of good text.
BAD_SIGNS = 8


def _class_table() -> np.ndarray:
    """Character class of each code point of the basic plane, by Unicode category; signs that the labellers ask for have their own."""
    of = {"Ll": 0, "Lm": 0, "Lo": 0, "Mn": 0, "Mc": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3, "Zl": 4, "Zp": 4, "Pd": 12, "Pc": 12, "Ps": 11, "Pe": 11, "Pi": 11, "Pf": 11, "Po": 12}
    kind = np.array([of.get(unicodedata.category(chr(c)), 13) for c in range(0x10000)], np.uint8)
    kind[128:256] = [0 if chr(c).islower() else 1 if chr(c).isupper() else 2 if chr(c).isdigit() else 13 for c in range(128, 256)]
    kind[[ord("\t"), ord("\r"), ord("\n")]] = 3, 4, 4
    for n, some in enumerate((".。｡।", ",，、،", "!！", "?？؟", "|", "#$%&*@~^", "'\"()[]{}<>", "-_/\\:;+=`"), 5):
        for s in some:
            kind[ord(s)] = n
    return kind


_KIND = _class_table()
_SPOT = (np.arange(_CLASSES**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 11)).astype(np.int64)
assert WIDTH == 1 << 11


class Marks:
    """What labellers and scorer see of some documents: class counts, trigram features and word statistics."""

    def __init__(self, texts: list[str], features: bool):
        raws = [t.encode("utf-32-le", "replace") for t in texts]
        sizes = np.array([len(r) // 4 for r in raws], np.int64)
        of = np.repeat(np.arange(len(raws)), sizes)
        points = np.frombuffer(b"".join(raws), "<u4")
        kinds = _KIND[np.minimum(points, 0xFFFF)]  # beyond the basic plane: as its last code point, neither letter nor sign
        kinds[(points >= 0x20000) & (points < 0x40000)] = 0  # ideographs
        # scripts that put no space between words: two characters count as a word
        dense = np.bincount(of[(points >= 0x0E00) & (points < 0x0EE0) | (points >= 0x3040) & (points < 0xA000) | (points >= 0x20000) & (points < 0x40000)], minlength=len(raws)) // 2
        self.n = np.maximum(sizes, 1)
        self.by_class = np.bincount(of * _CLASSES + kinds, minlength=len(raws) * _CLASSES).reshape(-1, _CLASSES)
        words = [t.split() for t in texts]
        self.words = np.maximum(np.array([len(w) for w in words], np.int64), dense)
        some = np.maximum(self.words, 1)
        self.again = np.array([sum(map(eq, w, w[1:])) for w in words]) / some
        self.distinct = np.array([len(set(w)) for w in words]) / some
        self.capital = np.array([sum(map(str.isupper, w)) for w in words]) / some
        self.common = np.array([sum(map(COMMON.__contains__, w)) for w in words]) / some
        if features:
            code = kinds[:-2].astype(np.int64) * 256 + kinds[1:-1].astype(np.int64) * 16 + kinds[2:] if len(kinds) > 2 else np.zeros(0, np.int64)
            inside = of[:-2] == of[2:] if len(kinds) > 2 else np.zeros(0, bool)
            got = np.bincount(of[:-2][inside] * WIDTH + _SPOT[code[inside]], minlength=len(raws) * WIDTH) if len(code) else np.zeros(len(raws) * WIDTH)
            x = got.reshape(-1, WIDTH).astype(np.float32)
            x /= self.n[:, None].astype(np.float32)
            np.sqrt(x, out=x)
            for salt, level in ((1, np.minimum(self.again * 10, 9)), (2, np.minimum(self.distinct * 10, 9)), (3, np.minimum(self.common * 20, 9))):
                spot = ((np.floor(level).astype(np.uint64) + np.uint64(1000 * salt)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(53)).astype(np.int64)
                x[np.arange(len(raws)), spot] += 0.5
            self.x = x

    def votes(self) -> np.ndarray:
        """One column per labeller: 1 good, -1 bad, 0 no vote."""
        c, n, w = self.by_class, self.n, np.maximum(self.words, 1)
        upper = c[:, 1] / np.maximum(c[:, 0] + c[:, 1], 1)
        signs = c[:, 10] + c[:, 7]
        stops = (c[:, 5] + c[:, 6]) / w
        bad = [upper > 0.3, self.capital > 0.3, signs / n > 0.03, signs / w > 0.3, c[:, 9] / n > 0.02, c[:, 9] / w > 0.12, self.again > 0.12, (self.distinct < 0.3) & (w > 20) & (self.again > 0.05)]
        good = [self.common > 0.06, (stops > 0.02) & (stops < 0.5) & (self.distinct > 0.2)]
        return np.stack([-x.astype(np.int8) for x in bad] + [x.astype(np.int8) for x in good], axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, trust: float = 0.01) -> tuple[float, np.ndarray]:
    """Share of good documents and how often each labeller fires on bad and on good ones (labeller, bad/good).

    The first guess says what the labellers are meant for: a sign of bad text is rare in good text and shows in some
    of the bad, a sign of good text shows in nearly all good and half of the bad. It counts as trust x the corpus.
    """
    signs_bad = np.array([n < BAD_SIGNS for n in range(patterns.shape[1])])
    guess = np.stack([np.where(signs_bad, 0.25, 0.5), np.where(signs_bad, 0.01, 0.95)], axis=1)
    share, rate, fired = 0.85, guess, (patterns != 0).astype(float)
    held = trust * counts.sum() + 1
    for _ in range(rounds):
        good = posterior(patterns, share, rate)
        weight = np.stack([counts * (1 - good), counts * good])
        rate = ((weight @ fired).T + guess * held * [1 - share, share]) / (weight.sum(axis=1) + held * np.array([1 - share, share]))
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        share = float((weight[1].sum() + 0.85 * held) / (counts.sum() + held))
    return share, rate


def posterior(patterns: np.ndarray, share: float, rate: np.ndarray) -> np.ndarray:
    """Probability of a good document for each row of votes."""
    fired = (patterns != 0).astype(float)
    odds = np.log(share / (1 - share)) + fired @ np.log(rate[:, 1] / rate[:, 0]) + (1 - fired) @ np.log((1 - rate[:, 1]) / (1 - rate[:, 0]))
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights and, last, bias of a logistic scorer for soft labels y, both classes with equal weight; x is not copied."""
    x = x.astype(np.float32, copy=False)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    pull = (y / share + (1 - y) / (1 - share)).astype(np.float32) / (2 * len(y))
    w, seen = np.zeros(x.shape[1] + 1, np.float32), np.full(x.shape[1] + 1, 1e-8, np.float32)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        off = (pull * (p - y)).astype(np.float32)
        g = np.append(off @ x, off.sum()) + 1e-5 * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return w


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Labeller estimates over all documents and the scorer's weights."""
    docs = documents(docs)

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        seen = Counter(v.tobytes() for v in Marks(b.column("text").to_pylist(), False).votes())
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    rows = arrow_map(docs, count, "votes binary, n long", rows=AT_ONCE).groupBy("votes").agg(F.sum("n").alias("n")).collect()  # at most 2 ** 10
    total = sum(r.n for r in rows)
    if not total:
        return {"share": 0.5, "rate": None, "w": np.zeros(WIDTH + 1, np.float32)}
    patterns = np.stack([np.frombuffer(bytes(r.votes), np.int8) for r in rows]).astype(np.int64)
    share, rate = estimate(patterns, np.array([r.n for r in rows], float))

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        spot, first = np.unique(np.asarray(b.column("spot")), return_index=True)  # a repeated row once
        m = Marks(b.column("text").take(pa.array(first)).to_pylist(), True)
        p = posterior(m.votes().astype(np.int64), share, rate)
        return pa.RecordBatch.from_arrays([pa.array(spot), pa.array([r.astype(np.float16).tobytes() for r in m.x], pa.binary()), pa.array(p)], ["spot", "x", "p"])

    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, n = np.empty((train_rows, WIDTH), np.float32), np.empty(train_rows), 0
        for b in batches:
            for raw, p in zip(b.column("x"), b.column("p").to_pylist()):
                x[n], y[n] = np.frombuffer(raw.as_buffer(), np.float16), p
                n += 1
        w = train(x[:n], y[:n]) if n else np.zeros(WIDTH + 1, np.float32)
        del x
        release()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["n", "w"])

    placed = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 60)).alias("spot"), "text")
    part = min(1.0, 1.1 * train_rows / total)
    while True:
        picked = placed.where(F.col("spot") < int(part * (1 << 60)) + 1)
        sample = arrow_map(picked, features, "spot long, x binary, p double", rows=AT_ONCE).dropDuplicates(["spot"]).orderBy("spot").limit(train_rows)
        # the sample, bounded by train_rows, meets in one task; the driver gets the weights
        got = sample.repartition(1).sortWithinPartitions("spot").mapInArrow(scorer, "n long, w binary").first()
        if part >= 1.0 or got.n >= train_rows // 2:
            break
        part = min(1.0, 8 * part)  # many rows repeat: look further
    return {"share": share, "rate": rate, "w": np.frombuffer(bytes(got.w), np.float32)}


def _judged(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Score and weak label of each text."""
    share, w = model["share"], model["w"]
    m = Marks(texts, True)
    told = np.minimum(m.words / ENOUGH_WORDS, 1.0)
    odds = told * (m.x @ w[:-1] + w[-1]) + (1 - told) * np.log(share / (1 - share))
    p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return np.where(m.words > 0, p, 0.0).astype(np.float64), posterior(m.votes().astype(np.int64), share, model["rate"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (probability of a good document by the scorer), weak_label (posterior of its votes), kept."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        p, weak = _judged(b.column("text").to_pylist(), model)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(weak), pa.array(p >= KEEP_FROM)], ["doc_id", "score", "weak_label", "kept"])

    return arrow_map(documents(docs), one, "doc_id long, score double, weak_label double, kept boolean", rows=AT_ONCE)


def judge_quality(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit on the documents and judge every one of them."""
    return score(docs, fit(docs, train_rows))


def keep_good(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps; each row is judged in its place, nothing is joined."""
    model = fit(docs, train_rows)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(_judged([t or "" for t in b.column("text").to_pylist()], model)[0] >= KEEP_FROM))

    return arrow_map(docs, one, docs.schema, rows=AT_ONCE)
