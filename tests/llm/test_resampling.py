"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linequarry.llm import resampling
from linequarry.llm.resampling import features, resample

from .rows import no_docs, odd_docs

TARGET = "item_id long, text string, range int, kind int"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def counted(text):
    w = words(text)
    return Counter(zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])


def plain(docs, target):
    own, wanted = Counter(), Counter()
    for _, t in docs:
        own.update(counted(t))
    for t in target:
        wanted.update(counted(t))
    s_all, t_all = sum(own.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((own[b] + 1) * (t_all + 10_000))))
    rows = []
    for d, t in docs:
        c = counted(t)
        n = sum(c.values())
        weight = sum(gain(b) * k for b, k in c.items()) // n if n else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, n, weight, score, None, len(words(t))])
    able = sorted((r for r in rows if r[0] is not None and r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def _got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in df.dtypes} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _text(r, n):
    return " ".join(r.choice(["alpha", "Beta", "gamma", "日本語", "x" * 70, "y" * 64, "z" * 65, "naïve", "a1b2", "3", "it's", "end."]) for _ in range(n))


@pytest.mark.parametrize("stretch", [40, 1 << 20])
def test_features(monkeypatch, stretch):
    monkeypatch.setattr(resampling, "STRETCH", stretch)
    r = random.Random(1)
    texts = [None, "", " ", "one", "One ONE one", "w" * 500, *[_text(r, n) for n in (1, 2, 30, 400)], "é\x00b\x7fc{d`e"]
    n_words, bucket, doc, count = features(texts)
    assert n_words.tolist() == [len(words(t)) for t in texts]
    want = {(b, d): n for d, t in enumerate(texts) for b, n in counted(t).items()}
    assert dict(zip(zip(bucket.tolist(), doc.tolist()), count.tolist())) == want
    packed = resampling._pack(bucket, doc, count)
    # buckets of one range at a time
    some = bucket % resampling.RANGES == bucket[0] % resampling.RANGES
    place, docs, counts = resampling._unpack(resampling._pack(bucket[some], doc[some], count[some]))
    assert (place == bucket[some] // resampling.RANGES).all() and (docs == doc[some]).all() and (counts == count[some]).all() and packed


def test_counts_beyond_a_byte():
    bucket, doc, count = np.array([0, 0, 64, 64]), np.array([3, 900, 0, 7999]), np.array([1, 255, 256, 10**10])
    assert [x.tolist() for x in resampling._unpack(resampling._pack(bucket, doc, count))] == [[0, 0, 1, 1], doc.tolist(), count.tolist()]


def test_plain_version(spark, monkeypatch):
    r = random.Random(5)
    docs = [(n, _text(r, r.choice([0, 3, 19, 20, 21, 60]))) for n in range(400)] + [(None, _text(r, 30)), (None, None), (1, _text(r, 40)), (2, ""), (1, "alpha " * 25)]
    target = [_text(r, 30) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(4) for c in ("kind", "range", "slice", "part", "row", "rank", "score", "n", "body")})
    aim = spark.createDataFrame([(n, t, 1, 2) for n, t in enumerate(target)], TARGET)
    assert _got(resample(df.repartition(3), aim)) == plain(docs, target)
    monkeypatch.setattr(resampling, "PART_BYTES", 2000)  # several parts of a range
    assert _got(resample(df.repartition(5), aim)) == plain(docs, target)


def test_hot_texts_and_ties(spark):
    docs = [(n, "the same words again and again " * 5) for n in range(600)] + [(n, f"rare{n} " * 25) for n in range(600, 900)]
    assert _got(resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(1, "rare700 words", 1, 1)], TARGET))) == plain(docs, ["rare700 words"])


def test_odd_and_empty(spark):
    df, rows = odd_docs(spark)
    aim = spark.createDataFrame([(1, "plain text with stops", 1, 1)], TARGET)
    assert _got(resample(df, aim)) == plain([x[:2] for x in rows], ["plain text with stops"])
    assert resample(no_docs(spark), aim).collect() == []
    none = spark.createDataFrame([], TARGET)
    assert _got(resample(df, none)) == plain([x[:2] for x in rows], [])
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert _got(resample(blank, none)) == plain([(1, None), (2, " ")], [])
