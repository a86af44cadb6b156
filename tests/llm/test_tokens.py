import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linequarry.llm.bpe import BacktrackingBPE, bpe_digests, bpe_round_trip
from linequarry.llm.packing import best_fit, pack_documents
from linequarry.llm.tokens import ChunkEncoder
from pyspark.sql import functions as F

from linequarry.llm import wavelet
from linequarry.llm.wavelet import WaveletMatrix, ids_at, nth_places, opened, ranks, read_shards, token_places, token_segments, write_shards

from .rows import no_docs, odd_docs

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def own():
    return BacktrackingBPE(BYTE)


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab c\n.'seE é", max_size=60), st.text("theingdouanr", min_size=20, max_size=200)))
def test_backtracking_gives_the_library_ids(own, lib, text):
    ids = own.encode(text)
    assert ids == lib.encode(text, add_special_tokens=False).ids
    assert own.decode(np.array(ids, np.int64)) == lib.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_any_ids_decode_as_the_library_does(own, lib, ids):
    assert own.decode(np.array(ids, np.int64)) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab c\n.,'sT é1\t", max_size=60), min_size=1, max_size=4))
def test_chunks_give_the_library_ids(texts):
    for path, space in ((BYTE, True), (WORD, False)):
        want = [_LIB[path].encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(r, "<u4").tolist() for r in _CHUNKS[path].encode(texts)] == want


_LIB = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
_CHUNKS = {BYTE: ChunkEncoder(BYTE, True), WORD: ChunkEncoder(WORD, False)}


def test_digests(spark, lib):
    df, rows = odd_docs(spark)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digests(df).collect()}
    for d, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert got[d] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe_digests(no_docs(spark)).count() == 0
    assert {r.doc_id: r.decoded for r in bpe_round_trip(df).collect()} == {d: t or "" for d, t, *_ in rows}


def test_packing(spark):
    df, rows = odd_docs(spark)
    out = pack_documents(df.repartition(3), length=64).collect()
    lib = _LIB[WORD]
    want = {}
    for d, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4")
            want[d, k] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    total = sum(n for _, n, _ in want.values())
    assert len(bins) <= -(-total // 64) + 2
    assert pack_documents(no_docs(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_fills_every_item_once(sizes):
    bins = best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= 2 * -(-sum(sizes) // 50) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500), st.sampled_from([6, 16, 17]))
def test_wavelet_matrix(ids, bits):
    w = WaveletMatrix.build(np.array(ids, np.int64), bits)
    assert w.ids().tolist() == ids
    for i in range(0, len(ids), 97):
        assert w.access(i) == ids[i]
        assert w.rank(ids[i], i) == ids[:i].count(ids[i])
    for t in {0, 7, 40, 41}:
        places = [i for i, x in enumerate(ids) if x == t]
        assert w.rank(t, len(ids)) == len(places) and w.select(t, len(places)) == -1
        if len(places) < 50:
            assert w.occurrences(t) == places


def test_shards(spark, lib):
    df, rows = odd_docs(spark)
    files = write_shards(df.repartition(4))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_shards(files).collect()}
    at = 0
    for d, t, *_ in sorted(rows):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    row = files.first().asDict()
    assert opened(row).access(0) == opened(row).ids()[0]
    assert read_shards(write_shards(no_docs(spark))).count() == 0


def test_lookups_over_shard_files_of_several_segments(spark, lib, monkeypatch):
    """Access, rank, select and occurrences over whole shard files, against the ids in plain lists."""
    monkeypatch.setattr(wavelet, "SEGMENT", 300)
    monkeypatch.setattr(wavelet, "ASKS", 40)
    texts = ["the cat sat on the mat and the dog", None, "", "a dog and a cat " * 40, "none of these"] * 25
    files = write_shards(spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").repartition(3))
    plain = {}
    for r in sorted(files.collect(), key=lambda r: (r.shard, r.segment)):
        plain.setdefault(r.shard, []).extend(opened(r.asDict()).ids().tolist())
    every = [i for t in texts for i in [*lib.encode(t or "", add_special_tokens=False).ids, 0]]
    assert [i for s in sorted(plain) for i in plain[s]] == every and files.groupBy("shard").count().where("count > 3").count() > 0
    common = sorted(set(every), key=every.count)[-4:]
    tokens = [*common, 0, 49_999]
    got = sorted(map(tuple, token_places(files, tokens).collect()))
    want = sorted((s, t, k, p) for s, ids in plain.items() for t in set(tokens) for k, p in enumerate([p for p, i in enumerate(ids) if i == t]))
    assert got == want
    asks = [(s, p) for s, ids in plain.items() for p in [*range(0, len(ids), 53), len(ids) - 1, len(ids), -1, None]] + [(99, 0), (None, 1)]
    found = ids_at(files, spark.createDataFrame(asks + asks, "shard int, place long")).collect()
    assert sorted(map(tuple, found)) == sorted((s, p, plain[s][p]) for s, p in asks if s in plain and p is not None and 0 <= p < len(plain[s]))
    asks = [(s, t, e) for s, ids in plain.items() for t in tokens for e in [*range(0, len(ids), 211), len(ids), len(ids) + 1, None]]
    found = ranks(files, spark.createDataFrame(asks + asks, "shard int, token int, end long")).collect()
    assert sorted(map(tuple, found)) == sorted((s, t, e, plain[s][:e].count(t)) for s, t, e in set(asks) if e is not None and e <= len(plain[s]))
    asks = [(s, t, k) for s, ids in plain.items() for t in tokens for k in [*range(0, ids.count(t) + 2, 17), ids.count(t) - 1, ids.count(t), -1]] + [(0, None, 1), (0, 5, None)]
    found = nth_places(files, spark.createDataFrame(asks, "shard int, token int, nth long")).collect()
    held = {(s, t): [p for p, i in enumerate(ids) if i == t] for s, ids in plain.items() for t in tokens}
    assert sorted(map(tuple, found)) == sorted((s, t, k, held[s, t][k]) for s, t, k in set(asks) if (s, t) in held and k is not None and 0 <= k < len(held[s, t]))
    counts = token_segments(files, spark.createDataFrame([(s, t) for s in plain for t in common], "shard int, token int")).groupBy("shard", "token").agg(F.sum("n").alias("n")).collect()
    assert {(r.shard, r.token): r.n for r in counts} == {(s, t): ids.count(t) for s, ids in plain.items() for t in common}
    assert token_places(write_shards(no_docs(spark)), [0]).count() == 0


def test_chunks_that_are_forgotten_are_found_anew():
    import random

    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 30))) for _ in range(300)]
    texts += ["", "x" * 70000, "a.\nb", " ", "  ", "z " * 50]
    for path, space in ((BYTE, True), (WORD, False)):
        some = ChunkEncoder(path, space)
        some.most = 200
        for _ in range(2):
            got = [x for at in range(0, len(texts), 37) for x in some.encode(texts[at : at + 37])]
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [_LIB[path].encode(t, add_special_tokens=False).ids for t in texts]
        assert some.n < 5000
