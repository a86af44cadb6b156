"""Null and repeated ids, repeated rows, clashing columns and empty tables, for every operator and stage."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linequarry.llm import queries
from linequarry.llm.bpe import bpe_digests
from linequarry.llm.exact import exact_dedup
from linequarry.llm.jaccard import jaccard_groups
from linequarry.llm.neardup import near_vectors
from linequarry.llm.packing import pack, pack_documents
from linequarry.llm.quality import judge_quality, keep_good
from linequarry.llm.secrets import mask_secrets, secret_digests
from linequarry.llm.sharding import shard_documents
from linequarry.llm.suffixes import repeat_removal
from linequarry.llm.wavelet import read_shards, write_shards

A = "The first text of them all is short, and it was written by one and read by many. token=abcdefgh12"
B = "A second text that has other words in it, which nobody has seen before this day in the sun."
ROWS = [(1, A)] * 30 + [(1, B)] * 3 + [(None, A)] * 4 + [(2, A.replace(" ", " \t"))] + [(None, None), (None, "")] + [(3, None)] * 2 + [(None, B + " eyJa.eyJb.c")]
CLASH = "entry key node grp hash uid piece shard _id _mark spans label fill size value kind n total text_hash row dim carried liked spot".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit(f"x{n}") for n, c in enumerate(CLASH)}).repartition(5)


def _sorted(rows):
    return sorted(rows, key=repr)


def test_repeated_rows_are_judged_alike(spark, docs):
    got = judge_quality(docs).collect()
    assert len(got) == len(ROWS) and len({(r.score, r.kept) for r in got}) <= 5
    assert keep_good(docs).columns == docs.columns
    one = spark.createDataFrame([(1, A)] * 3000, "doc_id long, text string")
    assert judge_quality(one).select("kept").distinct().count() == 1


def test_exact(docs):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for d, t in ROWS:
        groups.setdefault(norm(t), []).append(d)
    want = []
    for d, t in ROWS:
        ids = groups[norm(t)]
        keep = min((i for i in ids if i is not None), default=None)
        want.append((d, keep, len(ids), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert _sorted(tuple(r) for r in exact_dedup(docs).collect()) == _sorted(want)


def test_jaccard(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(docs).collect()}
    n = lambda t: max(1, len(t.split()) - 4)
    assert got == {(1, n(A), 1), (1, n(B), 1), (2, n(A), 1), (None, n(A), None), (None, 0, None), (3, 0, 3), (None, n(B) + 1, None)}


def test_tokens(docs):
    plain = bpe_digests(docs).collect()
    assert len(plain) == len(ROWS) and {r.decoded_sha256 for r in plain} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS}
    packed = pack_documents(docs, length=16).collect()
    assert sum(r.length for r in packed) == sum(r.length for r in packed if r.doc_id is not None) + sum(r.length for r in packed if r.doc_id is None)
    assert sum(r.piece == 0 for r in packed) == len(ROWS) and sum(r.doc_id is None and r.piece == 0 for r in packed) == sum(d is None for d, _ in ROWS)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, k in sorted(b):
            assert o == at
            at += k
        assert at <= 16
    read = read_shards(write_shards(docs)).collect()
    assert len(read) == len(ROWS) and sum(r.doc_id is None for r in read) == sum(d is None for d, _ in ROWS)
    ends = sorted((r.start, r.start + r.n_tokens) for r in read)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    order = [r.doc_id for r in sorted(read, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_bins_that_nothing_can_join_leave(spark):
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1100).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32")).repartition(16)
    assert pack(same).select("sequence_id").distinct().count() == 4000
    mixed = same.withColumn("length", F.when(F.col("doc_id") % 2 == 0, 1100).otherwise(948).cast("long"))
    assert pack(mixed).select("sequence_id").distinct().count() <= 2100
    ties = same.withColumn("length", F.lit(512).cast("long"))
    assert pack(ties).select("sequence_id").distinct().count() <= 1005


def test_suffixes_and_secrets(docs):
    got = repeat_removal(docs).collect()
    assert len(got) == len(ROWS) and all(r.n_removed == 0 for r in got)  # all shorter than a string
    found = secret_digests(docs).collect()
    assert len(found) == len(ROWS) and sum(r.n_assign for r in found) == sum((t or "").count("token=") for _, t in ROWS)
    assert sum("jwt:" in r.spans for r in found) == 1
    assert sum("[assign]" in r.text for r in mask_secrets(docs).collect()) == 35


def test_sharding(docs):
    got = shard_documents(docs).collect()
    sizes = [sum(r.shard == k for r in got) for k in range(16)]
    assert sum(sizes) == len(ROWS) and max(sizes) - min(sizes) <= 1
    assert _sorted((r.doc_id, r.size, r.text_crc32) for r in got) == _sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ROWS)
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))


def test_vectors(spark):
    rows = [(1, [1.0, 0.0])] * 5 + [(1, [0.0, 1.0])] + [(None, [1.0, 0.0])] * 2 + [(2, [2.0, 0.1]), (3, None), (4, [-0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in CLASH})
    got = _sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df.repartition(3), recall=0.9999).collect())
    assert got == _sorted([(1, 5, 1, True)] * 5 + [(1, 1, 1, True)] + [(None, 0, None, True)] * 2 + [(2, 5, 1, False), (3, 0, 3, True), (4, 1, 1, False)])


def test_stages(spark, docs):
    now = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    exact = corpus_pipeline.exact(spark, now, "")
    assert exact.columns == now.columns
    assert _sorted({(r.doc_id, r.text) for r in exact.collect()}) == _sorted({(1, A), (1, B), (3, None), (None, B + " eyJa.eyJb.c")})
    near = corpus_pipeline.near(spark, now, "")
    assert near.columns == now.columns and {(r.doc_id, r.text) for r in near.collect()} >= {(1, A), (None, B + " eyJa.eyJb.c"), (3, None)}
    masked = corpus_pipeline.secrets(spark, now, "")
    assert masked.columns == now.columns and masked.count() == len(ROWS)
    empty = now.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, key string")
    for one in (exact_dedup, bpe_digests, repeat_removal, shard_documents, jaccard_groups, secret_digests, judge_quality, pack_documents, mask_secrets):
        assert one(none).count() == 0, one
    assert len(queries.QUERIES) == 13
