"""Importance resampling towards a target corpus over bucket-partitioned inverted postings.

Words and pairs of neighbouring words are hashed to a fixed number of buckets. Slices of documents emit postings
(bucket, document, count), packed per range of buckets, and the counts of each bucket. Postings are partitioned by
bucket range and by as many parts of each range as its bytes ask for, so no bucket, however common, fills one task.
In each partition the counts of both corpora for the range come first, give the buckets' gains there, and the postings
that follow turn into contributions, one sum per document of a slice; contributions are reduced by slice. The draw
adds a Gumbel number per document, seeded by its id, and takes the highest scores.

Null and empty texts have no words: no features, weight 0. A row without doc_id has a weight but no score and no rank,
and does not count among the documents to draw from. Rows that repeat a doc_id are scored each for itself. With an
empty table nothing is drawn. Other columns are ignored. Very long texts are read in stretches between words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, saved, ship, slices

BUCKETS = 10_000
#: Ranges of buckets; bucket b is in range b % RANGES, so common ones spread.
RANGES = 64
#: Bytes of packed postings in one partition of a range.
PART_BYTES = 64 << 20
#: Bytes and rows of a slice, bytes of text looked at together.
SLICE_BYTES, SLICE_ROWS, STRETCH = 4 << 20, 8000, 4 << 20
#: Words a document needs to be drawn, per cent of those documents drawn, seed of the draw.
LEAST_WORDS, PER_CENT, SEED = 20, 25, 7

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()
#: Words of up to so many bytes are hashed side by side; _PAST[n][k][v]: what byte k with value v of a CRC becomes after n zero bytes.
_SHORT = 64


def _past() -> np.ndarray:
    out = np.empty((_SHORT + 1, 4, 256), np.uint32)
    out[0] = [[v << 8 * k for v in range(256)] for k in range(4)]
    for n in range(_SHORT):
        out[n + 1] = _CRC[out[n] & np.uint32(255)] ^ (out[n] >> np.uint32(8))
    return out


_PAST = _past()


def _word_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, a byte place of all words at a time; long ones by zlib."""
    order = np.argsort(-np.minimum(size, _SHORT + 1), kind="stable")
    at, n = start[order], size[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-n, -_SHORT, side="left"))
    for k in range(int(n[long]) if long < len(n) else 0):
        end = int(np.searchsorted(-n, -k, side="left"))  # words with more than k bytes
        c = crc[long:end]
        crc[long:end] = _CRC[(c ^ data[at[long:end] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(data[at[i] : at[i] + n[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _pair_crcs(left: np.ndarray, right: np.ndarray, size: np.ndarray, data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """CRC-32 of left word, space, right word from the words' own; size and start are of the right word."""
    c = left ^ np.uint32(0xFFFFFFFF)
    c = (_CRC[(c ^ np.uint32(32)) & np.uint32(255)] ^ (c >> np.uint32(8))) ^ np.uint32(0xFFFFFFFF)
    n = np.minimum(size, _SHORT)
    out = right.copy()
    for k in range(4):
        out ^= _PAST[n, k, (c >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(size > _SHORT):
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes(), int(c[i]))
    return out


def _stretches(data: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places that cut the bytes into stretches of about STRETCH, never inside a word."""
    at = 0
    while at < len(data):
        end = min(at + STRETCH, len(data))
        if end < len(data):
            gap = np.flatnonzero(~word[at:end])
            end = at + int(gap[-1]) + 1 if len(gap) else end
            while end < len(data) and word[end - 1] and word[end]:  # one word fills the stretch
                end += 1
        yield at, end
        at = end


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and bucket, text and count of all its features, by bucket and then text."""
    raws = [(t or "").encode("utf-8") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raws])
    data = _LOWER[np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)]
    word = _WORD[data]
    n_words = np.zeros(len(texts), np.int64)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    last_doc, last_crc = -1, np.uint32(0)
    for a, z in _stretches(data, word):
        some = np.flatnonzero(np.diff(word[a:z].astype(np.int8), prepend=0, append=0)) + a
        start, size = some[::2], some[1::2] - some[::2]
        if not len(start):
            continue
        doc = np.searchsorted(ends, start, side="right")
        n_words += np.bincount(doc, minlength=len(texts))
        crc = _word_crcs(data, start, size)
        before = np.concatenate([[last_crc], crc[:-1]]).astype(np.uint32)
        joined = np.concatenate([[last_doc], doc[:-1]]) == doc
        pair = _pair_crcs(before[joined], crc[joined], size[joined], data, start[joined])
        last_doc, last_crc = int(doc[-1]), crc[-1]
        key = np.concatenate([crc % np.uint32(BUCKETS), pair % np.uint32(BUCKETS)]).astype(np.int64) * len(texts) + np.concatenate([doc, doc[joined]])
        key, n = np.unique(key, return_counts=True)
        if len(keys):
            key, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
            n = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
        keys, counts = key, n
    return n_words, keys // max(1, len(texts)), keys % max(1, len(texts)), counts


def _pack(bucket: np.ndarray, doc: np.ndarray, count: np.ndarray) -> bytes:
    """Postings in the order of bucket and document: steps of the document and counts, a byte each where they fit."""
    key = (bucket // RANGES) * np.int64(1 << 20) + doc
    step = np.diff(key, prepend=0)
    small = np.minimum(step, 255).astype(np.uint8)
    few = np.minimum(count, 255).astype(np.uint8)
    far, many = step[step >= 255], count[count >= 255]
    head = np.array([len(step), len(far), len(many)], np.int64)
    raw = b"".join(x.tobytes() for x in (head, far, many, small, few))
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the bucket in its range, document in its slice, count."""
    raw = pa.decompress(raw[8:], int(np.frombuffer(raw[:8], np.int64)[0]), codec="zstd", asbytes=True)
    n, far, many = np.frombuffer(raw[:24], np.int64)
    at = 24 + 8 * int(far + many)
    step = np.frombuffer(raw[at : at + n], np.uint8).astype(np.int64)
    count = np.frombuffer(raw[at + n :], np.uint8).astype(np.int64)
    step[step == 255] = np.frombuffer(raw[24 : 24 + 8 * far], np.int64)
    count[count == 255] = np.frombuffer(raw[24 + 8 * far : at], np.int64)
    key = np.cumsum(step)
    return key >> 20, key & ((1 << 20) - 1), count


#: kind 0: counts of a range's buckets; 1: the rows of a slice; 2: a slice's postings in a range.
_POSTED = "kind int, range int, slice long, body binary, doc_ids binary"
_NAMES = [f.split()[0] for f in _POSTED.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_WIDE = -(-BUCKETS // RANGES)


def _ids(ids: list[int | None]) -> bytes:
    known = np.array([i is not None for i in ids], np.int64)
    return np.concatenate([known, np.array([i or 0 for i in ids], np.int64)]).tobytes()


def postings(texts: DataFrame, with_rows: bool) -> DataFrame:
    """Packed postings, slices and bucket counts of doc_id, text; for the target corpus the counts alone."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, n_slices, total = TaskContext.get().partitionId(), 0, np.zeros(_WIDE * RANGES, np.int64)
        for b in slices(batches, SLICE_BYTES, SLICE_ROWS):
            n_words, bucket, doc, count = features(b.column("text").to_pylist())
            total += np.bincount(bucket, count, minlength=len(total)).astype(np.int64)
            if not with_rows:
                continue
            slice_, n_slices = here << 32 | n_slices, n_slices + 1
            rows = [(1, -1, slice_, n_words.tobytes(), _ids(b.column("doc_id").to_pylist()))]
            by = np.argsort(bucket % RANGES, kind="stable")
            cut = np.searchsorted((bucket % RANGES)[by], np.arange(RANGES + 1))
            for r in range(RANGES):
                p = by[cut[r] : cut[r + 1]]
                if len(p):
                    rows.append((2, r, slice_, _pack(bucket[p], doc[p], count[p]), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)
        if total.any():
            rows = [(0, r, None, total[r::RANGES].tobytes(), None) for r in range(RANGES)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)

    return texts.select("doc_id", "text").mapInArrow(run, _POSTED)


def _summed(posted: DataFrame) -> DataFrame:
    """One row per range with the counts of its buckets added up, by partial sums over the tasks' rows."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [np.frombuffer(x, np.int64) for x in b.column("body").to_pylist()]
        n = len(out)
        place = np.tile(np.arange(_WIDE, dtype=np.int32), n)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column("range")), _WIDE)), pa.array(place), pa.array(np.concatenate(out))], ["range", "place", "n"])

    return arrow_map(posted.where("kind = 0").select("range", "body"), one, "range int, place int, n long").groupBy("range", "place").agg(F.sum("n").alias("n"))


def gains(own: np.ndarray, wanted: np.ndarray, own_total: int, wanted_total: int) -> np.ndarray:
    """Whole thousandths of the log ratio of a bucket's smoothed shares in the target and in the documents."""
    ratio = (wanted + 1).astype(np.float64) * np.float64(own_total + BUCKETS) / ((own + 1).astype(np.float64) * np.float64(wanted_total + BUCKETS))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def _contributions(cells: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """kind, slice, body: sums of gain times count for the documents of a slice, from partitions sorted by cell and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, gain = None, None
        for b in slices(batches, 8 << 20, 4000):
            out = []
            for row in b.to_pylist():
                if (row["range"], row["part"]) != cell:  # its counts come first
                    cell, gain = (row["range"], row["part"]), None
                if row["kind"] == 0:
                    own, wanted = np.array(row["counts"], np.int64).reshape(2, -1)
                    gain = gains(own, wanted, *totals)
                else:
                    place, doc, count = _unpack(row["body"])
                    sums = np.bincount(doc, gain[place] * count).astype(np.int64)  # whole numbers far below 2**53
                    out.append((3, row["slice"], sums.astype(np.int32 if abs(sums).max(initial=0) < 2**31 else np.int64).tobytes(), len(sums)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int32(), pa.int64(), pa.binary(), pa.int32()])], ["kind", "slice", "body", "n"])

    return cells.mapInArrow(run, "kind int, slice long, body binary, n int")


def _reduced(parts: DataFrame) -> DataFrame:
    """doc_id, n_words, total of the rows of each slice, from partitions sorted by slice and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def rows() -> pa.RecordBatch:
            ids, n_words, total = held
            known, value = np.frombuffer(ids, np.int64).reshape(2, -1)
            return pa.RecordBatch.from_arrays([pa.array(value, mask=known == 0), pa.array(n_words), pa.array(total)], ["doc_id", "n_words", "total"])

        for b in slices(batches, 8 << 20, 4000):
            for row in b.to_pylist():
                if row["kind"] == 1:
                    if held is not None:
                        yield rows()
                    n_words = np.frombuffer(row["body"], np.int64)
                    held = (row["doc_ids"], n_words, np.zeros(len(n_words), np.int64))
                else:
                    sums = np.frombuffer(row["body"], np.int32 if len(row["body"]) == 4 * row["n"] else np.int64)
                    held[2][: len(sums)] += sums
        if held is not None:
            yield rows()

    return parts.mapInArrow(run, "doc_id long, n_words long, total long")


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of docs (doc_id, text) against target (text)."""
    spark = docs.sparkSession
    ship(spark)
    own = saved(postings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), True), "resample-postings")
    wanted = postings(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), False)
    counts = _summed(own).select("range", "place", "n", F.lit(0).cast("long").alias("t")).unionAll(_summed(wanted).select("range", "place", F.lit(0).cast("long").alias("n"), F.col("n").alias("t")))
    counts = saved(counts.groupBy("range", "place").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "resample-counts")  # a row per bucket: BUCKETS rows
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    sizes = {r.range: r.size for r in own.where("kind = 2").groupBy("range").agg(F.sum(F.octet_length("body")).alias("size")).collect()}  # RANGES rows
    parts = [1 + sizes.get(r, 0) // PART_BYTES for r in range(RANGES)]
    n_parts = F.array(*[F.lit(int(p)) for p in parts])[F.col("range")]

    place = F.sort_array(F.collect_list(F.struct("place", "n", "t")))  # a range has BUCKETS / RANGES places
    first = counts.groupBy("range").agg(place.alias("c")).select("range", F.concat("c.n", "c.t").alias("counts"))
    first = first.select(F.lit(0).alias("kind"), "range", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"), F.lit(None).cast("long").alias("slice"), F.lit(None).cast("binary").alias("body"), "counts")
    posted = own.where("kind = 2").select("kind", "range", F.pmod(F.xxhash64("slice"), n_parts).cast("int").alias("part"), "slice", "body", F.lit(None).cast("array<long>").alias("counts"))
    n_cells = sum(parts)
    cells = first.unionAll(posted).repartition(n_cells, "range", "part").sortWithinPartitions("range", "part", "kind")
    given = _contributions(cells, (int(totals[0]), int(totals[1]))).withColumn("doc_ids", F.lit(None).cast("binary"))
    members = own.where("kind = 1").select("kind", "slice", "body", F.lit(0).alias("n"), "doc_ids")
    both = members.unionAll(given.select("kind", "slice", "body", "n", "doc_ids")).repartition("slice").sortWithinPartitions("slice", "kind")
    n_features = F.greatest(F.lit(0).cast("long"), 2 * F.col("n_words") - 1)
    # whole-number division rounds towards zero: step down where it left a negative rest
    mean = F.when(F.col("n_words") > 0, F.expr("total div n_features - CASE WHEN total % n_features < 0 THEN 1 ELSE 0 END")).otherwise(0)
    return _reduced(both).withColumn("n_features", n_features).select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def score(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """The weight and a Gumbel number in thousandths, seeded by the doc_id; null without one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    """rows with rank 1 to n in the order of score downwards and doc_id; null for the rest.

    Ranges of that order are numbered apart; one count per range brings them together.
    """
    key = [F.col("score").desc(), F.col("doc_id").asc()]
    schema = ", ".join([f"{name} {kind}" for name, kind in rows.dtypes] + ["range int", "place long"])
    names = [*rows.columns, "range", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, at = TaskContext.get().partitionId(), 0
        for b in batches:
            place = np.arange(at + 1, at + b.num_rows + 1)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, here, np.int32)), pa.array(place)], names)

    placed = saved(rows.repartitionByRange(*key, "row").sortWithinPartitions(*key, "row").mapInArrow(run, schema), "resample-order")
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))  # a row per range
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.join(F.broadcast(counts.select("range", before.alias("before"))), "range")
    at = F.col("before") + F.col("place")
    return ranked.withColumn("rank", F.when(at <= n, at)).drop("range", "place", "before")


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null where not drawn)."""
    scored = weights(docs, target).withColumn("score", score(F.col("doc_id"), F.col("weight"), seed))
    scored = saved(scored.withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    n = scored.where(able).count() * per_cent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = _ranked(scored.where(able), n).select(*columns, "rank")
    return drawn.unionAll(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


SQL = r"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(0, 256) r(i)),
words AS (
  SELECT 0 AS corpus, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
feats AS (SELECT corpus, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
named AS (SELECT DISTINCT f FROM feats),
hexed AS (SELECT f, hex(encode(f)) AS h FROM named),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
                            lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM hexed, tab),
counted AS (SELECT corpus, id, bucket, count(*) AS n FROM feats JOIN hashed USING (f) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (corpus = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (corpus = 1), 0)::BIGINT AS t FROM counted GROUP BY bucket),
totals AS (SELECT sum(s)::BIGINT AS sall, sum(t)::BIGINT AS tall FROM b),
g AS (SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1)::DOUBLE * (sall + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tall + 10000)::DOUBLE)))::BIGINT AS gain FROM b, totals),
per AS (SELECT id AS doc_id, sum(n)::BIGINT AS nf, sum(n * gain)::BIGINT AS total FROM counted JOIN g USING (bucket) WHERE corpus = 0 GROUP BY id),
d AS (
  SELECT documents.doc_id, coalesce(nf, 0) AS n_features, coalesce(total // nf - CASE WHEN total % nf < 0 THEN 1 ELSE 0 END, 0) AS weight
  FROM documents LEFT JOIN per ON per.doc_id = documents.doc_id),
sc AS (
  SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score, n_features >= 39 AS able FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""
