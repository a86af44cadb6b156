"""Token-id shards as wavelet matrices: succinct bit planes with rank and select, written and read as files.

Documents are put in ascending doc_id order (rows without one first, repeated ids as the table has them), encoded,
each followed by the end id 0, and written as shards, one file per range of that order; rows that repeat one id are
spread over as many ranges as they need. A file holds one or more segments of bounded length; a segment
is a wavelet matrix: one bit plane per bit of the ids, most significant first, each plane in the stable order left
by the planes above it, with the ones counted before every block of bits. Access, counting and finding occurrences
read that one file; whole segments decode plane by plane. Over a whole shard file lookups go to the segments that
hold the answer: places by where segments begin, tokens by how often earlier segments of the file hold them.

Null text counts as empty and gives the end id alone; an empty table gives no file and no row. Other columns are ignored.
Of lookups, repeated ones are answered once, and those beyond a shard's end (or of a null shard, token or place) give no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, documents, saved, ship
from .tokens import encoder, vocabulary

FILE = "byte_bpe_50k.json"
#: Ids in a segment (a longer document makes a longer one).
SEGMENT = 500_000
#: Bits between two entries of the rank table.
BLOCK = 512
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class WaveletMatrix:
    """Bit planes over a sequence of ids below 2**bits."""

    def __init__(self, n: int, bits: int, planes: np.ndarray, zeros: np.ndarray, ranks: np.ndarray):
        self.n, self.bits, self.planes, self.zeros, self.ranks = n, bits, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        vals = ids.astype(kind)
        n = len(vals)
        width = -(-n // BLOCK) * (BLOCK // 8)
        planes = np.zeros((bits, width), np.uint8)
        zeros = np.zeros(bits, np.int64)
        for k in range(bits):
            one = (vals & kind(1 << (bits - 1 - k))) != 0
            packed = np.packbits(one)
            planes[k, : len(packed)] = packed
            low = np.compress(~one, vals)
            zeros[k] = len(low)
            vals = np.concatenate([low, np.compress(one, vals)])
        ranks = np.zeros((bits, width * 8 // BLOCK + 1), np.uint32)
        if n:
            np.cumsum(_ONES[planes].reshape(bits, -1, BLOCK // 8).sum(axis=2, dtype=np.uint32), axis=1, out=ranks[:, 1:])
        return cls(n, bits, planes, zeros, ranks)

    def ids(self) -> np.ndarray:
        """The whole sequence, from the last plane up: each plane tells which half an id came from."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        vals = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n).view(bool)
            above = np.empty(self.n, kind)
            z = int(self.zeros[k])
            above[np.flatnonzero(~one)] = vals[:z]
            above[np.flatnonzero(one)] = vals[z:] | kind(1 << (self.bits - 1 - k))
            vals = above
        return vals

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        block = i // BLOCK
        first = block * (BLOCK // 8)
        full = int(self.ranks[k, block]) + int(_ONES[self.planes[k, first : i // 8]].sum())
        return full + (int(_ONES[self.planes[k, i // 8] >> (8 - i % 8)]) if i % 8 else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        out = 0
        for k in range(self.bits):
            one = self.planes[k, i // 8] >> (7 - i % 8) & 1
            before = self._ones(k, i)
            out = out << 1 | int(one)
            i = int(self.zeros[k]) + before if one else i - before
        return out

    def _span(self, token: int, end: int) -> tuple[int, int]:
        a, b = 0, end
        for k in range(self.bits):
            x, y = self._ones(k, a), self._ones(k, b)
            a, b = (int(self.zeros[k]) + x, int(self.zeros[k]) + y) if token >> (self.bits - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, end: int) -> int:
        """How often token stands before place end."""
        if token >> self.bits:
            return 0
        a, b = self._span(token, end)
        return b - a

    def select(self, token: int, nth: int) -> int:
        """Place of the nth (from 0) token, -1 if there are fewer."""
        if self.rank(token, self.n) <= nth:
            return -1
        i = self._span(token, self.n)[0] + nth
        for k in range(self.bits - 1, -1, -1):
            want = token >> (self.bits - 1 - k) & 1
            nth_in = i - int(self.zeros[k]) if want else i
            a, b = 0, self.n
            while a < b:  # the place before which there are nth_in of that bit, at which one stands
                m = (a + b) // 2
                ones = self._ones(k, m + 1)
                if (ones if want else m + 1 - ones) > nth_in:
                    b = m
                else:
                    a = m + 1
            i = a
        return i

    def occurrences(self, token: int) -> list[int]:
        """All places of token, ascending: its run in the last order, carried up plane by plane at once."""
        if token >> self.bits:
            return []
        at = np.arange(*self._span(token, self.n))
        for k in range(self.bits - 1, -1, -1):
            want = token >> (self.bits - 1 - k) & 1
            if not len(at):
                return []
            held = np.flatnonzero(np.unpackbits(self.planes[k], count=self.n) == want)
            at = held[at - int(self.zeros[k]) if want else at]
        return at.tolist()


_SEGMENT = "shard int, segment int, before long, n_ids long, unnamed int, bits int, doc_ids binary, counts binary, planes binary, zeros binary, ranks binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
_NAMES = [f.split()[0] for f in _SEGMENT.split(", ")]


def opened(row: dict) -> WaveletMatrix:
    """The wavelet matrix of one row of a shard file."""
    bits = row["bits"]
    cut = lambda name, kind: np.frombuffer(row[name], kind).reshape(bits, -1)
    return WaveletMatrix(row["n_ids"], bits, cut("planes", np.uint8), np.frombuffer(row["zeros"], np.int64), cut("ranks", np.uint32))


def write_shards(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and write shard files to the shared folder; returns them read back, a row per segment."""
    path = path or vocabulary(FILE)
    docs = documents(docs)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import slices

        own = encoder(path, True)
        bits = max(1, (own.lib.get_vocab_size(True) - 1).bit_length())
        shard, segment, before, held, docs_held, total = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, before, held, docs_held, total
            ids = np.concatenate(held)
            w = WaveletMatrix.build(ids, bits)
            unnamed = docs_held.count(None)  # these come first
            doc_ids, counts = np.array(docs_held[unnamed:], np.int64), np.array([len(h) for h in held], np.int64)
            row = (shard, segment, before, len(ids), unnamed, bits, doc_ids.tobytes(), counts.tobytes(), w.planes.tobytes(), w.zeros.tobytes(), w.ranks.tobytes())
            segment, before, held, docs_held, total = segment + 1, before + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _KINDS)], _NAMES)

        end = b"\0\0\0\0"
        for b in slices(batches, keep=True):
            for doc, raw in zip(b.column("doc_id").to_pylist(), own.encode(b.column("text").to_pylist())):
                ids = np.frombuffer(raw + end, "<u4")
                if total and total + len(ids) > SEGMENT:
                    yield flush()
                held.append(ids.astype(np.uint16) if bits <= 16 else ids)
                docs_held.append(doc)
                total += len(ids)
        if total:
            yield flush()

    key = ["doc_id", "row"]
    keyed = docs.withColumn("row", F.monotonically_increasing_id())
    return saved(keyed.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text").mapInArrow(run, _SEGMENT), "wavelet")


def read_shards(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. The driver adds up one total per shard."""
    starts, at = {}, 0
    for shard, n in sorted((r.shard, r.n) for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):  # ranges ascend
        starts[shard], at = at, at + n
    where = files.sparkSession.sparkContext.broadcast(starts)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for row in b.to_pylist():
            ids = opened(row).ids()
            counts = np.frombuffer(row["counts"], np.int64)
            ends = np.cumsum(counts)
            first = where.value[row["shard"]] + row["before"]
            raw = memoryview(ids.astype("<u4")).cast("B")
            out[0] += [None] * row["unnamed"] + np.frombuffer(row["doc_ids"], np.int64).tolist()
            out[1] += (first + ends - counts).tolist()
            out[2] += counts.tolist()
            out[3] += [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(files, one, "doc_id long, start long, n_tokens long, ids_crc32 long", rows=1, keep=True)


#: Lookups that meet a segment in one task; more are answered in several tasks, each with the segment.
ASKS = 100_000
_ANSWER = "shard int, segment int, token int, arg long, answer long"


def _answers(files: DataFrame, asks: DataFrame, how: str) -> DataFrame:
    """Ask segments. asks: shard, segment, token, arg. how: count, rank, select, access (arg a place or number within the
    segment) or occurrences (a row per place)."""
    here = ["shard", "segment"]
    asks = asks.select(*here, F.col("token").cast("int").alias("token"), F.col("arg").cast("long").alias("arg")).distinct()
    parts = asks.groupBy(*here).agg(F.ceil(F.count("*") / F.lit(ASKS)).cast("int").alias("_parts"))
    dealt = asks.join(parts, here).withColumn("_part", F.pmod(F.xxhash64("token", "arg"), "_parts").cast("int")).drop("_parts")
    held = files.join(parts, here).withColumn("_of", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    held = held.withColumnsRenamed({"shard": "_shard", "segment": "_segment"})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0]
        w = opened(row)
        tokens, args = left.column("token").to_pylist(), left.column("arg").to_pylist()
        if how == "occurrences":
            found = [w.occurrences(t) for t in tokens]
            tokens, args = [t for t, f in zip(tokens, found) for _ in f], [k for f in found for k in range(len(f))]
            out = [p for f in found for p in f]
        elif how == "access":
            out = [w.access(i) for i in args]
        elif how == "select":
            out = [w.select(t, k) for t, k in zip(tokens, args)]
        else:
            out = [w.rank(t, w.n if how == "count" else i) for t, i in zip(tokens, args)]
        columns = [pa.array([row["_" + c]] * len(out), pa.int32()) for c in here]
        return pa.Table.from_arrays([*columns, pa.array(tokens, pa.int32()), pa.array(args, pa.int64()), pa.array(out, pa.int64())], ["shard", "segment", "token", "arg", "answer"])

    return dealt.groupBy(*here, "_part").cogroup(held.groupBy("_shard", "_segment", "_of")).applyInArrow(run, _ANSWER)


def _bounds(files: DataFrame) -> DataFrame:
    """Where segments begin in their shard, as one array a shard (16 bytes for each 500,000 ids or longer document)."""
    return files.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("before", "segment", "n_ids"))).alias("_at"))


def _placed(files: DataFrame, asks: DataFrame, place: str) -> DataFrame:
    """Adds segment and arg, the place within it, to asks about places of a shard."""
    mine = F.filter("_at", lambda s: (s["before"] <= F.col(place)) & (F.col(place) < s["before"] + s["n_ids"]))
    inside = asks.join(_bounds(files), "shard").withColumn("_s", F.get(mine, F.lit(0)))
    return inside.where("_s is not null").withColumn("segment", F.col("_s.segment")).withColumn("arg", F.col(place) - F.col("_s.before")).drop("_at", "_s")


def token_segments(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """tokens (shard, token): for each segment of the shard how often it holds the token, and how often earlier ones do.

    shard, segment, before (place where the segment begins in its shard), token, n, earlier. A window covers the
    segments of one shard for one token.
    """
    asks = tokens.select("shard", "token").where("token is not null").distinct().join(files.select("shard", "segment"), "shard")
    counts = _answers(files, asks.withColumn("arg", F.lit(0)), "count")
    earlier = F.coalesce(F.sum("answer").over(Window.partitionBy("shard", "token").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = files.select("shard", "segment", "before")
    return counts.withColumn("earlier", earlier).join(begun, ["shard", "segment"]).select("shard", "segment", "before", "token", F.col("answer").alias("n"), "earlier")


def ids_at(files: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (shard, place): the id that stands there. shard, place, token."""
    placed = saved(_placed(files, asks.select("shard", "place").distinct(), "place"), "wavelet-asks")
    got = _answers(files, placed.withColumn("token", F.lit(0)), "access").select("shard", "segment", "arg", "answer")
    return placed.join(got, ["shard", "segment", "arg"]).select("shard", "place", F.col("answer").cast("int").alias("token"))


def ranks(files: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (shard, token, end): how often token stands before place end of the shard (from 0 to its length). Adds rank."""
    asks = asks.select("shard", F.col("token").cast("int").alias("token"), F.col("end").cast("long").alias("end")).where("token is not null and end >= 0").distinct()
    lengths = files.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    asks = asks.join(lengths, "shard").where("end <= _n").drop("_n")
    last = F.greatest(F.col("end") - 1, F.lit(0))  # place `end` itself may be where the shard ends
    placed = _placed(files, asks.withColumn("_last", last), "_last").withColumn("arg", F.col("arg") + F.col("end") - F.col("_last")).drop("_last")
    placed = saved(placed, "wavelet-asks")
    got = _answers(files, placed, "rank").select("shard", "segment", "token", "arg", "answer")
    before = token_segments(files, placed.select("shard", "token")).select("shard", "segment", "token", "earlier")
    return placed.join(got, ["shard", "segment", "token", "arg"]).join(before, ["shard", "segment", "token"]).select("shard", "token", "end", (F.col("answer") + F.col("earlier")).alias("rank"))


def nth_places(files: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (shard, token, nth, from 0): the place of the nth token in the shard; no row where it has fewer. Adds place."""
    asks = asks.select("shard", F.col("token").cast("int").alias("token"), F.col("nth").cast("long").alias("nth")).distinct()
    held = asks.join(token_segments(files, asks), ["shard", "token"]).where("earlier <= nth and nth < earlier + n")
    held = saved(held.withColumn("arg", F.col("nth") - F.col("earlier")), "wavelet-asks")
    got = _answers(files, held, "select").select("shard", "segment", "token", "arg", "answer")
    return held.join(got, ["shard", "segment", "token", "arg"]).select("shard", "token", "nth", (F.col("before") + F.col("answer")).alias("place"))


def token_places(files: DataFrame, tokens: list[int]) -> DataFrame:
    """Every occurrence of the given ids in all shards. shard, token, nth (from 0 within the shard), place."""
    asks = files.select("shard").distinct().withColumn("token", F.explode(F.array(*map(F.lit, tokens)).cast("array<int>")))
    held = saved(token_segments(files, asks).where("n > 0"), "wavelet-asks")
    got = _answers(files, held.withColumn("arg", F.lit(0)), "occurrences").withColumnRenamed("arg", "_k")
    return got.join(held, ["shard", "segment", "token"]).select("shard", "token", (F.col("earlier") + F.col("_k")).alias("nth"), (F.col("before") + F.col("answer")).alias("place"))
