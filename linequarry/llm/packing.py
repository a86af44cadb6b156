"""Best-fit packing of tokenised documents into sequences of bounded length, by hierarchical residual packing.

Each partition packs its own pieces best-fit, longest first. Bins that are nearly full leave at once, and so do those
that not even the emptiest bin left could join; the others are items of the next level, where several groups' items
meet and are packed best-fit again, and so on up a tree until one group is left or nothing fits together. A bin that
becomes an item keeps its members together. After best-fit at most one bin of a packing is half empty, so FAN_IN
groups bring about as many guests, and of the bins that are equally full no more than that many can ever be needed:
the others leave, which bounds every group by FAN_IN bins for each fill and group below.

Null text counts as empty; every document has its end id, so an empty one is a piece of length 1. Repeated rows
are packed each for itself, rows without doc_id likewise. Equal lengths go in the order doc_id, piece. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents, saved, ship
from .tokens import encoder, vocabulary

FILE = "word_bpe_49k.json"
LENGTH = 2048
#: A bin whose free room is at most this share of it leaves its level.
NEARLY = 0.01
#: Groups of the level below that meet in one group.
FAN_IN = 8
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that a task holds at once on the first level.
HELD = 200_000


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Tokenise every text, append id 0 and cut what is longer than a sequence; one row per piece."""
    path = path or vocabulary(FILE)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc, raw in zip(b.column("doc_id").to_pylist(), encoder(path, False).encode(b.column("text").to_pylist())):
            raw += b"\0\0\0\0"
            n = len(raw) // 4
            for k, at in enumerate(range(0, n, length)):
                part = raw[4 * at : 4 * (at + length)]
                rows.append((doc, k, at, len(part) // 4, zlib.crc32(part)))
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(documents(docs), one, _PIECE, keep=True)


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins as lists of item numbers: longest item first, each into the bin it fills best."""
    free: list[int] = []  # free room that some open bin has, ascending
    of: dict[int, list[int]] = {}  # open bins by free room
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(free, sizes[i])
        if at == len(free):
            n, left = len(bins), room
            bins.append([])
        else:
            left = free[at]
            n = of[left].pop()
            if not of[left]:
                del of[left], free[at]
        bins[n].append(i)
        left -= sizes[i]
        if left:
            if left not in of:
                of[left] = []
                insort(free, left)
            of[left].append(n)
    return bins


_BIN = "fill long, members binary, full boolean, grp long, number long"
_NAMES = ["fill", "members", "full", "grp", "number"]
_KINDS = [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()]


def _level(items: Iterator[tuple[int, bytes]], grp: int, length: int, level: int, last: bool) -> Iterator[tuple]:
    """Pack (fill, members) items; members are int64 rows (doc_id, piece, start, length, crc) in order."""
    held = list(items)
    hosts: dict[int, int] = {}  # more than half full bins by fill
    for k, chosen in enumerate(best_fit([f for f, _ in held], length)):
        fill = sum(held[i][0] for i in chosen)
        leaves = last or length - fill <= NEARLY * length
        if not leaves and 2 * fill > length:
            hosts[fill] = hosts.get(fill, 0) + 1
            leaves = hosts[fill] > FAN_IN
        yield fill, b"".join(held[i][1] for i in chosen), bool(leaves), grp, level << 56 | grp << 28 | k


def most_fill(fills: dict[int, int], length: int) -> int:
    """The largest fill that a bin can have and still be joined with another; fills: bins by fill."""
    least = sorted(fills)[:2]
    if not least:
        return -1
    second = least[0] if fills[least[0]] > 1 or len(least) == 1 else least[1]
    alone = len(least) == 1 and fills[least[0]] == 1
    return -1 if alone or least[0] + second > length else length - least[0]


def _merge(level: int, last: bool, length: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """One group of a level of the tree."""

    def again(key: tuple, table: pa.Table) -> pa.Table:
        order = sorted(zip(table.column("fill").to_pylist(), table.column("number").to_pylist(), table.column("members").to_pylist()), key=lambda r: r[:2])
        out = list(_level(((f, m) for f, _, m in order), int(key[0].as_py()), length, level, last))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], names=_NAMES)

    return again


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces with sequence_id and offset. cut: doc_id, piece, start, length, ids_crc32, each length at most length."""
    ship(cut.sparkSession)

    def rows_out(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        for r in rows:
            some.append(r)
            if len(some) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), _KINDS)], _NAMES)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), _KINDS)], _NAMES)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, count, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count, held, n
            table = np.concatenate(held)
            table = table[np.lexsort((table[:, 1], table[:, 0]))]
            for b in rows_out(_level(((int(r[3]), r.tobytes()) for r in table), grp, length, 0, False)):
                number = np.asarray(b.column("number")) + count
                yield b.set_column(4, "number", pa.array(number))
            count, held, n = count + len(table), [], 0

        for b in batches:
            held.append(np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], axis=1))
            n += b.num_rows
            if n >= HELD:
                yield from flush()
        if n:
            yield from flush()

    # a piece without doc_id goes along as number 0 with its place negative
    named = cut.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.when(F.col("doc_id").isNull(), -1 - F.col("piece")).otherwise(F.col("piece")).alias("piece"), "start", "length", "ids_crc32")
    bins, done, level = saved(named.mapInArrow(first, _BIN), "bins0"), [], 0
    while True:
        left = bins.where("not full").groupBy("fill").agg(F.count("*").alias("n"), F.max("grp").alias("grp")).collect()  # at most `length` rows
        most = most_fill({r.fill: r.n for r in left}, length)
        done.append(bins.where(F.col("full") | (F.col("fill") > most)))
        if most < 0:
            break
        rest = bins.where(~F.col("full") & (F.col("fill") <= most))
        level, groups = level + 1, -(-(max(r.grp for r in left) + 1) // FAN_IN)
        merged = rest.withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("long")).groupBy("grp").applyInArrow(_merge(level, groups == 1, length), _BIN)
        if groups == 1:
            done.append(merged)
            break
        bins = saved(merged, f"bins{level}")
    every = done[0]
    for d in done[1:]:
        every = every.unionAll(d)

    def unfold(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = b.column("members").to_pylist()
        table = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 5)
        sizes = np.array([len(r) // 40 for r in raw])
        ends = np.cumsum(table[:, 3])
        before = ends - table[:, 3]
        at = np.cumsum(sizes) - sizes
        offset = before - np.repeat(before[at], sizes)
        unnamed = table[:, 1] < 0
        piece = np.where(unnamed, -1 - table[:, 1], table[:, 1]).astype(np.int32)
        cols = [piece, table[:, 2], table[:, 3], table[:, 4], np.repeat(np.asarray(b.column("number")), sizes), offset]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(table[:, 0]), mask=unnamed), *(pa.array(np.ascontiguousarray(c)) for c in cols)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return arrow_map(every.select("members", "number"), unfold, _PIECE + ", sequence_id long, offset long", keep=True)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and place."""
    return pack(pieces(docs, path, length), length)
