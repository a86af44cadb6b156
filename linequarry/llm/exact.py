"""Exact dedup by an extendible-hash index on shared files.

Every task first folds the equal texts of its own rows into one entry (key, representative, count, text), so a
text that makes up a third of all rows reaches the index once per task and not once per row. The directory is
a table on the shared files, worked out from the bytes below every key prefix: it starts with one bucket and doubles,
bit by bit, where a bucket holds more than its capacity, until each holds less or DEEPEST bits are used. Buckets are
key ranges; consecutive ones are dealt to owner tasks of about equal bytes. An owner reads its buckets' entries in key
order from the shared files, keeps one chain per key, compares bytes along the chain, and so finds the row that stays
for every entry. Rows then look their entry up in the written index.

Texts are equal when identical after each run of white space is one space. Null counts as empty; empty texts are
a group like any other. Of equal texts the smallest doc_id is kept; rows that repeat it count in group_size and share
its decision. A row without doc_id counts in its group and is kept only where no row of the group has one. What has
to leave one row of each group and no more, whatever its ids, goes by (doc_id, text_sha256) of the kept rows and takes
one row of each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, saved, ship, slices

#: Bytes of text in a bucket before the directory doubles there: what gives each partition about four buckets, within these.
BUCKET_BYTES = 256 << 10, 64 << 20
#: Bits of a key that the directory uses at most, and bits beyond an even spread at which counting starts.
DEEPEST, SPARE = 40, 5
#: Key prefixes over which the driver adds up bytes to deal out owners.
TOP = 12
#: Bytes of text a task folds together before it hands its entries on.
FOLD_BYTES = 24 << 20
_RUN = re.compile("[\x20\x09-\x0d]+")
#: Rows a task folds together; an entry of a text that repeats without end then has at most so many rows.
FOLD_ROWS = 100_000
_ENTRY = "doc_id long, entry long, first long, key long, sha string, text string, n long, size long"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [f.split()[0] for f in _ENTRY.split(", ")]


def normalised(text: str) -> str:
    return _RUN.sub(" ", text)


def text_digest(text: Column) -> Column:
    """SHA-256 of a normalised text as a column, as the operator returns it."""
    return F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "), 256)


def _least(ids) -> int | None:
    """The smallest id, None only where there is no other."""
    return min((i for i in ids if i is not None), default=None)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document naming its task's entry; the first row of an entry carries smallest doc_id, text and count."""
    groups: dict[str, list[int | None]] = {}
    held = rows_held = 0
    entry = TaskContext.get().partitionId() << 36  # entries are numbered within their task

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal entry
        rows: list[tuple] = []
        for text, ids in groups.items():
            raw = text.encode("utf-8")
            digest = hashlib.sha256(raw)
            key, sha = int.from_bytes(digest.digest()[:8], "big") >> 1, digest.hexdigest()
            rows.append((ids[0], entry, _least(ids), key, sha, text, len(ids), len(raw)))
            for at in range(1, len(ids), 1000):
                rows += [(i, entry, None, key, sha, None, 0, 0) for i in ids[at : at + 1000]]
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)
                    rows = []
            entry += 1
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)

    for b in slices(batches):
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            text = normalised(text)
            if text not in groups:
                groups[text] = []
                held += len(text)
            groups[text].append(doc)
        rows_held += b.num_rows
        if held > FOLD_BYTES or rows_held > FOLD_ROWS:
            yield from out()
            groups, held, rows_held = {}, 0, 0
    yield from out()


def directory(entries: DataFrame, capacity: int | None = None) -> DataFrame:
    """The buckets: first (key), depth, bytes; no bucket holds more than its capacity unless it is DEEPEST bits deep."""
    sized = entries.where("text is not null").select("key", "size")
    total = sized.agg(F.sum("size")).first()[0] or 0
    if capacity is None:
        capacity = min(max(total // (4 * int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))), BUCKET_BYTES[0]), BUCKET_BYTES[1])
    deepest = min(DEEPEST, int(total // capacity).bit_length() + SPARE)
    cells = sized.groupBy(F.shiftright("key", 63 - deepest).alias("cell")).agg(F.sum("size").alias("bytes"))
    # what lies below every prefix, from the whole table down to the cells
    below = cells.select("bytes", "cell", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"))
    below = below.select("depth", F.expr(f"shiftright(cell, {deepest} - depth)").alias("prefix"), "bytes")
    nodes = saved(below.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes")), "exact-prefixes")
    split = nodes.where((F.col("bytes") > capacity) & (F.col("depth") < deepest))
    # a bucket is a prefix that was not split whose parent was
    made = nodes.join(split.select("depth", "prefix"), ["depth", "prefix"], "left_anti").withColumns({"up": F.col("depth") - 1, "of": F.shiftright("prefix", 1)})
    parents = split.select(F.col("depth").alias("up"), F.col("prefix").alias("of"))
    leaves = made.where("depth > 0").join(parents, ["up", "of"], "left_semi").unionByName(made.where("depth = 0"))
    first = F.expr("if(depth = 0, 0L, shiftleft(prefix, 63 - depth))")
    return saved(leaves.select(first.alias("first"), "depth", "bytes"), "exact-directory")


def owners(buckets: DataFrame, tasks: int) -> list[int]:
    """First keys of at most `tasks` runs of consecutive buckets, of about equal bytes each."""
    top = F.shiftright("first", 63 - TOP)
    sums = buckets.groupBy(top.alias("top")).agg(F.sum("bytes").alias("n"))
    before = sums.select("top", F.coalesce(F.sum("n").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # 2 ** TOP rows at most
    total = max(1, buckets.agg(F.sum("bytes")).first()[0] or 0)
    upto = F.col("before") + F.sum("bytes").over(Window.partitionBy("top").orderBy("first")) - F.col("bytes")
    dealt = buckets.withColumn("top", top).join(F.broadcast(before), "top").select("first", F.floor(upto * tasks / total).alias("owner"))
    return sorted(r.first for r in dealt.groupBy("owner").agg(F.min("first").alias("first")).collect())  # a row per task


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order; one chain per key, told apart by bytes."""
    key, chain = None, {}
    rows: list[tuple] = []

    def close() -> None:
        for place, (sha, entries) in enumerate(chain.values()):
            keep, total = _least(first for _, first, _ in entries), sum(n for _, _, n in entries)
            rows.extend((e, keep, total, place) for e, _, _ in entries)

    def take() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["entry", "keep_id", "group_size", "chain"])
        rows.clear()
        return out

    for b in slices(batches):
        for k, e, first, n, sha, text in zip(*(b.column(c).to_pylist() for c in ("key", "entry", "first", "n", "sha", "text"))):
            if k != key:
                close()
                key, chain = k, {}
            chain.setdefault(text, (sha, []))[1].append((e, first, n))
        if len(rows) > 5000:
            yield take()
    close()
    if rows:
        yield take()


def exact_dedup(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = documents(docs)
    ship(docs.sparkSession)
    entries = saved(docs.mapInArrow(_fold, _ENTRY), "exact-entries")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = np.array(owners(directory(entries, capacity), tasks), np.int64)

    @F.pandas_udf("int")
    def owner_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(firsts, key.to_numpy(), side="right") - 1, 0).astype(np.int32))

    heads = entries.where("text is not null").select("key", "entry", "first", "n", "sha", "text")
    owned = heads.repartitionById(max(1, len(firsts)), owner_of("key")).sortWithinPartitions("key", "entry")
    index = saved(owned.mapInArrow(_own, "entry long, keep_id long, group_size long, chain int"), "exact-index")
    found = entries.select("doc_id", "entry", "sha").join(index, "entry")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
