"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Equal vectors are one node with a count. Each table gives every node a signature, the signs of its products with
some random planes; nodes with one signature in a table are compared by exact cosine in double precision. As many
planes are used as keep buckets small for the number of nodes, and as many tables as find a pair right at the
threshold with probability RECALL. A pair is counted in the first table in which it meets. Signatures are worked out
once per node and go along with its vector; buckets of one node are dropped before vectors join their buckets. Large
buckets are cut into tiles which meet pairwise; a tile emits link counts per node and a spanning forest, never its
pairs. Components of the forests are found distributed.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do those without
vec_id, which have no component and are kept. Vectors of different lengths never link. Repeated rows (equal vec_id and
vector) link with each other; rows that share a vec_id but not the vector are vectors of their own. Labels and other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship
from .components import components, roots

THRESHOLD = 0.9
RECALL = 0.99
#: Nodes that a bucket is meant to hold on average; nodes in a tile.
BUCKET, TILE = 50, 1024
SEED = 20240229


def planes_and_tables(nodes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Planes per table and tables for so many nodes."""
    bits = min(30, max(4, round(math.log2(max(nodes, 1) / BUCKET + 1))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One number per row of x and table."""
    planes = np.random.default_rng(SEED + x.shape[1]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _unit(raw: list[bytes], kind: str = "<f8") -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_NODE = "node long, first long, many long, dim int, vec binary, sigs array<int>"


def _signed(bits: int, tables: int, kind: str):
    """Nodes with their signature in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims).tolist():
                some = b.filter(pa.array(dims == dim))
                for at in range(0, some.num_rows, 2000):
                    part = some.slice(at, 2000)
                    sigs = signatures(_unit(part.column("vec").to_pylist(), kind), bits, tables).astype(np.int32)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sigs.size + 1, tables), pa.int32()), pa.array(sigs.ravel()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "first", "many", "dim", "vec")), flat], ["node", "first", "many", "dim", "vec", "sigs"])

    return run


def _tiles(threshold: float, kind: str):
    """Tiles, rows in key order: link counts (kind 0: node, n) and spanning links (kind 1: node, other)."""

    def one(table: int, own: bool, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        side = np.array([r[0] for r in rows])
        node = np.array([r[1] for r in rows], np.int64)
        many = np.array([r[2] for r in rows], np.int64)
        x = _unit([r[3] for r in rows], kind)
        sigs = np.array([r[4][:table] for r in rows], np.int32).reshape(len(rows), table)
        a, b = (np.arange(len(rows)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links, counts = [], np.zeros(len(rows), np.int64)
        for at in range(0, len(a), TILE):
            some = a[at : at + TILE]
            i, j = np.nonzero(x[some] @ x[b].T >= threshold)
            i, j = some[i], b[j]
            if own:
                i, j = i[i < j], j[i < j]
            first = ~(sigs[i] == sigs[j]).any(axis=1)
            i, j = i[first], j[first]
            counts += np.bincount(i, weights=many[j], minlength=len(rows)).astype(np.int64) + np.bincount(j, weights=many[i], minlength=len(rows)).astype(np.int64)
            if len(i):
                links.append((node[i], node[j]))
        hit = np.flatnonzero(counts)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(hit), np.int8)), pa.array(node[hit]), pa.array(counts[hit])], ["kind", "node", "value"])
            named, root = roots(*(np.concatenate(c) for c in zip(*links)))
            off = named != root
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(off.sum()), np.int8)), pa.array(named[off]), pa.array(root[off])], ["kind", "node", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("dim", "tab", "sig", "ti", "tj", "side", "node", "many", "vec", "sigs")]
            for r in zip(*cols):
                if r[:5] != key:
                    if len(rows) > 1:
                        yield from one(key[1], key[3] == key[4], rows)
                    key, rows = r[:5], []
                rows.append(r[5:])
        if len(rows) > 1:
            yield from one(key[1], key[3] == key[4], rows)

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    number, kind = ("float", "<f4") if single else ("double", "<f8")  # floats are kept as they are and compared as doubles
    v = F.col("v")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{number}>").alias("v"))
    rows = rows.select("vec_id", F.coalesce(ok, F.lit(False)).alias("ok"), "v")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("v")
            flat, ends = np.asarray(col.flatten()).astype(kind) + np.dtype(kind).type(0), np.cumsum(np.asarray(col.value_lengths()))  # -0 becomes 0
            raw, size = flat.tobytes(), flat.itemsize
            starts = [0, *ends[:-1].tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(np.diff(ends, prepend=0).astype(np.int32)), pa.array([raw[size * i : size * j] for i, j in zip(starts, ends.tolist())], pa.binary())], ["vec_id", "dim", "vec"])

    named = rows.where("ok").select("vec_id", "v").mapInArrow(packed, "vec_id long, dim int, vec binary")
    groups = named.groupBy("dim", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("many"))
    nodes = saved(groups.select(F.monotonically_increasing_id().alias("node"), "first", "many", "dim", "vec"), "near-nodes")
    bits, tables = planes_and_tables(nodes.count(), threshold, recall)
    nodes = saved(nodes.mapInArrow(_signed(bits, tables, kind), _NODE), "near-signed")
    cells = nodes.select("dim", "node", F.posexplode("sigs").alias("tab", "sig"))
    key = ["dim", "tab", "sig"]
    sizes = cells.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1").withColumn("parts", F.ceil(F.col("size") / TILE).cast("int")).drop("size")
    cells = cells.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("ti"), F.greatest("part", o).alias("tj"), F.when(F.col("part") <= o, 0).otherwise(1).alias("side"))))
    tiles = cells.withColumn("t", meet).select("node", "tab", "sig", "t.ti", "t.tj", "t.side").join(nodes.select("node", "dim", "many", "vec", "sigs"), "node")
    order = [*key, "ti", "tj"]
    found = saved(tiles.repartition(*order).sortWithinPartitions(*order).mapInArrow(_tiles(threshold, kind), "kind byte, node long, value long"), "near-found")
    counts = found.where("kind = 0").groupBy("node").agg(F.sum("value").alias("links"))
    group = components(found.where("kind = 1").select(F.col("node").alias("a"), F.col("value").alias("b")))
    rooted = nodes.select("node", "first", "many", "dim", "vec").join(counts, "node", "left").join(group.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("component", "node"))
    rooted = saved(rooted.select("dim", "vec", "first", "root", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links")), "near-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(least, "root").select("dim", "vec", "n_links", "component_id")
    good = named.join(known, ["dim", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
