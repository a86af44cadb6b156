"""Connected components of a link table, distributed.

Each partition first folds its own links into stars by union-find. Then large-star and small-star steps alternate:
every node's neighbours are tied to the smallest node it knows, until all links are stars around the smallest node
of their component. Every round is written to the shared folder, so lineage stays short and a lost executor costs
one round. Node groups are only ever reduced by minima; no node's neighbours are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import replaced, saved, ship

_LINK = "a long, b long"
#: Links a task folds at once.
FOLD = 1_000_000
#: Nodes with more than one in so many link ends are joined by broadcast; there are fewer of them than this.
HOT = 1_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of their component, for links held in memory."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        low, high = np.minimum(px, py), np.maximum(px, py)
        if (low == high).all():
            return nodes, nodes[parent]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        a, b = (np.concatenate(c) for c in zip(*held))
        node, root = roots(a, b)
        some = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(root[some])], ["a", "b"])

    for x in batches:
        if x.num_rows:
            held.append((np.asarray(x.column("a")), np.asarray(x.column("b"))))
            n += x.num_rows
        if n >= FOLD:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _star(links: DataFrame, n: int, large: bool) -> DataFrame:
    """One star step over n links.

    A node that holds more than one in HOT of the link ends would fill one task of the join. There are fewer than HOT
    such nodes, so their minima are broadcast and their links stay where they are; the others are joined by shuffle.
    """
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("ends"))
    most = (2 * n if large else n) / HOT
    hot = F.broadcast(least.where(F.col("ends") > most).select("a", "m"))
    side = both.where("b > a") if large else links
    tied = side.join(hot, "a").unionAll(side.join(hot, "a", "left_anti").join(least.where(F.col("ends") <= most).select("a", "m"), "a"))
    if large:  # larger neighbours go to the smallest of the node and its neighbours
        tied = tied.select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    else:  # a is the larger end: its smaller neighbours and itself go to the smallest of them
        tied = tied.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
    return tied.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component for every node of links (a, b) that is not the smallest of its own component."""
    ship(links.sparkSession)
    big = F.greatest("a", "b").alias("a")
    now = saved(links.where("a <> b").select(big, F.least("a", "b").alias("b")).mapInArrow(_fold, _LINK), "links")
    said = None
    while True:
        # a star forest has every node under one centre that is under no other
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (count, total) == said or not count:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        said = (count, total)
        now = replaced(_star(now, count, True), "links", now)
        now = replaced(_star(now, now.count(), False), "links", now)
