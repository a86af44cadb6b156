"""Mixing sources to target weights: fixed-length blocks, draws per output shard, index permutations, joins by index.

The documents of a source, in the order of doc_id, are one stream of words that is cut into blocks of a fixed length;
the last may be shorter. Sources in code point order, null last, weigh WEIGHTS in turn and share all words by weight;
none gets more than MOST times its own words, what is above goes to the others by weight.

A source's target is met exactly, to the word: its blocks are taken over and over, the last one taken is cut. So it
has a known number of slots in the mix. Output shards hold a fixed number of slots; how many of each source a shard
holds is drawn: multinomial draws for all shards, given the sources' totals, are the same as splitting the totals
hypergeometrically, first between the halves of the shards, then within each half. Any shard's counts follow from the
path to it, so shards are drawn in parallel, each knowing too which slots of a source come before its own. The draws
of a range are seeded by the range: reruns and retried tasks agree.

A pseudorandom permutation (a Feistel network over the block numbers, walked until it falls inside) maps a source's
slots to its blocks, another one each time round; so no block is taken more than MOST times. Slots and the documents'
pieces then meet by source and block.

Null text has no words. Rows without doc_id come first in their source; rows that repeat it are ordered by size and a
hash of the text; repeated rows are taken each for itself. An empty table, or one without words, gives zeros. Other
columns are ignored. The driver holds one row per source, as it holds their weights: a configuration of a mix, checked
to be at most MOST_SOURCES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship

#: Weights of the sources, in turn, and how often a source may be used over.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words in a block, slots in an output shard.
BLOCK, SLOTS = 128, 16_384
#: Sources that a mix may have.
MOST_SOURCES = 1_000_000
SEED = 12
#: Ranges with more slots are halved evenly but for the remainders; the exact draw is for fewer.
EXACT = 900_000_000
_WHITE = "[\\x20\\x09-\\x0D]+"


def targets(words: np.ndarray, weights: np.ndarray, most: float = MOST) -> np.ndarray:
    """Words each source should give: all words shared by weight, none above most times its own.

    Sources reach their bound in the order of words to weight; level is what a weight of one gets once those that
    reach it are set aside.
    """
    words, weights = np.asarray(words, np.float64), np.asarray(weights, np.float64)
    order = np.argsort(words / weights, kind="stable")
    bound = most * words[order]
    left = words.sum() - np.concatenate([[0.0], np.cumsum(bound)[:-1]])
    weight = np.cumsum(weights[order][::-1])[::-1]
    level = left / weight
    fits = level * weights[order] <= bound  # from the first source that stays below its bound on
    k = int(np.argmax(fits)) if fits.any() else len(order)
    out = bound.copy()
    if k < len(order):
        out[k:] = level[k] * weights[order][k:]
    back = np.empty_like(out)
    back[order] = out
    return back


def scrambled(i: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Places of the indices i under a pseudorandom permutation of range(n); n and key may differ by index."""
    i, n, key = np.broadcast_arrays(*(np.asarray(x, np.uint64) for x in (i, n, key)))
    half = np.ones(i.shape, np.uint64)  # bits of each half
    while True:
        short = (np.uint64(1) << (half * np.uint64(2))) < n
        if not short.any():
            break
        half = half + short
    low = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray, half: np.ndarray, low: np.ndarray, key: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for r in range(rounds):
            h = (right + key * np.uint64(2 * r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, (left ^ (h >> np.uint64(32))) & low
        return left << half | right

    out = once(i, half, low, key)
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = once(out[far], half[far], low[far], key[far])
    return out.astype(np.int64)


def drawn(totals: np.ndarray, shards: int, slots: int, first: int, last: int, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard from first to before last: how many slots of each source it holds, and how many come before.

    totals: slots of each source; all shards hold `slots`, the last one what is left.
    """
    n = int(totals.sum())

    def split(lo: int, hi: int, counts: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or last <= lo:
            return
        if hi - lo == 1:
            yield lo, counts, before
            return
        mid = (lo + hi) // 2
        size, take = int(counts.sum()), min(mid * slots, n) - lo * slots
        rng = np.random.default_rng([seed, lo, hi])
        if size < EXACT:
            left = rng.multivariate_hypergeometric(counts, take, method="marginals")
        else:
            share = counts * (take / size)
            left = np.minimum(np.floor(share).astype(np.int64), counts)
            over = take - int(left.sum())
            chance = np.where(left < counts, share - left + 1e-9, 0.0)
            left[rng.choice(len(counts), size=over, replace=False, p=chance / chance.sum())] += 1
        yield from split(lo, mid, left, before)
        yield from split(mid, hi, counts - left, before + left)

    if shards:
        yield from split(0, shards, np.asarray(totals, np.int64), np.zeros(len(totals), np.int64))


class Recipe:
    """What the mix takes of each source: whole rounds over all its blocks, then part of a round.

    The part round takes full blocks in permuted order, the last of them cut; the short block only after all of them.
    """

    def __init__(self, words, weights, block: int = BLOCK, most: int = MOST):
        self.block, self.words = block, np.asarray(words, np.int64)
        self.target = targets(self.words, weights, most)
        self.takes = np.minimum(np.floor(self.target + 0.5).astype(np.int64), most * self.words)
        self.full, self.short = self.words // block, self.words % block
        self.blocks = self.full + (self.short > 0)
        some = np.maximum(self.words, 1)
        self.rounds, self.rest = self.takes // some, self.takes % some
        self.slots = self.rounds * self.blocks + np.minimum(-(-self.rest // block), self.full) + (self.rest > self.full * block)

    def taken(self, source: int, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and words, from the block's start, that these slots of a source take."""
        blocks, full = int(self.blocks[source]), int(self.full[source])
        turn, i = slot // blocks, slot % blocks
        key = (np.uint64(SEED) << np.uint64(48)) + (np.uint64(source) << np.uint64(8)) + turn.astype(np.uint64)
        partly = turn == self.rounds[source]
        among = np.where(partly, max(full, 1), blocks)
        tail = partly & (i >= full)
        which = np.where(tail, full, scrambled(np.where(tail, 0, i), among, key))
        size = np.where(which < full, self.block, self.short[source])
        return which, np.where(partly, np.minimum(size, self.rest[source] - i * self.block), size)


def _placed(sizes: DataFrame) -> DataFrame:
    """sizes (source_no, doc_id, size, ...) with start: the words before each document in its source.

    Ranges of the order are summed apart; one small row per range and source brings them together.
    """
    order = ["source_no", "doc_id", "size", "hash", "row"]
    names = sizes.columns
    schema = ", ".join([f"{name} {kind}" for name, kind in sizes.dtypes] + ["range int", "within long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, last, so_far = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if b.num_rows:
                source, size = np.asarray(b.column("source_no")), np.asarray(b.column("size"))
                total = np.cumsum(size)
                new = np.concatenate([[last is None or source[0] != last], source[1:] != source[:-1]])
                begin = np.where(new, total - size, 0)
                if not new[0]:
                    begin[0] = -so_far
                begin = begin[np.maximum.accumulate(np.where(new | (np.arange(len(new)) == 0), np.arange(len(new)), 0))]
                within = total - size - begin
                last, so_far = source[-1], int(within[-1] + size[-1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, here, np.int32)), pa.array(within)], [*names, "range", "within"])

    summed = saved(sizes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "mix-order")
    ranges = summed.groupBy("source_no", "range").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("source_no", "range", F.coalesce(before, F.lit(0)).alias("before"))
    return summed.join(ranges, ["source_no", "range"]).withColumn("start", F.col("within") + F.col("before")).drop("range", "within", "before")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents and the mix.

    documents: row (names one within this result), doc_id, size, source, source_size, target.
    mix: shard, slot (from 0 in the shard), row, first, words: these words of the document stand in that slot.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(F.array_remove(F.split(text, _WHITE), "")).cast("long").alias("size"), F.xxhash64(text).alias("hash"))
    own = saved(own.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    found = own.groupBy("source").agg(F.sum("size").alias("words")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"a mix has at most {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))  # Python compares strings by code point
    recipe = Recipe([r.words for r in found], [weights[k % len(weights)] for k in range(len(found))], block, most)
    table = spark.createDataFrame(
        [(r.source, k, r.words, float(recipe.target[k])) for k, r in enumerate(found)], "said string, source_no int, source_size long, target double"
    )
    rows = own.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("said"))).drop("said")
    placed = _placed(rows.select("source_no", "doc_id", "size", "hash", "row").where("size > 0"))

    n_shards = -(-int(recipe.slots.sum()) // slots)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            wanted = np.asarray(b.column("id"))  # a range of shards in one piece
            for shard, counts, before in drawn(recipe.slots, n_shards, slots, int(wanted[0]), int(wanted[-1]) + 1, seed):
                some = np.flatnonzero(counts)
                source = np.repeat(some, counts[some]).astype(np.int32)
                taken = [recipe.taken(int(k), np.arange(before[k], before[k] + counts[k])) for k in some]
                which, words = (np.concatenate(c) for c in zip(*taken))
                slot = scrambled(np.arange(len(source)), len(source), np.uint64(seed) << np.uint64(52) | np.uint64(shard))  # sources stand mixed in a shard
                cols = [pa.array(np.full(len(source), shard, np.int64)), pa.array(slot), pa.array(source), pa.array(which), pa.array(words)]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "slot", "source_no", "block", "length"])

    tasks = max(1, min(n_shards, spark.sparkContext.defaultParallelism * 4 if n_shards < 4096 else n_shards // 64))
    slots_table = spark.range(0, n_shards, 1, tasks).mapInArrow(draw, "shard long, slot long, source_no int, block long, length long")
    covered = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    pieces = placed.select("source_no", "row", "start", "size", F.explode(covered).alias("block"))
    at = F.col("block") * block
    begin = F.greatest("start", at)
    end = F.least(F.col("start") + F.col("size"), at + F.col("length"))
    # the planner takes the slots for as few rows as there are shards and would broadcast them
    placed_words = pieces.join(slots_table.hint("merge"), ["source_no", "block"]).select("shard", "slot", "row", (begin - F.col("start")).alias("first"), (end - begin).alias("words")).where("words > 0")
    return rows.select("row", "doc_id", "size", "source", "source_size", "target"), placed_words


def mixture(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    own, words = mix(docs)
    taken = words.groupBy("row").agg(F.sum("words").alias("taken"))
    return own.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
