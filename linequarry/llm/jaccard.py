"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Two sets that overlap by the threshold share an n-gram among the first n - ceil(t n) + 1 of each, in any one
order of all n-grams; these columns of the incidence matrix are enough to find every pair. Rare n-grams come first in
the order; the common ones are found by counting, over the whole corpus, what recurs within a task's rows. The
order only steers the cost: any order gives the same pairs. Columns are cut into blocks by hash. Each block's rows meet
in one task, which accumulates for neighbouring rows of a column their overlap counts and discards pairs whose
sizes cannot reach the bound. What is left is verified on the whole sets.

Equal sets are one row (node) throughout. Within a column, neighbours in several orders are tried first, for each
node those with the largest counts; once their links have made components, columns whose nodes still lie in different
components are multiplied out between components (where sizes, places and parity maps allow it), so a large group of near copies costs about as many pairs as it has
members, and no link between components is missed.

Sets: distinct word shingles; with fewer words the whole sequence; without words empty, linked with nothing. Null
text counts as empty. Repeated rows are equal sets; rows that share a doc_id but not their text are sets of their own,
and a row without doc_id takes part in no link and has no component. Sizes may tie; order then goes by hash. Other
columns are ignored. Nodes are told apart by a 64-bit hash of their set. The operator gives groups, which is all that
dedup asks; links inside a group that is already one are not counted out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, documents, saved, ship, slices
from .components import components
from .shingles import WORDS, mixed, shingle_sets

#: Jaccard of at least NUMBER / OF.
NUMBER, OF = 80, 100
#: Common n-grams that the order knows of, at most; the rest count as rare.
COMMON = 400_000
#: Least count, over all tasks, of an n-gram that counts as common.
OFTEN = 8
#: N-grams a task counts together.
COUNTED = 1_000_000
#: Bytes of text whose sets are made at once; cells that a task deals out at once.
AT_ONCE, DEALT = 1 << 20, 1_000_000
#: Bits of a node's parity map.
PARITY_BITS = 1024
#: n-gram (24 bits, within its block) and its place among the node's first ones (in 256ths, rounded down), node, size.
_CELL = np.dtype([("h", "<u4"), ("s", "<i8"), ("n", "<i4")])
_MEMBER = np.dtype([("s", "<i8"), ("n", "<i4"), ("q", "<i4")])
#: Partners per node that a round tries before components are looked at anew.
PARTNERS = 8
#: Orders in which a column's nodes are paired with their neighbours.
ORDERS = 6


def signature(shingles: np.ndarray, doc: int) -> int:
    """One number for a set; an empty one gets its document's own."""
    if not len(shingles):
        return int(mixed(np.array([doc or 0], np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)[0])
    place = mixed(shingles)
    total = int(place.sum(dtype=np.uint64)) + 3 * int(np.bitwise_xor.reduce(mixed(place))) + len(shingles)
    return int(mixed(np.array([total & (2**64 - 1)], np.uint64)).view(np.int64)[0])


def _parity(shingles: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits, each the parity of the shingles that fall on it: two sets differ in at least as many shingles as bits."""
    odd = np.bincount((mixed(shingles) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _survey(words: int):
    """Pass 1: per document its node and size (kind 0); n-grams that recur among the distinct sets of a task (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        held: list[np.ndarray] = []
        seen: set[int] = set()
        n = 0

        def recurring() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            grams, counts = grams[counts > 1].view(np.int64), counts[counts > 1]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((np.ones(len(grams), np.int8), grams, np.zeros(len(grams), np.int64), counts, np.zeros(len(grams), np.int64)), kinds)] + [pa.nulls(len(grams), pa.list_(pa.int64()))], ["kind", "a", "b", "n", "hash", "bits"])

        for b in slices(batches, AT_ONCE):
            docs = b.column("doc_id").to_pylist()
            sets = shingle_sets(b.column("text").to_pylist(), words)
            signs = [signature(s, d) for s, d in zip(sets, docs)]
            for s, g in zip(sets, signs):
                if g not in seen and len(s):
                    seen.add(g)
                    held.append(s)
                    n += len(s)
            parity = pa.array([_parity(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(([0] * len(docs), docs, signs, [len(s) for s in sets], b.column("hash")), kinds)), parity], ["kind", "a", "b", "n", "hash", "bits"])
            if n > COUNTED:
                yield recurring()
                held, seen, n = [], set(), 0
        if n:
            yield recurring()

    return run


def prefix_length(n: int, number: int = NUMBER, of: int = OF) -> int:
    return n - -(-number * n // of) + 1


def _cells(words: int, blocks: int, common, number: int, of: int):
    """Pass 2: each node's first n-grams in the order, dealt to blocks; one packed row per block."""

    def dealt(parts: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.concatenate(parts)
        cells = cells[np.argsort(cells["block"], kind="stable")]
        cut = np.flatnonzero(np.diff(cells["block"], prepend=-1, append=-1))
        packed = np.empty(len(cells), _CELL)
        for f in ("h", "s", "n"):
            packed[f] = cells[f]
        return pa.RecordBatch.from_arrays([pa.array(cells["block"][cut[:-1]], pa.int32()), pa.array([packed[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], ["block", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, level = common.value
        parts: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0
        for b in slices(batches, AT_ONCE):
            docs = b.column("doc_id").to_pylist()
            for s, d in zip(shingle_sets(b.column("text").to_pylist(), words), docs):
                if not len(s):
                    continue
                g = signature(s, d)
                if g in seen:
                    continue
                seen.add(g)
                keep = prefix_length(len(s), number, of)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                    weight = np.where(grams[at] == s, level[at], 0)
                    first = s[np.argsort(weight, kind="stable")[:keep]]
                else:
                    first = s[:keep]
                cell = np.empty(keep, np.dtype([("block", "<i4"), ("h", "<u4"), ("s", "<i8"), ("n", "<i4")]))
                spread = mixed(first)
                cell["block"], cell["h"], cell["s"], cell["n"] = (spread >> np.uint64(32)) % np.uint64(blocks), (spread & np.uint64(0xFFFFFF)) << np.uint64(8) | (np.arange(keep) * 256 // keep).astype(np.uint64), g, len(s)
                parts.append(cell)
                held += keep
            if held > DEALT:
                yield dealt(parts)
                parts, seen, held = [], set(), 0
        if parts:
            yield dealt(parts)

    return run


def _reach(n, q, m, r, number: int, of: int):
    """Whether nodes of sizes n and m that share an n-gram at places q and r (of 256) can still reach the threshold:
    with this as their first common one, what follows it must be enough. Works on numpy arrays and on columns."""
    share = (of - number) / of / 256.0  # of a node's n-grams that one 256th of its first ones stands for, rounded down
    left_n, left_m = n * (1.0 - share * q), m * (1.0 - share * r)
    need = number * (n + m)
    return (of * m >= number * n) & (of * n >= number * m) & ((number + of) * left_n >= need) & ((number + of) * left_m >= need)


def _product(number: int, of: int):
    """A block: overlap counts of neighbours within its columns (kind 0), and its columns of three nodes or more (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {}
        for b in batches:
            for k, raw in zip(b.column("block").to_pylist(), b.column("cells").to_pylist()):
                blocks.setdefault(k, []).append(raw)
        for k in list(blocks):
            cells = np.frombuffer(b"".join(blocks.pop(k)), _CELL)
            h, q = cells["h"] >> 8, cells["h"] & 255
            order = np.lexsort((q, cells["s"], cells["n"], h))
            h, q, s, n = h[order], q[order].astype(np.int64), cells["s"][order], cells["n"][order].astype(np.int64)
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            h, q, s, n = h[new], q[new], s[new], n[new]
            pairs = []
            for turn in range(ORDERS):  # size order, then orders by hash: each pairs a node with other ones of its columns
                o = np.arange(len(h)) if not turn else np.lexsort((mixed(s.view(np.uint64) + np.uint64(turn)), h))
                i, j = o[:-1], o[1:]
                near = (h[i] == h[j]) & _reach(n[i], q[i], n[j], q[j], number, of)
                a, c = s[i][near], s[j][near]
                pairs.append(np.stack([np.minimum(a, c), np.maximum(a, c)], axis=1))
            pairs = np.concatenate(pairs)
            if len(pairs):
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                head = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1)))
                pairs, counts = pairs[head], np.diff(np.append(head, len(pairs)))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(pairs), np.int8)), pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(counts.astype(np.int64)), pa.nulls(len(pairs), pa.binary())], ["kind", "a", "b", "n", "column"])
            start = np.flatnonzero(np.diff(h.astype(np.int64), prepend=-1, append=-1))
            wide = np.flatnonzero(np.diff(start) > 2)
            if len(wide):
                rows = np.empty(len(h), _MEMBER)
                rows["s"], rows["n"], rows["q"] = s, n, q
                raws = [rows[start[w] : start[w + 1]].tobytes() for w in wide.tolist()]
                names = [int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) for r in raws]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(raws), np.int8)), pa.array(names, pa.int64()), pa.nulls(len(raws), pa.int64()), pa.nulls(len(raws), pa.int64()), pa.array(raws, pa.binary())], ["kind", "a", "b", "n", "column"])

    return run


def _best(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, n) those among the PARTNERS of one of their nodes with the largest counts."""
    place = lambda x, y: F.row_number().over(Window.partitionBy(x).orderBy(F.desc("n"), y))
    ranked = pairs.withColumns({"ra": place("a", "b"), "rb": place("b", "a")})
    return ranked.where((F.col("ra") <= PARTNERS) | (F.col("rb") <= PARTNERS)).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, number: int, of: int) -> DataFrame:
    """Of pairs (a, b) of nodes those that reach the threshold."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = ends.join(nodes, "node").select("node", F.col("rep").alias("doc_id"), "hash")
    texts = saved(wanted.join(docs, ["doc_id", "hash"]).dropDuplicates(["node"]).select("node", "text"), "jaccard-texts")
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        sides = [dict(zip(ids := b.column(r).to_pylist(), texts)) for r, texts in (("a", b.column("ta").to_pylist()), ("b", b.column("tb").to_pylist()))]
        named = sides[0] | sides[1]
        sets = dict(zip(named, shingle_sets(list(named.values()), words)))
        good = []
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            both = np.concatenate([sets[x], sets[y]])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            good.append(of * shared >= number * (len(both) - shared))
        keep = pa.array(good)
        return pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return arrow_map(both, one, "a long, b long", limit=AT_ONCE)


def jaccard_groups(docs: DataFrame, words: int = WORDS, number: int = NUMBER, of: int = OF) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), text_hash,
    stays (true for one row of each group)."""
    docs = documents(docs).withColumn("hash", F.xxhash64("text"))
    spark = docs.sparkSession
    ship(spark)
    seen = saved(docs.mapInArrow(_survey(words), "kind byte, a long, b long, n long, hash long, bits array<long>"), "jaccard-survey")
    rows = seen.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), "n", "hash")
    docs = docs.where("doc_id is not null")
    each = seen.where("kind = 0 and a is not null").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("a", "hash")).alias("first"), F.any_value("bits").alias("bits"))
    nodes = saved(each.select("node", F.col("first.a").alias("rep"), F.col("first.hash").alias("hash"), "bits"), "jaccard-nodes")
    often = seen.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The grams, ascending, and their levels as two runs of bytes: 9 bytes a gram reach the driver."""
        rows = [(np.asarray(b.column("a")).view(np.uint64), np.asarray(b.column("n"))) for b in batches]
        grams, n = (np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, np.uint64), np.zeros(0))
        order = np.argsort(grams)
        level = np.ceil(np.log2(n.astype(float) + 1)).astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array([grams[order].tobytes()], pa.binary()), pa.array([level[order].tobytes()], pa.binary())], ["grams", "level"])

    table = often.orderBy(F.desc("n"), "a").limit(COMMON).repartition(1).mapInArrow(packed, "grams binary, level binary").first()
    common = spark.sparkContext.broadcast((np.frombuffer(bytes(table.grams), np.uint64), np.frombuffer(bytes(table.level), np.int8)) if table else (np.zeros(0, np.uint64), np.zeros(0, np.int8)))
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = docs.mapInArrow(_cells(words, blocks, common, number, of), "block int, cells binary").repartition("block")
    found = saved(cells.mapInArrow(_product(number, of), "kind byte, a long, b long, n long, column binary"), "jaccard-found")
    neighbours = saved(found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")), "jaccard-neighbours")
    tried = saved(_best(neighbours), "jaccard-pairs")
    links = saved(_verified(tried, nodes, docs, words, number, of), "jaccard-links")
    named = _labelled(nodes, links)

    def unfold(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = b.column("column").to_pylist()
        every = np.frombuffer(b"".join(raw), _MEMBER)
        cols = [np.repeat(np.asarray(b.column("gram")), [len(r) // _MEMBER.itemsize for r in raw]), np.ascontiguousarray(every["s"]), every["n"].astype(np.int64), every["q"].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["gram", "node", "n", "q"])

    columns = found.where("kind = 1").select(F.col("a").alias("gram"), "column")
    members = saved(arrow_map(columns, unfold, "gram long, node long, n long, q long"), "jaccard-members")

    def unsettled() -> DataFrame:
        """Members of the columns whose nodes lie in more than one component."""
        labelled = saved(members.join(named.select("node", "label"), "node"), "jaccard-labelled")
        split = labelled.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("gram")
        return saved(labelled.join(split, "gram").join(nodes.select("node", "bits"), "node"), "jaccard-unsettled")

    # all pairs of different components that can reach the threshold, from columns and from neighbours
    members = unsettled()
    other = members.select("gram", F.col("node").alias("other"), F.col("n").alias("m"), F.col("q").alias("r"), F.col("label").alias("olabel"), F.col("bits").alias("obits"))
    differ = F.aggregate(F.zip_with("bits", "obits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, k: acc + k)
    close = (of + number) * differ <= (of - number) * (F.col("n") + F.col("m"))
    across = members.join(other, "gram").where((F.col("node") < F.col("other")) & (F.col("label") != F.col("olabel")) & _reach(F.col("n"), F.col("q"), F.col("m"), F.col("r"), number, of) & close)
    side = lambda x: named.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    pending = neighbours.join(tried, ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b").where("la <> lb").select("a", "b")
    rest = across.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    rest = saved(rest.unionAll(pending).distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    if rest.limit(1).count():
        more = saved(_verified(rest, nodes, docs, words, number, of), "jaccard-links")
        if more.limit(1).count():
            named = _labelled(nodes, links.unionAll(more))
    out = rows.join(named, "node", "left")
    # one row of a group stays: the first by doc_id and text; a row without doc_id is in no group
    stays = F.col("doc_id").isNull() | (F.col("chief") & (F.col("doc_id") == F.col("rep")) & (F.col("hash") == F.col("first_hash")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("label")).alias("component_id"), F.col("hash").alias("text_hash"), stays.alias("stays"))


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, rep and first_hash (its first row), label (smallest doc_id of its component), chief (whether it is the first node there)."""
    group = saved(components(links).select(F.col("id").alias("node"), F.col("component").alias("root")), "jaccard-roots")
    tied = group.unionAll(group.select(F.col("root").alias("node"), "root").distinct()).join(nodes.select("node", "rep"), "node")
    least = tied.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("least"))
    said = tied.join(least, "root").select("node", F.col("least.rep").alias("label"), (F.col("least.node") == F.col("node")).alias("chief"))
    whole = nodes.select("node", "rep", F.col("hash").alias("first_hash")).join(said, "node", "left")
    return saved(whole.select("node", "rep", "first_hash", F.coalesce("label", "rep").alias("label"), F.coalesce("chief", F.lit(True)).alias("chief")), "jaccard-labels")
