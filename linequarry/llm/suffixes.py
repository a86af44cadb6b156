"""Removal of repeated passages by suffix arrays over shards.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Equal texts are one text with a
count. Which strings of the others can be equal is narrowed first, without losing any: of the GRAM-byte grams in a
string the least by hash is its anchor, equal strings have equal anchors, and runs of strings with one anchor form a
context of a few hundred bytes. Contexts meet by the hash of a block that all their strings contain; those whose block
nothing else has are done. All others are cut from their texts and go, as bytes, to shards of bounded size. There
equal bytes fold into one context, whose places all repeat; over the distinct ones a shard builds its suffix array by
Larsson-Sadakane refinement (doubling, only groups not yet sorted are sorted again) and the common prefixes of
neighbours by Kasai's rule, and a string repeats if a neighbour shares all its bytes. A block with more contexts than
a shard holds is dealt over several shards, whose sorted strings are then merged by binary search. Hashes only steer
which bytes meet; no string counts as repeated unless its bytes were compared, but for whole equal texts, which are
told by 128 bits of their SHA-256.

Null text counts as empty. Matches never cross documents. Repeated rows are copies, so their long texts go whole;
copies of a text cost as much as one in each task. Texts shorter than LENGTH keep everything. Strings are judged on the
input. A null doc_id is one like any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents, release, saved, ship, slices

LENGTH = 200
GRAM = 16
#: Strings whose anchor lies up to so far in go by the block right of it, others by the block left of it.
TURN = 92
#: Bytes of contexts in a shard; distinct contexts of one block in a shard.
SHARD_BYTES, SHARD_CONTEXTS = 4 << 20, 1000
#: Bytes of contexts, and texts, that a task remembers to know copies by.
KNOWN_BYTES, KNOWN_TEXTS = 32 << 20, 500_000
#: Strings that one merge of several shards looks up together.
MERGED = 1_000
_SPAN = LENGTH - GRAM + 1  # grams in a string
_CELL = np.dtype([("u0", "<u8"), ("u1", "<u8"), ("c", "<u8"), ("g", "<u4"), ("at", "<i4"), ("n", "<u2")])


def anchors(data: np.ndarray) -> np.ndarray:
    """For each start of LENGTH bytes in data the place of its anchor; equal strings have it at the same distance."""
    n = len(data) - GRAM + 1
    load = lambda k: np.ndarray((n,), "<u8", data.data, k, (1,)).copy()
    x = load(0) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += load(8) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    bits = max(1, int(n).bit_length())
    x >>= np.uint64(bits)
    x <<= np.uint64(bits)
    x |= np.arange(n, dtype=np.uint64)
    rows = -(-n // _SPAN)
    padded = np.full(rows * _SPAN + _SPAN, np.iinfo(np.uint64).max)
    padded[:n] = x
    grid = padded[: rows * _SPAN].reshape(rows, _SPAN)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - _SPAN + 1
    least = np.minimum(tail[:starts], head[_SPAN - 1 : _SPAN - 1 + starts])
    return (least & np.uint64((1 << bits) - 1)).astype(np.int64)


def contexts(texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """Of each text: (text number, start, length, block hash, content hash) of its contexts."""
    whole = b"".join(texts)
    if len(whole) < LENGTH:
        return
    data = np.frombuffer(whole, np.uint8)
    view = memoryview(whole)
    ends = np.cumsum([len(t) for t in texts])
    anchor = anchors(data)
    starts = np.arange(len(anchor))
    of = np.searchsorted(ends, starts, side="right")
    good = starts + LENGTH <= ends[np.minimum(of, len(ends) - 1)]
    key = np.where(good, anchor, -1)
    cut = np.flatnonzero(np.diff(key, prepend=-2))
    cut = np.append(cut, len(key))
    low, high = cut[:-1], cut[1:] - 1
    some = key[low] >= 0
    low, high = low[some], high[some]
    place = key[low]
    digest = xxhash.xxh3_64_intdigest
    base = ends - np.array([len(t) for t in texts])
    for a, b, p, t in zip(low.tolist(), high.tolist(), place.tolist(), of[low].tolist()):
        first = max(a, p - TURN)
        if first <= b:
            yield t, first - int(base[t]), b + LENGTH - first, digest(view[p : p + LENGTH - TURN], 1), digest(view[first : b + LENGTH], 3)
        last = min(b, p - TURN - 1)
        if a <= last:
            yield t, a - int(base[t]), last + LENGTH - a, digest(view[p - TURN : p + GRAM], 2), digest(view[a : last + LENGTH], 3)


def _uids(cells: np.ndarray) -> pa.Array:
    """The 16 bytes that name each cell's text."""
    both = np.stack([cells["u0"], cells["u1"]], axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())


_OUT = "kind byte, block int, cells binary, uid binary, at int, n int"
_OUT_KINDS = [pa.int8(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]


def _table(kind: int, rows: int, **cols) -> pa.RecordBatch:
    names = ["block", "cells", "uid", "at", "n"]
    arrays = [pa.array(np.full(rows, kind, np.int8))]
    for c, k in zip(names, _OUT_KINDS[1:]):
        arrays.append(cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols[c], k) if c in cols else pa.nulls(rows, k))
    return pa.RecordBatch.from_arrays(arrays, ["kind", *names])


def _cells(blocks: int):
    """Contexts of a slice's distinct texts: cells per block (kind 0); of contexts that the slice has several times,
    byte for byte, one cell and all places (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in slices(batches):
            new = [n for n, u in enumerate(b.column("uid").to_pylist()) if not (u in seen or seen.add(u))]
            if len(seen) > KNOWN_TEXTS:
                seen = set()
            if not new:
                continue
            b = b.take(pa.array(new))
            texts = [t.encode("utf-8") for t in b.column("text").to_pylist()]
            found = list(contexts(texts))
            if not found:
                continue
            t, at, n, g, c = (np.array(x, k) for x, k in zip(zip(*found), (np.int64, np.int32, np.uint16, np.uint64, np.uint64)))
            uid = np.frombuffer(b"".join(b.column("uid").to_pylist()), "<u8").reshape(-1, 2)[t]
            order = np.lexsort((at, t, c, g))
            t, at, n, g, c, uid = t[order], at[order], n[order], g[order], c[order], uid[order]
            same = np.flatnonzero((g[1:] == g[:-1]) & (c[1:] == c[:-1]) & (n[1:] == n[:-1])) + 1  # alike: compare bytes
            copy = np.zeros(len(g), bool)
            for k in same.tolist():
                x, y, z = int(at[k - 1]), int(at[k]), int(n[k])
                copy[k] = texts[t[k - 1]][x : x + z] == texts[t[k]][y : y + z]
            cells = np.empty(len(g), _CELL)
            cells["u0"], cells["u1"], cells["c"], cells["g"], cells["at"], cells["n"] = uid[:, 0], uid[:, 1], c, g & np.uint64(0xFFFFFFFF), at, n
            again = copy.copy()
            again[:-1] |= copy[1:]
            if again.any():
                some = cells[again]
                yield _table(1, len(some), uid=_uids(some), at=some["at"].copy(), n=some["n"].astype(np.int32))
            cells, block = cells[~copy], ((g >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32)[~copy]
            order = np.argsort(block, kind="stable")
            cells, block = cells[order], block[order]
            cut = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            yield _table(0, len(cut) - 1, block=block[cut[:-1]], cells=[cells[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])])

    return run


_WANT = "uid binary, at int, n int, grp long, part int, parts int"


def _meet(batches: Iterator[pa.RecordBatch], shard_contexts: int) -> Iterator[pa.RecordBatch]:
    """A block's cells: every place whose block another place has too, with the shard its bytes go to."""
    blocks: dict[int, list[bytes]] = {}
    for b in batches:
        for k, raw in zip(b.column("block").to_pylist(), b.column("cells").to_pylist()):
            blocks.setdefault(k, []).append(raw)
    for k in list(blocks):
        cells = np.frombuffer(b"".join(blocks.pop(k)), _CELL)
        cells = cells[np.lexsort((cells["at"], cells["u1"], cells["u0"], cells["c"], cells["g"]))]
        first = np.ones(len(cells), bool)  # copies of a text in several tasks bring their cells several times
        first[1:] = (cells["g"][1:] != cells["g"][:-1]) | (cells["at"][1:] != cells["at"][:-1]) | (cells["u0"][1:] != cells["u0"][:-1]) | (cells["u1"][1:] != cells["u1"][:-1])
        cells = cells[first]
        new = np.ones(len(cells), bool)
        new[1:] = cells["g"][1:] != cells["g"][:-1]
        other = new.copy()
        other[1:] |= cells["c"][1:] != cells["c"][:-1]
        of = np.cumsum(new) - 1
        places, distinct = np.bincount(of), np.bincount(of, weights=other)
        ask = np.flatnonzero(places[of] > 1)
        if len(ask):
            parts = -(-distinct[of[ask]].astype(np.int64) // shard_contexts)
            pick = cells[ask]
            part = (pick["c"] % parts.astype(np.uint64)).astype(np.int32)  # equal contexts meet in one shard
            cols = [pick["at"].copy(), pick["n"].astype(np.int32), (np.int64(k) << np.int64(32)) + pick["g"].astype(np.int64), part, parts.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([_uids(pick), *map(pa.array, cols)], ["uid", "at", "n", "grp", "part", "parts"])


def suffix_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Starts of all length-byte strings inside [starts, ends) parts of data, sorted by those bytes.

    Larsson-Sadakane refinement: a place's rank is where its group begins; each round sorts only the places of
    groups of two or more by the rank a step further on, doubling the step, until length is reached.
    """
    end = np.repeat(ends, ends - starts)  # the parts cover data without gaps
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    key = np.ndarray((n,), ">u8", padded.data, 0, (1,)).astype(np.uint64)
    place = np.flatnonzero(np.arange(n) + 8 <= end)
    order = place[np.argsort(key[place], kind="stable")]
    rank = np.full(n, -1, np.int64)
    tied = _group(order, key[order], np.arange(len(order)), rank)
    known = 8
    while known < length and len(tied):
        step = min(known, length - known)
        tied = tied[tied + known + step <= end[tied]]
        order = tied[np.lexsort((rank[tied + step], rank[tied]))]
        first, second = rank[order], rank[order + step]
        begin = np.ones(len(order), bool)
        begin[1:] = first[1:] != first[:-1]
        inside = np.arange(len(order)) - np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))
        change = begin.copy()
        change[1:] |= second[1:] != second[:-1]
        tied = _group(order, np.cumsum(change), first + inside, rank)
        known += step
    window = np.flatnonzero(np.arange(n) + length <= end)
    return window[np.argsort(rank[window], kind="stable")]


def _group(order: np.ndarray, key: np.ndarray, slot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Give every place of a run of equal keys the slot of its first one; returns the places of runs of two or more."""
    if not len(order):
        return order
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(order)))
    rank[order] = np.repeat(slot[head], size)
    return order[np.repeat(size > 1, size)]


def common_prefixes(data: np.ndarray, sa: np.ndarray, starts: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Bytes that each place of sa shares with the one before it, up to limit, by Kasai's rule: one place further on
    at most one byte is lost, provided the neighbour's next place is in sa too and still comes first; otherwise the
    count starts anew. All parts step along together, each with its own count."""
    spot = np.full(len(data) + 1, -1, np.int64)
    spot[sa] = np.arange(len(sa))
    out = np.zeros(len(sa), np.int64)
    place, held = starts.copy(), np.zeros(len(starts), np.int64)
    live = spot[place] >= 0
    place, held = place[live], held[live]
    follows = np.full(len(place), len(data))
    while len(place):
        here = spot[place]
        before = sa[here - 1]
        led = spot[follows]
        held = np.where((led >= 0) & (led < here), np.maximum(held - 1, 0), 0)
        going = np.flatnonzero((here > 0) & (held < limit))
        while len(going):
            h = held[going]
            going = going[data[place[going] + h] == data[before[going] + h]]
            held[going] += 1
            going = going[held[going] < limit]
        out[here] = held
        place, follows = place + 1, np.where(here > 0, before + 1, len(data))
        live = spot[place] >= 0
        place, held, follows = place[live], held[live], follows[live]
    return out


_CUT = "uid binary, at int, n int, grp long, part int, parts int, bytes binary"
_CUT_KINDS = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_CUT_NAMES = [f.split()[0] for f in _CUT.split(", ")]


def _cut_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the places asked for. Of contexts that this task has had before, byte for byte, only the places
    (bytes null: known to repeat), so that no shard gets a common context more than a few times from a task."""
    known: dict[bytes, tuple | None] = {}
    held = 0
    for b in slices(batches):
        asked = b.column("asked")
        sizes = np.asarray(asked.value_lengths())
        uids, texts = b.column("uid").to_pylist(), [t.encode("utf-8") for t in b.column("text").to_pylist()]
        at, n, grp, part, parts = (np.asarray(x).tolist() for x in asked.flatten().flatten())
        rows: list[tuple] = []
        for k, row in enumerate(np.repeat(np.arange(len(sizes)), sizes).tolist()):
            raw = texts[row][at[k] : at[k] + n[k]]
            if raw not in known:
                known[raw] = uids[row], at[k], n[k]
                held += n[k] + 200
                rows.append((uids[row], at[k], n[k], grp[k], part[k], parts[k], raw))
                continue
            if known[raw] is not None:
                rows.append((*known[raw], at[k], -1, 1, None))
                known[raw] = None
            rows.append((uids[row], at[k], n[k], at[k], -1, 1, None))
        for start in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[start : start + 5000]), _CUT_KINDS)], _CUT_NAMES)
        if held > KNOWN_BYTES:
            known, held = {}, 0


_FOUND = "kind byte, uid binary, at int, n int, string binary"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in (grp, part) order: repeated stretches (kind 1); of blocks in several parts every distinct string (kind 3)."""
    index: dict[bytes, int] = {}  # distinct contexts of the shard
    held: list[tuple] = []  # and their first places
    times: list[int] = []
    ready: list[tuple] = []  # places whose context is there already
    size, last = 0, None

    def out() -> Iterator[pa.RecordBatch]:
        if ready:
            uid, at, n = zip(*ready)
            yield _rows(1, list(uid), np.array(at), np.array(n), None)
            ready.clear()
        if not held:
            return
        raw = b"".join(index)
        data = np.frombuffer(raw, np.uint8)
        lens = np.array([len(r) for r in index])
        ends = np.cumsum(lens)
        starts = ends - lens
        sa = suffix_array(data, starts, ends)
        shared = common_prefixes(data, sa, starts)
        again = shared >= LENGTH
        same = again.copy()
        same[:-1] |= again[1:]
        of = np.searchsorted(ends, sa, side="right")
        parts, at = np.array([r[2] for r in held]), np.array([r[1] for r in held], np.int64)
        whole = np.array(times) > 1
        uid = [r[0] for r in held]
        full = np.flatnonzero(whole)
        if len(full):
            yield _rows(1, [uid[c] for c in full.tolist()], at[full], lens[full], None)
        hit = np.sort(sa[same & ~whole[of]])
        if len(hit):
            ctx = np.searchsorted(ends, hit, side="right")
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (ctx[1:] != ctx[:-1])
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(hit)) - 1
            c = ctx[a]
            yield _rows(1, [uid[x] for x in c.tolist()], at[c] + hit[a] - starts[c], hit[b] - hit[a] + LENGTH, None)
        # several shards hold this block: one row per distinct string, those known to repeat with n = 0
        split = np.flatnonzero((parts[of] > 1) & ~again)
        for some in np.array_split(split, -(-len(split) // 5000)) if len(split) else ():
            place, c = sa[some], of[some]
            strings = [raw[p : p + LENGTH] for p in place.tolist()]
            yield _rows(3, [uid[x] for x in c.tolist()], at[c] + place - starts[c], np.where(same[some] | whole[c], 0, LENGTH), strings)

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("uid", "at", "n", "parts", "bytes", "grp", "part"))):
            uid, at, n, parts, raw = row[:5]
            if raw is None:
                ready.append((uid, at, n))
            else:
                if held and row[5:] != last and size > SHARD_BYTES:
                    yield from out()
                    index, held, times, size = {}, [], [], 0
                last = row[5:]
                k = index.get(raw)
                if k is None:
                    index[raw] = len(held)
                    held.append((uid, at, parts))
                    times.append(1)
                    size += n
                else:
                    times[k] += 1
                    ready.append((uid, at, n))
            if len(ready) > 20_000:
                done, ready[:] = list(ready), []
                yield _rows(1, [r[0] for r in done], np.array([r[1] for r in done]), np.array([r[2] for r in done]), None)
    yield from out()
    release()


def _rows(kind: int, uid: list[bytes], at: np.ndarray, n: np.ndarray, strings: list[bytes] | None) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(uid), kind, np.int8)), pa.array(uid, pa.binary()), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays([*cols, pa.array(strings, pa.binary()) if strings else pa.nulls(len(uid), pa.binary())], ["kind", "uid", "at", "n", "string"])


def _merge(strings: pa.Table) -> pa.Table:
    """Strings of several shards: each is looked up among all of them, sorted, by binary search over their bytes."""
    mine = np.array(strings.column("string").to_pylist(), f"S{LENGTH}")
    line = np.sort(mine)
    times = np.searchsorted(line, mine, side="right") - np.searchsorted(line, mine, side="left")
    pick = pa.array((times > 1) & (strings.column("n").to_numpy() > 0))
    return strings.select(["uid", "at", "n"]).filter(pick)


def repeated_stretches(docs: DataFrame, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """Stretches (uid, at, n) of bytes to remove; docs: uid (the name of the text), text. Stretches of one text may overlap."""
    spark = docs.sparkSession
    ship(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("uid", "text")
    copies = docs.groupBy("uid").agg(F.count("*").alias("rows"), F.max(F.octet_length("text")).alias("n")).where(f"rows > 1 and n >= {LENGTH}")
    first = saved(docs.mapInArrow(_cells(4 * partitions), _OUT), "repeats-cells")
    want = saved(first.where("kind = 0").select("block", "cells").repartition("block").mapInArrow(partial(_meet, shard_contexts=shard_contexts), _WANT), "repeats-want")
    asked = want.groupBy("uid").agg(F.collect_list(F.struct("at", "n", "grp", "part", "parts")).alias("asked"))
    texts = asked.join(docs.groupBy("uid").agg(F.first("text").alias("text")), "uid")
    pieces = texts.select("uid", "text", "asked").mapInArrow(_cut_asked, _CUT)
    sorted_pieces = pieces.repartition(partitions, "grp", "part").sortWithinPartitions("grp", "part", "uid", "at")
    found = saved(sorted_pieces.mapInArrow(_shards, _FOUND), "repeats-found")
    split = found.where("kind = 3").select("uid", "at", "n", "string")
    merges = max(1, split.count() // MERGED)
    merged = split.groupBy(F.pmod(F.xxhash64("string"), F.lit(merges)).alias("near")).applyInArrow(_merge, "uid binary, at int, n int")
    keep = ["uid", "at", "n"]
    whole = copies.select("uid", F.lit(0).alias("at"), F.col("n").cast("int").alias("n"))
    return first.where("kind = 1").select(keep).unionAll(found.where("kind = 1").select(keep)).unionAll(merged).unionAll(whole)


def _left(texts: list[str], stretches: list[list | None]) -> Iterator[tuple[bytes, int, int, int, bytes]]:
    """Per text: its bytes, how many, how many go, in how many runs, and what is left."""
    for text, some in zip(texts, stretches):
        raw = text.encode("utf-8")
        if not some:
            yield raw, len(raw), 0, 0, raw
            continue
        at = sorted((s["at"], s["at"] + s["n"]) for s in some)
        runs = [list(at[0])]
        for a, b in at[1:]:
            if a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        left, upto = [], 0
        for a, b in runs:
            left.append(raw[upto:a])
            upto = b
        left.append(raw[upto:])
        yield raw, len(raw), sum(b - a for a, b in runs), len(runs), b"".join(left)


def repeat_removal(docs: DataFrame, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (bytes left), kept_sha256."""
    docs = documents(docs).withColumn("uid", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    gone = repeated_stretches(docs, shard_contexts).groupBy("uid").agg(F.collect_list(F.struct("at", "n")).alias("gone"))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(_left(b.column("text").to_pylist(), b.column("gone").to_pylist()))
        nums = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *nums, pa.array([r[4] for r in rows], pa.binary()), pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = docs.join(gone, "uid", "left").select("doc_id", "text", "gone")
    return arrow_map(joined, one, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
