"""Folders of a mounted file system as tables: a safe walk, image headers, and snapshots of table folders.

Listing, reading and copying run in tasks; the driver sees one row per level or per snapshot.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .export import plain_path
from .intake import MOST_FRAMES, checked_files, image_problem
from .numbering import numbered, written
from .sources import FORMATS, signature_matches

#: Bytes of a file that are looked at to tell its format.
HEAD = 16
_FOUND = "rel string, key string, kind string, size long, mtime long, device long, inode long, head binary, size_after long, mtime_after long"
_NAMES = [f.split()[0] for f in _FOUND.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
_AT_ONCE = 2000


def _looked(path: str) -> tuple[bytes | None, int | None, int | None]:
    """A file's first bytes, and its size and time after they were read."""
    try:
        with open(path, "rb") as f:
            head = f.read(HEAD)
        after = os.stat(path, follow_symlinks=False)
    except OSError:
        return None, None, None
    return head, after.st_size, after.st_mtime_ns


def listing(spark: SparkSession, folder: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Files and folders below a folder, links left out and `skip` (workspace, output) not entered.

    rel, key, kind (file, folder, error), size, mtime, device, inode; for files of known formats also head and a second
    look at size and time. One Spark job lists one level, a task several folders. Sorting by key gives the order of a
    walk: a folder's files by case-folded name, then its folders.
    """
    root = plain_path(folder).rstrip("/") or "/"
    away = {os.path.abspath(plain_path(s)) for s in skip}

    def one(rel: str, key: str) -> Iterator[tuple]:
        try:
            with os.scandir(os.path.join(root, rel)) as entries:
                for e in entries:
                    below = f"{rel}/{e.name}" if rel else e.name
                    part = f"{e.name.casefold()}\x01{e.name}\x02"
                    if e.is_symlink() or os.path.abspath(e.path) in away:
                        continue
                    if e.is_dir(follow_symlinks=False):
                        yield below, f"{key}1{part}", "folder", *[None] * 7
                    elif e.is_file(follow_symlinks=False):
                        s = os.stat(e.path, follow_symlinks=False)
                        known = e.name.rpartition(".")[2].lower() in FORMATS
                        yield below, f"{key}0{part}", "file", s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino, *(_looked(e.path) if known else (None, None, None))
        except OSError:
            yield rel, f"{key}0", "error", *[None] * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], _NAMES)
        for b in batches:
            for rel, key in zip(b.column("rel").to_pylist(), b.column("key").to_pylist()):
                for row in one(rel, key):
                    out.append(row)
                    if len(out) >= _AT_ONCE:
                        yield batch()
                        out = []
        if out:
            yield batch()

    levels, now = [], spark.createDataFrame([("", "")], "rel string, key string")
    while True:
        found = written(now.mapInArrow(run, _FOUND), "listing")
        levels.append(found)
        folders = found.where("kind = 'folder'").select("rel", "key")
        if not folders.limit(1).count():
            break
        now = folders.repartition("rel")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    return out


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of every file below a folder, found and read in tasks: the driver lists none of them."""
    root = plain_path(folder).rstrip("/")
    files = listing(spark, folder)
    wrong = files.where("kind = 'error'").select("rel").first()
    if wrong is not None:
        raise OSError(f"parts of {root} can't be read: {wrong.rel}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, bytes]] = []
        size = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in ((0, pa.string()), (1, pa.binary()))], ["path", "content"])
        for b in batches:
            for rel in b.column("rel").to_pylist():
                with open(os.path.join(root, rel), "rb") as f:
                    out.append((f"{root}/{rel}", f.read()))
                size += len(out[-1][1])
                if len(out) >= _AT_ONCE or size >= 1 << 24:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    spread = 4 * spark.sparkContext.defaultParallelism  # a given number: rows are few bytes, the files behind them are not
    return files.where("kind = 'file'").select("rel").repartition(spread, "rel").mapInArrow(run, "path string, content binary")


def walked(spark: SparkSession, folder: str, skip: tuple[str, ...] = (), include: list[str] | None = None) -> DataFrame:
    """The files of a walk with what is wrong with each: ordinal, path (below the folder) and the columns and states of checked_files."""
    files = numbered(listing(spark, folder, skip).where("kind = 'file'"), [], ["key"], "ordinal").withColumnRenamed("rel", "path")
    if include is not None:
        files = files.join(spark.createDataFrame([(p,) for p in include], "path string"), "path", "left_semi")
    files = files.withColumn("matches", F.coalesce(signature_matches(F.col("path"), F.col("head")), F.lit(False)))
    return checked_files(files.select("ordinal", "path", "size", "mtime", "device", "inode", "matches", "size_after", "mtime_after"))


def _png(raw: bytes) -> tuple[int, int, int]:
    if raw[12:16] != b"IHDR" or struct.unpack(">I", raw[8:12])[0] != 13:
        raise ValueError("no_header")
    at, frames, size = 8, 1, None
    while True:
        length, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + length]
        crc = struct.unpack(">I", raw[at + 8 + length : at + 12 + length])[0]
        if kind in (b"IHDR", b"acTL") and zlib.crc32(kind + body) != crc:
            raise ValueError("checksum")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"acTL":
            frames = struct.unpack(">I", body[:4])[0]
        elif kind == b"IEND":
            return frames, *size
        at += 12 + length


def _jpeg(raw: bytes) -> tuple[int, int, int]:
    at = 2
    while True:
        if raw[at] != 0xFF:
            raise ValueError("marker")
        kind = raw[at + 1]
        if kind == 0xFF:  # fill
            at += 1
            continue
        if kind in (0x01, *range(0xD0, 0xD8)):
            at += 2
            continue
        if kind in (0xD9, 0xDA):
            raise ValueError("no_frame")
        length = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        if length < 2:
            raise ValueError("marker")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
            return 1, width, height
        at += 2 + length


def _tiff(raw: bytes) -> tuple[int, int, int]:
    order = "<" if raw[:2] == b"II" else ">"
    number, at = struct.unpack(order + "HI", raw[2:8])
    if number != 42:
        raise ValueError("no_header")
    seen, best = set(), (0, 0)
    while at:
        if at in seen:
            raise ValueError("cycle")
        seen.add(at)
        n = struct.unpack(order + "H", raw[at : at + 2])[0]
        size = {}
        for k in range(n):
            tag, kind, _, value = struct.unpack(order + "HHI4s", raw[at + 2 + 12 * k : at + 14 + 12 * k])
            if tag in (256, 257):
                if kind not in (3, 4):
                    raise ValueError("tag")
                size[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
        if len(size) < 2:
            raise ValueError("tag")
        best = max(best, (size[256], size[257]), key=lambda s: s[0] * s[1])
        if len(seen) > MOST_FRAMES:
            break
        at = struct.unpack(order + "I", raw[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    if not seen:
        raise ValueError("no_frame")
    return len(seen), *best


def image_header(raw: bytes | None) -> tuple[str | None, int | None, int | None, int | None, str | None]:
    """(format, frames, width and height of the largest frame, flaw) from an image's bytes; format null where they are no image."""
    raw = raw or b""
    kind = "png" if raw[:8] == b"\x89PNG\r\n\x1a\n" else "jpeg" if raw[:2] == b"\xff\xd8" else "tiff" if raw[:4] in (b"II*\0", b"MM\0*") else None
    if kind is None:
        return None, None, None, None, "no_image"
    try:
        return kind, *{"png": _png, "jpeg": _jpeg, "tiff": _tiff}[kind](raw), None
    except ValueError as e:
        return kind, None, None, None, str(e)
    except (struct.error, IndexError, TypeError):
        return kind, None, None, None, "truncated"


def image_headers(files: DataFrame) -> DataFrame:
    """files (path, content, ...) with actual, frames, width, height, flaw (cycle, truncated, ...) and problem, the first rule broken."""
    kept = [c for c in files.columns if c != "content"]
    kinds = ", ".join(f"`{n}` {k}" for n, k in files.dtypes if n != "content") + ", actual string, frames int, width long, height long, flaw string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*(image_header(x.as_py()) for x in b.column("content")))) if b.num_rows else [()] * 5
            cols = [b.column(c) for c in kept] + [pa.array(c, k) for c, k in zip(got, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "actual", "frames", "width", "height", "flaw"])

    told = files.select(*kept, "content").mapInArrow(run, kinds)
    rule = image_problem(F.col("path"), F.col("actual"), F.col("frames"), F.col("width"), F.col("height"))
    wrong = F.when(F.col("flaw").isNotNull() & F.col("actual").isNotNull(), F.lit("damaged"))
    return told.withColumn("problem", F.coalesce(F.when(F.col("actual").isNull(), F.coalesce(rule, F.lit("format_mismatch"))), wrong, rule))


class SnapshotDamaged(ValueError):
    """A snapshot whose files are missing or not what its list says."""


def _each(files: DataFrame, do, schema: str) -> DataFrame:
    """Rows (rel, sha, size) through do(rel, sha, size) -> row, in tasks."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [do(*r) for r in zip(*(b.column(c).to_pylist() for c in ("rel", "sha", "size")))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    return files.select("rel", "sha", "size").mapInArrow(run, schema)


def _sha(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def _put(source: str, target: str) -> None:
    """Copy under another name, then rename: a reader never sees half a file."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    aside = f"{target}.{uuid.uuid4().hex}.tmp"
    shutil.copyfile(source, aside)
    os.replace(aside, target)


def back_up(spark: SparkSession, folder: str, vault: str) -> str:
    """A snapshot of all files below a folder; returns its name. A file's content is kept once, under its digest.

    Digests and copies are made in tasks; the list of files is written last and makes the snapshot one.
    """
    root, store = plain_path(folder), plain_path(vault)
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    files = listing(spark, folder).where("kind = 'file'").select("rel", F.lit("").alias("sha"), "size")
    if listing(spark, folder).where("kind = 'error'").limit(1).count():
        raise OSError(f"parts of {root} can't be read")

    def keep(rel: str, _: str, size: int) -> tuple[str, str, int]:
        sha = _sha(path := os.path.join(root, rel))
        target = os.path.join(store, "objects", sha[:2], sha)
        if not os.path.exists(target):
            _put(path, target)
            if _sha(target) != sha:  # the file changed while it was copied
                os.remove(target)
                raise OSError(f"{rel} changes while it is copied")
        return rel, sha, os.path.getsize(target)

    listed = _each(files.repartition("rel"), keep, "rel string, sha string, size long")
    listed.write.parquet(f"file://{store}/lists/{name}")
    seen = spark.read.parquet(f"file://{store}/lists/{name}").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    os.makedirs(os.path.join(store, "snapshots"), exist_ok=True)
    aside = os.path.join(store, "snapshots", f".{name}")
    with open(aside, "w", encoding="utf-8") as f:
        json.dump({"name": name, "files": seen.n, "bytes": seen["size"]}, f)
    os.replace(aside, os.path.join(store, "snapshots", name))
    return name


def snapshots(vault: str) -> list[str]:
    """Names of the complete snapshots, oldest first."""
    folder = os.path.join(plain_path(vault), "snapshots")
    return sorted(n for n in os.listdir(folder) if not n.startswith(".")) if os.path.isdir(folder) else []


def damaged(spark: SparkSession, vault: str, name: str) -> DataFrame:
    """The files of a snapshot whose content is missing or has another digest or size, worked out in tasks."""
    store = plain_path(vault)
    listed = spark.read.parquet(f"file://{store}/lists/{name}")

    def look(rel: str, sha: str, size: int) -> tuple[str, str, bool]:
        path = os.path.join(store, "objects", sha[:2], sha)
        return rel, sha, os.path.exists(path) and os.path.getsize(path) == size and _sha(path) == sha

    return _each(listed.repartition("rel"), look, "rel string, sha string, sound boolean").where("NOT sound").select("rel", "sha")


def restore(spark: SparkSession, vault: str, name: str, target: str) -> int:
    """Put a snapshot's files into a new folder; refused, with nothing written, if one of them is damaged. Returns their number."""
    store, goal = plain_path(vault), plain_path(target)
    if name not in snapshots(vault):
        raise SnapshotDamaged(f"no snapshot {name}")
    if os.path.exists(goal):
        raise FileExistsError(goal)
    with open(os.path.join(store, "snapshots", name), encoding="utf-8") as f:
        told = json.load(f)
    listed = spark.read.schema("rel string, sha string, size long").parquet(f"file://{store}/lists/{name}")
    if listed.count() != told["files"] or damaged(spark, vault, name).limit(1).count():
        raise SnapshotDamaged(name)
    aside = f"{goal}.{uuid.uuid4().hex}.tmp"
    os.makedirs(aside)

    def put(rel: str, sha: str, size: int) -> tuple[str, int]:
        _put(os.path.join(store, "objects", sha[:2], sha), os.path.join(aside, rel))
        return rel, size

    n = _each(listed.repartition("rel"), put, "rel string, size long").count()
    os.replace(aside, goal)
    return n


def retain(spark: SparkSession, vault: str, newest: int) -> list[str]:
    """Keep the newest snapshots and what they refer to; returns the names of those that went."""
    store, names = plain_path(vault), snapshots(vault)
    gone = names[: max(0, len(names) - newest)]
    kept = names[len(gone) :]
    for name in gone:  # the mark first: what is half removed is no snapshot
        os.remove(os.path.join(store, "snapshots", name))
    if gone:
        lists = lambda some: spark.read.schema("rel string, sha string, size long").parquet(*[f"file://{store}/lists/{n}" for n in some]).select("sha").distinct()
        free = lists(gone).join(lists(kept), "sha", "left_anti") if kept else lists(gone)

        def drop(_: str, sha: str, size: int) -> tuple[str, int]:
            path = os.path.join(store, "objects", sha[:2], sha)
            if os.path.exists(path):
                os.remove(path)
            return sha, size

        _each(free.select(F.lit("").alias("rel"), "sha", F.lit(0).cast("long").alias("size")), drop, "sha string, size long").count()
    return gone
