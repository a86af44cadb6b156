"""Exports of a snapshot: JSON, review records, offline HTML. Tasks write their blocks at offsets worked out from sizes; no row passes the driver."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import script_safe
from .numbering import written

#: Label of a decision.
DECISIONS = {"confirmed": "Confirmed", "needs_review": "Needs review", "rejected": "Rejected", "unreviewed": "Unreviewed"}


def status_label(decision: Column) -> Column:
    """(value, label) of a decision; anything unknown and null are unreviewed."""
    known = F.create_map(*[F.lit(x) for p in DECISIONS.items() for x in p])
    value = F.when(decision.isin(*DECISIONS), decision).otherwise("unreviewed")
    return F.struct(value.alias("value"), F.element_at(known, value).alias("label"))


def preview(text: Column, length: int = 80) -> Column:
    """Text on one line, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length - 1), F.lit("…"))).otherwise(flat)


def highlight(text: Column, term: Column) -> Column:
    """(before, mark, after) around the first occurrence; all of it before if there is none."""
    at = F.when(F.length(term) > 0, F.instr(text, term)).otherwise(F.lit(0))
    none = at == 0
    return F.struct(F.when(none, text).otherwise(F.substring(text, F.lit(1), at - 1)).alias("before"), F.when(none, "").otherwise(term).alias("mark"), F.when(none, "").otherwise(F.substring(text, at + F.length(term), F.length(text))).alias("after"))


def integrity(status: Column, failures: Column, reviewed: Column, total: Column) -> Column:
    """What an export of a task can claim."""
    return F.when((status == "completed") & (failures == 0) & (reviewed == total), "final").when((status == "completed") & (failures == 0), "scan_complete").otherwise("partial")


#: Bytes of a file that one row of blocks holds, about.
BLOCK_BYTES = 4 << 20
_BLOCK = "part int, block int, body binary, n long, size long"


def _blocks(separator: bytes):
    """Texts of a partition, in order, each with the separator before it, as blocks of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, n, size = TaskContext.get().partitionId(), 0, [], 0, 0

        def out() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, block, b"".join(held), n, size), kinds)], ["part", "block", "body", "n", "size"])

        for b in batches:
            for text in b.column("piece").to_pylist():
                raw = separator + text.encode("utf-8")
                held.append(raw)
                n, size = n + 1, size + len(raw)
                if size >= BLOCK_BYTES:
                    yield out()
                    block, held, n, size = block + 1, [], 0, 0
        if n:
            yield out()

    return run


def plain_path(path: str) -> str:
    """A path of the file system that all tasks see, without its scheme."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError("one file is put together by offset, which takes a mounted file system")
    return path


def assembled(sections: list[tuple[str, DataFrame, list[str]]], tail: Callable[[list[dict]], str], path: str, separator: str = ",\n") -> list[dict]:
    """One file out of sections (text before, rows with a column `piece`, order), written by all tasks at once.

    The rows of a section are dealt to ranges of their order and packed into blocks of bytes; sums of the blocks' sizes
    say where in the file each belongs, and every task writes its blocks there. A task that runs again writes the same
    bytes to the same place. Rows, bytes and hash of each section come from the same blocks and go to `tail`, which
    ends the file; then it gets its name.
    """
    path = plain_path(path)
    temp, at, facts = f"{path}.{uuid.uuid4().hex}.tmp", 0, []
    with open(temp, "wb"):
        pass

    def put(where: int, raw: bytes) -> int:
        with open(temp, "r+b") as f:
            f.seek(where)
            f.write(raw)
        return where + len(raw)

    sep = separator.encode("utf-8")
    for before, rows, order in sections:
        at = put(at, before.encode("utf-8"))
        blocks = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("piece").mapInArrow(_blocks(sep), _BLOCK), "export-blocks")
        parts = blocks.groupBy("part").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
        past = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        before_part = parts.select("part", past(Window.orderBy("part")).alias("_before"))  # a row per range of the sort
        inside = blocks.select("part", "block", past(Window.partitionBy("part").orderBy("block")).alias("_inside"))
        where = inside.join(before_part, "part").select("part", "block", (F.col("_before") + F.col("_inside")).alias("at"))
        shift = at - len(sep)  # the first row has no separator

        def write(batches: Iterator[pa.RecordBatch], shift: int = shift, first: int = at) -> Iterator[pa.RecordBatch]:
            for b in batches:
                done = 0
                with open(temp, "r+b") as f:
                    for offset, body in zip(b.column("at").to_pylist(), b.column("body").to_pylist()):
                        skip = max(0, first - shift - offset)
                        f.seek(shift + offset + skip)
                        f.write(body[skip:])
                        done += len(body) - skip
                yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["bytes"])

        placed = blocks.select("part", "block", "body").join(where, ["part", "block"])
        size = placed.select("at", "body").mapInArrow(write, "bytes long").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
        told = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.crc32("body")), F.lit(0)).alias("crc_sum")).first()
        facts.append({"rows": told.rows, "bytes": size, "crc_sum": told.crc_sum})
        at += size
    put(at, tail(facts).encode("utf-8"))
    os.replace(temp, path)
    return facts


def _json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def write_json(task: dict, occurrences: DataFrame, path: str) -> int:
    """One document: the task, all occurrences in sequence order, one to a line, and what was written; returns its bytes."""
    rows = occurrences.select(_json(occurrences).alias("piece"), "global_sequence")
    head = '{"task": ' + json.dumps(task, ensure_ascii=False) + ', "occurrences": [\n'
    assembled([(head, rows, ["global_sequence"])], lambda f: f'\n], "integrity": {{"occurrences": {f[0]["rows"]}, "bytes": {f[0]["bytes"]}}}}}', path)
    return os.path.getsize(plain_path(path))


def write_reviews(reviews: DataFrame, path: str) -> int:
    """Review records, newest first."""
    rows = reviews.select(_json(reviews).alias("piece"), (-F.col("updated_at").cast("timestamp").cast("double")).alias("_age") if dict(reviews.dtypes)["updated_at"] in ("timestamp", "string", "date") else (-F.col("updated_at")).alias("_age"))
    assembled([("[", rows, ["_age", "piece"])], lambda f: "]", path)
    return os.path.getsize(plain_path(path))


def write_html(title: str, occurrences: DataFrame, pages: DataFrame, path: str) -> int:
    """An offline report: each page's record once, hits refer to it; data is script-safe and the script is pinned by its hash."""
    script = "const d=JSON.parse(document.getElementById('data').textContent);document.getElementById('n').textContent=d.hits.length;"
    pin = base64.b64encode(hashlib.sha256(script.encode()).digest()).decode()
    safe = lambda df, key: df.select(script_safe(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("piece"), key)
    head = f"<!doctype html><meta charset=utf-8><meta http-equiv=Content-Security-Policy content=\"default-src 'none'; script-src 'sha256-{pin}'\"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>Hits: <b id=n></b></p>"
    first = head + '<script id=data type="application/json">{"pages":['
    sections = [(first, safe(pages.dropDuplicates(["page_id"]), "page_id"), ["page_id"]), ('],"hits":[', safe(occurrences, "global_sequence"), ["global_sequence"])]
    tail = lambda f: f'],"facts":{{"pages":{f[0]["rows"]},"hits":{f[1]["rows"]},"bytes":{f[0]["bytes"] + f[1]["bytes"]}}}}}</script><script>{script}</script>'
    assembled(sections, tail, path)
    return os.path.getsize(plain_path(path))


def embedded(files: DataFrame, mime: str) -> DataFrame:
    """Adds data_url: a binary file's content for a single-file report."""
    return files.withColumn("data_url", F.concat(F.lit(f"data:{mime};base64,"), F.base64("content")))
