"""Shared folder, code shipping and Arrow helpers for the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text, and rows, that a Python worker holds decoded at once.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 4000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per SparkContext, for sessions that start without PYTHONPATH."""
    sc = spark.sparkContext
    if getattr(sc, "_linequarry_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="linequarry-code-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "linequarry_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    sc.addPyFile(target)
    sc._linequarry_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share (spark.checkpoint.dir); a local one, removed at exit, only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = getattr(sc, "_linequarry_tmp", None)
        if base is None:
            base = sc._linequarry_tmp = tempfile.mkdtemp(prefix="linequarry-")
            atexit.register(shutil.rmtree, base, True)
    return base.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder under a new name and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/linequarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._linequarry_path = path
    _TABLES.append(path)
    return out


#: Tables written by saved() that are still there, oldest first.
_TABLES: list[str] = []


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    paths = [p for p in paths if p in _TABLES]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _TABLES.remove(p)


def replaced(df: DataFrame, name: str, old: DataFrame) -> DataFrame:
    """saved(df), after which the table `old`, that df was made from and nothing else reads, goes."""
    out = saved(df, name)
    removed(df.sparkSession, [old._linequarry_path])
    return out


def tables() -> list[str]:
    """The tables written by saved() that are still there."""
    return list(_TABLES)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text only, null text as empty; other columns, whatever their names, do not take part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: What a Python worker remembers from one task to the next, and how to forget it.
MEMORIES: list[Callable[[], None]] = []


def release() -> None:
    """Hand memory that is no longer used back to the system; a worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _row_bytes(b: pa.RecordBatch) -> np.ndarray:
    """Bytes that the strings of each row take, at least 1."""
    size = np.ones(b.num_rows, np.int64)
    for c in b.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64)
    return size


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, rows: int = SLICE_ROWS, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no piece holds more than limit bytes of strings or that many rows, one row at least.

    keep: whether this step is one of those that use what the worker remembers; the others start without it.
    """
    if not keep:
        for forget in MEMORIES:
            forget()
    for b in batches:
        if b.num_rows:
            upto = np.cumsum(_row_bytes(b))
            at = 0
            while at < b.num_rows:
                end = int(np.searchsorted(upto, limit + (upto[at - 1] if at else 0), side="right"))
                end = max(at + 1, min(end, at + rows))
                yield b.slice(at, end - at)
                at = end
    release()


def arrow_map(df: DataFrame, one: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS, keep: bool = False) -> DataFrame:
    """mapInArrow over slices of bounded size; one() may return None for nothing."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit, rows, keep):
            out = one(b)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
