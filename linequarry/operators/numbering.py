"""Numbers within scopes whose rows no single task can hold: ranges of the order are numbered apart, then brought together."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch

#: Numbers of a sequence that one row stands for before they are spread out.
STRETCH = 65_536


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the scratch folder: what is read again later is what was seen now."""
    path = f"{scratch(df.sparkSession)}/linequarry-core/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; nulls are alike."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    other = np.asarray(pc.fill_null(pc.not_equal(a, b), False))
    return other | (np.asarray(pc.is_null(a)) != np.asarray(pc.is_null(b)))


def _place(scope: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, reached = TaskContext.get().partitionId(), None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in scope:
                new[1:] |= _changes(b.column(c))
            first = tuple(b.column(c)[0].as_py() for c in scope)
            new[0] = first != last
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, at, 0))
            place = at - begin + 1
            if not new[0]:
                head = int(np.argmax(new)) if new.any() else n
                place[:head] += reached
            last, reached = tuple(b.column(c)[n - 1].as_py() for c in scope), int(place[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, here, np.int32)), pa.array(place.astype(np.int64))], names)

    return run


def numbered(rows: DataFrame, scope: list[str], order: list[str], name: str) -> DataFrame:
    """Adds name: the row's place from 1 within its scope, in the order of the columns given (nulls first).

    Rows are dealt to ranges of (scope, order), so a scope may hold any share of them; each range numbers its own, one
    small row per scope and range says how many lie before. Rows alike in scope and order are numbered in any order.
    """
    columns = rows.columns
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    key = [*scope, *order, "_tie"]
    schema = ", ".join([f"`{n}` {k}" for n, k in tied.dtypes] + ["_range int", "_place long"])
    placed = written(tied.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_place(scope, [*tied.columns, "_range", "_place"]), schema), "numbered")
    ranges = placed.groupBy(*scope, "_range").agg(F.max("_place").alias("_n"))
    past = F.sum("_n").over(Window.partitionBy(*scope).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(*[F.col(c).alias(f"_s{k}") for k, c in enumerate(scope)], F.col("_range").alias("_r"), F.coalesce(past, F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(scope):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{k}"))
    return placed.join(ranges, same).select(*columns, (F.col("_before") + F.col("_place")).alias(name))


def counted_out(sizes: DataFrame, keys: list[str], n: str, name: str) -> DataFrame:
    """keys and every number from 1 to n, spread by stretches so that no row makes more than STRETCH."""
    low = F.explode(F.sequence(F.lit(0).cast("long"), (F.col(n) - 1).cast("long"), F.lit(STRETCH).cast("long"))).alias("_low")
    some = sizes.where(F.col(n) > 0).select(*keys, F.col(n).alias("_n"), low)
    return some.select(*keys, F.explode(F.sequence(F.col("_low") + 1, F.least(F.col("_low") + STRETCH, F.col("_n").cast("long")))).alias(name))
