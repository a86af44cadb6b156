"""The write path as set operations: numbering, upserts, idempotent batches, retention, commit by manifest."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numbering import counted_out, numbered


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return newest(rows, keys, order, 1)


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the order given."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def append_numbered(old: DataFrame | None, new: DataFrame, business_key: list[str], order: list[str], scope: str = "task_id", number: str = "global_sequence") -> DataFrame:
    """old and those of new whose business key isn't there, numbered on from the scope's highest number; ignored rows use none."""
    fresh = new.dropDuplicates(business_key)
    if old is not None:
        fresh = fresh.join(old, business_key, "left_anti")
    fresh = numbered(fresh, [scope], order, number)
    if old is None:
        return fresh
    top = old.groupBy(scope).agg(F.max(number).alias("_top"))
    fresh = fresh.join(top, scope, "left").withColumn(number, F.coalesce("_top", F.lit(0)) + F.col(number)).drop("_top")
    return old.unionByName(fresh)


def added(before: DataFrame | None, after: DataFrame) -> int:
    """How many rows an append has added."""
    return after.count() - (before.count() if before is not None else 0)


def fill_gaps(rows: DataFrame, scope: str, number: str, order: list[str]) -> DataFrame:
    """Keep the valid numbers of a scope (1 to its row count, first holder) and give the free ones, in order, to the other rows.

    order names columns that tell the rows of a scope apart.
    """
    sizes = rows.groupBy(scope).agg(F.count("*").alias("_n"))
    counted = rows.join(sizes, scope)
    held = counted.where(F.col(number).between(1, F.col("_n"))).groupBy(scope, number).agg(F.min(F.struct(*order)).alias("_first"))
    mine = F.struct(*order)
    kept = rows.withColumn("_first", mine).join(held, [scope, number, "_first"], "left_semi").drop("_first")
    rest = rows.withColumn("_first", mine).join(held.select(scope, "_first"), [scope, "_first"], "left_anti").drop("_first")
    free = counted_out(sizes, [scope], "_n", "_free").join(held.select(scope, F.col(number).cast("long").alias("_free")), [scope, "_free"], "left_anti")
    free = numbered(free, [scope], ["_free"], "_r")
    given = numbered(rest, [scope], order, "_r").join(free, [scope, "_r"]).withColumn(number, F.col("_free").cast("int"))
    return kept.withColumn(number, F.col(number).cast("int")).select(*rows.columns).unionByName(given.select(*rows.columns))


def latest_reviews(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The review state after a log of partial changes: each column from the last change that sets it, also to null."""
    pick = lambda flag, col: F.max_by(F.when(F.col(flag), F.struct(F.col(col).alias("v"))), F.when(F.col(flag), F.col(order)))["v"]
    return log.groupBy(*keys).agg(pick("sets_decision", "decision").alias("decision"), pick("sets_note", "note").alias("note"), F.max(order).alias("updated"))


def planned_decisions(changes: DataFrame, known: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Each change with the state before it, whether its target is missing and whether the batch names it twice."""
    flagged = changes.join(known.select(key, F.lit(True).alias("_known")).distinct(), key, "left").join(current.select(key, F.col("decision").alias("previous")), key, "left")
    return flagged.select(key, "decision", "previous", F.col("_known").isNull().alias("missing"), (F.count("*").over(Window.partitionBy(key)) > 1).alias("duplicate"))


class BatchRefused(ValueError):
    """A batch that names a target twice, a missing one, or an operation id with other content."""


def apply_decisions(current: DataFrame, changes: DataFrame, known: DataFrame, ledger: DataFrame, key: str, operation_id: str, keep: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """All changes or none: (reviews after, ledger after). A repeated operation with the same content changes nothing."""
    one = F.xxhash64(F.col(key).cast("string"), "decision").cast("decimal(38,0)")  # summed, so no task holds the batch
    sums = changes.agg(F.count("*").alias("n"), F.sum(one).alias("a"), F.sum(F.xxhash64(one).cast("decimal(38,0)")).alias("b")).first()
    digest = hashlib.sha256(f"{sums.n}|{sums.a}|{sums.b}".encode()).hexdigest()
    before = ledger.where(F.col("operation_id") == operation_id).select("request_hash").first()
    if before is not None:
        if before.request_hash != digest:
            raise BatchRefused("operation id was used for another request")
        return current, ledger
    wrong = planned_decisions(changes, known, current, key).agg(F.count_if("missing").alias("m"), F.count_if("duplicate").alias("d")).first()
    if wrong.m or wrong.d:
        raise BatchRefused(f"{wrong.m} missing, {wrong.d} named twice")
    after = current.join(changes, key, "left_anti").unionByName(changes.select(key, "decision"))
    now = current.sparkSession.sql("SELECT current_timestamp() AS t").first().t  # taken once: the ledger says the same whenever it is read
    row = current.sparkSession.createDataFrame([(operation_id, digest, now)], "operation_id string, request_hash string, created_at timestamp")
    grown = ledger.unionByName(row)
    return after, grown.orderBy(F.desc("created_at"), F.desc("operation_id")).limit(keep)


def optimistic(writes: DataFrame, overrides: DataFrame, keys: list[str], expected: str, updated: str) -> DataFrame:
    """Writes whose expectation holds: none expected and none there, or the expected version is the one there."""
    fresh = writes.where(F.col(expected).isNull()).join(overrides, keys, "left_anti")
    matched = writes.where(F.col(expected).isNotNull()).join(overrides.select(*keys, F.col(updated).alias(expected)), [*keys, expected], "left_semi")
    return fresh.unionByName(matched)


def stale_after(rows: DataFrame, overrides: DataFrame, keys: list[str], made: str, version: str) -> DataFrame:
    """Adds stale: whether an override of the row's page is newer than the row."""
    return rows.join(overrides, keys, "left").withColumn("stale", F.coalesce(F.col(made) < F.col(version), F.lit(False))).drop(version)


def page_violations(lined: DataFrame, longest: int = 600) -> DataFrame:
    """Per page: number of lines, gaps in their numbering, overlong lines, distinct confidences."""
    return lined.groupBy("source_id", "page_no").agg(
        F.count("*").alias("n_lines"), ((F.min("line_index") != 0) | (F.max("line_index") + 1 != F.count("*"))).alias("gap"), F.bool_or(F.length("raw_text") > longest).alias("long_line"), F.count_distinct("confidence").alias("kinds")
    )


def appended_events(known: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """fresh numbered on from each task's last sequence."""
    top = known.groupBy("task_id").agg(F.max("sequence").alias("_top"))
    placed = numbered(fresh, ["task_id"], [order], "_place")
    return placed.join(top, "task_id", "left").select("task_id", (F.coalesce("_top", F.lit(0)) + F.col("_place")).cast("long").alias("sequence"), "kind")


def replaced(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """new in place of all old rows of the scopes that new has."""
    return new.unionByName(old.join(new.select(*scope).distinct(), scope, "left_anti"))


class AlreadyCommitted(ValueError):
    """A key that must be new is in the manifest."""


class Moved(ValueError):
    """The manifest went on since the state a batch was worked out from."""


class Committed:
    """Batches of several tables that appear all at once: data under folders of one attempt each, then one manifest entry.

    An entry is created under the next free number, which the file system gives to one writer only; what names it is
    the key of the batch, and of several entries with one key the first counts. Readers see only the folders that the
    manifest names: an attempt that died before its entry is an orphan, one that died in it left an empty entry, which
    nobody reads.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self._path(f"{self.root}/manifest").getFileSystem(self._conf()).mkdirs(self._path(f"{self.root}/manifest"))

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf())

    def _entries(self) -> tuple[int, dict[str, dict]]:
        """The next free number, and the manifest's entries by key in order."""
        found, top = {}, -1
        for f in self._fs().listStatus(self._path(f"{self.root}/manifest")):
            name = f.getPath().getName()
            if not name.isdigit():
                continue
            top = max(top, int(name))
            if f.getLen():
                stream = self._fs().open(f.getPath())
                try:
                    found[int(name)] = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
                finally:
                    stream.close()
        by_key: dict[str, dict] = {}
        for _, entry in sorted(found.items()):
            by_key.setdefault(entry["batch"], entry)
        return top + 1, by_key

    def batches(self) -> list[str]:
        return list(self._entries()[1])

    def commit(self, tables: dict[str, DataFrame], key: str | None = None, new: bool = False, between=None, seen: int | None = None) -> str:
        """Write all tables and make them visible; a key that is committed already is left as it is, or refused if it must be new.

        between: called when the data is there and the entry is not (where a writer may be lost). seen: the next
        number when the state was read that the tables were worked out from; Moved if another has it by now.
        """
        batch = key or uuid.uuid4().hex
        if batch in self.batches():
            if new:
                raise AlreadyCommitted(batch)
            return batch
        attempt = f"{batch}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/batch={attempt}")
        if between is not None:
            between()
        entry = json.dumps({"batch": batch, "attempt": attempt, "tables": sorted(tables)}).encode("utf-8")
        while True:
            number, known = self._entries()
            if batch in known:  # another writer committed the same key meanwhile
                if new:
                    raise AlreadyCommitted(batch)
                return batch
            if seen is not None and number != seen:
                raise Moved(batch)
            try:
                stream = self._fs().create(self._path(f"{self.root}/manifest/{number:012d}"), False)
            except Py4JJavaError as e:
                if not self._fs().exists(self._path(f"{self.root}/manifest/{number:012d}")):
                    raise e
                continue  # the number went to another writer
            try:
                stream.write(bytearray(entry))
            finally:
                stream.close()
            if self._entries()[1][batch]["attempt"] != attempt and new:
                raise AlreadyCommitted(batch)
            return batch

    def read(self, name: str, batches: list[str] | None = None) -> DataFrame | None:
        """A table as of the manifest, or as of a list of batches taken earlier (a snapshot)."""
        known = self._entries()[1]
        chosen = [known[b] for b in (known if batches is None else batches)]
        paths = [f"{self.root}/{name}/batch={e['attempt']}" for e in chosen if name in e["tables"]]
        return self.spark.read.parquet(*paths) if paths else None

    def pin(self) -> Snapshot:
        """The state now: later commits do not show in it."""
        number, known = self._entries()
        return Snapshot(self, list(known), number)


@dataclass(frozen=True)
class Snapshot:
    """One state of a store."""

    store: Committed
    batches: list[str]
    number: int = 0

    def read(self, name: str) -> DataFrame | None:
        return self.store.read(name, self.batches)

    def totals(self, name: str, pages: list[str]) -> dict[str, int]:
        """Rows of a table and its distinct pages."""
        df = self.read(name)
        if df is None:
            return {"total": 0, "pages": 0}
        row = df.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*pages)).alias("p")).first()
        return {"total": row.n, "pages": row.p}

    def in_batches(self, name: str, order: list[str], size: int = 500) -> Iterator[list]:
        """A table's rows in order, so many at a time: the sort runs on the cluster, the driver holds one batch and one partition."""
        df = self.read(name)
        if df is None:
            return
        held = []
        for row in df.orderBy(*order).toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held
