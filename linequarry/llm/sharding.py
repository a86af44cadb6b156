"""Balanced label propagation of documents over shards, in DataFrame operations only.

Documents with equal texts are linked. Labels (shards) start dealt out evenly. In every round each document looks
at how many of its neighbours each shard holds and asks to move to the fullest one; a group larger than a shard
asks for as many shards as it needs, in the order of what they hold already. For every pair of shards as many
documents move one way as the other, linked ones first and unlinked ones as ballast, so the sizes never change:
law `rows`, counts at most one apart, holds from the first round to the last while fewer links are cut.

Null text counts as none: size 1, grouped with empty texts. A null doc_id is one like any other. Repeated rows are placed each for itself; ties go by
hash and doc_id. With fewer rows than shards some shards stay empty. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, saved

SHARDS = 16
ROUNDS = 3
#: Cells of a distributed numbering: a row's number is its place in its cell plus the rows of the cells before it.
CELLS = 1024
#: The same where rows are numbered per pair of shards.
PAIR_CELLS = 16
#: A group with more than this share (1 in HOT) of all rows is not joined by key.
HOT = 1000
_STATE = ["doc_id", "size", "text_crc32", "grp", "spread", "shard"]


def numbered(rows: DataFrame, within: list[str], name: str, cells: int = CELLS) -> DataFrame:
    """Gapless numbers from 0 within each combination of few values; no task sees more than a cell's rows."""
    rows = rows.withColumn("_cell", F.pmod("spread", F.lit(cells)))
    counts = rows.groupBy(*within, "_cell").count()
    before = F.coalesce(F.sum("count").over((Window.partitionBy(*within) if within else Window.partitionBy()).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*within, "_cell", before.alias("_before"))  # at most `cells` rows per combination
    place = F.row_number().over(Window.partitionBy(*within, "_cell").orderBy("spread", "doc_id"))
    ranked = rows.withColumn("_place", place)
    return ranked.join(F.broadcast(offsets), [*within, "_cell"]).withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_cell", "_before", "_place")


def _wishes(rows: DataFrame, total: int, turn: int, shards: int) -> DataFrame:
    """Each row's target (its own shard if it is content) and whether it is linked."""
    capacity = max(1, total // shards)
    by = F.array(*[F.struct((-F.count_if(F.col("shard") == k)).alias("less"), F.lit(k).alias("shard")) for k in range(shards)])
    liked = (
        rows.groupBy("grp")
        .agg(F.count("*").alias("total"), F.array_sort(by).alias("by"))
        .where("total > 1")
        .select("grp", "total", F.transform(F.slice("by", 1, F.least(F.ceil(F.col("total") / F.lit(capacity)), F.lit(shards)).cast("int")), lambda s: s["shard"]).alias("liked"))
    )
    liked = saved(liked, f"shard-liked-{turn}")
    # a group that holds more than 1 in HOT rows is told by broadcast (there are fewer than HOT of them), the others by a join
    hot = liked.where(F.col("total") * HOT > total).select("grp", F.col("liked").alias("_hot"))
    cold = liked.where(F.col("total") * HOT <= total).select("grp", "liked")
    known = rows.join(F.broadcast(hot), "grp", "left")
    told = known.where("_hot is null").drop("_hot").join(cold, "grp", "left").unionByName(known.where("_hot is not null").withColumnRenamed("_hot", "liked"))
    mixed: Column = F.xxhash64("spread", F.lit(turn))
    linked = F.col("liked").isNotNull()
    wish = (
        F.when(~linked, F.pmod(mixed, F.lit(shards)).cast("int"))
        .when(F.array_contains("liked", F.col("shard")), F.col("shard"))
        .otherwise(F.element_at("liked", (F.pmod(mixed, F.size("liked")) + 1).cast("int")))
    )
    return told.withColumn("target", wish).withColumn("linked", linked).drop("liked")


def _exchange(wished: DataFrame) -> DataFrame:
    """Carry out as many moves from a to b as from b to a."""
    ask = wished.where("target <> shard").groupBy("shard", "target").agg(F.count_if("linked").alias("x"), F.count("*").alias("t"))
    back = ask.select(F.col("shard").alias("target"), F.col("target").alias("shard"), F.col("x").alias("bx"), F.col("t").alias("bt"))
    flow = ask.join(F.broadcast(back), ["shard", "target"]).select("shard", "target", "x", F.least("t", "bt", F.greatest("x", "bx")).alias("allowed"))
    moving = wished.where("target <> shard")
    ranked = numbered(moving, ["shard", "target", "linked"], "rank", PAIR_CELLS).join(F.broadcast(flow), ["shard", "target"], "left")
    goes = F.when(F.col("linked"), F.col("rank")).otherwise(F.col("rank") + F.col("x")) < F.col("allowed")
    moved = ranked.withColumn("shard", F.when(F.coalesce(goes, F.lit(False)), F.col("target")).otherwise(F.col("shard")))
    return wished.where("target = shard").select(*_STATE).unionAll(moved.select(*_STATE))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, grp (the text's digest)."""
    docs = documents(docs)
    rows = docs.select("doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), F.md5("text").alias("grp"))
    rows = saved(rows.withColumn("spread", F.xxhash64("doc_id", "grp", F.monotonically_increasing_id())), "shard-rows")  # repeated rows spread too
    total = rows.count()
    now = saved(numbered(rows, [], "pos").withColumn("shard", F.pmod("pos", F.lit(shards)).cast("int")).drop("pos"), "shard-0")
    for turn in range(1, rounds + 1):
        wished = saved(_wishes(now, total, turn, shards), f"shard-wishes-{turn}")
        now = saved(_exchange(wished), f"shard-{turn}")
    return numbered(now, ["shard"], "slot").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "grp")


def cut_share(sharded: DataFrame) -> DataFrame:
    """Links between equal texts and how many of them lie across shards, from counts alone."""
    pairs = lambda n: n * (n - 1) / 2
    held = sharded.groupBy("grp", "shard").agg(F.count("*").alias("n"))
    whole = held.groupBy("grp").agg(F.sum("n").alias("total"), F.sum(pairs(F.col("n"))).alias("inside"))
    return whole.agg(F.sum(pairs(F.col("total"))).alias("links"), F.sum(pairs(F.col("total")) - F.col("inside")).alias("cut"))
