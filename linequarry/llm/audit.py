"""Filter interaction audit: what each filter removes in every order of the filters, from one pass over the documents.

Every document gets a mask of the filters it fails. Masks are counted per part (and labels with them), and a
subset-zeta transform turns a part's counts by mask into survivors of every subset of the filters: the documents whose
mask lies in the subset's complement. A step of an order is then the difference between two neighbouring subsets, so
no order is ever run over documents.

Filters look at one text, and one more may look at the whole table: a copy fails if the same text has a smaller doc_id
anywhere. Texts are told apart by SHA-256; equal texts have equal masks, so what is shuffled is digests, and rows that
repeat doc_id, text and part are counted before the shuffle.

Null text counts as empty and a null part as the empty string. A row without doc_id is no copy of any other, makes
none, and has no labels. Rows that repeat doc_id and text are no copies of each other. A doc_id with several label
rows is good, or toxic, if any of them says so; null labels say nothing. An empty table has no parts and gives no row.
Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHITE = "[\\x20\\x09-\\x0D]+"
#: What is counted of the documents with one mask.
COUNTED = ("n", "good", "toxic")


def quality_filters(text: Column) -> dict[str, Column]:
    """The filters on one text, by letter, as what makes a text fail: short, repetitive, shouting, odd signs."""
    words = F.array_remove(F.split(text, _WHITE), "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, filters=quality_filters, copies: str | None = "E", part: str = "source") -> tuple[list[str], DataFrame]:
    """The filters' letters, lowest bit first, and part, mask, n, good, toxic: documents by mask.

    filters: makes the conditions from the text's column; copies: the letter of the filter of copies, None for none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    conditions = filters(F.col("text"))
    mask = F.lit(0)
    for bit, failing in enumerate(conditions.values()):
        mask = mask + F.when(failing, 1 << bit).otherwise(0)
    own = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))
    own = own.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    if copies is not None:
        first = own.groupBy("digest").agg(F.min("doc_id").alias("first")).select("digest", F.col("first").alias("doc_id"), F.lit(True).alias("is_first"))
        copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
        own = own.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << len(conditions)).otherwise(0)).alias("mask"), "n")
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    said = said.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    marks = [F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNTED[1:]]
    counted = own.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *marks)
    return [*conditions, *([copies] if copies is not None else [])], counted


def survivors(counts: DataFrame, bits: int) -> DataFrame:
    """part and an array for each of COUNTED: at index s what passes every filter of the subset s.

    The subset-zeta transform sums counts over the subsets of a mask, one bit after the other; what passes the
    filters s has a mask within the complement of s.
    """
    full = (1 << bits) - 1
    entry = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTED).alias("c"))))  # at most 2**bits entries
    parts = counts.groupBy("part").agg(entry.alias("m"))
    at = [F.expr(f"transform(sequence(0, {full}), i -> coalesce(m[i].{c}, 0L))").alias(c) for c in COUNTED]
    parts = parts.select("part", *at)
    for b in range(bits):
        step = "transform({c}, (v, i) -> v + if((i & {bit}) != 0, {c}[i - {bit}], 0L))"
        parts = parts.select("part", *[F.expr(step.format(c=c, bit=1 << b)).alias(c) for c in COUNTED])
    return parts.select("part", *[F.reverse(c).alias(c) for c in COUNTED])  # index s holds what was at full - s


def interactions(letters: list[str], counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from the counts by mask."""
    bits = len(letters)
    full = (1 << bits) - 1
    parts = survivors(counts, bits)
    steps = []
    for order in permutations(range(bits)):
        name, before = "".join(letters[i] for i in order), 0
        for k, i in enumerate(order, 1):
            steps.append((name, k, before, before | 1 << i, i))
            before |= 1 << i
    table = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, after int, bit int")

    def shapley(i: int) -> str:
        """Of all orders, |s|! (bits - 1 - |s|)! run exactly the filters s before this one."""
        without = [s for s in range(full + 1) if not s >> i & 1]
        return " + ".join(f"{factorial(s.bit_count()) * factorial(bits - 1 - s.bit_count())}L * (n[{s}] - n[{s | 1 << i}])" for s in without)

    parts = parts.withColumn("shapley", F.expr(f"array({', '.join(shapley(i) for i in range(bits))})"))
    out = parts.crossJoin(F.broadcast(table))  # the orders are a fixed table, not data
    lost = {"good_lost": "good[before] - good[after]", "toxic_lost": "toxic[before] - toxic[after]"}
    removed = "n[before] - n[after]"
    return out.select(
        "part", "filter_order", "step", F.expr("n[after]").alias("kept"), F.expr(removed).alias("removed"),
        F.expr(f"n[0] - n[shiftleft(1, bit)] - ({removed})").alias("redundant"),
        F.expr(f"n[{full} - shiftleft(1, bit)] - n[{full}]").alias("unique_fails"),
        *[F.expr(e).alias(c) for c, e in lost.items()], F.expr("shapley[bit]").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction audit of the five quality filters per source."""
    return interactions(*mask_counts(docs, labels))


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) v(letter, k)),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || u.letter AS filter_order, [p.k, q.k, r.k, s.k, u.k] AS ks FROM x p, x q, x r, x s, x u
      WHERE len(list_distinct([p.k, q.k, r.k, s.k, u.k])) = 5),
steps AS (SELECT filter_order, i::INT AS step, ks[i] AS k, ks[1:i-1] AS earlier FROM o, range(1, 6) r(i)),
one AS (
  SELECT part, filter_order, step, k,
         coalesce(sum(n) FILTER (NOT fails[k] AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails[k] AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails[k] AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (fails[k] AND len(list_filter(fails, lambda z: z)) = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails[k] AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails[k] AND NOT gone), 0) AS toxic_lost
  FROM (SELECT m.*, s.*, len(list_filter(s.earlier, lambda z: m.fails[z])) > 0 AS gone FROM m, steps s)
  GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, k)::BIGINT AS shapley
FROM one
"""
