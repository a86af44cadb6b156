"""Secret scans over a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived that every match must satisfy. The
index holds, for the trigrams that some query asks for, which documents contain them; a document's postings are
brought together, the queries are answered on them, and only candidates are searched with the expression itself.
A rule from which no trigram is mandatory searches every text.

Kinds assign, access and hex are the base; further rules add spans and never take any away. Offsets count code
points, ends are exclusive, matches of one kind don't overlap and come leftmost first. Null and empty texts hold
nothing; repeated rows and rows without doc_id are searched each for itself; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

try:  # the standard library's expression parser
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser

#: Alternatives of one stretch of an expression that are still told apart.
MOST = 24
#: Trigrams in one word of a document's mask.
BITS = 62
#: Matches that are put in line together.
RUN = 64
#: Characters in a piece of a text from which masked text is put together.
PIECE = 256


@dataclass(frozen=True)
class Rule:
    """pattern as Java and re read it; a match counts if its group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in their order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # also takes what only begins like one, with an empty group, so that no stretch is gone over twice
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+((?:\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?)", 1, 1),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
)

Query = tuple  # ("all",) | ("has", trigram) | ("and", queries) | ("or", queries)
ALL: Query = ("all",)


def _and(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if not parts or ALL in parts:
        return ALL
    plain = lambda q: frozenset(q[1]) if q[0] == "and" else frozenset([q])
    parts = [p for p in parts if not any(plain(o) < plain(p) for o in parts)]  # what asks for more than another adds nothing
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What a text must hold to hold one of these strings."""
    return _or([_and([("has", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(tree) -> tuple[set[str] | None, Query]:
    """The strings (lower case) an expression can match, None if too many, and a query that then holds for its matches."""
    found: list[Query] = []
    now: set[str] = {""}
    for op, arg in tree:
        strings: set[str] | None
        query = ALL
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
            strings = {chr(c).lower() for _, c in arg}
        elif op is sre.SUBPATTERN:
            strings, query = _walk(arg[-1])
        elif op is sre.BRANCH:
            ways = [_walk(w) for w in arg[1]]
            strings = set().union(*(s for s, _ in ways)) if all(s is not None for s, _ in ways) else None
            if strings is None:
                query = _or([q if s is None else _and([q, _of_strings(s)]) for s, q in ways])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            strings, query = _walk(inner)
            if low == 0:
                query = ALL
                strings = strings | {""} if strings is not None and high == 1 else None
            elif not low == high == 1:
                if strings is not None:
                    query = _and([query, _of_strings(strings)])
                strings = None
        elif op is sre.AT:
            continue
        else:
            strings = None
        found.append(query)
        if strings is not None and len(now) * len(strings) <= MOST:
            now = {a + b for a in now for b in strings}
        else:
            found.append(_of_strings(now))
            now = strings if strings is not None and len(strings) <= MOST else {""}
            if strings is None:
                found.append(("cut",))
    if ("cut",) in found:
        found = [q for q in found if q != ("cut",)]
        return None, _and([*found, _of_strings(now)])
    if any(q != ALL for q in found):
        return None, _and([*found, _of_strings(now)])
    return now, ALL


def trigram_query(pattern: str) -> Query:
    """A query over lower-case trigrams that every text with a match satisfies; ALL if there is none."""
    strings, query = _walk(parser.parse(re.sub(r"\(\?i:", "(?:", pattern)))
    return query if strings is None else _and([query, _of_strings(strings)])


def _grams(q: Query) -> set[str]:
    return {q[1]} if q[0] == "has" else set().union(set(), *(_grams(x) for x in q[1])) if q[0] in ("and", "or") else set()


def _answer(q: Query, place: dict[str, int]) -> Column:
    if q[0] == "all":
        return F.lit(True)
    if q[0] == "has":
        word, bit = divmod(place[q[1]], BITS)
        return F.col(f"mask{word}").bitwiseAND(F.lit(1 << bit)) != 0
    parts = [_answer(x, place) for x in q[1]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if q[0] == "and" else (out | p)
    return out


def row_key() -> Column:
    """What a row's postings and its text meet by: doc_id and text, so rows without doc_id spread. Rows that share it by
    chance share their candidates, which the expressions then tell apart."""
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index for some trigrams: trigram number, row key."""
    wanted = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(g).alias("g")) for n, g in enumerate(grams)])
    inside = F.transform(F.array(F.lower("text")), lambda low: F.transform(F.filter(wanted, lambda w: F.contains(low, w.g)), lambda w: w.n))
    return docs.select(row_key().alias("key"), F.explode(inside[0]).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Row key and a flag per rule that has a query, for documents that satisfy one."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ALL}
    grams = sorted(set().union(*map(_grams, queries.values())))
    place = {g: n for n, g in enumerate(grams)}
    # postings of a document come together: map-side sums of distinct bits, then one row per document
    words = [F.bit_or(F.when(F.floor(F.col("gram") / BITS) == w, F.expr(f"shiftleft(1L, gram % {BITS})")).otherwise(F.lit(0).cast("long"))).alias(f"mask{w}") for w in range(-(-len(grams) // BITS))]
    masks = postings(docs, grams).groupBy("key").agg(*words)
    flags = [_answer(q, place).alias(f"may_{k}") for k, q in queries.items()]
    out = masks.select("key", *flags)
    some = F.lit(False)
    for k in queries:
        some = some | F.col(f"may_{k}")
    return out.where(some)


_ONE = "struct<start:bigint,place:int,end:bigint,kind:string>"
_SPAN = f"array<{_ONE}>"


def scanned(items: Column, zero: Column, after: Callable[[Column, Column], Column], one: Callable[[Column, Column], Column], kind: str) -> Column:
    """one(state, item) for every item of an array, where after(state, item) is the state for the next one. Arrays are
    only ever appended to in runs of RUN items, so the cost does not grow with the square of the array."""
    let = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  # value is worked out once
    cut = lambda some: F.transform(F.sequence(F.lit(0), F.floor((F.size(some) - 1) / RUN).cast("int")), lambda k: F.slice(some, k * RUN + 1, RUN))
    none = F.array().cast(f"array<{kind}>")
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def inside(run: Column, at: Column) -> Column:
        grown = F.aggregate(run, state(at, F.array().cast(f"array<{kind}>")), lambda s, r: state(after(s["at"], r), F.concat(s["out"], F.array(one(s["at"], r))).cast(f"array<{kind}>")))
        return grown["out"]

    def whole(runs: Column) -> Column:
        begun = F.aggregate(runs, state(zero, F.array().cast("array<bigint>")), lambda s, run: state(F.aggregate(run, s["at"], after), F.concat(s["out"], F.array(s["at"]))))
        return F.flatten(F.zip_with(runs, begun["out"], inside))

    many = lambda some: let(cut(some), whole)
    return let(items, lambda some: F.when(F.size(some) == 0, none).when(F.size(some) <= RUN, inside(some, zero)).otherwise(many(some)))


def spans(text: Column, rule: Rule, place: int) -> Column:
    """All spans of one rule: what splitting by the expression leaves and what it takes give the offsets."""
    pattern = F.lit(rule.pattern)
    rows = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("a"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("b"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("c")
    )
    rows = F.transform(rows, lambda r: F.struct(F.length(r["a"]).cast("long").alias("a"), F.length(r["b"]).cast("long").alias("b"), F.length(r["c"]).cast("long").alias("c")))
    after = lambda at, r: at + r["a"] + F.coalesce(r["b"], F.lit(0))

    def one(at: Column, r: Column) -> Column:
        start = at + r["a"]
        return F.when(r["c"] >= rule.least, F.struct(start.alias("start"), F.lit(place).alias("place"), (start + r["b"]).alias("end"), F.lit(rule.kind).alias("kind")))

    found = F.array_compact(scanned(rows, F.lit(0).cast("long"), after, one, _ONE))
    quick = rule.pattern
    if not rule.group and rule.least > 1 and rule.pattern.endswith("]+"):  # shorter matches would be dropped anyway
        low, high = parser.parse(rule.pattern[: rule.pattern.rindex("[")]).getwidth()
        if low == high < rule.least:
            quick = f"{rule.pattern[:-1]}{{{rule.least - low},}}"
    return F.when(text.rlike(quick), found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, carry: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, text, spans (array of start, place of the rule, end, kind) by start, then rule;
    carry: a column of docs that goes along as `carried`."""
    plain = documents(docs)
    known = candidates(plain, rules).withColumnRenamed("key", "_key")
    whole = plain if carry is None else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), carry.alias("carried"))
    joined = whole.join(known, row_key() == F.col("_key"), "left")
    found = []
    for n, r in enumerate(rules):
        if f"may_{r.kind}" in known.columns:
            found.append(F.when(F.col(f"may_{r.kind}"), spans(F.col("text"), r, n)).otherwise(F.array().cast(_SPAN)))
        else:
            found.append(spans(F.col("text"), r, n))
    return joined.select("doc_id", "text", *([] if carry is None else ["carried"]), F.array_sort(F.concat(*found)).cast(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))).alias("spans"))


def _said(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as text."""
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan_secrets(docs, rules).select("doc_id", *[count(r.kind) for r in BASE], F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, carry: Column | None = None) -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets, n_spans. Overlapping spans are replaced as one, by the first's kind."""
    let = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  # value is worked out once

    def stretch(pieces: Column, start: Column, end: Column) -> Column:
        """The characters from start to before end, from the pieces they lie in; the text is never gone through again."""
        i, j = F.floor(start / PIECE), F.floor((end - 1) / PIECE)
        inside = F.substring(pieces[i], (start - i * PIECE + 1).cast("int"), (end - start).cast("int"))
        head = F.substring(pieces[i], (start - i * PIECE + 1).cast("int"), F.lit(PIECE))
        between = F.array_join(F.slice(pieces, (i + 2).cast("int"), F.greatest(F.lit(0), j - i - 1).cast("int")), "")
        tail = F.substring(pieces[j], F.lit(1), (end - j * PIECE).cast("int"))
        return F.when(end <= start, F.lit("")).when(i == j, inside).otherwise(F.concat(head, between, tail))

    def masked(pieces: Column) -> Column:
        piece = lambda at, s: F.when(s["start"] < at, F.lit("")).otherwise(F.concat(stretch(pieces, at, s["start"]), F.lit("["), s["kind"], F.lit("]")))
        done = scanned(F.col("spans"), F.lit(0).cast("long"), lambda at, s: F.greatest(at, s["end"]), piece, "string")
        rest = stretch(pieces, F.array_max(F.transform("spans", lambda s: s["end"])), F.length("text").cast("long"))
        return F.concat(F.array_join(done, ""), rest)

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(let(pieces, masked))
    return scan_secrets(docs, rules, carry).select("doc_id", text.alias("text"), *([] if carry is None else ["carried"]), F.size("spans").cast("long").alias("n_spans"))


def sql(rules: tuple[Rule, ...] = BASE + MORE) -> str:
    """The digests in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for n, r in enumerate(rules):
        p = quote(r.pattern)
        parts.append(
            f"SELECT doc_id, {n} AS place, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(a[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'n': length(m[i]), 'g': length(g[i])}})) AS x"
            f" FROM (SELECT doc_id, string_split_regex(t, {p}) AS a, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS g FROM d WHERE regexp_matches(t, {p}))"
        )
    least = " ".join(f"WHEN {n} THEN {r.least}" for n, r in enumerate(rules))
    base = len(BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
f AS (SELECT doc_id, place, kind, x.s AS s, kind || ':' || x.s || ':' || (x.s + x.n) AS said FROM raw WHERE x.g >= CASE place {least} END),
g AS (SELECT doc_id, {counts}, coalesce(string_agg(said, ',' ORDER BY s, place) FILTER (place < {base}), '') AS base,
      string_agg(said, ',' ORDER BY s, place) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
