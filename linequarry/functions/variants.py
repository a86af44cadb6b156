"""Script variants from a conversion table: forms of a text, families, classification, variant graph, phrase evidence.

A table is a list of (source, simplified or folded) rows per character plus phrases; the engine is right for any
table, also for rows that change a text's length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import let

KINDS = ("simplified", "traditional", "taiwan", "hong_kong")
_HAN = r"^[\p{IsHan}〇]$"


@dataclass(frozen=True)
class VariantTable:
    """to_simple: variant -> simplified; to_kind: simplified -> preferred variant per regional kind; phrases: per kind."""

    to_simple: dict[str, str]
    to_kind: dict[str, dict[str, str]] = field(default_factory=dict)
    phrases: dict[str, dict[str, str]] = field(default_factory=dict)

    def convert(self, text: str, kind: str) -> str:
        """One form of a text: phrases first, the longest that fits, then single characters."""
        if kind == "simplified":
            return "".join(self.to_simple.get(c, c) for c in text)
        phrases, chars = self.phrases.get(kind, self.phrases.get("traditional", {})), self.to_kind.get(kind, self.to_kind.get("traditional", {}))
        longest, out, at = max(map(len, phrases), default=0), [], 0
        while at < len(text):
            for n in range(min(longest, len(text) - at), 1, -1):
                if text[at : at + n] in phrases:
                    out.append(phrases[text[at : at + n]])
                    at += n
                    break
            else:
                out.append(chars.get(text[at], text[at]))
                at += 1
        return "".join(out)

    def forms(self, text: str) -> dict[str, str]:
        """The original and the four forms; the traditional ones start from the simplified."""
        simple = self.convert(text, "simplified")
        return {"original": text, "simplified": simple} | {k: self.convert(simple, k) for k in KINDS[1:]}

    def simplified(self, c: str) -> str:
        return self.to_simple.get(c, c)

    def has_variant(self, c: str) -> bool:
        return len(set(self.forms(c).values())) > 1

    def same_family(self, a: str, b: str) -> bool:
        return a != b and self.simplified(a) == self.simplified(b)

    def graph(self) -> dict[str, list[str]]:
        """Simplified character -> its variants, sorted."""
        out: dict[str, set[str]] = {}
        for variant, simple in self.to_simple.items():
            if variant != simple:
                out.setdefault(simple, set()).add(variant)
        for chars in self.to_kind.values():
            for simple, variant in chars.items():
                if variant != simple:
                    out.setdefault(simple, set()).add(variant)
        return {k: sorted(v) for k, v in out.items()}

    def variants(self, c: str) -> list[str]:
        """Variants of a character's family: the regional preferred ones first, then the rest in order."""
        simple = self.simplified(c)
        preferred = [self.to_kind.get(k, {}).get(simple, simple) for k in KINDS[1:]]
        return list(dict.fromkeys([p for p in preferred if p != simple] + self.graph().get(simple, [])))

    def classify(self, text: str) -> str:
        """simplified, traditional, mixed or neutral by the characters that have variants."""
        graph = self.graph()
        traditional = any(self.simplified(c) != c for c in text)
        simplified = any(self.simplified(c) == c and graph.get(c) for c in text)
        return "mixed" if traditional and simplified else "traditional" if traditional else "simplified" if simplified else "neutral"

    def phrase_evidence(self, text: str) -> dict[str, str]:
        """Forms in which the whole phrase differs from its characters one by one."""
        if len(text) < 2:
            return {}
        simple = self.convert(text, "simplified")
        return {k: whole for k in KINDS[1:] if (whole := self.convert(simple, k)) != "".join(self.convert(c, k) for c in simple)}

    def query_graph(self, text: str) -> dict:
        """What a search needs to know of its query: forms, evidence, and the variants of every character."""
        evidence = self.phrase_evidence(text)
        return {"query": text, "forms": self.forms(text), "phrase_evidence": evidence, "status": "phrase" if evidence else "character", "variants": {c: self.variants(c) for c in dict.fromkeys(text) if self.variants(c)}}


#: Characters that the tests and the default search know.
HAN = VariantTable(
    to_simple={"虧": "亏", "約": "约", "檔": "档", "發": "发", "髮": "发", "頭": "头", "裡": "里", "裏": "里", "國": "国", "書": "书", "說": "说", "説": "说", "爲": "为", "為": "为"},
    to_kind={
        "traditional": {"亏": "虧", "约": "約", "档": "檔", "发": "發", "头": "頭", "里": "裏", "国": "國", "书": "書", "说": "說", "为": "爲"},
        "taiwan": {"亏": "虧", "约": "約", "档": "檔", "发": "發", "头": "頭", "里": "裡", "国": "國", "书": "書", "说": "說", "为": "為"},
        "hong_kong": {"亏": "虧", "约": "約", "档": "檔", "发": "發", "头": "頭", "里": "裏", "国": "國", "书": "書", "说": "説", "为": "為"},
    },
    phrases={"traditional": {"头发": "頭髮"}},
)
#: Accents folded, as the script family of the Latin sample texts.
ACCENTED, FOLDED = "àâäáãèéêëìíîïòóôöõùúûüçñÀÂÄÁÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAEEEEIIIIOOOOUUUUCN"
LATIN = VariantTable(dict(zip(ACCENTED, FOLDED)) | {"ß": "ss"})


def convert_column(text: Column, table: VariantTable = LATIN) -> Column:
    """The simplified form of a column: characters of equal number by translate, the others by replacement."""
    single = {a: b for a, b in table.to_simple.items() if len(a) == len(b) == 1}
    out = F.translate(text, "".join(single), "".join(single.values())) if single else text
    for a, b in table.to_simple.items():
        if a not in single:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


#: Most characters that are replaced one after the other instead of looked up one by one.
_FEW = 8


def by_character(text: Column, chars: dict[str, str]) -> Column:
    """Single characters converted all at once; what becomes several characters waits as a private one. A few that no
    conversion makes are replaced one after the other, which is faster."""
    if len(chars) <= _FEW and not any(c in v for v in chars.values() for c in chars):
        for c, v in chars.items():
            text = F.replace(text, F.lit(c), F.lit(v))
        return text
    long = {c: chr(0xF0000 + n) for n, c in enumerate(sorted(c for c in chars if len(chars[c]) != 1))}
    out = F.translate(text, "".join(chars), "".join(long.get(c, chars[c]) for c in chars)) if chars else text
    for c, mark in long.items():
        out = F.replace(out, F.lit(mark), F.lit(chars[c]))
    return out


def _kind_of(table: VariantTable, kind: str) -> tuple[dict[str, str], dict[str, str]]:
    """Phrases and characters of a regional kind."""
    return table.phrases.get(kind, table.phrases.get("traditional", {})), table.to_kind.get(kind, table.to_kind.get("traditional", {}))


def like_kind(table: VariantTable, kind: str) -> str:
    """The first kind that converts every text as this one does."""
    if kind == KINDS[0] or _kind_of(table, kind) == ({}, {}):
        return KINDS[0]
    return next(k for k in KINDS[1:] if _kind_of(table, k) == _kind_of(table, kind))


#: Private characters: around a phrase, and in the places of phrases.
_OPEN, _CLOSE, _PHRASE = chr(0xF2000), chr(0xF2001), 0xF1000


def _form_of(simple: Column, phrases: dict[str, str], chars: dict[str, str]) -> Column:
    """A regional form of a simplified text that holds phrases: these wait as private characters while the rest is
    converted. A text that has such characters itself is cut into pieces instead."""
    ways = "|".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in sorted(phrases, key=lambda p: (-len(p), p)))
    marks = {p: chr(_PHRASE + n) for n, p in enumerate(phrases)}
    out = F.regexp_replace(simple, ways, f"{_OPEN}$0{_CLOSE}")
    for p, mark in marks.items():
        out = F.replace(out, F.lit(f"{_OPEN}{p}{_CLOSE}"), F.lit(mark))
    out = by_character(out, chars)
    for p, mark in marks.items():
        out = F.replace(out, F.lit(mark), F.lit(phrases[p]))
    pieces = F.regexp_extract_all(simple, F.lit(f"(?s)(?:{ways})|(?:(?!{ways}).)+"), F.lit(0))
    told = F.create_map(*[F.lit(x) for p in phrases.items() for x in p])
    cut = F.array_join(F.transform(pieces, lambda t: F.when(t.isin(*phrases), F.element_at(told, t)).otherwise(by_character(t, chars))), "")
    own = F.lit(False)
    for mark in (_OPEN, _CLOSE, *marks.values()):
        own = own | F.contains(simple, F.lit(mark))
    return F.when(own, cut).otherwise(out)


def _holds(simple: Column, phrases: dict[str, str]) -> Column:
    held = F.lit(False)
    for p in phrases:
        held = held | F.contains(simple, F.lit(p))
    return held


def _phrases(table: VariantTable, kind: str) -> dict[str, str]:
    """Phrases of a kind that are longer than a character."""
    return {p: v for p, v in _kind_of(table, kind)[0].items() if len(p) > 1}


def form_column(text: Column, kind: str, table: VariantTable = LATIN) -> Column:
    """One form of a column. The regional ones start from the simplified form: at each place the longest phrase that
    fits, then single characters. The text is cut into phrases and what lies between them in one pass."""
    simple = convert_column(text, table)
    if kind == "simplified":
        return simple
    phrases, chars = _phrases(table, kind), _kind_of(table, kind)[1]
    if not phrases:
        return by_character(simple, chars)
    return let(simple, lambda s: F.when(_holds(s, phrases), _form_of(s, phrases, chars)).otherwise(by_character(s, chars)))


def same_family(a: Column, b: Column, table: VariantTable = LATIN) -> Column:
    """Whether two characters differ and have one simplified form."""
    return (a != b) & (convert_column(a, table) == convert_column(b, table))


def phrase_evidence(text: Column, table: VariantTable = LATIN) -> Column:
    """Regional kind -> (phrase_form, character_form), for the kinds in which the whole text becomes something else than
    its characters one by one; none for texts of one character."""

    def both(simple: Column) -> Column:
        told = []
        for kind in KINDS[1:]:
            phrases, chars = _phrases(table, kind), _kind_of(table, kind)[1]
            forms = F.struct(_form_of(simple, phrases, chars).alias("phrase_form"), by_character(simple, chars).alias("character_form")) if phrases else F.lit(None).cast("struct<phrase_form:string,character_form:string>")
            told += [F.lit(kind), F.when(_holds(simple, phrases), forms)]
        return F.create_map(*told)

    return F.map_filter(let(convert_column(text, table), both), lambda _, f: (F.length(text) > 1) & f.isNotNull() & (f["phrase_form"] != f["character_form"]))


def variant_rows(spark: SparkSession, table: VariantTable = LATIN) -> DataFrame:
    """The variant graph as a table: simple, variants (the regional preferred ones first, then the rest in order), and
    regions, the kinds that prefer each variant. Its size is that of the conversion table."""
    edges = [(s, v) for v, s in table.to_simple.items() if v != s] + [(s, v) for chars in table.to_kind.values() for s, v in chars.items() if v != s]
    preferred = [(s, n, k, v) for n, k in enumerate(KINDS[1:]) for s, v in table.to_kind.get(k, {}).items() if v != s]
    all_ = spark.createDataFrame(edges, "simple string, variant string").groupBy("simple").agg(F.array_sort(F.collect_set("variant")).alias("all"))
    first = spark.createDataFrame(preferred, "simple string, place int, kind string, variant string").groupBy("simple").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "variant"))).alias("first"))
    both = all_.join(first, "simple", "left").withColumn("first", F.coalesce("first", F.array().cast("array<struct<place:int,kind:string,variant:string>>")))
    ordered = F.array_distinct(F.concat("first.variant", "all"))
    regions = F.transform(ordered, lambda v: F.transform(F.filter("first", lambda f: f["variant"] == v), lambda f: f["kind"]))
    return both.select("simple", ordered.alias("variants"), regions.alias("regions"))


def query_graphs(queries: DataFrame, table: VariantTable = LATIN) -> DataFrame:
    """What a search needs to know of each query: query, forms, evidence, status, and for single characters their variants
    with the kinds that prefer them (`reverse` where none does)."""
    q = F.col("query")
    forms = F.struct(q.alias("original"), *[form_column(q, k, table).alias(k) for k in KINDS])
    told = queries.select("query", forms.alias("forms"), phrase_evidence(q, table).alias("evidence"), F.when(F.length(q) == 1, convert_column(q, table)).alias("simple"))
    known = told.join(variant_rows(queries.sparkSession, table), "simple", "left")
    of = F.zip_with("variants", "regions", lambda v, r: F.struct(v.alias("text"), F.when(F.size(r) == 0, F.array(F.lit("reverse"))).otherwise(r).alias("regions")))
    status = F.when(F.size("evidence") > 0, "phrase_confirmed").otherwise("glyph_only_unconfirmed")
    return known.select("query", "forms", "evidence", status.alias("status"), F.coalesce(of, F.array().cast("array<struct<text:string,regions:array<string>>>")).alias("variants"))


def classify_column(text: Column, table: VariantTable) -> Column:
    """classify for a column."""
    cls = lambda chars: "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"
    graph = table.graph()
    traditional = [c for c in table.to_simple if table.to_simple[c] != c]
    simple = [c for c in graph if len(c) == 1 and table.simplified(c) == c]
    t = text.rlike(cls(traditional)) if traditional else F.lit(False)
    s = text.rlike(cls(simple)) if simple else F.lit(False)
    return F.when(t & s, "mixed").when(t, "traditional").when(s, "simplified").otherwise("neutral")


def in_scope(script: Column, scope: str) -> Column:
    """both takes all; neutral texts are in any scope; mixed and unknown ones only in both."""
    return F.lit(True) if scope == "both" else (script == "neutral") | (script == scope)


def is_han(char: Column) -> Column:
    return char.rlike(_HAN)
