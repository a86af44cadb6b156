"""Literal text operators on code points: normalisation, matching, context, classification rules, escaping."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import let, prefix_sums

#: Longest query in code points.
QUERY_LIMIT = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class QueryError(ValueError):
    """A query text that cannot be searched for."""


def normalize_query(value: str) -> str:
    """Strip U+0020 at both ends, compose (NFC), and refuse empty, control, surrogate, byte-order-mark and overlong texts."""
    if not isinstance(value, str):
        raise QueryError("query is not a text")
    text = unicodedata.normalize("NFC", value.strip(" "))
    if not text:
        raise QueryError("query is empty")
    if any(c == chr(0xFEFF) or unicodedata.category(c) in ("Cc", "Cs") for c in text):
        raise QueryError("query holds a character that is not allowed")
    if len(text) > QUERY_LIMIT:
        raise QueryError(f"query is longer than {QUERY_LIMIT} characters")
    return text


@F.pandas_udf(T.StringType())
def compose(text: pd.Series) -> pd.Series:
    """NFC of a column; Spark has no such function."""
    return text.str.normalize("NFC")


def match_starts(text: Column, query: str) -> Column:
    """0-based starts of every occurrence, overlapping ones too, case-sensitive; none for an empty query.

    Splitting where the query lies ahead cuts the text before every occurrence; the pieces' lengths give the starts.
    """
    if not query:
        return F.array().cast("array<int>")
    ahead = "(?=\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E)"
    none = F.array().cast("array<int>")
    starts = let(prefix_sums(F.transform(F.split(text, ahead, -1), F.length)), lambda at: F.when(F.startswith(text, F.lit(query)), at).otherwise(F.slice(at, 2, F.size(at))))
    return F.when(F.contains(text, F.lit(query)), starts).otherwise(none)


def spans(text: Column, query: str) -> Column:
    """Half-open spans of match_starts."""
    return F.transform(match_starts(text, query), lambda s: F.struct(s.alias("start"), (s + len(query)).alias("end")))


def code_points(text: Column) -> Column:
    """U+XXXX for every character, parted by spaces; read off the hexadecimal UTF-32, eight digits a character."""
    digits = F.hex(F.encode(text, "UTF-32"))
    return F.rtrim(F.regexp_replace(digits, "0000([0-9A-F]{4})|000([0-9A-F]{5})|00([0-9A-F]{6})", "U+$1$2$3 "))


#: Characters that are told at once.
_AT_ONCE = 1 << 20
_DIGITS = np.frombuffer(b"0123456789ABCDEF", np.uint8)


def _told(texts: pa.Array) -> pa.Array:
    """Code points of texts without nulls: nine bytes a character, of which those that it has are kept."""
    sizes = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
    cells = np.empty((len(points), 9), np.uint8)
    cells[:, 0], cells[:, 1], cells[:, 8] = ord("U"), ord("+"), ord(" ")
    for k in range(6):
        cells[:, 7 - k] = _DIGITS[(points >> (4 * k)) & 15]
    kept = np.ones(cells.shape, bool)
    kept[:, 2], kept[:, 3] = points > 0xFFFFF, points > 0xFFFF
    ends = np.cumsum(sizes)
    kept[ends[sizes > 0] - 1, 8] = False
    before = np.append(0, np.cumsum(kept.sum(axis=1)))
    offsets = before[np.append(0, ends)].astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(cells[kept]))


@F.arrow_udf(T.StringType())
def code_points_of_lines(text: pa.Array) -> pa.Array:
    """code_points for whole lines, where a regular expression over the digits of every character costs too much."""
    whole, out, at = pc.fill_null(text, ""), [], 0
    ends = np.cumsum(np.asarray(pc.utf8_length(whole)).astype(np.int64))
    while at < len(whole):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, side="right")))
        out.append(_told(whole.slice(at, to - at)))
        at = to
    told = pa.concat_arrays(out) if out else pa.array([], pa.string())
    return pc.if_else(text.is_valid(), told, pa.scalar(None, pa.string())) if text.null_count else told


def context(text: Column, start: Column, end: Column, radius: int = 15) -> dict[str, Column]:
    """before, matched, after within radius code points."""
    first = F.greatest(start - radius, F.lit(0))
    return {"before": F.substring(text, first + 1, start - first), "matched": F.substring(text, start + 1, end - start), "after": F.substring(text, end + 1, F.lit(radius))}


def like_ascii(text: Column, query: str) -> Column:
    """text LIKE '%query%' where letter case is ignored in ASCII only, % and _ in query are wild and nothing escapes."""
    fold = lambda c: F.translate(c, _UPPER, _LOWER)
    return F.like(fold(text), F.lit("%" + query.translate(str.maketrans(_UPPER, _LOWER)) + "%"), F.lit("\x01"))


def verification(matched: Column, confidence: Column, secondary: Column) -> Column:
    """(status, reason) of an occurrence from a second reading of it and the first one's confidence."""
    some = F.coalesce(secondary, F.lit("")) != ""
    agrees = some & F.contains(secondary, matched)
    status = F.when(agrees & (confidence >= 0.7), "confirmed").when(some & ~agrees & (confidence < 0.7), "rejected").when(~some & (confidence >= 0.9), "confirmed").otherwise("needs_review")
    reason = F.when(agrees & (confidence >= 0.7), "second_reading_agrees").when(some & ~agrees & (confidence < 0.7), "second_reading_differs").when(~some & (confidence >= 0.9), "high_confidence").when(some & ~agrees, "readings_conflict").otherwise("low_confidence")
    return F.struct(status.alias("status"), reason.alias("reason"))


def script_safe(json: Column) -> Column:
    """JSON text that may stand inside a script element."""
    for char in ("&", "<", ">", chr(0x2028), chr(0x2029)):
        json = F.replace(json, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return json


def file_size(n: Column, decimals: int = 2) -> Column:
    """Bytes in the largest fitting unit of 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.concat(F.format_string(f"%.{decimals}f", n / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def file_url(path: Column) -> Column:
    """file:// address with everything but / and : quoted."""
    quoted = F.url_encode(F.regexp_replace(path, r"\\", "/"))
    for a, b in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%7E", "~"), ("*", "%2A")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    return F.concat(F.when(F.startswith(quoted, F.lit("/")), F.lit("file://")).otherwise(F.lit("file:///")), quoted)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def safe_relative(path: Column) -> Column:
    """The path if it is relative and never climbs, else null; backslashes count as separators."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when((path != "") & ~clean.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)"), clean)


def redacted(text: Column, user: str, home: str) -> Column:
    """User names and home folders out of a log line, whatever their case."""
    import re

    for literal, put in ((home, "<home>"), (user, "<user>")):
        if literal:
            text = F.regexp_replace(text, "(?i)" + re.escape(literal), put)
    text = F.regexp_replace(text, r"(?i)([a-z]:[\\/]users[\\/])[^\\/\s]+", "$1<user>")
    return F.regexp_replace(text, r"(/home/|/Users/)[^/\s]+", "$1<user>")
