"""Filter language: parsed on the driver to terms, compiled to one Column.

``field:value`` for the known fields, other words are substrings of the row's text, ``-`` negates, quotes keep spaces.
Predicates are two-valued: a term on a missing value is false, so its negation is true.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of the language.
FIELDS = ("method", "status", "host", "mime", "url", "route", "kind", "has", "seen")
NUMERIC = ("status", "seen")
_COMPARE = re.compile(r"(>=|<=|>|<|=)?(\d+)")


@dataclass(frozen=True)
class Term:
    field: str
    value: str
    negated: bool = False


def tokens(text: str) -> list[str]:
    """White-space separated; a quoted part, also after ``field:``, keeps its spaces and loses its quotes."""
    out, now, quoted, started = [], [], False, False
    for c in text or "":
        if c == '"':
            quoted, started = not quoted, True
        elif c.isspace() and not quoted:
            if now or started:
                out.append("".join(now))
            now, started = [], False
        else:
            now.append(c)
    if now or started:
        out.append("".join(now))
    return [t for t in out if t]


def parse(text: str) -> list[Term]:
    terms = []
    for token in tokens(text):
        negated = len(token) > 1 and token[0] == "-"
        token = token[1:] if negated else token
        name, colon, value = token.partition(":")
        known = bool(colon) and name.lower() in FIELDS and bool(value)
        terms.append(Term(name.lower(), value, negated) if known else Term("", token, negated))
    return terms


def wildcard(c: Column, pattern: str) -> Column:
    """Case-insensitive: contained, or with ``*`` a match of the whole value within a line. An empty pattern is false."""
    if not pattern:
        return F.lit(False)
    if "*" not in pattern:
        return F.lower(c).contains(pattern.lower())
    return c.rlike(r"(?i)\A" + ".*".join(f"\\Q{p}\\E" if p else "" for p in pattern.replace("\\E", "").split("*")) + r"\z")


def compare(c: Column, value: str) -> Column:
    m = _COMPARE.fullmatch(value)
    if not m:
        return F.lit(False)
    n = F.lit(int(m[2]))
    return {">=": c >= n, "<=": c <= n, ">": c > n, "<": c < n}.get(m[1], c == n)


def compile_filter(text: str, columns: dict[str, Column], haystack: Column) -> Column:
    """All terms as one Column. ``columns``: by field, with has_auth, has_body, is_error for ``has:``; absent ones never match."""

    def one(term: Term) -> Column:
        if not term.field:
            test = F.lower(haystack).contains(term.value.lower())
        elif term.field == "has":
            test = columns.get({"auth": "has_auth", "body": "has_body", "error": "is_error"}.get(term.value.lower(), ""), F.lit(False))
        elif term.field not in columns:
            test = F.lit(False)
        elif term.field in NUMERIC:
            test = compare(columns[term.field], term.value)
        elif term.field == "method":
            test = F.upper(columns["method"]) == term.value.upper() if "*" not in term.value else wildcard(columns["method"], term.value)
        else:
            test = wildcard(columns[term.field], term.value)
        test = F.coalesce(test, F.lit(False))
        return ~test if term.negated else test

    return reduce(lambda a, b: a & b, map(one, parse(text)), F.lit(True))


def apply(df: DataFrame, text: str, columns: dict[str, Column] | None = None, haystack: Column | None = None) -> DataFrame:
    columns = columns if columns is not None else {f: F.col(f) for f in FIELDS if f in df.columns} | {c: F.col(c) for c in ("has_auth", "has_body", "is_error") if c in df.columns}
    haystack = haystack if haystack is not None else F.concat_ws(" ", *[c.cast("string") for f, c in columns.items() if f in FIELDS])
    return df.where(compile_filter(text, columns, haystack))


def exchange_columns(df: DataFrame) -> dict[str, Column]:
    """Fields of a table of exchanges (url, method, status, mime, headers maps, req_body, resp_body)."""
    from ..functions import urls

    has = lambda c: c in df.columns
    auth = F.exists(F.map_keys("req_headers"), lambda k: F.lower(k) == "authorization") if has("req_headers") else F.lit(False)
    token = urls.query_of(F.col("url")).rlike(r"(?i)(\A|&)[^=&]*(token|api_?key|auth|session)[^=&]*=")
    bodies = [F.length(F.coalesce(F.col(c), F.lit(""))) > 0 for c in ("req_body", "resp_body") if has(c)]
    return {
        "method": F.col("method"),
        "status": F.col("status"),
        "host": urls.host_of(F.col("url")),
        "mime": F.col("mime"),
        "url": F.col("url"),
        "kind": urls.mime_group(F.col("mime"), F.col("url")),
        "has_auth": auth | token,
        "has_body": reduce(lambda a, b: a | b, bodies, F.lit(False)),
        "is_error": F.col("status") >= 400,
    } | ({"route": F.col("route")} if has("route") else {}) | ({"seen": F.col("seen")} if has("seen") else {})
