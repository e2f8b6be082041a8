"""Extraction of units from resource bodies: HTML, CSS, JSON, plain lines by built-in expressions; JS by one Arrow pass.

A unit is (resource_url, ord, kind, text, line, extra). Patterns are applied by ``regexp_extract_all`` and exploded;
the JS pass is a state machine over a whole body, so it is a table function over Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import let

UNIT = "resource_url string, ord int, kind string, text string, line int, extra string"

# Patterns of links, elements and style sheets.
HREF = r"(?i)(?:href|src|action|data-src)\s*=\s*[\"']([^\"']{1,300})[\"']"
SCRIPT_SRC = r"(?i)<script\b[^>]*src\s*=\s*[\"']([^\"']{1,300})[\"'][^>]*>"
IFRAME_SRC = r"(?i)<iframe\b[^>]*src\s*=\s*[\"']([^\"']{1,300})[\"'][^>]*>"
META = r"(?i)<meta\s+[^>]*name\s*=\s*[\"']([^\"']{1,80})[\"'][^>]*content\s*=\s*[\"']([^\"']{1,220})[\"'][^>]*>"
INPUT = r"(?i)<input\b[^>]*\sname\s*=\s*[\"']([^\"']{1,80})[\"']"
DATA_URL = r"(?i)\sdata-[a-z-]+\s*=\s*[\"']((?:https?:)?//[^\"']{4,220}|/[^\"']{2,220})[\"']"
INLINE_JSON = r"(?is)<script\b[^>]*type\s*=\s*[\"']application/(?:ld\+)?json[\"'][^>]*>(.*?)</script>"
IMPORT_MAP = r"(?is)<script\b[^>]*type\s*=\s*[\"']importmap[\"'][^>]*>(.*?)</script>"
FORM = r"(?i)<form\b[^>]*>"
INVISIBLE = r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->"
CSS_URL = r"url\(\s*['\"]?([^'\")]{1,220})['\"]?\s*\)"
CSS_IMPORT = r"@import\s+(?:url\()?['\"]([^'\"]{1,220})['\"]"
CSS_SELECTOR = r"[.#][A-Za-z_][A-Za-z0-9_-]{2,60}"
NEXT_DATA = r"(?is)<script\b[^>]*id\s*=\s*[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"
SKIPPED_LINK = r"(?i)\A\s*(data|javascript):"


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, ord, link): links of a page in order, data and script links left out."""
    out = pages.select(F.col(url).alias("url"), F.posexplode(all_of(F.col(html), HREF)).alias("ord", "link"))
    return out.where(~F.col("link").rlike(SKIPPED_LINK))


def links_by_host_class(pages: DataFrame) -> DataFrame:
    """Links per host and class of link, most first."""
    links = page_links(pages).select(urls.host_of(F.col("url")).alias("host"), F.coalesce(urls.classify_path(F.col("link")), F.lit("other")).alias("class"))
    return links.groupBy("host", "class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host", "class")


def _units(found: list[tuple[str, Column]]) -> Column:
    """One array of (kind, text) from several, in their order."""

    def tagged(kind: str, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))

    return F.flatten(F.array(*[tagged(kind, texts) for kind, texts in found]))


def _exploded(df: DataFrame, url: str, units: Column) -> DataFrame:
    out = df.select(F.col(url).alias("resource_url"), F.posexplode(units).alias("ord", "u"))
    return out.select("resource_url", "ord", "u.kind", "u.text").where(F.length("text") > 0)


def visible_text(html: Column) -> Column:
    """Text between tags, scripts, styles and comments left out, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), INVISIBLE, " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def html_units(pages: DataFrame, url: str = "url", html: str = "html", chunk: int = 180) -> DataFrame:
    """Units of HTML bodies: links, scripts, frames, forms, routes, meta tags, inputs, data URLs, import maps, text chunks."""
    body = F.col(html)
    links = F.filter(all_of(body, HREF), lambda x: ~x.rlike(SKIPPED_LINK))
    routes = F.transform(F.filter(links, lambda x: x.startswith("/") & (urls.classify_path(x) == "route")), lambda x: urls.normalize_route(x))
    metas = F.zip_with(all_of(body, META, 1), all_of(body, META, 2), lambda k, v: F.concat_ws(": ", k, v))
    maps = F.flatten(F.transform(all_of(body, IMPORT_MAP), lambda j: F.regexp_extract_all(j, F.lit(r'"[^"]{1,200}"\s*:\s*"([^"]{1,200})"'), F.lit(1))))
    cut = lambda shown: F.transform(F.sequence(F.lit(0), F.floor((F.length(shown) - 1) / chunk).cast("int")), lambda i: F.substring(shown, i * chunk + 1, F.lit(chunk)))
    text = let(visible_text(body), lambda shown: F.when(F.length(shown) > 0, cut(shown)).otherwise(F.array().cast("array<string>")))
    found = [("dom-link", links), ("script", all_of(body, SCRIPT_SRC)), ("iframe", all_of(body, IFRAME_SRC)), ("form", all_of(body, FORM, 0)), ("route", routes), ("meta-tag", metas), ("form-input", all_of(body, INPUT)), ("dom-data-url", all_of(body, DATA_URL)), ("importmap", maps), ("dom-text", text)]
    return _exploded(pages, url, _units(found))


def inline_json(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, ord, body) of JSON blocks within pages, to be flattened like any JSON body."""
    return pages.select(F.col(url).alias("url"), F.posexplode(F.concat(all_of(F.col(html), INLINE_JSON), all_of(F.col(html), NEXT_DATA))).alias("ord", "body"))


def css_units(sheets: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    c = F.col(body)
    return _exploded(sheets, url, _units([("css-reference", all_of(c, CSS_URL)), ("css-import", all_of(c, CSS_IMPORT)), ("css-selector", F.array_distinct(all_of(c, CSS_SELECTOR, 0)))]))


def text_lines(df: DataFrame, url: str = "url", body: str = "body", least: int = 3, most: int = 320) -> DataFrame:
    """Trimmed lines of ``least`` to ``most`` characters with their 1-based numbers."""
    # Trimmed before the lines become rows: filters on the text would repeat the work for each of their terms.
    lines = F.transform(F.split(F.col(body), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))
    out = df.select(F.col(url).alias("resource_url"), F.posexplode(lines).alias("ord", "text")).where(F.length("text").between(least, most))
    return out.select("resource_url", "ord", F.lit("text-line").alias("kind"), "text", (F.col("ord") + 1).alias("line"))


def header_units(exchanges: DataFrame) -> DataFrame:
    """URL, header and path-like header value units of (url, res_headers map)."""
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce("res_headers", F.create_map().cast("map<string,string>")))), lambda e: F.substring(F.concat_ws(": ", e["key"], e["value"]), 1, 320))
    paths = F.filter(F.map_values(F.coalesce("res_headers", F.create_map().cast("map<string,string>"))), lambda v: urls.classify_path(v).isNotNull())
    return _exploded(exchanges, "url", _units([("url", F.array("url")), ("header", pairs), ("route", paths)]))


def query_param_units(units: DataFrame) -> DataFrame:
    """(resource_url, param, host): names in the query strings of units that are URLs or paths."""
    named = units.select("resource_url", F.explode(urls.query_params(F.col("text"), 20)).alias("p"), urls.host_of(F.col("text")).alias("host"))
    return named.where(F.col("p.name").rlike(r"\A[A-Za-z_][A-Za-z0-9_.\-]{0,60}\z")).select("resource_url", F.col("p.name").alias("param"), "host").distinct()


# --- JSON -----------------------------------------------------------------------------------------------------------


def json_documents(text: str) -> list[tuple[str, object]]:
    """(root path, value) of a JSON text, or of each JSON line or ``data:`` line of one that isn't."""
    try:
        return [("", json.loads(text))]
    except ValueError:
        out = []
        for line in text.splitlines():
            line = line.strip().removeprefix("data:").strip()
            if line[:1] in ("{", "["):
                try:
                    out.append((f"$[{len(out)}]", json.loads(line)))
                except ValueError:
                    continue
        return out


def walk_json(root: str, value: object) -> Iterator[tuple[str, str, str]]:
    """(kind, text, path) of keys, pairs, strings and scalars, in document order."""
    todo = [(root, value)]
    while todo:
        path, now = todo.pop()
        if isinstance(now, dict):
            for key, child in now.items():
                below = f"{path}.{key}" if path else key
                yield "json-key", key, below
                if isinstance(child, str | int | float | bool):
                    yield "json-pair", f"{key}: {child if isinstance(child, str) else json.dumps(child)}", below
            todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(now.items())]
        elif isinstance(now, list):
            todo += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(now)))]
        elif isinstance(now, str):
            yield "json-string", now, path
        elif now is not None:
            yield "json-scalar", json.dumps(now), path


def json_units(df: DataFrame, url: str = "url", body: str = "body", most: int = 320) -> DataFrame:
    """Units of JSON, JSON-lines and event-stream bodies; ``extra`` is the path. Strings that are paths are also routes or endpoints."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for at, text in zip(part.url, part.body, strict=True):
                found = [u for root, value in json_documents(text or "") for u in walk_json(root, value)]
                rows += [(at, k, kind, t[:most], None, path) for k, (kind, t, path) in enumerate(found) if t]
            yield pd.DataFrame(rows, columns=["resource_url", "ord", "kind", "text", "line", "extra"])

    flat = df.select(F.col(url).alias("url"), F.col(body).alias("body")).mapInPandas(batches, UNIT)
    kind = urls.classify_path(F.col("text"))
    paths = flat.where((F.col("kind") == "json-string") & kind.isin("route", "endpoint")).withColumn("kind", kind)
    method = flat.where((F.col("kind") == "json-pair") & F.col("text").rlike(r"\Amethod: [A-Za-z_][\w.\-]{1,80}\z")).withColumn("text", F.substring_index("text", ": ", -1)).withColumn("kind", F.lit("jsonrpc-method"))
    return flat.unionByName(paths).unionByName(method)


def declared_endpoints(df: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """(url, method, path) declared by OpenAPI bodies."""
    spec = F.from_json(F.get_json_object(body, "$.paths"), "map<string,map<string,string>>")
    paths = df.where(F.col(body).contains('"paths"')).select(F.col(url).alias("url"), F.explode(spec).alias("path", "ops"))
    return paths.select("url", "path", F.explode(F.map_keys("ops")).alias("m")).where(F.lower("m").isin("get", "put", "post", "delete", "options", "head", "patch", "trace")).select("url", F.upper("m").alias("method"), "path")


# --- JavaScript -----------------------------------------------------------------------------------------------------

# Call forms that name a target, and sinks, as (kind, pattern).
JS_CALLS = (
    ("dynamic-import", re.compile(r"\bimport\s*\(\s*[\"'`]([^\"'`]{1,220})[\"'`]")),
    ("static-import", re.compile(r"\b(?:import|export)\s[^\"';]{0,400}?from\s*[\"']([^\"']{1,220})[\"']")),
    ("static-import", re.compile(r"\brequire\s*\(\s*[\"']([^\"']{1,220})[\"']\s*\)")),
    ("fetch-target", re.compile(r"\b(?:fetch|axios(?:\.(?:get|post|put|delete|patch))?|api\.(?:get|post|put|delete)|\$\.ajax)\s*\(\s*[\"'`]([^\"'`]{1,220})[\"'`]")),
    ("fetch-target", re.compile(r"\.open\s*\(\s*[\"'][A-Z]{3,7}[\"']\s*,\s*[\"'`]([^\"'`]{1,220})[\"'`]")),
    ("fetch-target", re.compile(r"\bnew\s+(?:WebSocket|EventSource)\s*\(\s*[\"'`]([^\"'`]{1,220})[\"'`]")),
    ("fetch-target", re.compile(r"\bsendBeacon\s*\(\s*[\"'`]([^\"'`]{1,220})[\"'`]")),
    ("fetch-target", re.compile(r"\bnew\s+URL\s*\(\s*[\"'`]([^\"'`]{1,160})[\"'`]")),
    ("route", re.compile(r"\bpath\s*:\s*[\"'](/[^\"']{1,120})[\"']")),
    ("sourcemap-ref", re.compile(r"//[#@]\s*sourceMappingURL\s*=\s*(\S{1,220})")),
    ("jsonrpc-method", re.compile(r"[\"']method[\"']\s*:\s*[\"']([A-Za-z_][\w.\-]{1,80})[\"']")),
    ("soap-op", re.compile(r"(?i)soapaction\s*[:=]\s*[\"']?([^\"'`\s]{2,160})")),
    ("sse-event", re.compile(r"(?m)^\s*event\s*:\s*([A-Za-z][\w\-]{0,60})")),
    ("trpc-proc", re.compile(r"/trpc/([A-Za-z_][\w.]{0,120})")),
)
SINKS = (
    ("eval", re.compile(r"\beval\s*\(")),
    ("Function", re.compile(r"\bnew\s+Function\s*\(")),
    ("innerHTML", re.compile(r"\.innerHTML\s*=(?!=)")),
    ("outerHTML", re.compile(r"\.outerHTML\s*=(?!=)")),
    ("document.write", re.compile(r"\bdocument\.write(?:ln)?\s*\(")),
    ("setTimeout-string", re.compile(r"\bset(?:Timeout|Interval)\s*\(\s*[\"'`]")),
)
GRAPHQL = re.compile(r"\b(query|mutation|subscription)\s+([A-Za-z_]\w*)\s*[({]")
PERSISTED = re.compile(r"sha256Hash[\"']\s*:\s*[\"']([a-f0-9]{32,})")
RPC_INPUT = re.compile(r"input[\"']?\s*[:=]\s*\{([^}]{1,400})")
RPC_KEY = re.compile(r"\"([A-Za-z_][\w.\-]{0,60})\"\s*:")
BASE_URL = re.compile(r"(?:baseURL\s*:|\b(?:API_BASE|API_URL|BASE_URL|baseUrl)\s*=)\s*[\"']([^\"']{1,200})[\"']")
ABSOLUTE = re.compile(r"(?:https?|wss?)://[^\s\"'`<>(){}\[\]]{4,200}")
IDENTIFIER = re.compile(r"\b[A-Za-z_$][A-Za-z0-9_$]{3,80}\b")
KEYWORDS = frozenset("abstract arguments async await boolean break byte case catch char class const continue debugger default delete double else enum eval export extends false final finally float for from function goto if implements import in instanceof int interface let long native new null of package private protected public return short static super switch synchronized this throw throws transient true try typeof undefined var void volatile while with yield".split())
_LITERAL = re.compile(r"//[^\n]*|/\*.*?\*/|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`", re.S)
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]{1,6})\}|(.))", re.S)
_JOIN = re.compile(r"([\"'])((?:(?!\1)[^\\\n])*)\1(?:\s*\+\s*([\"'])((?:(?!\3)[^\\\n])*)\3){1,2}")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
_API = re.compile(urls.API_SEGMENT.replace(r"\A", "^").replace(r"\z", "$"))
_BARE = re.compile(urls.BARE_API.replace(r"\A", "^"))
_ROUTE = re.compile(urls.ROUTE_CHARS.replace(r"\A", "^").replace(r"\z", r"\Z"))
_NAMESPACE = re.compile(urls.NAMESPACE.replace(r"\A", "^"))
_ASSET = re.compile(urls.ASSET.replace(r"\z", "$"))


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return chr(min(int(code, 16), 0x10FFFF)) if code else _PLAIN.get(m[4], m[4])

    return _ESCAPE.sub(one, s) if "\\" in s else s


def literals(src: str) -> Iterator[tuple[int, str]]:
    """(offset, value) of string literals outside comments; templates are split at their ``${}`` parts."""
    for m in _LITERAL.finditer(src):
        if m.lastindex is None:
            continue
        value = m[m.lastindex]
        if m.lastindex == 3:
            for piece in re.split(r"\$\{[^}]*\}", value):
                if piece:
                    yield m.start(), unescape(piece)
        else:
            yield m.start(), unescape(value)


def path_class(s: str) -> str | None:
    """The same classes as ``urls.classify_path`` for one text."""
    t = s.strip()[:260]
    m = re.match(r"(?i)(?:https?|wss?)://[^/?#]*", t)
    path = t[m.end() :] if m else t
    api = 2 <= len(t) <= 260 and bool(_API.search(path) if path.startswith("/") else _BARE.match(path))
    route = 2 <= len(t) <= 220 and t.startswith("/") and not t.startswith("//") and bool(_ROUTE.match(t)) and bool(re.search("[A-Za-z]", t)) and not _NAMESPACE.match(t)
    if api:
        return "endpoint"
    return ("asset" if _ASSET.search(t) else "route") if route else None


def js_unit_list(src: str, identifiers: int = 1200) -> list[tuple[str, str, int, str | None]]:
    """(kind, text, offset, extra) of a script. Paths first, then targets, then literals, then identifiers."""
    paths: dict[str, tuple[str, int, str | None]] = {}
    strings: dict[str, int] = {}
    found = list(literals(src))
    found += [(m.start(), "".join(re.findall(r"[\"']((?:[^\"'\\\n])*)[\"']", m[0]))) for m in _JOIN.finditer(src)]
    for at, value in found:
        if not value or len(value) > 360:
            continue
        kind = path_class(value)
        if kind:
            paths.setdefault(value, (kind, at, None))
        elif len(value) >= 2 and not re.fullmatch(r"[0-9.,;:\s]+|#[0-9a-fA-F]{1,8}", value):
            strings.setdefault(value, at)
    out = [("asset-ref" if kind == "asset" else kind, text, at, extra) for text, (kind, at, extra) in paths.items()]
    for m in ABSOLUTE.finditer(src):
        out.append(("url", m[0], m.start(), None))
        tail = re.sub(r"^\w+://[^/?#]*", "", m[0])
        kind = path_class(tail) if tail else None
        if kind and tail not in paths:
            paths[tail] = (kind, m.start(), None)
            out.append(("asset-ref" if kind == "asset" else kind, tail, m.start(), f"from-url:{m[0]}"))
    for kind, pattern in JS_CALLS:
        out += [(kind, m[1], m.start(), None) for m in pattern.finditer(src)]
    out += [("graphql-op", f"graphql:{m[1]}:{m[2]}", m.start(), None) for m in GRAPHQL.finditer(src)]
    out += [("graphql-op", f"graphql:persisted:{m[1][:8]}", m.start(), None) for m in PERSISTED.finditer(src)]
    bases = list(dict.fromkeys(m[1] for m in BASE_URL.finditer(src)))[:10]
    relative = [t for t, (kind, _, _) in paths.items() if kind in ("endpoint", "route")][:301]
    out += [("endpoint", f"{b.rstrip('/')}/{t.lstrip('/')}", 0, f"base:{b}") for b in bases for t in relative if not t.startswith(b)]
    for text in [*paths, *(t for k, t, _, _ in out if k in ("url", "fetch-target"))]:
        query = text.partition("?")[2].partition("#")[0]
        out += [("param", p.partition("=")[0], 0, text) for p in query.split("&") if re.fullmatch(r"[A-Za-z_][\w.\-]{0,60}", p.partition("=")[0])]
    if any("/trpc/" in t or "batch=" in t for k, t, _, _ in out if k in ("url", "endpoint", "fetch-target", "route")):
        out += [("trpc-proc", key, m.start(), "trpc:input") for m in RPC_INPUT.finditer(src) for key in RPC_KEY.findall(m[1])]
    out += [("sink", src[m.start() : m.start() + 120].split("\n")[0], m.start(), name) for name, pattern in SINKS for m in pattern.finditer(src)]
    out += [("string-literal", t[:320], at, None) for t, at in strings.items()]
    names = dict.fromkeys(m[0] for m in IDENTIFIER.finditer(src) if m[0] not in KEYWORDS)
    out += [("identifier", n, 0, None) for n in list(names)[:identifiers]]
    return list({(k, t): (k, t, at, extra) for k, t, at, extra in reversed(out)}.values())[::-1]


def js_units(scripts: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Units of script bodies, one of each kind and text a script, with 1-based lines."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_right

        for part in parts:
            rows = []
            for at, src in zip(part.url, part.body, strict=True):
                starts = [m.end() for m in re.finditer("\n", src or "")]
                rows += [(at, k, kind, text, bisect_right(starts, where) + 1, extra) for k, (kind, text, where, extra) in enumerate(js_unit_list(src or ""))]
            yield pd.DataFrame(rows, columns=["resource_url", "ord", "kind", "text", "line", "extra"])

    return scripts.select(F.col(url).alias("url"), F.col(body).alias("body")).mapInPandas(batches, UNIT)


def script_windows(scripts: DataFrame, size: int = 200_000, overlap: int = 2_000, url: str = "url", body: str = "body") -> DataFrame:
    """(url, window, base_line, body): a script in windows that overlap, with the 1-based line each begins in.

    So a very long script is spread over tasks. Every part of a script is in a window; what lies across the end of one
    is whole in it if it's no longer than ``overlap``.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    windows = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size) - 1, F.lit(0)).cast("int"))
    parts = scripts.select(F.col(url).alias("url"), text.alias("whole"), F.posexplode(F.transform(windows, lambda k: F.substring(text, k * size + 1, F.lit(size + overlap)))).alias("window", "body"))
    before = F.substring("whole", F.lit(1), F.col("window") * size)
    return parts.select("url", "window", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("base_line"), "body")


def windowed_js_units(scripts: DataFrame, size: int = 200_000, overlap: int = 2_000, url: str = "url", body: str = "body") -> DataFrame:
    """Units of scripts by windows: the first of each kind and text of a script, with its line in the whole script."""
    windows = script_windows(scripts, size, overlap, url, body)
    keyed = windows.withColumn("key", F.to_json(F.struct("url", "window", "base_line")))
    found = js_units(keyed, "key").withColumn("k", F.from_json("resource_url", "url string, window int, base_line int"))
    placed = found.select(F.col("k.url").alias("resource_url"), F.col("k.window").alias("window"), "ord", "kind", "text", (F.col("line") + F.col("k.base_line") - 1).alias("line"), "extra")
    first = F.min_by(F.struct("ord", "line", "extra", "window"), F.struct("window", "ord"))
    out = placed.groupBy("resource_url", "kind", "text").agg(first.alias("f"))
    return out.select("resource_url", "f.window", "f.ord", "kind", "text", "f.line", "f.extra")


def inline_scripts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, ord, body) of scripts within pages."""
    code = r"(?is)<script\b(?![^>]*\bsrc\s*=)(?![^>]*type\s*=\s*[\"']application/(?:ld\+)?json)[^>]*>(.*?)</script>"
    return pages.select(F.col(url).alias("url"), F.posexplode(all_of(F.col(html), code)).alias("ord", "body")).where(F.length(F.trim("body")) > 0)


def units(resources: DataFrame) -> DataFrame:
    """Units of (url, mime, body) by kind of body: JSON, style sheets, HTML, scripts, else lines."""
    mime, u = F.lower(F.coalesce("mime", F.lit(""))), F.lower("url")
    sniffed = F.substring(F.col("body"), 1, 80).rlike(r"\A\s*[\[{]\s*[\"\[{\]}0-9tfn-]")
    form = (
        F.when(mime.contains("json") | u.rlike(r"\.(nd)?json(\z|\?)") | mime.contains("event-stream") | (sniffed & ~mime.contains("html") & ~mime.contains("javascript")), "json")
        .when(mime.contains("css") | u.rlike(r"\.css(\z|\?)"), "css")
        .when(mime.contains("html"), "html")
        .when(mime.rlike("javascript|ecmascript") | u.rlike(r"\.m?js(\z|\?)"), "js")
        .otherwise("text")
    )
    of = lambda name: resources.where(form == name)
    parts = [json_units(of("json")), css_units(of("css")), html_units(of("html"), html="body"), js_units(of("js")), text_lines(of("text"))]
    columns = ["resource_url", "ord", "kind", "text", "line", "extra"]
    full = [p.select(*[F.col(c) if c in p.columns else F.lit(None).cast("int" if c == "line" else "string").alias(c) for c in columns]) for p in parts]
    return reduce(DataFrame.unionByName, full)


def first_units(df: DataFrame) -> DataFrame:
    """One unit of each text and resource, the first in order."""
    w = Window.partitionBy("resource_url", "text").orderBy("ord")
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
