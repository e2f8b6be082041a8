"""URL functions: hosts, templates, kinds, classes. Built-in expressions; only reference resolution is an Arrow UDF."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that define the classes and templates.
API_SEGMENT = r"(?i)(\A|/)(api|apis|rest|graphql|gql|trpc|v\d{1,3})(/|\z|[?#])"
BARE_API = r"(?i)\A(api|rest|graphql|gql|trpc|v\d{1,3})/"
ROUTE_CHARS = r"\A/[A-Za-z0-9_\-.~/{}$:@!&'()*+,;=%?#\[\]]{1,220}\z"
NAMESPACE = r"\A/(19\d{2}|2000)/"
ASSET = r"(?i)\.(m?js|css|map|json|png|jpe?g|gif|webp|avif|svg|ico|woff2?|ttf|otf|eot|mp4|webm|mp3|wav|wasm|txt|xml)(\?|#|\z)"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
WHOLE_ID = rf"\A(\d{{2,}}|{UUID}|0x[0-9a-fA-F]+|[0-9a-fA-F]{{16,}})\z"
SOME_ID = rf"\d{{2,}}|{UUID}|0x[0-9a-fA-F]+"
API_ROUTE = r"(?i)/api(/|\z|[?#])|/graphql|/trpc|/rest/|v\d+/|/ajax/|/rpc\b|/query\b|/gateway/|graphql"
OAUTH_PARAM = r"(?i)[?&#](code|access_token|id_token|session_token|token|api_key|auth_token|refresh_token)=([^&#\s]{8,})"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user and port; empty for others and null."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Path of an absolute or relative URL; ``/`` where an absolute one has none."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_extract(rest, r"\A([^?#]*)", 1)
    return F.when((path == "") & (origin_of(url) != ""), "/").otherwise(path)


def query_of(url: Column) -> Column:
    """What stands between ``?`` and ``#``, empty if nothing."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\A[^?#]*\?([^#]*)", 1)


def filename_of(url: Column) -> Column:
    last = F.element_at(F.split(path_of(url), "/"), -1)
    return F.when(last != "", last).otherwise(url)


def query_params(url: Column, most: int = 30) -> Column:
    """Array of (name, value) in order, empty names left out."""
    pairs = F.filter(F.split(query_of(url), "&"), lambda p: F.substring_index(p, "=", 1) != "")
    return F.slice(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.regexp_replace(p, r"\A[^=]*=?", "").alias("value"))), 1, most)


def _template(path: Column, test) -> Column:
    out = F.array_join(F.transform(F.split(path, "/", -1), lambda seg: F.when(test(seg), "{id}").otherwise(seg)), "/")
    return F.when(out == "", "/").otherwise(out)


def template_openapi(path: Column) -> Column:
    """Whole segments that are identifiers become ``{id}``."""
    return _template(F.coalesce(path, F.lit("")), lambda seg: seg.rlike(WHOLE_ID))


def template_path(path: Column) -> Column:
    """Segments that contain an identifier become ``{id}``; query and fragment are dropped."""
    return _template(F.regexp_extract(F.coalesce(path, F.lit("")), r"\A([^?#]*)", 1), lambda seg: seg.rlike(SOME_ID))


def normalize_dynamic(path: Column) -> Column:
    """UUIDs, long hexadecimal and numeric segments become ``{uuid}``, ``{hash}`` and ``{id}``.

    Two numeric segments in a row share a slash, so only every other one is replaced.
    """
    out = F.regexp_replace(F.coalesce(path, F.lit("")), UUID, "{uuid}")
    out = F.regexp_replace(out, r"/[0-9a-fA-F]{24,64}(/|\z)", "/{hash}$1")
    return F.regexp_replace(out, r"/\d+(/|\z)", "/{id}$1")


def normalize_route(url: Column, origin: str = "") -> Column:
    """Route of a URL of this origin: leading slash, no trailing one."""
    rest = F.when(F.lit(bool(origin)) & url.startswith(origin), F.substring(url, F.lit(len(origin) + 1), F.length(url))).otherwise(url)
    slashed = F.when(rest.startswith("/") | rest.contains("://"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(slashed == "/", "/").otherwise(F.regexp_replace(slashed, r"/+\z", ""))


def is_api(s: Column) -> Column:
    absolute = s.rlike(r"(?i)\A(https?|wss?)://")
    path = F.when(absolute, F.concat(path_of(s), F.when(query_of(s) != "", F.concat(F.lit("?"), query_of(s))).otherwise(""))).otherwise(s)
    return F.length(s).between(2, 260) & F.when(path.startswith("/"), path.rlike(API_SEGMENT)).otherwise(path.rlike(BARE_API))


def is_route(s: Column) -> Column:
    return F.length(s).between(2, 220) & s.rlike(ROUTE_CHARS) & ~s.startswith("//") & s.rlike("[A-Za-z]") & ~s.rlike(NAMESPACE)


def classify_path(s: Column) -> Column:
    """``endpoint``, ``asset``, ``route`` or null."""
    t = F.substring(F.trim(s), 1, 260)
    return F.when(is_api(t), "endpoint").when(is_route(t), F.when(t.rlike(ASSET), "asset").otherwise("route"))


def mime_group(mime: Column, url: Column) -> Column:
    m, u = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    both = F.concat_ws(" ", m, u)
    major = F.substring_index(m, "/", 1)
    return (
        F.when(m.contains("json"), "json")
        .when(m.rlike("javascript|ecmascript") | u.rlike(r"\.m?js(\z|\?)"), "js")
        .when(m.contains("css") | u.rlike(r"\.css(\z|\?)"), "css")
        .when(m.contains("html"), "html")
        .when(both.rlike("image/|png|jpe?g|gif|webp|avif|svg|ico"), "img")
        .when(both.rlike("video/|audio/|mp4|webm|mp3|wav"), "media")
        .when(both.rlike("font/|woff2?|ttf|otf|eot"), "font")
        .when(m.rlike("xml|csv|text/"), "text")
        .when(m == "", "unknown")
        .otherwise(F.when(m.contains("/") & (major != ""), major).otherwise(F.substring(m, 1, 24)))
    )


def resource_kind(url: Column, mime: Column, origin: str = "") -> Column:
    u, m = F.lower(F.coalesce(url, F.lit(""))), F.coalesce(mime, F.lit(""))
    code = r"\.(js|css|png|jpg|jpeg|gif|webp|svg|woff2?|ttf|otf)"
    return (
        F.when(F.concat(u, m).rlike(r"\.map(\z|\?)|source-?map|application/json\+sourcemap"), "source-map")
        .when(m.rlike("json") | (u.rlike(r"/api/|/graphql|/v\d+/|/rpc|/rest/") & ~u.rlike(code)), "api-json")
        .when(m.rlike("javascript|ecmascript") | u.rlike(r"\.m?js(\z|\?)"), F.when(u.rlike("chunk|lazy|async|assets/"), "chunk").otherwise("script"))
        .when(m.contains("css") | u.rlike(r"\.css(\z|\?)"), "stylesheet")
        .when(m.contains("html") | (u == f"{origin}/") | ~u.rlike(r"\.\w{2,4}(\z|\?)"), "document")
        .when(u.rlike(r"\.(png|jpe?g|gif|webp|avif|svg|ico|mp4|webm|mp3)(\z|\?)"), "media-meta")
        .when(u.rlike(r"\.(woff2?|ttf|otf|eot)(\z|\?)"), "font-meta")
        .otherwise("other-text")
    )


def api_kind(url: Column, mime: Column, body: Column) -> Column:
    u, m, b = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(mime, F.lit(""))), F.coalesce(body, F.lit(""))
    path, query = F.lower(path_of(url)), F.lower(query_of(url))
    return (
        F.when(u.startswith("ws:") | u.startswith("wss:"), "WebSocket")
        .when(m.contains("grpc"), "gRPC-Web")
        .when(m.contains("event-stream"), "SSE")
        .when(path.contains("/graphql") | b.contains('"query"'), "GraphQL")
        .when(path.contains("/trpc/") | query.contains("batch="), "tRPC")
        .when(b.contains('"method"'), "JSON-RPC")
        .when(b.contains("Envelope") | m.contains("soap"), "SOAP")
        .when(path.rlike(r"/api/|/rest/|/v\d+/") | query.rlike("query=|input="), "REST")
        .otherwise("Other")
    )


def is_subdomain(host: Column, base: str) -> Column:
    bare = base.lower().removeprefix("www.")
    h = F.regexp_replace(F.lower(host), r"\Awww\.", "")
    return (h == bare) | h.endswith(f".{bare}")


def short_url(url: Column, most: int = 80) -> Column:
    path = path_of(url)
    shown = F.when(F.length(path) > 1, path).otherwise(F.when(host_of(url) != "", host_of(url)).otherwise(url))
    return F.when(F.length(shown) > most, F.concat(F.lit("…"), F.right(shown, F.lit(most - 1)))).otherwise(shown)


def oauth_tokens(url: Column) -> Column:
    """Array of (name, value) of OAuth-like parameters of eight characters or more."""
    names = F.regexp_extract_all(url, F.lit(OAUTH_PARAM), F.lit(1))
    return F.arrays_zip(names.alias("name"), F.regexp_extract_all(url, F.lit(OAUTH_PARAM), F.lit(2)).alias("value"))


_SAFE = "!#$%&'()*+,/:;=?@[]~"


def resolve_url(base: str | None, ref: str | None) -> str | None:
    """Absolute URL of ``ref`` seen from ``base``: dot segments resolved, host in lower case, other characters encoded; None if it isn't absolute."""
    if ref is None:
        return None
    try:
        joined = urljoin(base or "", re.sub(r"[\t\r\n]", "", ref.strip()))
        parts = urlsplit(joined)
        if not parts.scheme or not (parts.netloc or parts.scheme in ("data", "blob", "javascript", "mailto")):
            return None
        path = quote(parts.path or ("/" if parts.netloc else ""), safe=_SAFE)
        query = f"?{quote(parts.query, safe=_SAFE)}" if parts.query else ""
        tail = f"#{quote(parts.fragment, safe=_SAFE)}" if parts.fragment else ""
        return f"{parts.scheme}:{'//' + parts.netloc.lower() if parts.netloc else ''}{path}{query}{tail}"
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def url_resolve(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([resolve_url(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)
