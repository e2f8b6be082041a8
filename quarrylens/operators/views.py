"""Views of a session's tables: routes, resources, exchanges, endpoints and findings under filters and the URL finder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.fuzzy import fuzzy_match
from ..functions.text import normalize
from . import dsl
from .extract import page_links
from .search import norm_of
from .tables import first_per

ALL = "ALL"
FIND_LEAST = 0.45
# Families of findings by the beginning of their rule.
FAMILIES = {"cloud-config-": "cloud", "crypto-": "crypto", "ephemeral-oauth-token": "crypto", "csp-": "csp", "postmessage-": "dom", "fw-": "framework", "hyg-": "hygiene"}


def found(url: Column, query: str, fuzzy: bool = True) -> Column:
    """Whether a URL holds the query in any case or, with ``fuzzy``, resembles it; an empty query finds all.

    Only URLs that don't hold it and are long enough for a score are sent to Arrow.
    """
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    shown = F.coalesce(url, F.lit(""))
    held = F.lower(shown).contains(wanted)
    needle = norm_of(wanted)
    if not fuzzy or not needle:
        return held
    norm = normalize(shown)
    return held | (fuzzy_match(F.when(~held & (F.length(norm) >= len(needle)), norm), needle)["score"] >= FIND_LEAST)


def _shown(df: DataFrame, filters: list[Column], order: list[Column], most: int | None) -> DataFrame:
    out = df.where(reduce(lambda a, b: a & b, filters, F.lit(True))).orderBy(*order)
    return out if most is None else out.limit(most)


def routes(df: DataFrame, text: str = "", find: str = "", fuzzy: bool = True, most: int | None = None) -> DataFrame:
    """Routes (route, url, method, count, seq), the first of each URL without its last slash, filtered, by route."""
    one = first_per(df.withColumn("__url", F.regexp_replace("url", r"/\z", "")), ["__url"], [F.col("seq")]).drop("__url")
    columns = {"method": F.col("method"), "route": F.col("route"), "url": F.col("url"), "seen": F.col("count")}
    return _shown(one, [dsl.compile_filter(text, columns, F.col("route")), found(F.col("url"), find, fuzzy)], [F.col("route")], most)


def resources(df: DataFrame, kind: str = ALL, text: str = "", find: str = "", origin: str = "", fuzzy: bool = True, most: int | None = None) -> DataFrame:
    """Resources (url, kind, mime, ts, seq), the first of each absolute URL, of one kind and filtered, newest first."""
    whole = F.when(F.col("url").startswith("/"), F.concat(F.lit(origin), "url")).otherwise(F.col("url"))
    one = first_per(df.withColumn("__url", whole), ["__url"], [F.col("seq")]).drop("__url")
    columns = {"url": F.col("url"), "kind": F.col("kind"), "mime": F.col("mime"), "host": urls.host_of(F.col("url"))}
    own = [F.lit(True) if kind == ALL else F.col("kind") == kind]
    return _shown(one, [*own, dsl.compile_filter(text, columns, F.concat_ws(" ", "url", "kind")), found(F.col("url"), find, fuzzy)], [F.desc("ts"), F.col("seq")], most)


def exchanges(df: DataFrame, method: str = ALL, group: str = ALL, text: str = "", find: str = "", fuzzy: bool = True, most: int | None = None) -> DataFrame:
    """Exchanges (url, method, status, mime, seq, ...) of one method and type group, filtered, newest first."""
    own = [F.lit(True) if method == ALL else F.col("method") == method, F.lit(True) if group == ALL else urls.mime_group(F.col("mime"), F.col("url")) == group]
    terms = dsl.compile_filter(text, dsl.exchange_columns(df), F.concat_ws(" ", "url", F.coalesce("mime", F.lit(""))))
    return _shown(df, [*own, terms, found(F.col("url"), find, fuzzy)], [F.desc("seq")], most)


def endpoints(df: DataFrame, kind: str = ALL, find: str = "", fuzzy: bool = True) -> DataFrame:
    """Endpoints (url, kind, ...) of one kind, by the URL finder."""
    return df.where((F.lit(True) if kind == ALL else F.col("kind") == kind) & found(F.col("url"), find, fuzzy))


def family(rule: Column) -> Column:
    """The family of a finding; ``secrets`` for all rules that belong to no other."""
    out = F.lit("secrets")
    for start, name in reversed(FAMILIES.items()):
        out = F.when(rule.startswith(start), name).otherwise(out)
    return out


def findings(df: DataFrame, sev: str = ALL, kind: str = ALL, text: str = "") -> DataFrame:
    """Findings (rule, sev, label, text, url) of a severity and a family that hold a text in any of their columns."""
    out = df.where(F.col("sev") == sev) if sev != ALL else df
    out = out.where(family(F.col("rule")) == kind) if kind != ALL else out
    held = [F.lower(F.coalesce(c, F.lit(""))).contains(text.lower()) for c in ("text", "label", "rule", "url")]
    return out.where(reduce(lambda a, b: a | b, held)) if text else out


def discovered_routes(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(url, route): path and query of each page's links to its own origin; fragments are none, links are resolved in Arrow batches."""
    links = page_links(pages).where(~F.trim("link").startswith("#")).withColumn("to", urls.url_resolve(F.col("url"), F.col("link")))
    own = links.where(urls.origin_of(F.col("to")) == F.lower(urls.origin_of(F.col("url"))))
    route = F.concat(urls.path_of(F.col("to")), F.when(urls.query_of(F.col("to")) != "", F.concat(F.lit("?"), urls.query_of(F.col("to")))).otherwise(""))
    out = own.select("url", route.alias("route"), "ord").groupBy("url", "route").agg(F.min("ord").alias("ord"))
    if most is not None:
        out = first_many(out, most)
    return out.select("url", "route")


def first_many(df: DataFrame, most: int) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy("ord"))).where(F.col("__n") <= most).drop("__n")


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) with the labels of their nodes (id, label); an unknown node is its own label."""
    names = nodes.select("id", "label")
    out = edges
    for end in ("src", "dst"):
        side = names.select(F.col("id").alias(end), F.col("label").alias("__label"))
        out = out.join(side, end, "left").withColumn(f"{end}_label", F.coalesce("__label", end)).drop("__label")
    return out


def framework_routes(pages: DataFrame, url: str = "url", html: str = "html", most: int | None = None) -> DataFrame:
    """(url, manifests, next_pages, is_nuxt) of pages: build manifests they load, paths in their data block, a Nuxt mark."""
    body = F.coalesce(F.col(html), F.lit(""))
    loaded = F.regexp_extract_all(body, F.lit(r"""(?i)(?:src|href)\s*=\s*["']([^"']{1,300})["']"""), F.lit(1))
    manifests = F.array_distinct(F.filter(loaded, lambda x: F.lower(x).contains("buildmanifest") | F.lower(x).contains("ssgmanifest")))
    data = F.array_join(F.regexp_extract_all(body, F.lit(r"""(?is)<script\b[^>]*id\s*=\s*["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""), F.lit(1)), "\n")
    strings = F.regexp_extract_all(data, F.lit(r'"\s*((?:\\?/)(?:[^"\\]|\\.){0,199})"(?!\s*:)'), F.lit(1))
    paths = F.array_distinct(F.transform(strings, lambda x: F.rtrim(F.replace(x, F.lit("\\/"), F.lit("/")))))
    cut = (lambda c: c) if most is None else (lambda c: F.slice(c, 1, most))
    return pages.select(F.col(url).alias("url"), cut(manifests).alias("manifests"), cut(paths).alias("next_pages"), body.contains("__NUXT__").alias("is_nuxt"))
