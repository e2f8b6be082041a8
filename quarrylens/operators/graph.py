"""Discovery graph: nodes and edges of pages, links, scripts and endpoints, and a bounded crawl over stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .extract import page_links


def nodes(*parts: DataFrame) -> DataFrame:
    """One node per id (id, label, kind, url, seq), the first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("seq", "kind"))).where("__n = 1").drop("__n")


def edges_of_units(units: DataFrame) -> DataFrame:
    """(src, dst, via) from the units that name another resource, one of each."""
    via = (
        F.when(F.col("kind").isin("dom-link", "script", "iframe", "form"), F.col("kind"))
        .when(F.col("kind").isin("dynamic-import", "static-import"), "import")
        .when(F.col("kind") == "fetch-target", "fetch")
        .when(F.col("kind") == "sourcemap-ref", "source-map")
        .when(F.col("kind").isin("css-reference", "css-import"), "css")
        .when(F.col("kind").isin("route", "endpoint"), "js-string")
    )
    return units.withColumn("via", via).where("via is not null").select(F.col("resource_url").alias("src"), F.col("text").alias("dst"), "via").distinct()


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) from pages (url, html) to the absolute URLs of their links, self-links left out; references are resolved in Arrow batches."""
    links = page_links(pages).withColumn("dst", urls.url_resolve(F.col("url"), F.col("link"))).where("dst is not null")
    bare = lambda c: F.regexp_extract(c, r"\A([^#]*)", 1)
    return links.select(bare("url").alias("src"), bare("dst").alias("dst")).where("src <> dst").distinct()


def summary(edges: DataFrame, most: int = 20) -> DataFrame:
    """The newest edges as ``from —[via]→ to``, of (src, dst, via, seq)."""
    return edges.orderBy(F.desc("seq"), "src", "dst").limit(most).select(F.concat(F.col("src"), F.lit(" —["), F.col("via"), F.lit("]→ "), F.col("dst")).alias("line"))


def crawl(edges: DataFrame, seeds: DataFrame, depth: int = 2, pages: int | None = 25, per_page: int | None = 60, same_host: bool = True) -> DataFrame:
    """Breadth-first visit of a stored graph: (url, depth), each page at its least depth.

    Every level joins the frontier with the edges and drops what is visited; with ``pages`` the visit ends at that
    many, by depth and then by name. ``per_page`` follows so many links a page, by name.
    """
    seen = seeds.select("url", F.lit(0).alias("depth")).distinct()
    frontier = seen
    if per_page is not None:
        w = Window.partitionBy("src").orderBy("dst")
        edges = edges.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_page).drop("__n")
    if same_host:
        edges = edges.where(urls.host_of(F.col("src")) == urls.host_of(F.col("dst")))
    for level in range(1, depth + 1):
        found = frontier.join(edges, frontier.url == edges.src).select(F.col("dst").alias("url")).distinct()
        frontier = found.join(seen.select("url"), "url", "left_anti").select("url", F.lit(level).alias("depth"))
        seen = seen.unionByName(frontier)
    return seen if pages is None else seen.orderBy("depth", "url").limit(pages)
