"""Queries over pages: links, classes, groups, templates, text, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import extract, graph, tables
from ..session import table

QUERIES: dict = {}
ORACLES: dict = {}

#: SQL shared by the comparisons: hosts, paths and the class of a link.
HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
PATH = "coalesce(nullif(regexp_extract(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^([^?#]*)', 1), ''), '/')"
QUERY = "regexp_extract({0}, '^[^?#]*\\?([^#]*)', 1)"
LINKS = """SELECT page_id, url, i - 1 AS ord, l[i] AS link FROM (
    SELECT page_id, url, regexp_extract_all(html, '(?i)(?:href|src|action|data-src)\\s*=\\s*["'']([^"'']{1,300})["'']', 1) AS l FROM pages
), unnest(generate_series(1, len(l))) AS g(i) WHERE NOT regexp_matches(l[i], '(?i)^\\s*(data|javascript):')"""
CLASS = """CASE WHEN length(trim({0})) BETWEEN 2 AND 260 AND CASE WHEN starts_with(trim({0}), '/')
        THEN regexp_matches(trim({0}), '(?i)(^|/)(api|apis|rest|graphql|gql|trpc|v\\d{{1,3}})(/|$|[?#])')
        ELSE regexp_matches(trim({0}), '(?i)^(api|rest|graphql|gql|trpc|v\\d{{1,3}})/') END THEN 'endpoint'
    WHEN length(trim({0})) BETWEEN 2 AND 220 AND regexp_matches(trim({0}), '^/[A-Za-z0-9_\\-.~/{{}}$:@!&''()*+,;=%?#\\[\\]]{{1,220}}$')
        AND NOT starts_with(trim({0}), '//') AND regexp_matches(trim({0}), '[A-Za-z]') AND NOT regexp_matches(trim({0}), '^/(19\\d{{2}}|2000)/')
        THEN CASE WHEN regexp_matches(trim({0}), '(?i)\\.(m?js|css|map|json|png|jpe?g|gif|webp|avif|svg|ico|woff2?|ttf|otf|eot|mp4|webm|mp3|wav|wasm|txt|xml)(\\?|#|$)') THEN 'asset' ELSE 'route' END END"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("e6_links_by_host_class", f"SELECT {HOST.format('url')} AS host, coalesce({CLASS.format('link')}, 'other') AS class, count(*) AS n FROM ({LINKS}) GROUP BY ALL")
def links_by_host_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.links_by_host_class(table(spark, sf_dir, "pages"))


@query("e6_page_links", f"SELECT url, ord, link FROM ({LINKS})")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_links(table(spark, sf_dir, "pages")).select("url", F.col("ord").cast("long").alias("ord"), "link")


@query("a1_links_top", f"SELECT link AS value, count(*) AS n FROM ({LINKS}) GROUP BY ALL")
def links_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.count_by(extract.page_links(table(spark, sf_dir, "pages")), "link")


@query("a4_pages_by_host", f"SELECT {HOST.format('url')} AS host, count(*) AS n, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY ALL")
def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.group_by_host(table(spark, sf_dir, "pages"), size=F.octet_length("html").cast("long"))


@query("w2_pages_capped_per_host", f"""SELECT host, page_id, greatest(n - 3, 0) AS more FROM (
    SELECT {HOST.format('url')} AS host, page_id, row_number() OVER (PARTITION BY {HOST.format('url')} ORDER BY page_id DESC) AS r,
        count(*) OVER (PARTITION BY {HOST.format('url')}) AS n FROM pages) WHERE r <= 3""")
def pages_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"))
    return tables.capped_per(pages, ["host"], [F.desc("page_id")], 3).select("host", "page_id", "more")


@query("e10_page_text_lines", """SELECT url AS resource_url, i AS line, trim(l[i], ' \t\r') AS text FROM (SELECT url, string_split(html, chr(10)) AS l FROM pages), unnest(generate_series(1, len(l))) AS g(i)
    WHERE length(trim(l[i], ' \t\r')) BETWEEN 3 AND 320""".replace("' \t\r'", "' ' || chr(9) || chr(13)"))
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.text_lines(table(spark, sf_dir, "pages"), body="html").select("resource_url", F.col("line").cast("long").alias("line"), "text")


@query("e6_html_units", None)
def html_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.html_units(table(spark, sf_dir, "pages"))


@query("e2_inline_script_units", None)
def script_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.js_units(extract.inline_scripts(table(spark, sf_dir, "pages")))


@query("e5_inline_style_units", None)
def style_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    sheets = pages.select("url", F.explode(extract.all_of(F.col("html"), r"(?is)<style\b[^>]*>(.*?)</style>")).alias("body"))
    return extract.css_units(sheets.withColumn("body", F.concat("body", F.lit(" .extra-rule{background:url(/img/a.png)}"))))


@query("u_url_parts", f"SELECT page_id, {HOST.format('url')} AS host, {PATH.format('url')} AS path, {QUERY.format('url')} AS query FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host_of(u).alias("host"), urls.path_of(u).alias("path"), urls.query_of(u).alias("query"))


@query("u_path_templates", f"""SELECT page_id,
    coalesce(nullif(array_to_string(list_transform(string_split({PATH.format('url')}, '/'), lambda s: CASE WHEN regexp_matches(s, '^(\\d{{2,}}|0x[0-9a-fA-F]+|[0-9a-fA-F]{{16,}}|[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}})$') THEN '{{id}}' ELSE s END), '/'), ''), '/') AS whole,
    coalesce(nullif(array_to_string(list_transform(string_split({PATH.format('url')}, '/'), lambda s: CASE WHEN regexp_matches(s, '\\d{{2,}}|0x[0-9a-fA-F]+') THEN '{{id}}' ELSE s END), '/'), ''), '/') AS loose,
    regexp_replace(regexp_replace({PATH.format('url')}, '/[0-9a-fA-F]{{24,64}}(/|$)', '/{{hash}}\\1', 'g'), '/\\d+(/|$)', '/{{id}}\\1', 'g') AS dynamic FROM pages""")
def path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = urls.path_of(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.template_openapi(path).alias("whole"), urls.template_path(path).alias("loose"), urls.normalize_dynamic(path).alias("dynamic"))


@query("e2g_query_params", f"""SELECT p.name AS value, count(*) AS n FROM (SELECT unnest(list_transform(list_filter(string_split({QUERY.format('url')}, '&'), lambda x: split_part(x, '=', 1) <> ''), lambda x: {{'name': split_part(x, '=', 1)}})) AS p FROM pages) GROUP BY ALL""")
def query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "pages").select(F.explode(urls.query_params(F.col("url"))).alias("p"))
    return tables.count_by(named, F.col("p.name"))


@query("a2_mime_groups", """SELECT CASE WHEN regexp_matches(lower(url), '\\.m?js($|\\?)') THEN 'js' WHEN regexp_matches(lower(url), '\\.css($|\\?)') THEN 'css' ELSE 'html' END AS value, count(*) AS n FROM pages GROUP BY ALL""")
def mime_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.mime_group_counts(table(spark, sf_dir, "pages").withColumn("mime", F.lit("text/html")))


@query("f8_url_finder", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'utm_source')")
def url_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.lower("url").contains("utm_source")).select("page_id", "url")


@query("f3_wildcard", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)^https://.*/en/.*$')")
def wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import dsl

    return table(spark, sf_dir, "pages").where(dsl.wildcard(F.col("url"), "HTTPS://*/en/*")).select("page_id", "url")


@query("j1_links_without_page", f"""WITH l AS ({LINKS}) SELECT DISTINCT link AS route FROM l WHERE starts_with(link, '/') AND link NOT IN (SELECT {PATH.format('url')} FROM pages)""")
def links_without_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    called = pages.select(urls.path_of(F.col("url")).alias("route")).distinct()
    return extract.page_links(pages).where(F.col("link").startswith("/")).select(F.col("link").alias("route")).distinct().join(called, "route", "left_anti")


@query("x1_normalize_urls", "SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ-_./\\:;|+~*% ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM pages")
def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.normalize(F.col("url")).alias("norm"))


@query("g1_page_graph_degree", f"""WITH l AS ({LINKS}), e AS (SELECT DISTINCT regexp_extract(url, '^([^#]*)', 1) AS src, link FROM l WHERE starts_with(link, '/') AND NOT starts_with(link, '//'))
    SELECT {HOST.format('src')} AS host, count(*) AS n FROM e GROUP BY ALL""")
def page_graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different link targets per host; links of pages are all within their host here."""
    links = extract.page_links(table(spark, sf_dir, "pages")).where(F.col("link").startswith("/") & ~F.col("link").startswith("//"))
    edges = links.select(F.regexp_extract("url", r"\A([^#]*)", 1).alias("src"), "link").distinct()
    return edges.groupBy(urls.host_of(F.col("src")).alias("host")).agg(F.count("*").alias("n"))


@query("g2_page_edges", None)
def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.page_edges(table(spark, sf_dir, "pages"))


@query("g3_crawl", None)
def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    seeds = pages.select(F.regexp_extract("url", r"\A([^#]*)", 1).alias("url"))
    return graph.crawl(graph.page_edges(pages), seeds, depth=2, pages=None)


@query("e26_script_position", """SELECT page_id, strpos(html, '<article>') - 1 AS at, length(left(html, strpos(html, '<article>') - 1)) - length(replace(left(html, strpos(html, '<article>') - 1), chr(10), '')) + 1 AS line FROM pages WHERE contains(html, '<article>')""")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.instr("html", "<article>") - 1
    found = table(spark, sf_dir, "pages").where(F.col("html").contains("<article>"))
    return found.select("page_id", at.cast("long").alias("at"), text.line_of(F.col("html"), at).cast("long").alias("line"))


@query("r2_exposures", None)
def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import exposures as ex

    pages = table(spark, sf_dir, "pages")
    params = pages.select(F.explode(urls.query_params(F.col("url"))).alias("p")).select(F.col("p.name").alias("param")).distinct()
    routes = extract.page_links(pages).select(F.col("link").alias("route")).distinct()
    return ex.merge(ex.auth_in_url(pages), ex.internal_hosts(pages), ex.interesting_params(params), ex.sensitive_routes(routes))
