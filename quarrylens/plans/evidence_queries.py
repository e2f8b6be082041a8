"""Queries over exchanges derived from pages and events: inventory, HAR, sessions, OpenAPI, wordlists, dossiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import api, exposures, extract, tables
from ..session import table
from ..sources import exports
from .unit_queries import HOST, LINKS, PATH, QUERY

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def exchanges_of_pages(pages: DataFrame) -> DataFrame:
    """Pages as exchanges: a GET each, its html the body, headers that a server would send."""
    return pages.select(
        F.col("page_id").alias("seq"),
        "url",
        F.lit("GET").alias("method"),
        F.lit(200).alias("status"),
        F.lit("text/html").alias("mime"),
        urls.path_of(F.col("url")).alias("route"),
        F.create_map(F.lit("accept"), F.lit("text/html")).alias("req_headers"),
        F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8"), F.lit("set-cookie"), F.concat(F.lit("sid="), F.col("page_id").cast("string"))).alias("res_headers"),
        F.lit(None).cast("string").alias("req_body"),
        F.col("html").alias("resp_body"),
    )


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges_of_pages(table(spark, sf_dir, "pages"))


@query("a8_endpoint_evidence", f"""WITH r AS (SELECT coalesce(nullif(array_to_string(list_transform(string_split({PATH.format('url')}, '/'), lambda s: CASE WHEN regexp_matches(s, '\\d{{2,}}|0x[0-9a-fA-F]+') THEN '{{id}}' ELSE s END), '/'), ''), '/') AS template, count(*) AS calls FROM pages GROUP BY 1),
    s AS (SELECT DISTINCT coalesce(nullif(array_to_string(list_transform(string_split(coalesce(nullif(regexp_extract(link, '^([^?#]*)', 1), ''), ''), '/'), lambda s: CASE WHEN regexp_matches(s, '\\d{{2,}}|0x[0-9a-fA-F]+') THEN '{{id}}' ELSE s END), '/'), ''), '/') AS template, true AS in_code FROM ({LINKS}))
    SELECT coalesce(r.template, s.template) AS template, coalesce(calls, 0) AS calls, coalesce(in_code, false) AS in_code FROM r FULL JOIN s ON r.template = s.template""")
def endpoint_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract.page_links(table(spark, sf_dir, "pages")).select(F.col("link").alias("text"), F.col("url").alias("resource_url"), "ord")
    found = api.evidence(_pages(spark, sf_dir), links)
    return found.select("template", "calls", F.col("file").isNotNull().alias("in_code"))


@query("a10_openapi_paths", f"""SELECT coalesce(nullif(array_to_string(list_transform(string_split({PATH.format('url')}, '/'), lambda s: CASE WHEN regexp_matches(s, '^(\\d{{2,}}|0x[0-9a-fA-F]+|[0-9a-fA-F]{{16,}})$') THEN '{{id}}' ELSE s END), '/'), ''), '/') AS path, 'get' AS method, min(page_id) AS seq FROM pages GROUP BY 1""")
def openapi_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.openapi_paths(_pages(spark, sf_dir)).select("path", "method", "seq")


@query("s15_openapi_document", None)
def openapi_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = extract.page_links(table(spark, sf_dir, "pages")).select(F.col("link").alias("route")).distinct()
    return api.openapi_document(_pages(spark, sf_dir), routes, most=None)


@query("f14_inventory", None)
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = extract.page_links(table(spark, sf_dir, "pages")).select(F.col("link").alias("route")).distinct()
    return api.inventory(_pages(spark, sf_dir), routes)


@query("r7_hygiene", f"""SELECT rule, count(*) AS n FROM (SELECT DISTINCT rule, {HOST.format('url')} AS host FROM pages, (VALUES ('hyg-csp-missing'), ('hyg-clickjacking'), ('hyg-hsts-missing'), ('hyg-cookie-httponly'), ('hyg-cookie-secure')) AS r(rule)
    WHERE rule NOT IN ('hyg-hsts-missing', 'hyg-cookie-secure') OR starts_with(url, 'https:')) GROUP BY ALL""")
def hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = _pages(spark, sf_dir).select("url", "mime", F.col("res_headers").alias("headers"))
    return exposures.hygiene(responses).groupBy("rule").agg(F.count("*").alias("n"))


@query("s11_har_entries", f"SELECT page_id, 'GET' AS method, url, 200 AS status, strlen(html) AS size FROM pages WHERE regexp_matches(url, '^https?://')")
def har_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges to HAR entries and back."""
    from ..sources import har

    back = har.parse_entries(har.entries(_pages(spark, sf_dir), body=None), body=None)
    return back.select(F.col("seq").cast("long").alias("page_id"), "method", "url", "status", F.octet_length("resp_body").cast("long").alias("size"))


@query("s17_wordlist", f"""SELECT kind, word FROM (SELECT 'endpoint' AS kind, {PATH.format('url')} AS word FROM pages
    UNION SELECT 'param', split_part(p, '=', 1) FROM (SELECT unnest(string_split({QUERY.format('url')}, '&')) AS p FROM pages) WHERE split_part(p, '=', 1) <> ''
    UNION SELECT 'word', lower(w) FROM (SELECT unnest(string_split({PATH.format('url')}, '/')) AS w FROM pages) WHERE length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$')
    UNION SELECT 'header', h FROM (VALUES ('accept'), ('content-type'), ('set-cookie')) AS x(h))""")
def wordlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.wordlist(_pages(spark, sf_dir))


@query("s22_curl", "SELECT page_id, 'curl -X GET ''' || replace(url, '''', '''\\''''') || ''' -H ''accept: text/html''' AS curl FROM pages")
def curl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(F.col("seq").alias("page_id"), exports.curl(F.col("method"), F.col("url"), F.col("req_headers")).alias("curl"))


@query("a14_dossier_counts", None)
def dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    routes = extract.page_links(pages).select(F.col("link").alias("route")).distinct()
    return exports.dossier(_pages(spark, sf_dir), routes)


@query("f13_api_kinds", "SELECT 'Other' AS value, count(*) AS n FROM pages")
def api_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.count_by(_pages(spark, sf_dir), urls.api_kind(F.col("url"), F.col("mime"), F.lit("")))


@query("e22_header_units", "SELECT kind, count(*) AS n FROM (SELECT 'url' AS kind FROM pages UNION ALL SELECT 'header' FROM pages, generate_series(1, 2)) GROUP BY ALL")
def header_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.header_units(_pages(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))
