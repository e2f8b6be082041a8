"""Queries over views of derived exchanges, the page graph, what pages report and captured streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import exposures, extract, graph, views
from ..session import table
from ..sources import capture
from .derived_queries import EXCHANGES, KIND, METHOD, exchanges
from .unit_queries import HOST, LINKS

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    """Registers a query over the derived exchanges, which its SQL sees as ``ex``."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(exchanges(spark, sf_dir))
        ORACLES[name] = f"WITH RECURSIVE ex AS ({EXCHANGES.format(events='events')}) {sql}"
        return f

    return add


def page_query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(table(spark, sf_dir, "pages"))
        ORACLES[name] = sql
        return f

    return add


def _routes(ex: DataFrame) -> DataFrame:
    return ex.select(F.concat("url", F.when(F.col("seq") % 2 == 0, "/").otherwise("")).alias("url"), F.col("url").alias("route"), F.coalesce(F.nullif("method", F.lit("")), F.lit("GET")).alias("method"), (F.col("seq") % 5).alias("count"), "seq")


@query("f7_route_view", """SELECT route, method, seq FROM (SELECT url AS route, coalesce(nullif(method, ''), 'GET') AS method, seq % 5 AS n, seq, row_number() OVER (PARTITION BY regexp_replace(url || CASE WHEN seq % 2 = 0 THEN '/' ELSE '' END, '/$', '') ORDER BY seq) AS r FROM ex)
    WHERE r = 1 AND n >= 2 AND NOT contains(lower(route), 'graphql') AND contains(lower(route), 'example.com')""")
def route_view(ex: DataFrame) -> DataFrame:
    return views.routes(_routes(ex), "seen:>=2 -graphql", "Example.COM", fuzzy=False).select("route", "method", "seq")


@query("f7_resource_view", f"""SELECT url, seq FROM (SELECT url, mime, {KIND} AS kind, seq, row_number() OVER (PARTITION BY CASE WHEN starts_with(url, '/') THEN 'https://app.example.com' || url ELSE url END ORDER BY seq) AS r FROM ex)
    WHERE r = 1 AND kind = 'api-json' AND NOT {HOST.format('url')} = 'live.example.com'""")
def resource_view(ex: DataFrame) -> DataFrame:
    found = ex.select("url", "mime", urls.resource_kind(F.col("url"), F.col("mime")).alias("kind"), F.col("seq").alias("ts"), "seq")
    return views.resources(found, "api-json", "-host:live.example.com", origin="https://app.example.com").select("url", "seq")


@query("f7_exchange_view", "SELECT seq FROM ex WHERE method = 'POST' AND status >= 400 AND NOT contains(lower(url), 'cdn')")
def exchange_view(ex: DataFrame) -> DataFrame:
    return views.exchanges(ex, "POST", text="status:>=400 -url:cdn").select("seq")


@query("f20_endpoint_view", "SELECT seq, url FROM ex WHERE starts_with(url, 'wss://') AND contains(lower(url), '/socket/4')")
def endpoint_view(ex: DataFrame) -> DataFrame:
    found = ex.select("seq", "url", urls.api_kind(F.col("url"), F.col("mime"), F.col("req_body")).alias("kind"))
    return views.endpoints(found, "WebSocket", "/Socket/4", fuzzy=False).select("seq", "url")


RULES = ("cloud-config-firebase", "crypto-cleartext-or-key", "ephemeral-oauth-token", "csp-cloud-bucket", "postmessage-no-origin-check", "fw-react", "hyg-csp-missing", "jwt")
FINDINGS = f"SELECT seq, list_extract({list(RULES)}, CAST(seq % 8 AS INT) + 1) AS rule, CASE seq % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS sev, event_type AS label, 't' || user_id AS text, url FROM ex"
FAMILY = """CASE seq % 8 WHEN 0 THEN 'cloud' WHEN 1 THEN 'crypto' WHEN 2 THEN 'crypto' WHEN 3 THEN 'csp' WHEN 4 THEN 'dom' WHEN 5 THEN 'framework' WHEN 6 THEN 'hygiene' ELSE 'secrets' END"""


def _findings(ex: DataFrame) -> DataFrame:
    rule = F.element_at(F.array(*map(F.lit, RULES)), (F.col("seq") % 8 + 1).cast("int"))
    sev = F.when(F.col("seq") % 3 == 0, "critical").when(F.col("seq") % 3 == 1, "high").otherwise("medium")
    return ex.select("seq", rule.alias("rule"), sev.alias("sev"), F.col("event_type").alias("label"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("text"), "url")


@query("f19_finding_families", f"SELECT {FAMILY} AS family, count(*) AS n FROM ({FINDINGS}) GROUP BY ALL")
def finding_families(ex: DataFrame) -> DataFrame:
    return _findings(ex).groupBy(views.family(F.col("rule")).alias("family")).agg(F.count("*").alias("n"))


@query("f19_finding_view", f"SELECT seq, rule FROM ({FINDINGS}) WHERE sev = 'high' AND {FAMILY} = 'crypto' AND (contains(lower(text), 'oa') OR contains(lower(label), 'oa') OR contains(rule, 'oa') OR contains(lower(url), 'oa'))")
def finding_view(ex: DataFrame) -> DataFrame:
    return views.findings(_findings(ex), "high", "crypto", "OA").select("seq", "rule")


@query("r8_page_findings", """SELECT rule, sev, label, text, url FROM (
    SELECT 'ephemeral-oauth-token' AS rule, 'critical' AS sev, 'Ephemeral OAuth Token (code)' AS label, 'code=c' || seq AS text, url || '#t' AS url FROM ex WHERE seq % 4 = 0
    UNION ALL SELECT 'crypto-cleartext-or-key', 'high', 'Crypto Tap (encrypt AES-GCM)', '[encrypt AES-GCM] ' || event_type, url FROM ex WHERE length(event_type) >= 8
    UNION ALL SELECT 'postmessage-no-origin-check', 'medium', 'postMessage Listener Missing Origin Check', 'on ' || event_type, url FROM ex WHERE seq % 3 <> 1)""")
def page_findings(ex: DataFrame) -> DataFrame:
    seq = F.col("seq")
    token = F.struct(F.lit("code").alias("param"), F.concat(F.lit("c"), seq.cast("string")).alias("token"), F.concat("url", F.lit("#t")).alias("url"))
    tap = F.struct(F.lit("encrypt").alias("op"), F.lit("AES-GCM").alias("algo"), F.col("event_type").alias("preview"))
    heard = F.struct(F.concat(F.lit("on "), "event_type").alias("preview"), F.when(seq % 3 == 0, F.lit(False)).when(seq % 3 == 1, F.lit(True)).alias("has_origin_check"))
    batches = ex.select("url", F.lit("/").alias("route"), F.when(seq % 4 == 0, F.array(token)).alias("tokens"), F.array(tap).alias("crypto"), F.array(heard).alias("listeners"))
    return exposures.page_runtime(batches).select("rule", "sev", "label", "text", "url")


@query("r6_cloud_findings", "SELECT 'cloud-config-firebase' AS rule, '[firebase] apiKey=k' || seq || ', projectId=' || event_type AS text, url FROM ex")
def cloud_findings(ex: DataFrame) -> DataFrame:
    config = F.create_map(F.lit("projectId"), F.col("event_type"), F.lit("apiKey"), F.concat(F.lit("k"), F.col("seq").cast("string")))
    return exposures.cloud_findings(ex.select(F.col("url").alias("resource_url"), F.lit("firebase").alias("provider"), config.alias("config"))).select("rule", "text", "url")


@query("j12_labelled_edges", "SELECT seq, event_type AS src_label, CASE WHEN seq % 2 = 0 THEN 'n' || url ELSE url END AS dst_label FROM ex")
def labelled_edges(ex: DataFrame) -> DataFrame:
    """Even rows' targets are named, the others and all sources aren't."""
    edges = ex.select("seq", F.col("event_type").alias("src"), F.concat(F.col("seq").cast("string"), F.lit(" "), "url").alias("dst"))
    nodes = ex.select(F.concat(F.col("seq").cast("string"), F.lit(" "), "url").alias("id"), F.concat(F.when(F.col("seq") % 2 == 0, "n").otherwise(""), "url").alias("label"))
    return views.labelled(edges, nodes).select("seq", "src_label", "dst_label")


@query("s8_tab_events", f"""SELECT type, count(*) AS n, min(url) AS first_url, max(note) AS note FROM (
    SELECT 'nav' AS type, url, NULL AS note FROM ex WHERE seq % 4 = 0
    UNION ALL SELECT 'req-meta', url, NULL FROM ex WHERE seq % 4 = 1 AND NOT starts_with(url, 'chrome-extension://') AND seq % 9 <> 0
    UNION ALL SELECT 'res-meta', url, NULL FROM ex WHERE seq % 4 = 2
    UNION ALL SELECT 'diag', url, 'request error: ' || event_type FROM ex WHERE seq % 4 = 3) GROUP BY ALL""")
def tab_events(ex: DataFrame) -> DataFrame:
    part = lambda k: ex.where(F.col("seq") % 4 == k)
    requests = part(1).withColumn("tab_id", F.when(F.col("seq") % 9 == 0, -1).otherwise(1))
    found = capture.navigation_events(part(0).select("url"), requests.select("url", "method", "tab_id"), part(2).select("url", "status"), part(3).select("url", F.col("event_type").alias("error")))
    return found.groupBy("type").agg(F.count("*").alias("n"), F.min("url").alias("first_url"), F.max("note").alias("note"))


@query("s7_snapshot_units", """SELECT url AS resource_url, kind, text FROM (
    SELECT seq, url, 'dom-link' AS kind, '/a' || seq AS text FROM ex UNION ALL SELECT seq, url, 'dom-link', '/hidden' FROM ex WHERE seq % 2 = 0
    UNION ALL SELECT seq, url, 'script', event_type || '.js' FROM ex UNION ALL SELECT seq, url, 'iframe', 'https://f.example.com/' FROM ex WHERE seq % 3 = 0) WHERE seq % 5 <> 0""")
def snapshot_units(ex: DataFrame) -> DataFrame:
    """A row in five isn't JSON; closed shadow trees repeat a link of the page."""
    seq = F.col("seq")
    link = F.concat(F.lit("/a"), seq.cast("string"))
    frames = F.when(seq % 3 == 0, F.array(F.struct(F.lit("https://f.example.com/").alias("src"))))
    whole = F.to_json(F.struct("url", F.array(link).alias("links"), F.array(F.concat("event_type", F.lit(".js"))).alias("scripts"), frames.alias("iframes"), F.when(seq % 2 == 0, F.array(F.lit("/hidden"), link)).alias("shadowLinks")))
    found = capture.dom_snapshots(ex.select(F.when(seq % 5 == 0, "{broken").otherwise(whole).alias("batch")))
    return capture.snapshot_units(found).select("resource_url", "kind", "text")


@query("st9_frame_bodies", """SELECT url, count(*) AS frames, substr(string_agg(coalesce(resp_body, ''), '' ORDER BY seq), 1, 40) AS body FROM ex GROUP BY url""")
def frame_bodies(ex: DataFrame) -> DataFrame:
    return capture.frame_bodies(ex.select("url", "seq", F.col("resp_body").alias("payload")), 40).select("url", "frames", "body")


@query("d2_bytes", "SELECT seq, array_to_string(list_transform(string_split(event_type || 'é€Ā', ''), lambda c: printf('%02X', unicode(c) & 255)), '') AS octets FROM ex")
def octets(ex: DataFrame) -> DataFrame:
    return ex.select("seq", F.hex(text.bytes_view(F.concat("event_type", F.lit("é€Ā")))).alias("octets"))


@query("d15_module_routes", "SELECT 'm' || seq AS url, '/api/' || event_type AS route FROM ex")
def module_routes(ex: DataFrame) -> DataFrame:
    body = F.concat(F.unhex(F.lit("0061736D01000000")), F.encode(F.concat(F.lit("/api/"), "event_type"), "UTF-8"), F.unhex(F.lit("00")))
    return capture.module_routes(ex.select(F.concat(F.lit("m"), F.col("seq").cast("string")).alias("url"), body.alias("body")))


@query("e4_script_windows", """SELECT 's' || seq AS url, k AS "window", 1 + k * 5 AS base_line, least(110, 250 - k * 100) AS size FROM ex, range(3) AS g(k)""")
def script_windows(ex: DataFrame) -> DataFrame:
    """Scripts of 250 characters in windows of 100 with 10 of the next: every twentieth character ends a line."""
    body = F.repeat(F.concat(F.lpad(F.col("seq").cast("string"), 19, F.lit("x")), F.lit("\n")), 13)
    found = extract.script_windows(ex.select(F.concat(F.lit("s"), F.col("seq").cast("string")).alias("url"), F.substring(body, 1, 250).alias("body")), 100, 10)
    return found.select("url", F.col("window").cast("long").alias("window"), F.col("base_line").cast("long").alias("base_line"), F.length("body").cast("long").alias("size"))


@query("e7_framework_routes", """SELECT 'p' || seq AS url, '/_next/' || user_id || '/_buildManifest.js' AS manifests, '/' || event_type || ',/docs/a' AS next_pages, seq % 2 = 0 AS is_nuxt FROM ex""")
def framework_routes(ex: DataFrame) -> DataFrame:
    load = F.concat(F.lit('<script src="/_next/'), F.col("user_id").cast("string"), F.lit('/_buildManifest.js"></script><a href="/x">y</a>'))
    data = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"page":"/'), "event_type", F.lit('","/key":1,"q":["\\/docs\\/a","no","/'), "event_type", F.lit('"]}</script>'))
    html = F.concat(load, data, F.when(F.col("seq") % 2 == 0, "<script>window.__NUXT__={}</script>").otherwise(""))
    found = views.framework_routes(ex.select(F.concat(F.lit("p"), F.col("seq").cast("string")).alias("url"), html.alias("html")))
    return found.select("url", F.array_join("manifests", ",").alias("manifests"), F.array_join("next_pages", ",").alias("next_pages"), "is_nuxt")


ENCODED = "array_to_string(list_transform(string_split(link, ''), lambda c: CASE WHEN unicode(c) > 127 THEN url_encode(c) ELSE c END), '')"
ORIGIN = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))"
EDGES = f"SELECT DISTINCT src, dst FROM (SELECT regexp_extract(url, '^([^#]*)', 1) AS src, {ORIGIN} || {ENCODED} AS dst FROM ({LINKS})) WHERE src <> dst"


@page_query("d21_discovered_routes", f"SELECT DISTINCT url, {ENCODED} AS route FROM ({LINKS})")
def discovered_routes(pages: DataFrame) -> DataFrame:
    """All links of these pages begin with a slash."""
    return views.discovered_routes(pages)


@page_query("g2_resolved_edges", EDGES)
def resolved_edges(pages: DataFrame) -> DataFrame:
    return graph.page_edges(pages)


@page_query("g3_crawl_levels", f"""WITH RECURSIVE e AS ({EDGES}), v AS (SELECT DISTINCT regexp_extract(url, '^([^#]*)', 1) AS url, 0 AS depth FROM pages UNION SELECT dst, depth + 1 FROM v JOIN e ON v.url = e.src WHERE depth < 2)
    SELECT depth, count(*) AS n, min(url) AS first_url FROM (SELECT url, min(depth) AS depth FROM v GROUP BY url) GROUP BY ALL""")
def crawl_levels(pages: DataFrame) -> DataFrame:
    seeds = pages.select(F.regexp_extract("url", r"\A([^#]*)", 1).alias("url"))
    seen = graph.crawl(graph.page_edges(pages), seeds, depth=2, pages=None, per_page=None, same_host=False)
    return seen.groupBy("depth").agg(F.count("*").alias("n"), F.min("url").alias("first_url"))


def url_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With its tolerant leg; no SQL has that score, so a test compares it with a loop."""
    ex = exchanges(spark, sf_dir).select("url").distinct()
    return ex.where(views.found(F.col("url"), "usres")).select("url")


QUERIES["f8_tolerant_url_finder"] = url_finder
