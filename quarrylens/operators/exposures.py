"""Findings from observed resources, routes, URLs, parameters and headers: exposures, hygiene, CSP, frameworks, clouds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

# Patterns of the exposure rules.
AUTH_IN_URL = r"(?i)(token|api_?key|sessionid|auth|access_token|secret|password)"
INTERESTING_PARAM = r"(?i)\A(redirect|redirect_uri|debug|url|next|return|returnto|callback|file|path|dest|destination)\z"
SENSITIVE_ROUTE = r"(?i)/(debug|admin|console|internal|actuator|phpmyadmin|wp-admin|server-status)"
INTERNAL_HOST = r"localhost|\A127\.|\A10\.|\A192\.168\.|\A172\.(1[6-9]|2\d|3[01])\.|\.local\z|\.test\z|\.invalid\z|staging|internal|dev\.|\.dev\z"
COLUMNS = ("rule", "sev", "label", "text", "url", "route", "kind")


def finding(rule: str, sev: str, label: str, text: Column, url: Column | None = None, route: Column | None = None, kind: str = "url") -> list[Column]:
    blank = F.lit("")
    values = (F.lit(rule), F.lit(sev), F.lit(label), text, blank if url is None else url, blank if route is None else route, F.lit(kind))
    return [v.cast("string").alias(name) for v, name in zip(values, COLUMNS, strict=True)]


def source_maps(resources: DataFrame) -> DataFrame:
    return resources.where("has_source_map").select(*finding("expo-sourcemap", "high", "Exposed source map (original source leak)", urls.filename_of(F.col("url")), F.col("url"), kind="source-map"))


def sensitive_routes(routes: DataFrame) -> DataFrame:
    return routes.where(F.col("route").rlike(SENSITIVE_ROUTE)).select(*finding("expo-sensitive-endpoint", "high", "Sensitive endpoint exposed", F.col("route"), route=F.col("route"), kind="route"))


def auth_in_url(observed: DataFrame) -> DataFrame:
    pairs = F.filter(F.split(urls.query_of(F.col("url")), "&"), lambda p: F.substring_index(p, "=", 1).rlike(AUTH_IN_URL))
    hit = observed.withColumn("__p", F.get(pairs, F.lit(0))).where(F.col("__p").isNotNull())
    return hit.select(*finding("expo-auth-in-url", "high", "Auth material in URL", F.substring("__p", 1, 120), F.col("url")))


def interesting_params(params: DataFrame) -> DataFrame:
    return params.where(F.col("param").rlike(INTERESTING_PARAM)).select(*finding("expo-param", "medium", "Interesting parameter (redirect/debug/file?)", F.col("param"), kind="param"))


def internal_hosts(observed: DataFrame) -> DataFrame:
    """Once per host, with its least URL."""
    hosts = observed.select(urls.host_of(F.col("url")).alias("host"), "url").where("host <> ''").where(F.col("host").rlike(INTERNAL_HOST))
    return hosts.groupBy("host").agg(F.min("url").alias("url")).select(*finding("expo-internal-domain", "medium", "Internal/staging domain", F.col("host"), F.col("url")))


def _header(headers: str, name: str) -> Column:
    """Value of a header whatever its case, null if absent."""
    return F.get(F.map_values(F.map_filter(F.coalesce(F.col(headers), F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k) == name)), F.lit(0))


def hygiene(responses: DataFrame) -> DataFrame:
    """Header audit of responses (url, mime, headers map), once per rule and host; a design of our own with the four known rules and more."""
    h = lambda name: _header("headers", name)
    html, secure = F.coalesce(F.col("mime"), F.lit("")).contains("html"), F.col("url").startswith("https:")
    csp, cookie = h("content-security-policy"), h("set-cookie")
    cors = (F.lower(h("access-control-allow-credentials")) == "true") & h("access-control-allow-origin").rlike(r"\A(\*|null)\z|://")
    framed = h("x-frame-options").isNull() & ~F.coalesce(csp.contains("frame-ancestors"), F.lit(False))
    rules = (
        ("hyg-csp-missing", "medium", "No Content-Security-Policy", html & csp.isNull(), urls.host_of(F.col("url"))),
        ("hyg-csp-weak", "medium", "Content-Security-Policy allows unsafe scripts", csp.rlike(r"'unsafe-(inline|eval)'|script-src[^;]*\s\*"), csp),
        ("hyg-clickjacking", "medium", "Page can be framed", html & framed, urls.host_of(F.col("url"))),
        ("hyg-hsts-missing", "medium", "No Strict-Transport-Security", html & secure & h("strict-transport-security").isNull(), urls.host_of(F.col("url"))),
        ("hyg-cors-creds", "high", "CORS with credentials", cors, h("access-control-allow-origin")),
        ("hyg-cookie-httponly", "medium", "Cookie without HttpOnly", cookie.isNotNull() & ~F.lower(cookie).contains("httponly"), F.substring_index(cookie, "=", 1)),
        ("hyg-cookie-secure", "medium", "Cookie without Secure", cookie.isNotNull() & secure & ~F.lower(cookie).rlike(r";\s*secure"), F.substring_index(cookie, "=", 1)),
        ("hyg-server-disclosure", "info", "Server names its version", F.coalesce(h("server"), h("x-powered-by")).rlike(r"[0-9]+\.[0-9]"), F.coalesce(h("server"), h("x-powered-by"))),
    )
    made = [F.when(F.coalesce(test, F.lit(False)), F.struct(*finding(rule, sev, label, F.substring(text, 1, 120), F.col("url"), kind="header"))) for rule, sev, label, test, text in rules]
    rows = responses.select(F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("f")).select("f.*")
    first = Window.partitionBy("rule", "__host").orderBy("url", "text")
    return rows.withColumn("__host", urls.host_of(F.col("url"))).withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*COLUMNS)


# Fixed values: (rule, label, severity, pattern of a URL, header that names it or empty, pattern of its value).
FRAMEWORKS = (
    ("fw-nextjs", "Next.js", "info", r"/_next/", "x-powered-by", r"(?i)next\.js"),
    ("fw-wordpress", "WordPress", "info", r"/wp-(content|includes|json|admin)(/|\z)", "link", r"api\.w\.org"),
    ("fw-drupal", "Drupal", "info", r"/sites/(default|all)/|/core/misc/drupal", "x-generator", r"(?i)drupal"),
    ("fw-nuxt", "Nuxt", "info", r"/_nuxt/", "", ""),
    ("fw-sveltekit", "SvelteKit", "info", r"/_app/immutable/", "", ""),
    ("fw-astro", "Astro", "info", r"/_astro/", "", ""),
    ("fw-laravel", "Laravel", "info", r"/vendor/laravel|/livewire/", "set-cookie", r"laravel_session|XSRF-TOKEN"),
    ("fw-vite", "Vite", "info", r"/@vite/|/assets/[\w.-]+-[A-Za-z0-9_-]{8}\.(js|css)", "", ""),
    ("fw-webpack", "webpack", "info", r"webpack|\.chunk\.js|/runtime[.~-][\w.-]*\.js", "", ""),
    ("fw-django", "Django", "info", r"/static/admin/|/__debug__/", "set-cookie", r"csrftoken="),
    ("fw-rails", "Rails", "info", r"/rails/active_storage/|/packs/js/", "x-runtime", r"\A\d+\.\d+\z"),
    ("fw-firebase", "Firebase", "info", r"firebaseio\.com|firebaseapp\.com|firestore\.googleapis\.com", "", ""),
    ("fw-supabase", "Supabase", "info", r"\.supabase\.(co|in)/", "", ""),
    ("fw-stripe", "Stripe", "info", r"js\.stripe\.com|api\.stripe\.com", "", ""),
    ("fw-algolia", "Algolia", "info", r"\.algolia(net)?\.(com|net)", "", ""),
    ("fw-sanity", "Sanity", "info", r"\.sanity\.io|cdn\.sanity", "", ""),
    ("fw-contentful", "Contentful", "info", r"\.contentful\.com|ctfassets\.net", "", ""),
)
VERSION = r"[?&]ver=([0-9]+(?:\.[0-9]+)+)"


def frameworks(observed: DataFrame) -> DataFrame:
    """One finding per rule and host from (url, headers, req_headers): the least evidence; a version only where it is stated.

    ``fw-cve-next-flight`` marks server-action or flight requests together with Next.js evidence on a host.
    """
    h = lambda name: _header("headers", name)
    made = []
    for rule, label, sev, pattern, header, value in FRAMEWORKS:
        by_url = F.col("url").rlike(pattern)
        test = by_url | F.coalesce(h(header).rlike(value), F.lit(False)) if header else by_url
        made.append(F.when(test, F.struct(*finding(rule, sev, label, F.col("url"), F.col("url"), kind="framework"))))
    names = F.transform(F.map_keys(F.coalesce("req_headers", F.create_map().cast("map<string,string>"))), F.lower)
    flight = F.arrays_overlap(names, F.array(F.lit("next-action"), F.lit("rsc"))) | F.coalesce(h("content-type").contains("text/x-component"), F.lit(False))
    made.append(F.when(flight, F.struct(*finding("fw-cve-next-flight", "medium", "Next.js flight protocol exposed: check the version for known holes", F.col("url"), F.col("url"), kind="framework"))))
    generator = F.coalesce(F.regexp_extract(h("x-generator"), r"([0-9]+(?:\.[0-9]+)*)", 1), F.lit(""))
    version = F.coalesce(F.nullif(F.regexp_extract("url", VERSION, 1), F.lit("")), F.nullif(generator, F.lit("")))
    rows = observed.select(version.alias("version"), F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("f")).select("f.*", "version", urls.host_of(F.col("url")).alias("host"))
    grouped = rows.groupBy("rule", "sev", "label", "kind", "host").agg(F.min("url").alias("url"), F.max("version").alias("version"))
    return grouped.select("rule", "sev", F.concat_ws(" ", "label", "version").alias("label"), F.col("url").alias("text"), "url", F.lit("").alias("route"), "kind")


def csp_directives(csp: Column) -> Column:
    """Map of directive to its sources; the first of a repeated directive counts."""
    parts = F.filter(F.transform(F.split(csp, ";"), lambda d: F.split(F.trim(d), r"\s+")), lambda d: F.get(d, F.lit(0)) != "")
    names = F.transform(parts, lambda d: F.lower(d[0]))
    first = F.filter(parts, lambda d, i: F.array_position(names, F.lower(d[0])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda d: F.struct(F.lower(d[0]), F.slice(d, 2, F.size(d)))))


def csp_domains(csp: Column) -> Column:
    """Struct of sorted domains, internal ones and cloud buckets that a policy names."""
    words = F.flatten(F.map_values(csp_directives(csp)))
    hosts = F.transform(F.filter(words, lambda w: w.rlike(r"\A(?:[a-z+.-]+://)?[^'/:]*(?:[A-Za-z0-9-]\.[A-Za-z]|localhost|\A[0-9.]+)")), lambda w: F.lower(F.regexp_extract(w, r"\A(?:[A-Za-z+.-]+://)?(?:\*\.)?([^/:]+)", 1)))
    hosts = F.array_sort(F.array_distinct(hosts))
    internal = F.filter(hosts, lambda x: x.rlike(INTERNAL_HOST + r"|\.corp\z|\.intranet\z"))
    buckets = F.filter(hosts, lambda x: x.rlike(r"\.s3[.-]|\.s3\z|storage\.googleapis\.com|\.blob\.core\.windows\.net|\.digitaloceanspaces\.com"))
    return F.struct(hosts.alias("domains"), internal.alias("internal"), buckets.alias("buckets"))


def csp_findings(responses: DataFrame) -> DataFrame:
    d = responses.select("url", csp_domains(_header("headers", "content-security-policy")).alias("d"))
    internal = d.select(F.explode("d.internal").alias("h"), "url").groupBy("h").agg(F.min("url").alias("url")).select(*finding("csp-internal-domain", "medium", "Internal domain in CSP", F.col("h"), F.col("url"), kind="csp-domain"))
    buckets = d.select(F.explode("d.buckets").alias("h"), "url").groupBy("h").agg(F.min("url").alias("url")).select(*finding("csp-cloud-bucket", "info", "Cloud bucket in CSP", F.col("h"), F.col("url"), kind="csp-domain"))
    return internal.unionByName(buckets)


def page_runtime(batches: DataFrame) -> DataFrame:
    """Findings of what pages report while they run.

    batches: (url, route, tokens array<struct<param,token,url>>, crypto array<struct<op,algo,preview>>, listeners
    array<struct<preview,has_origin_check>>). A token in a URL is critical, a preview of eight characters or more of
    what a page encrypts is high, a message listener that doesn't check its sender is medium.
    """

    def rows(items: str, test: Column, rule: str, sev: str, label: Column, text: Column, url: Column, kind: str) -> DataFrame:
        named = (F.lit(rule), F.lit(sev), label, text, url, F.col("route"), F.lit(kind))
        return batches.select("url", "route", F.explode(items).alias("x")).where(test).select(*[c.cast("string").alias(n) for c, n in zip(named, COLUMNS, strict=True)])

    x = F.col("x")
    tokens = rows("tokens", F.lit(True), "ephemeral-oauth-token", "critical", F.concat(F.lit("Ephemeral OAuth Token ("), x["param"], F.lit(")")), F.concat_ws("=", x["param"], x["token"]), x["url"], "route")
    named = F.concat_ws(" ", x["op"], x["algo"])
    crypto = rows("crypto", F.length(x["preview"]) >= 8, "crypto-cleartext-or-key", "high", F.concat(F.lit("Crypto Tap ("), named, F.lit(")")), F.concat(F.lit("["), named, F.lit("] "), x["preview"]), F.col("url"), "document")
    heard = rows("listeners", ~F.coalesce(x["has_origin_check"], F.lit(False)), "postmessage-no-origin-check", "medium", F.lit("postMessage Listener Missing Origin Check"), x["preview"], F.col("url"), "document")
    return tokens.unionByName(crypto).unionByName(heard)


def cloud_findings(configs: DataFrame) -> DataFrame:
    """One finding for each configuration of (resource_url, provider, config map)."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("config")), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    text = F.concat(F.lit("["), F.col("provider"), F.lit("] "), shown)
    named = (F.concat(F.lit("cloud-config-"), F.col("provider")), F.lit("medium"), F.concat(F.lit("Cloud BaaS Config ("), F.upper("provider"), F.lit(")")), text, F.col("resource_url"), F.lit(""), F.lit("script"))
    return configs.select(*[c.cast("string").alias(n) for c, n in zip(named, COLUMNS, strict=True)])


def merge(*families: DataFrame, most: int | None = None) -> DataFrame:
    """Union of finding families, one of each rule, text and url; most severe first."""
    from .tables import severity_rank

    out = reduce(DataFrame.unionByName, families).dropDuplicates(["rule", "text", "url"])
    out = out.orderBy(severity_rank(F.col("sev")), "rule", "url", "text")
    return out if most is None else out.limit(most)
