"""Capture tables: resources from files, exchange normalisation, body gates and decoding, rules, derived tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..functions.decode import map_candidates
from ..functions.text import ascii_lower

# Types and extensions whose bodies are kept as metadata only.
BINARY_MIME = r"(?i)\A(image|audio|video|font)/|octet-stream|wasm|zip|gzip|pdf"
BINARY_NAME = r"(?i)\.(png|jpe?g|gif|webp|avif|ico|mp4|webm|mp3|wav|woff2?|ttf|otf|eot|wasm|zip|gz|pdf)(\?|#|\z)"
# Scopes of a search and the resource kinds they hold.
SCOPES = {
    "documents": ("document",),
    "dom": ("dom",),
    "scripts": ("script",),
    "chunks": ("chunk",),
    "styles": ("stylesheet",),
    "maps": ("source-map",),
    "manifests": ("manifest",),
    "frames": ("frame",),
    "requests": ("xhr", "fetch"),
    "api": ("api-json", "api-text"),
    "media": ("media-meta", "font-meta"),
    "text": ("other-text",),
    "routes": ("route", "url"),
    "headers": ("header",),
}
# What a capture toggle admits.
TOGGLES = {"dom": ("document", "dom", "frame"), "js": ("script", "chunk", "source-map"), "css": ("stylesheet",), "json": ("api-json", "api-text", "manifest", "xhr", "fetch")}
# Kinds of debugger targets.
TARGETS = {"page": "page", "iframe": "iframe", "worker": "worker", "shared_worker": "worker", "service_worker": "serviceworker"}


def read_resources(spark: SparkSession, path: str, base: str = "", glob: str | None = None) -> DataFrame:
    """(url, kind, size, ts, body) of files, kinds by name; bodies that aren't text are null."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    url = F.concat(F.lit(base), F.element_at(F.split("path", "/"), -1)) if base else F.col("path")
    text = F.when(~F.col("path").rlike(BINARY_NAME), F.col("content").cast("string"))
    return files.select(url.alias("url"), urls.resource_kind(F.col("path"), F.lit("")).alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("ts"), text.alias("body"))


def scoped(df: DataFrame, scope: dict[str, bool], kind: str = "resource_kind") -> DataFrame:
    """Rows of the kinds whose scope isn't switched off."""
    out = [k for name, kinds in SCOPES.items() if scope.get(name, True) for k in kinds]
    return df.where(F.col(kind).isin(out))


def capture_allowed(kind: Column, toggles: dict[str, bool]) -> Column:
    """Kinds without a toggle are always admitted."""
    shut = [k for name, kinds in TOGGLES.items() if not toggles.get(name, True) for k in kinds]
    return ~kind.isin(shut) if shut else F.lit(True)


def body_wanted(url: Column, mime: Column, retain: bool = True, binary: bool = False) -> Column:
    opaque = F.coalesce(mime, F.lit("")).rlike(BINARY_MIME) | url.rlike(BINARY_NAME)
    return F.lit(retain) & url.rlike(r"\Ahttps?://") & (F.lit(binary) | ~opaque)


def decoded_body(body: Column, is_base64: Column, most: int = 1 << 20) -> Column:
    """Text of a body, cut at ``most`` characters; null for base64 that can't be read."""
    plain = F.when(is_base64, F.try_to_binary(body, F.lit("base64")).cast("string")).otherwise(body)
    return F.substring(plain, 1, most)


def normalized_exchanges(raw: DataFrame) -> DataFrame:
    """Exchanges without those of extensions, tools and data URLs, methods in upper case, opaque bodies left out."""
    kept = raw.where(~F.col("url").rlike(r"(?i)\A(data|blob|chrome|chrome-extension|devtools|about):"))
    body = F.when(body_wanted(F.col("url"), F.col("mime")), F.col("resp_body"))
    return kept.withColumn("method", F.upper(F.coalesce(F.nullif("method", F.lit("")), F.lit("GET")))).withColumn("resp_body", body).withColumn("req_body", F.substring("req_body", 1, 2000))


def changed_only(bodies: DataFrame, known: DataFrame) -> DataFrame:
    """Bodies (url, body) whose content differs from the last known hash (url, hash) of their URL."""
    hashed = bodies.withColumn("hash", F.xxhash64("body"))
    return hashed.join(known.select("url", "hash"), ["url", "hash"], "left_anti")


def with_initiator(exchanges: DataFrame, initiators: DataFrame) -> DataFrame:
    """Exchanges with the initiator of their URL, the first by ``seq``, null if none is known."""
    first = initiators.groupBy("url").agg(F.min_by("initiator", "seq").alias("initiator"))
    return exchanges.join(first, "url", "left")


def with_body(exchanges: DataFrame, bodies: DataFrame) -> DataFrame:
    """Exchanges with the newest body (url, body, ingest_seq) of their URL."""
    newest = bodies.groupBy("url").agg(F.max_by("body", "ingest_seq").alias("body"))
    return exchanges.join(newest, "url", "left")


def worker_kind(target: Column, has_parent: Column) -> Column:
    out = F.lit("unknown")
    for name, kind in TARGETS.items():
        out = F.when(target == name, kind).otherwise(out)
    return F.when((out == "page") & has_parent, "iframe").otherwise(out)


def with_worker(exchanges: DataFrame, targets: DataFrame) -> DataFrame:
    """Exchanges (target_id) with the kind of the worker that made them, from (target_id, type, parent_id)."""
    kinds = targets.select("target_id", worker_kind(F.col("type"), F.col("parent_id").isNotNull()).alias("worker_kind"))
    return exchanges.join(kinds, "target_id", "left").withColumn("worker_kind", F.coalesce("worker_kind", F.lit("unknown")))


def first_rule(exchanges: DataFrame, rules: list[dict]) -> DataFrame:
    """Exchanges with ``rule_id`` and ``rule_kind`` of the first rule that fits, null if none.

    A rule has id, kind, match, use_regex, method (ANY for all) and enabled; a pattern that isn't valid fits nothing.
    Rules are a list written by hand, so they are compiled into one expression, not joined.
    """
    from ..operators.search import valid_pattern

    rule, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed([r for r in rules if r.get("enabled", True)]):
        if r.get("use_regex"):
            test = F.col("url").rlike(f"(?i){r['match']}") if valid_pattern(exchanges, r["match"]) else F.lit(False)
        else:
            test = ascii_lower(F.col("url")).contains(r["match"].lower()) if r["match"] else F.lit(False)
        if r.get("method", "ANY").upper() != "ANY":
            test = test & (F.upper("method") == r["method"].upper())
        rule, kind = F.when(test, r["id"]).otherwise(rule), F.when(test, r["kind"]).otherwise(kind)
    return exchanges.withColumn("rule_id", rule).withColumn("rule_kind", kind)


def source_files(maps: DataFrame) -> DataFrame:
    """(map_url, path, content) of source maps (url, body) that carry their sources, by built-in expressions."""
    shape = F.from_json(F.regexp_replace("body", r"\A\)\]\}'", ""), "struct<sources:array<string>,sourcesContent:array<string>>")
    pairs = maps.select(F.col("url").alias("map_url"), shape.alias("m"))
    rows = pairs.select("map_url", F.explode(F.arrays_zip(F.col("m.sources").alias("path"), F.col("m.sourcesContent").alias("content"))).alias("f"))
    return rows.select("map_url", "f.path", "f.content").where((F.length("content") > 10) & F.col("path").isNotNull())


def unmapped_scripts(resources: DataFrame) -> DataFrame:
    """(url, candidate): where the map of a script without one may lie, without those that are known resources."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def guesses(url: pd.Series) -> pd.Series:
        return url.map(map_candidates)

    bare = resources.where(F.col("kind").isin("script", "chunk") & ~F.coalesce("has_source_map", F.lit(False))).select("url")
    found = bare.select("url", F.explode(guesses("url")).alias("candidate"))
    return found.join(resources.select(F.col("url").alias("candidate")), "candidate", "left_anti").select("url", "candidate")


def harvested_findings(tokens: DataFrame) -> DataFrame:
    """Secret findings of harvested values (key, val, source)."""
    from ..operators import secrets

    return secrets.scan(tokens.withColumnRenamed("val", "text"), most=1).withColumnRenamed("text", "val")


def endpoint_detail(exchanges: DataFrame, schemas: DataFrame) -> DataFrame:
    """Per URL: badges, template, headers, JSON keys, and the mined call schema whose URL it equals, contains or is contained in.

    Schemas are keyed by the last path segment, so the containment test runs only between URLs that share it.
    """
    from ..operators import api

    last = lambda c: F.element_at(F.split(F.regexp_replace(urls.path_of(c), r"/+\z", ""), "/"), -1)
    e = exchanges.withColumn("key", last(F.col("url"))).alias("e")
    s = schemas.select(F.col("url").alias("schema_url"), F.col("method").alias("schema_method"), "params", "body_keys").withColumn("key", last(F.col("schema_url"))).alias("s")
    fits = (F.col("e.key") == F.col("s.key")) & (F.col("e.url").contains(F.col("s.schema_url")) | F.col("s.schema_url").contains(F.col("e.url")))
    joined = e.join(s, fits, "left").select("e.*", "s.schema_url", "s.schema_method", "s.params", "s.body_keys")
    w = Window.partitionBy("seq").orderBy((F.col("url") != F.col("schema_url")), F.desc(F.length("schema_url")))
    best = joined.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "key")
    auth = F.exists(F.map_keys("req_headers"), lambda k: F.lower(k) == "authorization")
    cookie = F.exists(F.map_keys("req_headers"), lambda k: F.lower(k) == "cookie")
    badges = F.concat_ws(" ", F.when(auth, "auth"), F.when(cookie, "cookie"), F.when(F.col("status") >= 400, "error"))
    detail = best.withColumn("badges", badges).withColumn("template", urls.template_openapi(urls.path_of(F.col("url"))))
    return api.key_diff(detail, "resp_body", "req_body")


def replay_template(body_keys: Column) -> Column:
    """JSON body with an empty text for each mined key."""
    return F.to_json(F.map_from_arrays(body_keys, F.transform(body_keys, lambda k: F.lit(""))))


def framework_names(findings: DataFrame, observed: DataFrame) -> DataFrame:
    """Sorted names of frameworks from findings and from what URLs say."""
    # Parts of URLs and what they stand for.
    parts = (("/_next/", "Next.js"), ("/_nuxt/", "Nuxt"), ("/wp-content/", "WordPress"), ("/_app/immutable/", "SvelteKit"), ("/_astro/", "Astro"), ("react", "React"), ("vue", "Vue"), ("angular", "Angular"), ("svelte", "Svelte"), ("jquery", "jQuery"), ("graphql", "GraphQL"))
    named = F.array_compact(F.array(*[F.when(F.lower("url").contains(p), n) for p, n in parts]))
    seen = observed.select(F.explode(named).alias("name"))
    stated = findings.where(F.col("rule").startswith("fw-") & ~F.col("rule").startswith("fw-cve")).select(F.regexp_replace("label", r" [0-9.]+\z", "").alias("name"))
    return seen.unionByName(stated).distinct().orderBy("name")


NAVIGATION = "type string, kind string, id string, url string, method string, status int, frame_id long, note string, ts timestamp"


def navigation_events(navigations: DataFrame, requests: DataFrame, responses: DataFrame, errors: DataFrame) -> DataFrame:
    """One table or stream of what a tab does: committed, in-page and completed navigations, requests, answers, errors.

    Missing columns are null; requests of extensions and of the developer tools are left out, as are those without a tab
    (a negative ``tab_id``), where there is one. An error's text is its note.
    """
    names = [c.split(" ") for c in NAVIGATION.split(", ")]

    def of(df: DataFrame, kind: str) -> DataFrame:
        if kind == "req-meta":
            df = df.where(~F.col("url").rlike(r"\A(chrome-extension|devtools)://"))
            df = df.where("tab_id >= 0") if "tab_id" in df.columns else df
        own = df.withColumn("type", F.lit(kind))
        own = own.withColumn("note", F.concat(F.lit("request error: "), "error")) if kind == "diag" else own
        return own.select(*[(F.col(c) if c in own.columns else F.lit(None)).cast(t).alias(c) for c, t in names])

    parts = [of(navigations, "nav"), of(requests, "req-meta"), of(responses, "res-meta"), of(errors, "diag")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


SNAPSHOT = "url string, route string, htmlLen long, links array<string>, scripts array<string>, forms array<string>, iframes array<struct<src:string>>, routes array<string>, manifest string, chunks array<string>, apis array<string>, textSample string, shadowLinks array<string>, ts long"


def dom_snapshots(batches: DataFrame, batch: str = "batch") -> DataFrame:
    """Columns of page snapshots that come as JSON texts; what can't be read has no row. Works on streams."""
    parsed = batches.select(F.from_json(batch, SNAPSHOT).alias("s")).where("s.url is not null")
    return parsed.select("s.*")


def snapshot_units(snapshots: DataFrame) -> DataFrame:
    """(resource_url, ord, kind, text): links, also of closed shadow trees, scripts, frames, forms, routes, chunks, endpoints of snapshots."""
    none = F.array().cast("array<string>")
    of = lambda kind, c: F.transform(F.coalesce(c, none), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))
    frames = F.transform("iframes", lambda x: x["src"])
    links = F.array_distinct(F.concat(F.coalesce("links", none), F.coalesce("shadowLinks", none)))
    parts = [of("dom-link", links), of("script", F.col("scripts")), of("iframe", frames), of("form", F.col("forms")), of("route", F.col("routes")), of("chunk", F.col("chunks")), of("endpoint", F.col("apis"))]
    out = snapshots.select(F.col("url").alias("resource_url"), F.posexplode(F.flatten(F.array(*parts))).alias("ord", "u"))
    return out.select("resource_url", "ord", "u.kind", "u.text").where(F.length("text") > 0)


def frame_bodies(frames: DataFrame, most: int | None = 32_768) -> DataFrame:
    """(url, frames, chars, body) of socket frames (url, seq, payload): payloads in order, to ``most`` characters a URL."""
    size = F.length(F.coalesce("payload", F.lit("")))
    w = Window.partitionBy("url").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = frames.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0)))
    room = F.lit(None).cast("long") if most is None else F.greatest(F.lit(most) - F.col("before"), F.lit(0))
    part = F.coalesce(F.col("payload") if most is None else F.substring(F.col("payload"), F.lit(1), room.cast("int")), F.lit(""))
    held = F.array_sort(F.collect_list(F.when(F.length(part) > 0, F.struct("seq", part.alias("part")))))
    out = placed.groupBy("url").agg(F.count("*").alias("frames"), held.alias("held"))
    body = F.array_join(F.transform("held", lambda x: x["part"]), "")
    return out.select("url", "frames", F.length(body).alias("chars"), body.alias("body"))


def module_routes(modules: DataFrame) -> DataFrame:
    """(url, route) of endpoints that WebAssembly modules (url, body) name."""
    from ..functions import decode

    found = F.from_json(decode.wasm_json(F.col("body")), "endpoints array<string>")["endpoints"]
    return modules.select("url", F.explode(found).alias("route")).distinct()
