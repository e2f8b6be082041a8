"""Tables mined from scripts and headers: call schemas, GraphQL, server actions, validators, manifests, cloud configs."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import unescape

_CALL = re.compile(r"\b(?:(fetch)|axios\.(get|post|put|delete|patch))\s*\(\s*([\"'`])([^\"'`]{2,200})\3\s*(,)?")
_METHOD = re.compile(r"\bmethod\s*:\s*[\"'`]([A-Za-z]+)[\"'`]")
_GQL = re.compile(r"\b(query|mutation|subscription)\s+([A-Za-z_]\w*)\s*(\([^)]*\))?\s*\{|\b(fragment)\s+([A-Za-z_]\w*)\s+on\s+\w+\s*\{")
_VARIABLE = re.compile(r"\$(\w+)\s*:\s*([\w\[\]!]+)")
_ACTIONS = (re.compile(r"createServerReference\)?\s*\(\s*[\"']([0-9a-f]{8,64})[\"']"), re.compile(r"\$\$ACTION_ID_([0-9a-f]{8,64})"), re.compile(r"[\"']next-action[\"']\s*:\s*[\"']([0-9a-f]{8,64})[\"']", re.I))
_OBJECT = re.compile(r"\b(z|yup|Yup)\s*\.\s*(?:strict)?[oO]bject\s*\((?:\s*\)\s*\.shape\s*\()?\s*\{")
_FIELD = re.compile(r"([A-Za-z_$][\w$]*)\s*:\s*(?:z|yup|Yup)\s*\.\s*([^,}]*(?:\([^)]*\)[^,}]*)*)")
_RELAY = re.compile(r"[\"']?(?:doc_id|params\.id|docId)[\"']?\s*[:=]\s*[\"'](\d{6,})[\"']")
_APOLLO = re.compile(r"sha256Hash[\"']?\s*:\s*[\"']([a-f0-9]{32,64})[\"']")
# Cloud configurations, as (provider, field, pattern).
CLOUD = (
    ("firebase", "apiKey", r"apiKey\s*:\s*[\"'](AIza[\w-]{20,})[\"']"),
    ("firebase", "projectId", r"projectId\s*:\s*[\"']([\w-]{3,60})[\"']"),
    ("firebase", "authDomain", r"authDomain\s*:\s*[\"']([\w.-]+\.firebaseapp\.com)[\"']"),
    ("supabase", "url", r"(https://[a-z0-9]{8,}\.supabase\.(?:co|in))"),
    ("supabase", "anonKey", r"createClient\([^)]*[\"'](eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{4,})[\"']"),
    ("sentry", "dsn", r"(https://[0-9a-f]{16,}(?::[0-9a-f]+)?@[\w.-]*sentry\.io/\d+)"),
)


def balanced(src: str, at: int, opens: str = "{", closes: str = "}") -> str:
    """From an opening bracket to its closing one, strings skipped; to the end where it is missing."""
    depth, i, quote = 0, at, ""
    while i < len(src):
        c = src[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c == opens:
            depth += 1
        elif c == closes:
            depth -= 1
            if depth == 0:
                return src[at : i + 1]
        i += 1
    return src[at:]


def top_keys(obj: str) -> list[str]:
    """Names at the first level of an object literal, also in short form."""
    flat, depth, at = [], 0, 0
    for m in re.finditer(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|[{}\[\]()]", obj):
        if depth == 1:
            flat.append(obj[at : m.start()])
        if m[0] in "{[(":
            depth += 1
        elif m[0] in "}])":
            depth -= 1
        elif depth == 1:
            flat.append(m[0][1:-1])
        at = m.end()
    members = "".join(flat).split(",")
    names = [x.partition(":")[0].strip() for x in members]
    return list(dict.fromkeys(n for n in names if re.fullmatch(r"[A-Za-z_$][\w$-]{0,60}", n)))


def api_calls(src: str) -> list[dict]:
    """fetch and axios calls: method, url, query parameters and body keys; one per METHOD:url."""
    out = {}
    for m in _CALL.finditer(src):
        method, options = (m[2] or "get").upper(), ""
        brace = src.find("{", m.end()) if m[5] else -1
        if brace >= 0 and not src[m.end() : brace].strip():
            options = balanced(src, brace)
        if m[1]:
            method = (_METHOD.search(options) or [None, "GET"])[1].upper()
        body = re.search(r"\b(?:body\s*:\s*(?:JSON\.stringify\s*\(\s*)?|data\s*:\s*)\{", options) if m[1] else None
        keys = top_keys(balanced(options, body.end() - 1)) if body else top_keys(options) if not m[1] and options else []
        params = [p.partition("=")[0] for p in m[4].partition("?")[2].split("&") if p.partition("=")[0]]
        out.setdefault(f"{method}:{m[4]}", {"method": method, "url": m[4], "params": params, "body_keys": keys})
    return list(out.values())


def graphql_operations(src: str) -> list[dict]:
    out = {}
    for m in _GQL.finditer(src):
        kind, name = (m[1], m[2]) if m[1] else (m[4], m[5])
        raw = src[m.start() : m.end() - 1] + balanced(src, m.end() - 1)
        variables = [f"{a}: {b}" for a, b in _VARIABLE.findall(m[3] or "")]
        out.setdefault(name, {"kind": kind, "name": name, "variables": variables, "raw": raw})
    return list(out.values())


def server_actions(src: str) -> list[dict]:
    return [{"id": i} for i in dict.fromkeys(m[1] for p in _ACTIONS for m in p.finditer(src))]


def validation_schemas(src: str) -> list[dict]:
    out = {}
    for m in _OBJECT.finditer(src):
        fields = {f[1]: f[2].strip() for f in _FIELD.finditer(balanced(src, m.end() - 1))}
        if fields:
            out.setdefault(",".join(sorted(fields)), {"library": "zod" if m[1] == "z" else "yup", "fields": [f"{k}: {v}" for k, v in fields.items()]})
    return list(out.values())


def persisted_queries(src: str) -> list[dict]:
    found = [("relay", m[1]) for m in _RELAY.finditer(src)] + [("apollo", m[1]) for m in _APOLLO.finditer(src)]
    return [{"client": c, "id": i} for c, i in dict.fromkeys(found)]


def build_manifest(src: str) -> list[dict]:
    """Routes and chunks named by build manifests: page maps, app chunks, flight segments, route objects."""
    routes: dict[str, None] = {}
    if re.search(r"__BUILD_MANIFEST|__SSG_MANIFEST|sortedPages|__NEXT_DATA__|segmentPath|app/|__remixManifest|routes", src):
        routes |= dict.fromkeys(m[1] for m in re.finditer(r"[\"'](/[\w\-.~/:\[\]]*)[\"']\s*:\s*\[", src))
        for name in ("sortedPages", "__SSG_MANIFEST", "new Set"):
            for m in re.finditer(re.escape(name) + r"[^\[]{0,40}\[", src):
                routes |= dict.fromkeys(re.findall(r"[\"'](/[\w\-.~/:\[\]]*)[\"']", balanced(src, m.end() - 1, "[", "]")))
        routes |= dict.fromkeys(m[1] for m in re.finditer(r"[\"']page[\"']\s*:\s*[\"'](/[^\"']*)[\"']", src))
        routes |= dict.fromkeys("/" + m[1] for m in re.finditer(r"\bapp/([\w\-/\[\]]+?)/(?:page|route|layout)(?:-[a-f0-9]+)?\.js", src))
        routes |= dict.fromkeys("/" + m[1] for m in re.finditer(r"segmentPath[\"'\\]*\s*:\s*\[[\s\"'\\]*children[\s\"'\\]*,[\s\"'\\]*([\w\-]+)", src))
        routes |= dict.fromkeys("/" + m[1].strip("/") for m in re.finditer(r"[\"']path[\"']\s*:\s*[\"']([^\"']+)[\"']", src))
    routes.pop("/_app", None)
    chunks = dict.fromkeys(m[1] for m in re.finditer(r"[\"']([^\"'\s]+\.js)[\"']", src))
    build = re.search(r"[\"']buildId[\"']\s*:\s*[\"']([\w\-]+)[\"']", src)
    return [{"routes": list(routes), "chunks": list(chunks), "build_id": build[1] if build else None}] if routes or build else []


def chunk_map(src: str) -> list[dict]:
    """Chunk file names from a bundler's id-to-hash table, or those that are spelled out."""
    names: dict[str, None] = {}
    for m in re.finditer(r"\.u\s*=\s*(?:function\s*\([^)]*\)\s*\{|\(?\w+\)?\s*=>)", src):
        brace = src.find("{", m.end())
        if 0 <= brace < m.end() + 200:
            names |= {f"{a or b}.{h}.js": None for a, b, h in re.findall(r"(?:(\d+)|[\"']([^\"']+)[\"'])\s*:\s*[\"']([\w\-]+)[\"']", balanced(src, brace))}
    if not names:
        names = dict.fromkeys(re.findall(r"[\"']([\w\-./]+?\.chunk\.js)[\"']", src))
    return [{"chunks": list(names)}] if names else []


def bundlers(src: str) -> list[dict]:
    turbopack = list(dict.fromkeys(re.findall(r"[\"'](\[project\]/[^\"']+|(?:static/chunks/)?\[turbopack\][^\"']*)[\"']", src)))
    remotes = list(dict.fromkeys(f"{n}@{u}" for n, u in re.findall(r"[\"']?(\w+)[\"']?\s*:\s*[\"']\w+@(https?://[^\"']+)[\"']", src)))
    vite = list(dict.fromkeys(m[1] for m in re.finditer(r"[\"']((?:\./|/)?assets/[\w.\-]+\.(?:js|css))[\"']", src) if "__vite__mapDeps" in src or "modulepreload" in src))
    workbox = list(dict.fromkeys(re.findall(r"\{\s*[\"']?(?:revision|url)[\"']?\s*:[^}]*?[\"']?url[\"']?\s*:\s*[\"']([^\"']+)[\"']", src))) if "precacheAndRoute" in src or "workbox" in src else []
    return [{"turbopack": turbopack, "remotes": remotes, "vite": vite, "workbox": workbox}] if turbopack or remotes or vite or workbox else []


def deobfuscate(src: str, passes: int = 3) -> str:
    """Adjacent literals joined, printable escapes decoded, inline atob() calls replaced by their text."""
    for _ in range(passes):
        joined = re.sub(r"([\"'])((?:(?!\1)[^\\\n])*)\1\s*\+\s*\1((?:(?!\1)[^\\\n])*)\1", r"\1\2\3\1", src)
        if joined == src:
            break
        src = joined

    def plain(m: re.Match) -> str:
        c = unescape(m[0])
        return c if c.isprintable() and c not in "\"'\\`" else m[0]

    def atob(m: re.Match) -> str:
        try:
            text = base64.b64decode(m[2] + "=" * (-len(m[2]) % 4)).decode("latin-1")
        except (binascii.Error, ValueError):
            return m[0]
        return f'"{text}"' if text.isprintable() and '"' not in text else m[0]

    src = re.sub(r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}", plain, src)
    return re.sub(r"\batob\s*\(\s*([\"'])([A-Za-z0-9+/=]{4,})\1\s*\)", atob, src)


def _miner(run: Callable[[str], list[dict]], schema: str) -> Callable[..., DataFrame]:
    def mine(scripts: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
        names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = [(u, *[x[n] for n in names]) for u, b in zip(part.url, part.body, strict=True) for x in run(b or "")]
                yield pd.DataFrame(rows, columns=["resource_url", *names])

        return scripts.select(F.col(url).alias("url"), F.col(body).alias("body")).mapInPandas(batches, f"resource_url string, {schema}")

    mine.__doc__ = f"{run.__name__} of script bodies, a row each: {schema}"
    return mine


api_call_table = _miner(api_calls, "method string, url string, params array<string>, body_keys array<string>")
graphql_table = _miner(graphql_operations, "kind string, name string, variables array<string>, raw string")
server_action_table = _miner(server_actions, "id string")
validation_table = _miner(validation_schemas, "library string, fields array<string>")
persisted_table = _miner(persisted_queries, "client string, id string")
manifest_table = _miner(build_manifest, "routes array<string>, chunks array<string>, build_id string")
chunk_table = _miner(chunk_map, "chunks array<string>")
bundler_table = _miner(bundlers, "turbopack array<string>, remotes array<string>, vite array<string>, workbox array<string>")


def cloud_configs(scripts: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """(resource_url, provider, config map) of configurations in scripts, by built-in expressions."""
    out = []
    for provider in dict.fromkeys(c[0] for c in CLOUD):
        own = [(f, p) for who, f, p in CLOUD if who == provider]
        config = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f, _ in own]), F.array(*[F.regexp_extract(body, p, 1) for _, p in own])), lambda k, v: v != "")
        out.append(F.struct(F.lit(provider).alias("provider"), config.alias("config")))
    found = scripts.select(F.col(url).alias("resource_url"), F.explode(F.array(*out)).alias("c"))
    return found.select("resource_url", "c.provider", "c.config").where(F.size("config") > 0)


def graphql_registry(operations: DataFrame) -> DataFrame:
    """One text of all operations by name, each with a comment of its variables."""
    own = F.concat(F.lit("# "), F.concat_ws(" ", "kind", "name"), F.when(F.size("variables") > 0, F.concat(F.lit(" ("), F.concat_ws(", ", "variables"), F.lit(")"))).otherwise(""), F.lit("\n"), F.col("raw"))
    first = operations.groupBy("name").agg(F.min(own).alias("text"))
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "text"))), lambda x: x["text"]), "\n\n").alias("registry"))
