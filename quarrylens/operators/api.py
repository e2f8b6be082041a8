"""API inventory: called against declared or found endpoints, evidence per template, OpenAPI, schemas of samples."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from .tables import called_endpoints


def api_like(df: DataFrame) -> Column:
    """JSON by type, another API kind, a write with a body, or a body that parses as JSON; the parse comes last."""
    mime, body = F.coalesce("mime", F.lit("")), F.coalesce("resp_body", F.lit(""))
    kind = urls.api_kind(F.col("url"), F.col("mime"), F.substring(body, 1, 300))
    write = F.upper(F.coalesce("method", F.lit("GET"))).isin("POST", "PUT", "PATCH", "DELETE") & (F.length(F.coalesce("req_body", F.lit(""))) > 0)
    sniff = body.rlike(r"\A\s*[\[{]") & F.try_parse_json(body).isNotNull()
    return mime.contains("json") | (kind != "Other") | write | sniff


def call_keys(url: Column) -> Column:
    """Forms by which a route may match a call: url, path with query, path, each with and without a last slash."""
    path, query = urls.path_of(url), urls.query_of(url)
    full = F.when(query != "", F.concat(path, F.lit("?"), query)).otherwise(path)
    bare = F.when(F.length(path) > 1, F.regexp_replace(path, r"/+\z", "")).otherwise(path)
    return F.array_distinct(F.array(url, full, path, bare, F.concat(bare, F.lit("/"))))


def uncalled(routes: DataFrame, exchanges: DataFrame, pattern: str | None = urls.API_ROUTE) -> DataFrame:
    """Routes (route, ...) that look like APIs and that no exchange called: a left anti join on the forms of a call."""
    called = exchanges.select(F.explode(call_keys(F.col("url"))).alias("route")).distinct()
    wanted = routes if pattern is None else routes.where(F.col("route").rlike(pattern))
    return wanted.join(called, "route", "left_anti").dropDuplicates(["route"])


def inventory(exchanges: DataFrame, routes: DataFrame) -> DataFrame:
    """method, url, kind, detail: called API endpoints with their calls, then those only seen in code."""
    called = called_endpoints(exchanges.where(api_like(exchanges)))
    mime = F.lit(None).cast("string")
    seen = called.select("method", "url", urls.api_kind(F.col("url"), mime, F.substring("sample", 1, 300)).alias("kind"), F.concat(F.lit("called ×"), F.col("calls").cast("string")).alias("detail"))
    quiet = uncalled(routes, exchanges).select(F.lit("?").alias("method"), F.col("route").alias("url"), urls.api_kind(F.col("route"), mime, mime).alias("kind"), F.lit("uncalled").alias("detail"))
    return seen.unionByName(quiet)


def evidence(exchanges: DataFrame, static: DataFrame) -> DataFrame:
    """Per template: calls, methods, last status, routes, whether and where code names it, and badges.

    exchanges: (url, method, status, seq, route); static: (text, resource_url, ord).
    """
    runtime = exchanges.groupBy(urls.template_path(urls.path_of(F.col("url"))).alias("template")).agg(
        F.count("*").alias("calls"),
        F.array_sort(F.collect_set(F.upper(F.coalesce("method", F.lit("GET"))))).alias("methods"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("last_status"),
        F.array_sort(F.collect_set("route")).alias("routes"),
    )
    code = static.groupBy(urls.template_path(urls.path_of(F.col("text"))).alias("template")).agg(F.min_by("resource_url", F.struct("resource_url", "ord")).alias("file"))
    out = runtime.join(code, "template", "full").withColumn("calls", F.coalesce("calls", F.lit(0)))
    badges = F.concat_ws(" ", F.when(F.col("file").isNotNull(), "S"), F.when(F.col("calls") > 0, "R"), F.when(F.col("calls") > 1, F.concat(F.col("calls").cast("string"), F.lit("×"))), F.when(F.col("calls") == 0, "U"))
    return out.withColumn("badges", badges)


def preferred(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Evidence for (method, template): that of the same method, else of any method with the template."""
    joined = wanted.alias("w").join(known.alias("k"), F.col("w.template") == F.col("k.template"), "left")
    w = Window.partitionBy("w.method", "w.template").orderBy(F.col("w.method") != F.col("k.method"), F.col("k.method"))
    return joined.withColumn("n", F.row_number().over(w)).where("n = 1").select("w.method", "w.template", F.col("k.method").alias("found_method"), *[F.col(f"k.{c}") for c in known.columns if c not in ("method", "template")])


def infer_schema(value: object, depth: int = 0, deepest: int = 4, widest: int = 50) -> dict:
    """JSON schema of one sample: first array element, at most ``widest`` properties, ``deepest`` levels; null is a string."""
    if isinstance(value, bool):
        return {"type": "boolean"}
    if isinstance(value, int) or isinstance(value, float) and value == int(value):
        return {"type": "integer"}
    if isinstance(value, float):
        return {"type": "number"}
    if isinstance(value, list):
        return {"type": "array", "items": infer_schema(value[0], depth + 1) if value and depth < deepest else {}}
    if isinstance(value, dict):
        own = {} if depth >= deepest else {k: infer_schema(v, depth + 1) for k, v in list(value.items())[:widest]}
        return {"type": "object", "properties": own} if own else {"type": "object"}
    return {"type": "string"}


@F.pandas_udf(T.StringType())
def schema_of_sample(body: pd.Series) -> pd.Series:
    """``infer_schema`` of a JSON text, null where it isn't JSON."""

    def one(text):
        try:
            return json.dumps(infer_schema(json.loads(text)), sort_keys=True)
        except (TypeError, ValueError):
            return None

    return body.map(one)


def merged_schema(df: DataFrame, body: str) -> DataFrame:
    """Schema over all samples of a column, by the built-in aggregate; a better answer than one sample gives."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(body)).alias("schema"))


def json_keys(value: object, depth: int = 0) -> set[str]:
    if depth > 4:
        return set()
    if isinstance(value, dict):
        return set(value) | {k for v in value.values() for k in json_keys(v, depth + 1)}
    if isinstance(value, list):
        return {k for v in value[:5] for k in json_keys(v, depth + 1)}
    return set()


@F.pandas_udf(T.ArrayType(T.StringType()))
def key_set(body: pd.Series) -> pd.Series:
    """Sorted names of all keys to four levels, the first five elements of arrays; none where it isn't JSON."""

    def one(text):
        try:
            return sorted(json_keys(json.loads(text)))
        except (TypeError, ValueError):
            return []

    return body.map(one)


def key_diff(df: DataFrame, response: str, request: str) -> DataFrame:
    """Shared, response-only and request-only keys of two JSON columns."""
    a, b = key_set(F.col(response)), key_set(F.col(request))
    keyed = df.withColumn("__a", a).withColumn("__b", b)
    return keyed.withColumn("shared", F.array_intersect("__a", "__b")).withColumn("response_only", F.array_except("__a", "__b")).withColumn("request_only", F.array_except("__b", "__a")).drop("__a", "__b")


def flip_flags(value: object) -> object:
    """Every false of a JSON value made true."""
    if isinstance(value, dict):
        return {k: flip_flags(v) for k, v in value.items()}
    if isinstance(value, list):
        return [flip_flags(v) for v in value]
    return True if value is False else value


@F.pandas_udf(T.StringType())
def flags_on(body: pd.Series) -> pd.Series:
    def one(text):
        try:
            return json.dumps(flip_flags(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return text

    return body.map(one)


def openapi_paths(exchanges: DataFrame) -> DataFrame:
    """First observation of each template and method: (path, method, url, status, req_body, resp_body), http(s) only."""
    own = exchanges.where(F.col("url").rlike(r"\Ahttps?://")).withColumn("path", urls.template_openapi(urls.path_of(F.col("url")))).withColumn("method", F.lower(F.coalesce("method", F.lit("GET"))))
    w = Window.partitionBy("path", "method").orderBy("seq", "url")
    return own.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def openapi_document(exchanges: DataFrame, routes: DataFrame, title: str = "observed API", most: int | None = 300) -> DataFrame:
    """One row with an OpenAPI 3 document. Operations are built on the executors, one string each; the document only joins them."""

    def operations(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                raw = r.url.split("?")[0].split("#")[0].split("/")[3:]
                params = [{"name": s.strip("{}"), "in": "path", "required": True, "schema": {"type": "string"}, "example": raw[i] if i < len(raw) else ""} for i, s in enumerate(r.path.split("/")[1:]) if s.startswith("{")]
                params += [{"name": p["name"], "in": "query", "schema": {"type": "string"}, "example": p["value"][:120]} for p in r.query]
                op = {"parameters": params, "responses": {str(int(r.status) if r.status == r.status else 200): {"description": "observed"}}}
                for field, put in (("req_body", lambda s, op=op: op.__setitem__("requestBody", {"content": {"application/json": {"schema": s}}})), ("resp_body", lambda s, op=op: next(iter(op["responses"].values())).__setitem__("content", {"application/json": {"schema": s}}))):
                    try:
                        put(infer_schema(json.loads(getattr(r, field))))
                    except (TypeError, ValueError):
                        continue
                rows.append((r.path, f"{json.dumps(r.method)}:{json.dumps(op, sort_keys=True)}"))
            yield pd.DataFrame(rows, columns=["path", "op"])

    first = openapi_paths(exchanges).select("path", "method", "url", F.col("status").cast("double").alias("status"), "req_body", "resp_body", urls.query_params(F.col("url")).alias("query"))
    by_path = first.mapInPandas(operations, "path string, op string").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("op")), ",").alias("ops"))
    by_path = by_path.orderBy("path") if most is None else by_path.orderBy("path").limit(most)
    body = by_path.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "ops"))), lambda x: F.concat(F.to_json(F.struct(x["path"].alias("p"))).substr(F.lit(6), F.length(F.to_json(F.struct(x["path"].alias("p")))) - 6), F.lit(":{"), x["ops"], F.lit("}"))), ",").alias("paths"))
    quiet = uncalled(routes, exchanges).agg(F.to_json(F.array_sort(F.collect_list("route"))).alias("uncalled"))
    head = json.dumps({"openapi": "3.0.3", "info": {"title": title, "version": "1"}})[:-1]
    return body.crossJoin(quiet).select(F.concat(F.lit(head + ', "paths": {'), "paths", F.lit('}, "x-uncalled": '), "uncalled", F.lit("}")).alias("document"))
