"""Exports: cURL lines, word lists, dossiers, session folders, source ZIPs, copy lines."""

from __future__ import annotations

import io
import json
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.redact import redact, redact_headers

MAGIC, FORMAT = "quarrylens-session", 1
# Headers that belong to a connection, not to a request that is sent again.
HOP_BY_HOP = ("accept-charset", "accept-encoding", "connection", "content-length", "cookie", "date", "expect", "host", "keep-alive", "origin", "referer", "te", "trailer", "transfer-encoding", "upgrade", "via")


def sanitize_headers(headers: Column, longest: int = 8192) -> Column:
    """Headers fit to be sent again: valid names, none of a connection's, no ``sec-`` or pseudo headers, no over-long values."""
    keep = lambda k, v: k.rlike(r"\A[!#$%&'*+.^_`|~0-9A-Za-z-]+\z") & ~F.lower(k).isin(*HOP_BY_HOP) & ~F.lower(k).startswith("sec-") & (F.length(v) <= longest)
    return F.map_filter(F.coalesce(headers, F.create_map().cast("map<string,string>")), keep)


def curl(method: Column, url: Column, headers: Column, most: int = 20) -> Column:
    quote = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    pairs = F.slice(F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))), 1, most)
    flags = F.transform(pairs, lambda e: F.concat(F.lit("-H "), quote(F.concat_ws(": ", e["key"], F.substring(e["value"], 1, 500)))))
    return F.array_join(F.concat(F.array(F.concat(F.lit("curl -X "), F.upper(F.coalesce(method, F.lit("GET"))), F.lit(" "), quote(url))), flags), " ")


def wordlist(exchanges: DataFrame) -> DataFrame:
    """(kind, word): different endpoints, parameters, path words and header names."""
    path = urls.path_of(F.col("url"))
    one = lambda kind, c: exchanges.select(F.lit(kind).alias("kind"), c.alias("word"))
    words = one("word", F.explode(F.split(path, "/"))).where((F.length("word") >= 2) & ~F.col("word").rlike(r"\A[0-9]+\z")).withColumn("word", F.lower("word"))
    params = one("param", F.explode(F.transform(urls.query_params(F.col("url")), lambda p: p["name"])))
    names = F.explode(F.concat(*[F.map_keys(F.coalesce(c, F.create_map().cast("map<string,string>"))) for c in ("req_headers", "res_headers")]))
    headers = one("header", names).withColumn("word", F.lower("word"))
    return one("endpoint", path).unionByName(params).unionByName(words).unionByName(headers).distinct()


def dossier(exchanges: DataFrame, routes: DataFrame) -> DataFrame:
    """(section, key, value): called endpoints with redacted samples, uncalled APIs and page routes, for a reader outside."""
    from ..operators import api, tables

    called = tables.called_endpoints(exchanges)
    called = called.groupBy("method", urls.template_openapi(urls.path_of(F.col("url"))).alias("path")).agg(F.sum("calls").alias("calls"), F.min_by(redact(F.substring("sample", 1, 2000)), "url").alias("sample"))
    one = called.select(F.lit("called").alias("section"), F.concat_ws(" ", "method", "path").alias("key"), F.to_json(F.struct("calls", "sample")).alias("value"))
    rest = api.uncalled(routes, exchanges, pattern=None).select("route", F.col("route").rlike(urls.API_ROUTE).alias("is_api"))
    two = rest.select(F.when(F.col("is_api"), "uncalled").otherwise("page").alias("section"), F.col("route").alias("key"), F.lit(None).cast("string").alias("value"))
    return one.unionByName(two)


def redacted_exchanges(exchanges: DataFrame) -> DataFrame:
    out = exchanges.withColumn("req_headers", redact_headers(F.col("req_headers"))).withColumn("res_headers", redact_headers(F.col("res_headers")))
    return out.withColumn("req_body", redact(F.col("req_body"))).withColumn("resp_body", redact(F.col("resp_body"))).withColumn("url", redact(F.col("url")))


def save_session(tables: dict[str, DataFrame], path: str) -> None:
    """A folder with a table of gzip JSON lines each and a manifest."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
    manifest = json.dumps({"magic": MAGIC, "format": FORMAT, "tables": {n: json.loads(d.schema.json()) for n, d in tables.items()}})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def open_session(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``save_session``; ValueError for a folder of another kind or format."""
    from pyspark.sql.types import StructType

    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except (TypeError, ValueError) as error:
        raise ValueError("no session manifest") from error
    if manifest.get("magic") != MAGIC or manifest.get("format") != FORMAT:
        raise ValueError("no session of this format")
    return {n: spark.read.schema(StructType.fromJson(s)).json(f"{path}/{n}") for n, s in manifest["tables"].items()}


def zip_path(path: str) -> str:
    """A path within an archive: no scheme, drive, root or parent steps."""
    clean = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", path.replace("\\", "/")).split("?")[0]
    parts = [re.sub(r'[<>:"|*\x00-\x1f]', "_", p) for p in clean.split("/") if p not in ("", ".", "..")]
    return "/".join(parts) or "unnamed"


def source_zip(files: list[tuple[str, str]]) -> bytes:
    """Stored ZIP of (path, content); a repeated path gets a number."""
    out, seen = io.BytesIO(), {}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for path, content in files:
            name = zip_path(path)
            n = seen[name] = seen.get(name, -1) + 1
            z.writestr(zipfile.ZipInfo(f"{name}.{n}" if n else name, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def zip_sources(files: DataFrame) -> DataFrame:
    """(bundle, zip): the files (bundle, path, content) of each bundle as one archive, built on the executors."""
    import pandas as pd

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["path", "content"])
        return pd.DataFrame({"bundle": [key[0]], "zip": [source_zip(list(zip(rows.path, rows.content, strict=True)))]})

    return files.groupBy("bundle").applyInPandas(pack, "bundle string, zip binary")


def copy_lines(df: DataFrame, tag: str, url: str = "url", most: int = 1000) -> DataFrame:
    return df.select(F.concat_ws(" ", F.col(tag), F.col(url)).alias("line")).distinct().orderBy("line").limit(most)
