"""HTTP archive reading and writing: entries as rows, documents as JSON lines of one archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "array<struct<name:string,value:string>>"
ENTRY = (
    f"struct<startedDateTime:string,time:double,_seq:long,request:struct<method:string,url:string,headers:{PAIRS},postData:struct<mimeType:string,text:string>>,"
    f"response:struct<status:int,headers:{PAIRS},content:struct<size:long,mimeType:string,text:string,encoding:string>>>"
)
#: Bounds of an archive that tools exchange; None in the functions below lifts them.
BODY, REQUEST_BODY, HEADER, ENTRIES = 50_000, 20_000, 16_384, 2_000


def _pairs(headers: Column) -> Column:
    """Header map as name and value structs, by name."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), F.substring(e["value"], 1, HEADER).alias("value")))


def _cut(c: Column, most: int | None) -> Column:
    return c if most is None else F.substring(c, 1, most)


def entries(exchanges: DataFrame, body: int | None = BODY) -> DataFrame:
    """(seq, entry): a HAR 1.2 entry as JSON for each http(s) exchange."""
    ts = F.col("ts") if "ts" in exchanges.columns else F.lit(0)
    entry = F.struct(
        F.date_format(F.timestamp_millis(F.coalesce(ts.cast("long"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("startedDateTime"),
        F.lit(0.0).alias("time"),
        F.col("seq").cast("long").alias("_seq"),
        F.struct(
            F.upper(F.coalesce("method", F.lit("GET"))).alias("method"),
            "url",
            F.lit("HTTP/1.1").alias("httpVersion"),
            _pairs(F.col("req_headers")).alias("headers"),
            F.when(F.length("req_body") > 0, F.struct(F.lit("application/octet-stream").alias("mimeType"), _cut(F.col("req_body"), REQUEST_BODY if body is not None else None).alias("text"))).alias("postData"),
        ).alias("request"),
        F.struct(
            F.coalesce("status", F.lit(0)).cast("int").alias("status"),
            F.lit("HTTP/1.1").alias("httpVersion"),
            _pairs(F.col("res_headers")).alias("headers"),
            F.struct(F.coalesce(F.octet_length("resp_body"), F.lit(0)).cast("long").alias("size"), F.coalesce("mime", F.lit("")).alias("mimeType"), _cut(F.col("resp_body"), body).alias("text")).alias("content"),
        ).alias("response"),
    )
    return exchanges.where(F.col("url").rlike(r"\Ahttps?://")).select("seq", F.to_json(entry).alias("entry"))


def write(exchanges: DataFrame, path: str, body: int | None = BODY) -> None:
    """A folder of JSON lines, one entry each, written in parallel; ``document`` makes the single file other tools want."""
    entries(exchanges, body).select(F.col("entry").alias("value")).write.mode("overwrite").text(path)


def document(exchanges: DataFrame, most: int = ENTRIES, body: int | None = BODY) -> DataFrame:
    """One row, one HAR document of the newest ``most`` exchanges, oldest first."""
    newest = entries(exchanges.orderBy(F.desc("seq")).limit(most), body)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "entry"))), lambda x: x["entry"]), ",")
    return newest.agg(F.concat(F.lit('{"log":{"version":"1.2","creator":{"name":"quarrylens","version":"1"},"entries":['), joined, F.lit("]}}")).alias("har"))


def parse_entries(rows: DataFrame, entry: str = "entry", body: int | None = BODY) -> DataFrame:
    """Exchanges from HAR entries as JSON: http(s) URLs of at most 2,000 characters, status 100 to 999 or null, bodies decoded, first header of a name."""
    e = F.from_json(F.col(entry), ENTRY)
    r = rows.withColumn("__e", e).where(F.col("__e.request.url").rlike(r"\Ahttps?://") & (F.length("__e.request.url") <= 2000))

    def first_named(pairs: Column) -> Column:
        kept = F.slice(F.filter(F.coalesce(pairs, F.array().cast(PAIRS)), lambda p: p["name"].isNotNull() & (p["name"] != "")), 1, 60)
        names = F.transform(kept, lambda p: F.lower(p["name"]))
        own = F.filter(kept, lambda p, i: F.array_position(names, F.lower(p["name"])) == i + 1)
        return F.map_from_entries(F.transform(own, lambda p: F.struct(p["name"], p["value"])))

    content = F.col("__e.response.content")
    decoded = F.when(content["encoding"] == "base64", F.try_to_binary(content["text"], F.lit("base64")).cast("string")).otherwise(content["text"])
    status = F.col("__e.response.status")
    return r.select(
        F.coalesce("__e._seq", F.monotonically_increasing_id()).alias("seq"),
        "__e.request.url",
        F.substring(F.upper(F.coalesce("__e.request.method", F.lit("GET"))), 1, 16).alias("method"),
        F.when(status.between(100, 999), status).alias("status"),
        F.substring(F.coalesce(content["mimeType"], F.lit("")), 1, 128).alias("mime"),
        F.unix_millis(F.try_to_timestamp("__e.startedDateTime")).alias("ts"),
        first_named(F.col("__e.request.headers")).alias("req_headers"),
        first_named(F.col("__e.response.headers")).alias("res_headers"),
        _cut(F.col("__e.request.postData.text"), REQUEST_BODY if body is not None else None).alias("req_body"),
        _cut(decoded, body).alias("resp_body"),
    )


def read(spark: SparkSession, path: str, body: int | None = BODY) -> DataFrame:
    """Exchanges of archive documents, a file each; files without ``log.entries`` give none."""
    docs = spark.read.text(path, wholetext=True)
    listed = F.from_json(F.get_json_object("value", "$.log.entries"), "array<string>")
    return parse_entries(docs.select(F.posexplode(listed).alias("ord", "entry")), body=body)


def read_lines(spark: SparkSession, path: str, body: int | None = BODY) -> DataFrame:
    """Exchanges of what ``write`` wrote."""
    return parse_entries(spark.read.text(path), "value", body)


def is_valid(text: Column, most: int = 10_000) -> Column:
    """Whether a text is an archive with at most ``most`` entries."""
    listed = F.from_json(F.get_json_object(text, "$.log.entries"), "array<string>")
    return F.coalesce(F.size(listed).between(0, most) & listed.isNotNull(), F.lit(False))
