"""Grouping, counting, ranking and set operations over tables of exchanges, routes and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


def count_by(df: DataFrame, key: Column | str, name: str = "value") -> DataFrame:
    """Rows per key, most first, then by key; null and empty keys are ``other``."""
    key = F.col(key) if isinstance(key, str) else key
    shown = F.coalesce(F.nullif(key.cast("string"), F.lit("")), F.lit("other"))
    return df.groupBy(shown.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def mime_group_counts(df: DataFrame) -> DataFrame:
    return count_by(df, urls.mime_group(F.col("mime"), F.col("url")))


def method_counts(df: DataFrame) -> DataFrame:
    return count_by(df, F.upper(F.coalesce(F.nullif(F.col("method"), F.lit("")), F.lit("GET"))))


def group_by_host(df: DataFrame, url: str = "url", size: Column | None = None, first_party: str = "") -> DataFrame:
    """Rows and bytes per host: the first party first, relative URLs last, else most rows first, then by name."""
    host = urls.host_of(F.col(url))
    named = F.when(host == "", "(relative)").otherwise(host)
    size = size if size is not None else F.lit(0)
    out = df.groupBy(named.alias("host")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    return out.orderBy(F.col("host") != first_party, F.col("host") == "(relative)", F.desc("n"), "host")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def capped_per(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows a key, with ``more``: how many were left out."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("__n", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return ranked.where(F.col("__n") <= most).drop("__n")


def severity_rank(sev: Column) -> Column:
    # Order of severities.
    return F.when(sev == "critical", 0).when(sev == "high", 1).when(sev == "medium", 2).when(sev == "info", 3).otherwise(4)


def route_counts(exchanges: DataFrame) -> DataFrame:
    """(route, method of the first request, count) from (route, method, seq)."""
    return exchanges.where("route is not null").groupBy("route").agg(F.min_by("method", "seq").alias("method"), F.count("*").alias("count"))


def called_endpoints(exchanges: DataFrame) -> DataFrame:
    """One row per METHOD and url: calls, last known status, a body if any request had one, from (url, method, status, seq, resp_body)."""
    method = F.upper(F.coalesce(F.nullif(F.col("method"), F.lit("")), F.lit("GET")))
    known = F.when(F.col("status").isNotNull(), F.col("seq"))
    body = F.when(F.length(F.coalesce("resp_body", F.lit(""))) > 0, F.col("seq"))
    return exchanges.groupBy(method.alias("method"), "url").agg(F.count("*").alias("calls"), F.max_by("status", known).alias("status"), F.max_by("resp_body", body).alias("sample"))


def overview(resources: DataFrame) -> DataFrame:
    """Totals of a table of resources (url, kind, size, has_source_map, ts)."""
    return resources.agg(
        F.count("*").alias("resources"),
        F.count_if(F.col("kind") == "chunk").alias("chunks"),
        F.count_if(F.col("kind") == "api-json").alias("api_json"),
        F.count_if("has_source_map").alias("source_maps"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def near_duplicates(events: DataFrame, keys: list[str], ts: str, seconds: float, keep: list[str]) -> DataFrame:
    """Rows of equal keys with gaps of at most ``seconds`` merged: count, first and last time, last known value of ``keep``."""
    order = Window.partitionBy(*keys).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = events.withColumn("__new", (F.coalesce(at - F.lag(at).over(order), F.lit(1 << 62)) > int(seconds * 1e6)).cast("long"))
    runs = marked.withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in keep]
    return runs.groupBy(*keys, "run").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *last)


def retention(items: DataFrame, budget: int) -> DataFrame:
    """Items (category, bytes, seq) with the bytes kept from the newest on, and whether each still fits the budget.

    Running sums are made per category and time bucket, and the sums of earlier buckets added, so no task sorts all rows.
    """
    bucket = F.floor(F.col("seq") / 4096)
    parts = items.groupBy(bucket.alias("b")).agg(F.sum("bytes").alias("all"))
    newer = parts.withColumn("ahead", F.coalesce(F.sum("all").over(Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "ahead")
    within = Window.partitionBy("b").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    out = items.withColumn("b", bucket).withColumn("inside", F.sum("bytes").over(within)).join(newer, "b")
    return out.withColumn("held", F.col("ahead") + F.col("inside")).withColumn("kept", F.col("held") <= budget).drop("b", "inside", "ahead")


def pressure(used: Column, budget: Column) -> Column:
    return F.when(used >= budget, "full").when(used >= budget * 0.8, "tight").otherwise("ok")


def union_distinct(*frames: DataFrame, on: list[str]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.dropDuplicates(on)


def as_of(events: DataFrame, entries: DataFrame, keys: list[str], seconds: int = 30) -> DataFrame:
    """Each event with the newest entry of equal keys, at most ``seconds`` before it, that no earlier event has taken.

    Entries and events pair like opening and closing brackets in time order, as an event always takes the newest entry
    that is left; a pair too far apart is none. So every row goes to its own window of ``seconds`` and the next, and
    brackets are matched within each window by depth: one shuffle, and a busy key is split by time. Of entries at one
    time the one of the largest id is the newest; null keys and times match nothing.
    events: (event_id, ts, keys), entries: (entry_id, ts, keys).
    """
    span = seconds * 1_000_000

    def rows(df: DataFrame, own: str, step: int) -> DataFrame:
        return df.select(*keys, own, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.lit(step).alias("step")).dropna(subset=[*keys, "us"])

    both = rows(entries, "entry_id", 1).unionByName(rows(events, "event_id", -1), allowMissingColumns=True)
    own = F.col("us") - F.pmod("us", F.lit(span))
    dealt = both.withColumn("own", own).withColumn("w", F.explode(F.array(F.col("own"), F.col("own") + span)))
    order = [F.col("us"), F.desc("step"), F.col("entry_id"), F.col("event_id")]
    depth = F.sum("step").over(Window.partitionBy(*keys, "w").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    level = dealt.withColumn("level", depth + F.when(F.col("step") < 0, 1).otherwise(0))
    before = Window.partitionBy(*keys, "w", "level").orderBy(*order)
    pairs = level.withColumn("found", F.lag("entry_id").over(before)).withColumn("gap_us", F.col("us") - F.lag("us").over(before))
    kept = pairs.where((F.col("step") < 0) & (F.col("own") == F.col("w")) & F.col("found").isNotNull() & (F.col("gap_us") <= span))
    return kept.select(*keys, "event_id", F.col("found").alias("entry_id"), "gap_us")
