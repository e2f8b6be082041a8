"""Queries over the event and star tables: filters, groups, windows, set operations, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dsl, tables
from ..session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _event_columns() -> dict:
    return {"kind": F.col("event_type"), "status": F.col("value").cast("int"), "url": F.col("props"), "has_body": F.length("props") > 0, "is_error": F.col("event_type") == "error"}


@query("f2_dsl_events", "SELECT event_id FROM events WHERE event_type NOT ILIKE '%view%' AND NOT coalesce(CAST(trunc(value) AS INT) >= 50, false) AND contains(lower(coalesce(event_type, '') || ' ' || coalesce(CAST(CAST(trunc(value) AS INT) AS VARCHAR), '') || ' ' || coalesce(props, '')), 'k')")
def dsl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.apply(table(spark, sf_dir, "events"), "-kind:view -status:>=50 k", _event_columns()).select("event_id")


@query("f5_dsl_has_error", "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND CAST(trunc(value) AS INT) < 10")
def dsl_has_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.apply(table(spark, sf_dir, "events"), 'has:error status:<10', _event_columns()).select("event_id", "user_id")


@query("a1_events_by_type", "SELECT coalesce(nullif(event_type, ''), 'other') AS value, count(*) AS n FROM events GROUP BY ALL")
def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.count_by(table(spark, sf_dir, "events"), "event_type")


@query("a6_route_counts", "SELECT event_type AS route, arg_min(user_id, event_id) AS method, count(*) AS count FROM events GROUP BY ALL")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.route_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), F.col("user_id").alias("method"), F.col("event_id").alias("seq")))


@query("a7_called_endpoints", """SELECT upper(event_type) AS method, 'u' || user_id AS url, count(*) AS calls, arg_max(CAST(trunc(value) AS INT), event_id) FILTER (value IS NOT NULL) AS status FROM events GROUP BY ALL""")
def called(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("value").cast("int").alias("status"), F.col("event_id").alias("seq"), F.col("props").alias("resp_body"))
    return tables.called_endpoints(e).select("method", "url", "calls", "status")


@query("a9_event_overview", "SELECT count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (event_type = 'error') AS errors, sum(strlen(props))::BIGINT AS bytes FROM events")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(F.octet_length("props")).cast("long").alias("bytes"))


@query("w5_newest_events", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 800")
def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(800).select("event_id", "user_id")


@query("w6_near_duplicate_runs", """WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT user_id, event_type, run::BIGINT AS run, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY ALL""")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.near_duplicates(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 3600, ["value"]).drop("value")


@query("w1_first_event_per_user", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_per(table(spark, sf_dir, "events"), ["user_id"], [F.col("event_id")]).select("user_id", "event_id")


@query("w3_top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "o_totalprice")


@query("w2_orders_capped_per_customer", "SELECT o_custkey, o_orderkey, greatest(n - 5, 0) AS more FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r <= 5")
def orders_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.capped_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "more")


@query("w4_priority_order", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL")
def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.count_by(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("j1_customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j2_supplier_nation", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def supplier_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("s_suppkey", "n_name", "r_name")


@query("j6_as_of_events", """WITH r AS (SELECT user_id, event_id AS id, epoch_us(ts) AS us, CASE event_type WHEN 'view' THEN 1 ELSE -1 END AS step FROM events WHERE event_type IN ('view', 'purchase')),
    d AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY us, step DESC, id ROWS UNBOUNDED PRECEDING) AS depth FROM r),
    p AS (SELECT *, lag(id) OVER w AS entry_id, us - lag(us) OVER w AS gap_us FROM d WINDOW w AS (PARTITION BY user_id, CASE step WHEN 1 THEN depth ELSE depth + 1 END ORDER BY us, step DESC, id))
    SELECT user_id, id AS event_id, entry_id, gap_us FROM p WHERE step = -1 AND entry_id IS NOT NULL AND gap_us <= 21600000000""")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    buys = events.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    views = events.where("event_type = 'view'").select(F.col("event_id").alias("entry_id"), "ts", "user_id")
    return tables.as_of(buys, views, ["user_id"], 6 * 3600)


@query("u1_keys_union", "SELECT k, src FROM (SELECT c_nationkey AS k, 'customer' AS src FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier)")
def keys_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("src"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("src"))
    return tables.union_distinct(a, b, on=["k", "src"])


@query("u2_keys_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def keys_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("u3_parts_not_shipped", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def parts_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey")
    return table(spark, sf_dir, "part").select("p_partkey").distinct().join(shipped, F.col("p_partkey") == F.col("l_partkey"), "left_anti")


@query("a5_size_by_flag", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL")
def size_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("a16_retention", "SELECT event_id, sum(strlen(props)) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS held, sum(strlen(props)) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) <= 20000 AS kept FROM events")
def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select("event_id", F.octet_length("props").cast("long").alias("bytes"), F.col("event_id").alias("seq"))
    return tables.retention(items, 20_000).select("event_id", "held", "kept")


@query("st_window_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    return e.groupBy(F.col("at").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("e8_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("a19_conversation_reassembly", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body, count(*) AS turns FROM conversations GROUP BY ALL")
def reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(": ", "role", "text")
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("body"), F.count("*").alias("turns"))


@query("w_rank_users", "SELECT user_id, n, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) QUALIFY r <= 20")
def rank_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.rank().over(Window.orderBy(F.desc("n"))).cast("long")).where("r <= 20")
