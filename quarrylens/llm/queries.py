"""One query per corpus operator, over whole tables with production parameters, and the SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hostrank, kneser_ney, licenses, mixing, order_minhash, pii, simhash, toxicity, warc
from .shared import held_out, read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 3)
    scored = toxicity.score(docs, toxicity.learn(docs.where(~out), labels.where(~out).select("doc_id", "toxic")))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "matches")


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item_id").isNotNull().cast("int").alias("contaminated"), "item_id", F.round("share", 6).alias("share"), F.col("changed").cast("int").alias("reparameterised"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrank.judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled of high quality weigh 2, of low 0.5, others 1."""
    quality = mixing.label_quality(read_table(spark, sf_dir, "labels"))
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), quality)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.learn(docs))
    return found.select("doc_id", *(f"n_{k}" for k in pii.BASE), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.train_and_score(read_table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_with_edits(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_warc_zip": op2_warc_zip,
    "op3_decontamination": op3_decontamination,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_url_filter": op6_url_filter,
    "op7_source_mixing": op7_source_mixing,
    "op8_pii": op8_pii,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_order_minhash": op10_order_minhash,
}



def _host(url: str) -> str:
    return f"translate(regexp_extract(substr({url}, strpos({url}, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _ranks_sql(rounds: int = hostrank.ROUNDS) -> str:
    """The rule of each page, the host graph and its rounds of trust and distrust one after the other."""
    rules = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}:{h}{p}'" for h, p, v in sorted(hostrank.RULES, key=lambda r: -len(r[0] + r[1])))
    link = hostrank.LINK.replace("'", "''")
    d = hostrank.DAMPING
    steps = [
        f"""r{k + 1} AS MATERIALIZED (
            SELECT r.host, good, bad, leaves, entered,
                {1 - d!r} * good + {d!r} * (coalesce(t, 0) + coalesce((SELECT sum(trust) FROM r{k} WHERE NOT leaves), 0) * good) AS trust,
                {1 - d!r} * bad + {d!r} * (coalesce(b, 0) + coalesce((SELECT sum(distrust) FROM r{k} WHERE NOT entered), 0) * bad) AS distrust
            FROM r{k} r LEFT JOIN (SELECT dst AS host, sum(trust * forward) AS t FROM e JOIN r{k} ON src = host GROUP BY dst) USING (host)
                LEFT JOIN (SELECT src AS host, sum(distrust * backward) AS b FROM e JOIN r{k} ON dst = host GROUP BY src) USING (host))"""
        for k in range(rounds)
    ]
    return f"""
        WITH u AS (
            SELECT page_id, html, CASE WHEN contains(url, '://') THEN {_host('url')} ELSE '' END AS host,
                CASE WHEN contains(url, '://') THEN regexp_extract(regexp_replace(substr(url, strpos(url, '://') + 3), '^[^/?#]*', ''), '^([^?#]*)', 1) ELSE '' END AS path FROM pages
        ), p AS MATERIALIZED (SELECT page_id, html, host, path, CASE {rules} END AS r FROM u),
        s AS (SELECT host, count(*) AS n, count(*) FILTER (starts_with(r, 'allow')) AS a, count(*) FILTER (starts_with(r, 'block')) AS b FROM p WHERE host <> '' GROUP BY host),
        m AS (SELECT host, CASE WHEN a * 2 > n THEN a ELSE 0 END AS a, CASE WHEN b * 2 > n THEN b ELSE 0 END AS b FROM s),
        w AS (SELECT host, a / greatest(sum(a) OVER (), 1) AS good, b / greatest(sum(b) OVER (), 1) AS bad FROM m),
        l AS (SELECT host AS src, 'http:' || regexp_replace(unnest(regexp_extract_all(html, '{link}', 1)), '(?i)^https?:', '') AS o FROM p WHERE host <> ''),
        c AS (SELECT src, {_host('o')} AS dst, count(*) AS n FROM l GROUP BY ALL),
        e AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forward, n / sum(n) OVER (PARTITION BY dst) AS backward FROM c WHERE src <> dst AND dst <> ''),
        r0 AS MATERIALIZED (
            SELECT host, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, host IN (SELECT src FROM e) AS leaves, host IN (SELECT dst FROM e) AS entered, coalesce(good, 0) AS trust, coalesce(bad, 0) AS distrust
            FROM w FULL JOIN (SELECT src AS host FROM e UNION SELECT dst FROM e) USING (host)
        ), {', '.join(steps)}
        SELECT page_id, host, path, substr(r, 7) AS rule,
            coalesce(substr(r, 1, 5), CASE WHEN distrust > greatest(trust * {hostrank.RATIO!r}, {hostrank.FLOOR!r}) THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN (SELECT host, CASE WHEN (SELECT count(*) FROM e) = 0 THEN good ELSE trust END AS trust, CASE WHEN (SELECT count(*) FROM e) = 0 THEN bad ELSE distrust END AS distrust FROM r{rounds}) USING (host)
    """


ORACLES: dict[str, str] = {
    "op6_url_filter": _ranks_sql(),
    "op2_warc_zip": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (SELECT payload_digest, max(page_id) AS top FROM p GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
        FROM p JOIN g USING (payload_digest)
    """,
    "op7_source_mixing": r"""
        WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                -ln((('0x' || substr(md5('mix' || doc_id::VARCHAR), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
                    / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
            FROM documents LEFT JOIN l USING (doc_id)
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
        ), w AS (
            SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM s
        ), b AS (
            SELECT *, 3 * source_size / weight AS bound FROM w
        ), h AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER r, 0))::DOUBLE
                / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS here
            FROM b WINDOW r AS (ORDER BY bound, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), v AS (SELECT arg_min(here, bound) AS level FROM h WHERE here <= bound),
        t AS (
            SELECT source, source_size, CASE WHEN bound <= level THEN (3 * source_size)::DOUBLE ELSE level * weight END AS target FROM h, v
        ), o AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
                coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
            (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
                + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - ahead)))::BIGINT AS taken
        FROM o
    """,
}
