"""Queries over documents and pages: units, index, search modes, redaction, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.redact import redact
from ..operators import extract, search, secrets, tables
from ..session import table

QUERIES: dict = {}
ORACLES: dict = {}
LINES = """SELECT doc_id, i AS line, trim(l[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(generate_series(1, len(l))) AS g(i)
    WHERE length(trim(l[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12))) BETWEEN 3 AND 320"""
RECORDS = f"""SELECT doc_id, min(line) AS line, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ-_./\\:;|+~*% ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM ({LINES}) GROUP BY doc_id, text"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), "text")
    return extract.text_lines(docs, body="text")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.add_units(_lines(spark, sf_dir)).withColumn("doc_id", F.col("resource_url").cast("long"))


@query("e10_document_lines", LINES)
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(F.col("resource_url").cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"), "text")


@query("x6_index_records", f"SELECT doc_id, line, text, norm, length(text) AS len FROM ({RECORDS})")
def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("doc_id", F.col("line").cast("long").alias("line"), "text", "norm", F.col("len").cast("long").alias("len"))


@query("x3_trigram_counts", f"""SELECT tri, count(*) AS n FROM (SELECT doc_id, line, unnest(list_distinct(CASE WHEN length(norm) = 0 THEN [] WHEN length(norm) < 3 THEN [norm]
    ELSE list_transform(generate_series(1, least(length(norm) - 2, 64)), lambda i: substring(norm, i, 3)) END)) AS tri FROM ({RECORDS})) GROUP BY ALL""")
def trigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.trigram_postings(_records(spark, sf_dir)).groupBy("tri").agg(F.count("*").alias("n"))


@query("x5_token_counts", f"""SELECT token, count(*) AS n FROM (SELECT doc_id, line, unnest(list_distinct(list_filter(regexp_extract_all(norm, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda t: length(t) BETWEEN 2 AND 64)[1:24])) AS token FROM ({RECORDS})) GROUP BY ALL""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_records(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("n"))


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", F.col("line").cast("long").alias("line"), F.col("score").cast("double").alias("score"), "text")


@query("x9_search_exact", f"SELECT doc_id, line, 1.0::DOUBLE AS score, text FROM ({RECORDS}) WHERE contains(text, 'License')")
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(search.search(_records(spark, sf_dir), "License", "exact", limit=None))


@query("x10_search_substring", f"SELECT doc_id, line, CASE WHEN contains(text, 'license') THEN 1.0::DOUBLE ELSE 0.92 END AS score, text FROM ({RECORDS}) WHERE contains(lower(text), 'license')")
def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(search.search(_records(spark, sf_dir), "license", "substring", limit=None))


@query("x11_search_normalized", f"SELECT doc_id, line, CASE WHEN contains(lower(text), 'mit-license') THEN 0.95::DOUBLE ELSE 0.88 END AS score, text FROM ({RECORDS}) WHERE contains(norm, 'mitlicense')")
def search_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(search.search(_records(spark, sf_dir), "MIT-License", "normalized", limit=None))


@query("x12_search_regex", f"SELECT doc_id, line, 0.95::DOUBLE AS score, text FROM ({RECORDS}) WHERE regexp_matches(text, '[a-z]+\\.[0-9]{{2}}@mail[0-9]')")
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(search.search(_records(spark, sf_dir), r"[a-z]+\.[0-9]{2}@mail[0-9]", "regex", limit=None))


@query("x13_search_fuzzy", None)
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(search.search(_records(spark, sf_dir), "Apache Lisence", "fuzzy", limit=200))


@query("x7_candidates", None)
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return search.candidates(search.postings(records), search.trigram_postings(records), "Apache License")


@query("x18_search_surfaces", """WITH s AS (SELECT 'body' AS surface, 'd' || doc_id AS resource_url, text, 1.0::DOUBLE AS own FROM documents UNION ALL SELECT 'url', 'p' || page_id, url, 0.98 FROM pages UNION ALL SELECT 'store', 'c' || conv_id || '.' || turn, text, 0.95 FROM conversations),
    h AS (SELECT surface, resource_url, substring(text, greatest(strpos(lower(text), 'mail1') - 60, 1), 125) AS context, CASE WHEN surface = 'body' AND NOT contains(text, 'mail1') THEN 0.92 ELSE own END AS score FROM s WHERE contains(lower(text), 'mail1'))
    SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY resource_url, context ORDER BY score DESC, surface) = 1""")
def search_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    surfaces = {
        "body": table(spark, sf_dir, "documents").select("text", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("resource_url")),
        "url": table(spark, sf_dir, "pages").select(F.col("url").alias("text"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("resource_url")),
        "store": table(spark, sf_dir, "conversations").select("text", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("resource_url")),
    }
    return search.search_surfaces(surfaces, "mail1", limit=None)


@query("x17_snippets", """SELECT doc_id, strpos(text, 'License') - 1 AS start, substring(text, greatest(strpos(text, 'License') - 61, 0) + 1, least(strpos(text, 'License') - 1 + 67, length(text)) - greatest(strpos(text, 'License') - 61, 0)) AS body FROM documents WHERE contains(text, 'License')""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("License"))
    start = F.instr("text", "License") - 1
    return docs.select("doc_id", start.cast("long").alias("start"), F.replace(text.snippet(F.col("text"), start, F.lit(7)), F.lit("…"), F.lit("")).alias("body"))


@query("x2_normalized_spans", f"""SELECT doc_id, line, o[strpos(norm, 'mitlicense')] AS start, o[strpos(norm, 'mitlicense') + 9] + 1 - o[strpos(norm, 'mitlicense')] AS length, substr(text, o[strpos(norm, 'mitlicense')] + 1, o[strpos(norm, 'mitlicense') + 9] + 1 - o[strpos(norm, 'mitlicense')]) AS marked
    FROM (SELECT *, list_filter(range(length(text)), lambda i: NOT contains('-_./\\:;|+~*% ', text[i + 1])) AS o FROM ({RECORDS}) WHERE contains(norm, 'mitlicense'))""")
def normalized_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the text itself, of what was found in its normal form."""
    hits = search.search(_records(spark, sf_dir), "MIT-License", "normalized", limit=None)
    marked = F.substring("context", F.col("marks")[0]["s"] + 1, F.col("marks")[0]["e"] - F.col("marks")[0]["s"])
    return hits.select("doc_id", F.col("line").cast("long").alias("line"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), marked.alias("marked"))


@query("x19_exact_places", """SELECT doc_id, list_transform(generate_series(1, len(p) - 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + (i - 1) * 3) AS offsets FROM (SELECT doc_id, string_split(text, 'The') AS p FROM documents)""")
def exact_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.with_matches(table(spark, sf_dir, "documents"), "The", "exact")
    return found.select("doc_id", F.transform("matches", lambda m: m["at"].cast("long")).alias("offsets"))


@query("x19_regex_places", """SELECT doc_id, list_transform(generate_series(1, len(m)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x)))::BIGINT, 0)) AS offsets,
    list_transform(m, lambda x: length(x)) AS lengths FROM (SELECT doc_id, regexp_extract_all(text, '(?i)[a-z]+@[a-z.]+|[0-9]{3,}') AS m, regexp_split_to_array(text, '(?i)[a-z]+@[a-z.]+|[0-9]{3,}') AS p FROM documents)""")
def regex_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.with_matches(table(spark, sf_dir, "documents"), "[a-z]+@[a-z.]+|[0-9]{3,}", "regex")
    return found.select("doc_id", F.transform("matches", lambda m: m["at"].cast("long")).alias("offsets"), F.transform("matches", lambda m: m["len"].cast("long")).alias("lengths"))


@query("x19_match_offsets", """SELECT doc_id, list_transform(generate_series(1, least(len(p) - 1, 10)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + (i - 1) * 3) AS offsets FROM (SELECT doc_id, string_split(lower(text), 'the') AS p FROM documents) WHERE len(p) > 1""")
def match_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", search.matches_in_text(F.col("text"), "the").cast("array<long>").alias("offsets"))
    return found.where(F.size("offsets") > 0)


@query("r4_redaction", r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', '[USER_EMAIL_REDACTED]', 'g'),
    '(?i)(["'']?(?:password|passwd|secret|client_secret|api_secret)["'']?\s*[:=]\s*)["'']?[^"''\s,;]+["'']?', '\1"[REDACTED_SECRET]"', 'g') AS text FROM documents WHERE regexp_matches(text, '@|password|passwd|secret')""")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("@|password|passwd|secret"))
    return docs.select("doc_id", redact(F.col("text")).alias("text"))


@query("a15_entropy", f"""SELECT doc_id, line, round(-list_sum(list_transform(list_distinct(c), lambda x: (len(list_filter(c, lambda y: y = x)) / len(c)::DOUBLE) * log2(len(list_filter(c, lambda y: y = x)) / len(c)::DOUBLE))), 6) AS bits FROM (SELECT doc_id, line, string_split(text, '') AS c FROM ({LINES}))""")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per character of each line, the unit that the secret rules see."""
    lines = _lines(spark, sf_dir)
    return lines.select(F.col("resource_url").cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"), F.round(text.shannon(F.col("text")), 6).alias("bits"))


@query("r1_secret_findings", r"""SELECT doc_id, line, 'password_assignment' AS rule FROM (SELECT doc_id, line, trim(regexp_extract(text, '(?i)\b(passw(or)?d|passwd|pwd)\s*[:=]\s*["'']?([^"''`\s]{6,128})', 3), '"''') AS v, text FROM (""" + LINES + r"""))
    WHERE length(text) BETWEEN 8 AND 320 AND v <> '' AND NOT regexp_matches(lower(v), 'xxx|\*\*\*|abcd|123456|qwerty|password|aaaa|bbbb|cccc|dddd|eeee|ffff|0000|1111|2222|3333|4444|5555|6666|7777|8888|9999')""")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_lines(spark, sf_dir).withColumn("doc_id", F.col("resource_url").cast("long")))
    return found.where("rule = 'password_assignment'").select("doc_id", F.col("line").cast("long").alias("line"), "rule")


@query("u4_distinct_lines", f"SELECT text, count(DISTINCT doc_id) AS docs FROM ({LINES}) GROUP BY text HAVING count(DISTINCT doc_id) > 1")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("resource_url", "text").distinct()
    return lines.groupBy("text").agg(F.count("*").alias("docs")).where("docs > 1")


@query("j4_benchmark_containment", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("j3_labelled_documents", "SELECT source, toxic, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").groupBy("source", "toxic", "quality").agg(F.count("*").alias("n"))


@query("a1_documents_by_language", "SELECT coalesce(nullif(lang, ''), 'other') AS value, count(*) AS n FROM documents GROUP BY ALL")
def by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.count_by(table(spark, sf_dir, "documents"), "lang")
