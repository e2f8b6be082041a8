"""URL filter: host and path rules, and trust spread over the link graph of hosts.

Hosts most of whose pages an allow rule covers are trusted seeds, those a block rule mostly covers distrusted ones. Trust is
personalised PageRank along the links between hosts; distrust is the same along reversed links, from the blocked
hosts to those that link to them. What ends at hosts without links goes back to the seeds. The rounds end when ranks
change by less than ``TOLERANCE`` in all. A page that no rule fits is blocked if its host's distrust exceeds its trust by
``RATIO`` and ``FLOOR``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, store

# Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING = 0.85
ROUNDS = 50
TOLERANCE = 1e-6
RATIO = 1.0
FLOOR = 1e-12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<(?:a|area)\b[^>]*?\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``. Both empty without ``://`` or url."""
    start = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)\A([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the url's or above it and whose path begins the url's, as text, and its verdict; else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, kind in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        name = F.when(fits, own + start).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts, from the absolute and protocol-relative links in each page's html, counted before the shuffle."""
    src, _ = host_and_path(F.col("url"))
    out = pages.where(F.col("html").contains("//")).select(src.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    dst, _ = host_and_path(F.concat(F.lit("http:"), F.regexp_replace("to", r"(?i)\Ahttps?:", "")))
    return out.select("src", dst.alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(hosts: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """hosts (host, good, bad: seed shares) and links to (host, trust, distrust). Every round is a written table, the last is kept."""
    out = links.groupBy("src").agg(F.sum("links").alias("all"))
    into = links.groupBy("dst").agg(F.sum("links").alias("all"))
    along = links.join(out, "src").select("src", "dst", (F.col("links") / F.col("all")).alias("forward"))
    edges = store(along.join(links.join(into, "dst").select("src", "dst", (F.col("links") / F.col("all")).alias("backward")), ["src", "dst"]), "edges")
    if edges.isEmpty():
        return store(hosts.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust")), "rank")
    ends = edges.select(F.col("src").alias("host"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1))).groupBy("host").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    seeds = hosts.join(ends, "host", "full").select("host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad"), (F.coalesce("o", F.lit(0)) == 1).alias("leaves"), (F.coalesce("i", F.lit(0)) == 1).alias("entered"))
    rank = store(seeds.withColumn("trust", F.col("good")).withColumn("distrust", F.col("bad")).withColumn("moved", F.lit(1.0)), "rank")
    for _ in range(rounds):
        lost, lost_back, moved = rank.agg(F.sum(F.when(~F.col("leaves"), F.col("trust"))), F.sum(F.when(~F.col("entered"), F.col("distrust"))), F.sum("moved")).first()
        if moved < tolerance:
            break
        trust = edges.join(rank, edges.src == rank.host).select(F.col("dst").alias("host"), (F.col("trust") * F.col("forward")).alias("t"), F.lit(0.0).alias("d"))
        distrust = edges.join(rank, edges.dst == rank.host).select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("backward")).alias("d"))
        came = trust.union(distrust).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        mixed = lambda seed, part, back: (1 - damping) * F.col(seed) + damping * (F.coalesce(part, F.lit(0.0)) + F.lit(float(back or 0.0)) * F.col(seed))
        fresh = rank.join(came, "host", "left").withColumn("t", mixed("good", F.col("t"), lost)).withColumn("d", mixed("bad", F.col("d"), lost_back))
        fresh = fresh.withColumn("moved", F.abs(F.col("t") - F.col("trust")) + F.abs(F.col("d") - F.col("distrust")))
        last, rank = rank, store(fresh.select("host", "good", "bad", "leaves", "entered", F.col("t").alias("trust"), F.col("d").alias("distrust"), "moved"), "rank")
        forget(last)
    return rank.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, ratio: float = RATIO) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    Null urls and urls without ``://`` have empty host and path, fit no rule and are allowed. Null html has no links.
    Repeated rows are judged each; seeds are shares of pages, so they count as often as they occur. An empty table
    gives none.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = store(base.withColumn("rule", name).withColumn("by_rule", verdict), "judged")
    seeds = base.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("by_rule") == "allow", 1)).alias("a"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("b"))
    mostly = lambda c: F.when(F.col(c) * 2 > F.col("n"), F.col(c)).otherwise(0)
    seeds = store(seeds.select("host", mostly("a").alias("a"), mostly("b").alias("b")), "seeds")
    allowed, blocked = seeds.agg(F.sum("a"), F.sum("b")).first()
    seeds = seeds.select("host", (F.col("a") / F.lit(float(allowed or 1))).alias("good"), (F.col("b") / F.lit(float(blocked or 1))).alias("bad"))
    rank = propagate(seeds, store(host_links(pages), "links"), rounds)
    bad = F.col("distrust") > F.greatest(F.col("trust") * ratio, F.lit(FLOOR))
    joined = base.join(rank, "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
