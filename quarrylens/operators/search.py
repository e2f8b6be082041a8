"""Inverted and trigram index tables and search in five modes over units and other surfaces."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fuzzy
from ..functions.text import WORD_RUN, let, norm_offsets, normalize, tokenize, trigrams

MODES = ("exact", "substring", "normalized", "regex", "fuzzy")
# Scores of the surfaces.
SURFACE_SCORE = {"url": 0.98, "header": 0.92, "route": 0.99, "store": 0.95, "identity": 0.96}
FUZZY_LEAST = 0.12


def norm_of(text: str) -> str:
    """The normal form of a query, as ``normalize`` makes it."""
    from ..functions.text import LOWER, SEPARATORS, UPPER

    return text.translate(str.maketrans(UPPER, LOWER, SEPARATORS))


def add_units(units: DataFrame, most: int = 320) -> DataFrame:
    """Index records from (text, resource_url, ord, ...): one per text and resource, the first by ``ord``, with norm, len and id."""
    cut = units.withColumn("text", F.substring("text", 1, most)).where(F.length("text") > 0)
    w = Window.partitionBy("text", "resource_url").orderBy("ord")
    kept = cut.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return kept.withColumn("norm", normalize(F.col("text"))).withColumn("len", F.length("text")).withColumn("id", F.xxhash64("text", "resource_url"))


def postings(records: DataFrame) -> DataFrame:
    """(token, id), to be bucketed by token."""
    return records.select("id", F.explode(F.array_distinct(tokenize(F.col("norm")))).alias("token"))


def trigram_postings(records: DataFrame) -> DataFrame:
    """(tri, id), to be bucketed by tri."""
    return records.select("id", F.explode(F.array_distinct(trigrams(F.col("norm")))).alias("tri"))


def query_tokens(query: str) -> list[str]:
    runs = re.findall("[0-9a-z\x80-\U0010ffff]+", norm_of(query))
    return [t for t in runs if 2 <= len(t) <= 64][:24]


def candidates(token_index: DataFrame, tri_index: DataFrame, query: str) -> DataFrame:
    """Ids that hold all tokens of the query (whole or as a prefix), or a quarter of its trigrams. Literal keys prune the indexes."""
    tokens, grams = sorted(set(query_tokens(query))), []
    n = norm_of(query)
    grams = sorted({n[i : i + 3] for i in range(min(len(n) - 2, 32))}) if len(n) >= 3 else ([n] if n else [])
    if not tokens:
        return tri_index.select("id").distinct()
    test = reduce(lambda a, b: a | b, [(F.col("token") == t) | (F.col("token").startswith(t) if len(t) >= 3 else F.lit(False)) for t in tokens])
    held = [F.max(F.col("token").startswith(t) if len(t) >= 3 else F.col("token") == t) for t in tokens]
    by_token = token_index.where(test).groupBy("id").agg(*[h.alias(f"t{k}") for k, h in enumerate(held)]).where(reduce(lambda a, b: a & b, [F.col(f"t{k}") for k in range(len(tokens))])).select("id")
    votes = max(1, len(grams) // 4)
    by_tri = tri_index.where(F.col("tri").isin(grams)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= votes).select("id")
    return by_token.union(by_tri).distinct()


def search(records: DataFrame, query: str, mode: str = "substring", limit: int | None = 200, scope: list[str] | None = None, around: int = 60, prefilter: bool = True) -> DataFrame:
    """Scored hits of records (text, norm, resource_url, resource_kind, ord): score, start, length, context and marks, best first.

    ``start`` and ``length`` are places in the text as it is, also where its normal form was searched; ``marks`` are
    places in ``context``. A pattern that isn't valid gives no rows, as does an empty query. Fuzzy hits are scored in Arrow
    batches, only for texts of at least the needle's length and, with ``prefilter``, with a quarter of its trigrams.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if scope is not None:
        records = records.where(F.col("resource_kind").isin(scope))
    text, low, norm = F.col("text"), F.lower("text"), norm_of(query)
    if not query or mode in ("normalized", "fuzzy") and not norm or mode == "regex" and not valid_pattern(records, query):
        hits = records.where(F.lit(False)).withColumn("score", F.lit(0.0)).withColumn("__spans", _span(F.lit(0), F.lit(0)))
    elif mode == "exact":
        hits = records.where(text.contains(query)).withColumn("score", F.lit(1.0)).withColumn("__spans", _span(F.instr("text", query) - 1, F.lit(len(query))))
    elif mode == "substring":
        hits = records.where(low.contains(query.lower())).withColumn("score", F.when(text.contains(query), 1.0).otherwise(0.92))
        hits = hits.withColumn("__spans", _span(F.instr(low, query.lower()) - 1, F.lit(len(query))))
    elif mode == "normalized":
        hits = records.where(F.col("norm").contains(norm)).withColumn("score", F.when(low.contains(query.lower()), 0.95).otherwise(0.88))
        at = F.instr("norm", norm) - 1
        hits = hits.withColumn("__spans", _spans_of_norm(F.array(F.struct(at.alias("s"), (at + len(norm)).alias("e")))))
    elif mode == "regex":
        hits = records.withColumn("__m", F.regexp_extract("text", query, 0)).where(F.length("__m") > 0).withColumn("score", F.lit(0.95))
        hits = hits.withColumn("__spans", _span(F.instr("text", F.col("__m")) - 1, F.length("__m"))).drop("__m")
    else:
        worth = F.length("norm") >= len(norm)
        grams = sorted({norm[i : i + 3] for i in range(min(len(norm) - 2, 32))})
        if prefilter and grams:
            votes = lambda n: reduce(lambda a, b: a + b, [n.contains(g).cast("int") for g in grams])
            # The filter moves below the columns of the records; so the normal form is worked out once, not for each trigram.
            worth = let(F.col("norm"), lambda n: (F.length(n) >= len(norm)) & (votes(n) >= max(1, len(grams) // 4)))
        long_enough = records.where(worth).withColumn("__f", fuzzy.fuzzy_match(F.col("norm"), norm))
        bonus = F.when(text.contains(query), 0.15).otherwise(0.0) + F.when(low.contains(query.lower()), 0.08).otherwise(0.0) + F.when(F.col("norm").startswith(norm), 0.05).otherwise(0.0)
        hits = long_enough.where(F.col("__f.score") >= FUZZY_LEAST).withColumn("score", F.round(F.least(F.lit(1.0), F.col("__f.score") + bonus), 3))
        spans = _spans_of_norm(F.col("__f.spans"))
        hits = hits.withColumn("__spans", let(spans, lambda x: F.when(F.size(x) > 0, x).otherwise(_span(F.lit(0), F.least(F.length(text), F.lit(24)))))).drop("__f")
    hits = hits.withColumn("start", F.col("__spans")[0]["s"]).withColumn("length", F.element_at("__spans", -1)["e"] - F.col("start"))
    begin = F.greatest(F.col("start") - around, F.lit(0))
    end = F.least(F.length(text), F.col("start") + F.col("length") + around)
    marks = F.transform("__spans", lambda x: F.struct((x["s"] - begin).alias("s"), (F.least(x["e"], end) - begin).alias("e")))
    hits = hits.withColumn("mode", F.lit(mode)).withColumn("context", F.substring(text, begin + 1, end - begin)).withColumn("marks", marks).drop("__spans")
    hits = hits.orderBy(F.desc("score"), "resource_url", "ord")
    return hits if limit is None else hits.limit(limit)


def _span(at: Column, length: Column) -> Column:
    return F.array(F.struct(at.cast("int").alias("s"), (at + length).cast("int").alias("e")))


def _spans_of_norm(spans: Column) -> Column:
    """Spans of ``norm`` as spans of ``text``, in order."""

    def placed(offsets: Column) -> Column:
        last = F.size(offsets) - 1
        found = F.transform(spans, lambda x: F.struct(F.get(offsets, F.greatest(x["s"], F.lit(0))).alias("s"), (F.get(offsets, F.least(last, F.greatest(x["s"], x["e"] - 1))) + 1).alias("e")))
        return F.array_sort(F.filter(found, lambda x: x["e"] > x["s"]))

    return let(norm_offsets(F.col("text")), placed)


def valid_pattern(df: DataFrame, pattern: str) -> bool:
    """Whether the JVM compiles the pattern; asked of it without touching data."""
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except IllegalArgumentException:
        return False


def parse_surface(query: str) -> tuple[str, str]:
    """``in:body x`` to (body, x); all surfaces without a prefix."""
    m = re.match(r"\s*(?:in|scope|surface):(\w+)\s+(.*)\Z", query, re.S)
    return (m[1].lower(), m[2].strip()) if m else ("all", query.strip())


def text_hits(df: DataFrame, text: Column, query: str, mode: str) -> tuple[Column, Column]:
    """(is a hit, score) of a text on a surface; fuzzy and normalised search it as a substring there."""
    if mode == "exact":
        return text.contains(query), F.lit(1.0)
    if mode == "regex":
        ok = valid_pattern(df, query)
        return (text.rlike(f"(?i){query}") if ok else F.lit(False)), F.lit(0.95)
    return F.lower(text).contains(query.lower()), F.when(text.contains(query), 1.0).otherwise(0.92)


def search_surfaces(surfaces: dict[str, DataFrame], query: str, mode: str = "substring", limit: int | None = 200) -> DataFrame:
    """One ranked table of hits over surfaces (each: text, resource_url): body, url, header, route, source, store, index.

    ``in:name`` keeps one surface; the others aren't part of the plan. One hit of each resource and context.
    """
    wanted, query = parse_surface(query)
    # Other names of surfaces.
    wanted = {"bodies": "body", "state": "store", "headers": "header", "urls": "url", "routes": "route", "sources": "source"}.get(wanted, wanted)
    parts = []
    for name, df in surfaces.items():
        if wanted not in ("all", name) or not query:
            continue
        hit, score = text_hits(df, F.col("text"), query, mode)
        own = F.lit(SURFACE_SCORE[name]) if name in SURFACE_SCORE else score
        at = F.instr(F.lower("text"), query.lower())
        context = F.substring(F.col("text"), F.greatest(at - 60, F.lit(1)), F.lit(len(query) + 120))
        parts.append(df.where(F.coalesce(hit, F.lit(False))).select(F.lit(name).alias("surface"), "resource_url", context.alias("context"), own.cast("double").alias("score")))
    if not parts:
        some = next(iter(surfaces.values()))
        return some.sparkSession.createDataFrame([], "surface string, resource_url string, context string, score double")
    w = Window.partitionBy("resource_url", "context").orderBy(F.desc("score"), "surface")
    out = reduce(DataFrame.unionByName, parts).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    out = out.orderBy(F.desc("score"), "surface", "resource_url", "context")
    return out if limit is None else out.limit(limit)


# Noncharacters, which stand around a match while its place is worked out.
OPENS, CLOSES = "\ufdd0", "\ufdd1"


def with_matches(df: DataFrame, query: str, mode: str = "substring", text: str = "text", most: int | None = None) -> DataFrame:
    """``df`` with ``matches``: (at, len, score) of the places in a text that don't overlap, at most ``most``.

    ``exact`` keeps case, ``regex`` takes a pattern, all other modes look for the query in any case. A null text has null
    matches; an empty query, an invalid pattern and matches without characters give none.
    """
    none = F.array().cast("array<struct<at:int,len:int,score:double>>")
    if not query or mode == "regex" and not valid_pattern(df, query):
        return df.withColumn("matches", F.when(F.col(text).isNotNull(), none))
    literal = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pattern = {"exact": literal, "regex": f"(?i){query}"}.get(mode, f"(?iu){literal}")
    marked = F.regexp_replace(F.translate(F.col(text), OPENS + CLOSES, "\ufffd\ufffd"), pattern, f"{OPENS}$0{CLOSES}")

    def places(parts: Column) -> Column:
        def step(acc: Column, part: Column) -> Column:
            found = F.substring_index(part, CLOSES, 1)
            score = {"exact": F.lit(1.0), "regex": F.lit(0.95)}.get(mode, F.when(found == query, 1.0).otherwise(0.92))
            one = F.struct(acc["at"].alias("at"), F.length(found).alias("len"), score.alias("score"))
            return F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        start = F.struct(F.length(parts[0]).alias("at"), none.alias("out"))
        return F.aggregate(F.slice(parts, 2, F.size(parts)), start, step, lambda acc: F.filter(acc["out"], lambda x: x["len"] > 0))

    found = F.when(F.col(text).isNotNull(), let(F.split(marked, OPENS, -1), places))
    return df.withColumn("matches", found if most is None else F.slice(found, 1, most))


def matches_in_text(text: Column, query: str, most: int | None = 10) -> Column:
    """0-based offsets of case-insensitive occurrences that don't overlap."""

    def ends(pieces: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda acc, x: acc + F.length(x))
        return F.slice(F.transform(pieces, lambda p, i: before(i) + i * len(query)), 1, F.size(pieces) - 1)

    pieces = F.split(F.lower(text), "\\Q" + query.lower() + "\\E", -1)
    return let(pieces if most is None else F.slice(pieces, 1, most + 1), ends)


class Needles:
    """Texts searched for all at once: by a hash of their first octets, then as a whole at the place found."""

    def __init__(self, texts: list[str]):
        self.places: dict[tuple[int, int], list[tuple[int, bytes]]] = defaultdict(list)
        self.always = [k for k, t in enumerate(texts) if not t]
        for k, t in enumerate(texts):
            if t:
                own = t.encode("utf-8", "surrogatepass")
                size = 32 if len(own) >= 32 else min(8, len(own))
                self.places[size, int(self._heads(own, size)[0])].append((k, own))
        self.sizes = sorted({size for size, _ in self.places})
        self.filters = {size: np.zeros(1 << 20, dtype=bool) for size in self.sizes}
        for size, head in self.places:
            self.filters[size][head & (1 << 20) - 1] = True

    @staticmethod
    def _heads(octets: bytes, size: int) -> np.ndarray:
        """A hash of the ``size`` octets from each place on."""
        n, step = len(octets) - size + 1, min(size, 8)
        raw = np.frombuffer(octets, np.uint8)
        words = np.zeros(len(octets) - step + 1, np.uint64)
        for k in range(step):
            words |= raw[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
        out = np.zeros(n, np.uint64)
        for k in range(0, size, step):
            out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def within(self, text: str) -> list[int]:
        """The numbers of the texts that ``text`` contains, ascending."""
        octets, found = text.encode("utf-8", "surrogatepass"), set(self.always)
        for size in self.sizes:
            if len(octets) < size:
                break
            heads = self._heads(octets, size)
            for at in np.flatnonzero(self.filters[size][(heads & np.uint64((1 << 20) - 1)).astype(np.int64)]).tolist():
                found.update(k for k, own in self.places.get((size, int(heads[at])), ()) if octets.startswith(own, at))
        return sorted(found)


def contained(docs: DataFrame, items: DataFrame, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id) for each row of ``docs`` (doc_id, text) and of ``items`` (item_id, text) it contains, as SQL's contains.

    The items are sent to all tasks in blocks of about ``block_chars`` characters. Repeated rows answer each; null texts
    contain nothing and are in nothing; an empty item is in every text.
    """
    docs, items = docs.where("text is not null").select("doc_id", "text"), items.where("text is not null").select("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    kind = to_arrow_type(items.schema["item_id"].dataType)
    parts = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == block).collect()
        needles, ids = Needles([r.text for r in rows]), [r.item_id for r in rows]

        def batches(found: Iterator[pa.RecordBatch], needles: Needles = needles, ids: list = ids) -> Iterator[pa.RecordBatch]:
            for part in found:
                hits = [needles.within(t) for t in part.column("text").to_pylist()]
                places = pa.array([k for k, h in enumerate(hits) for _ in h], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(places), pa.array([ids[k] for h in hits for k in h], kind)], names=["doc_id", "item_id"])

        parts.append(docs.mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"))
    return reduce(DataFrame.unionAll, parts)


__all__ = ["MODES", "WORD_RUN", "add_units", "candidates", "contained", "matches_in_text", "postings", "search", "search_surfaces", "trigram_postings", "with_matches"]
