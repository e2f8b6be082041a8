"""Order MinHash fingerprints with DataFrame functions only.

A text is cut into tokens (words, long ones in pieces of ``TOKEN_CHARS`` characters, so that unspaced texts have tokens
too); its k-mers are runs of ``KMER`` tokens. Repeated k-mers are numbered by occurrence, so every one counts. For each
of ``SLOTS`` random orders over all of them the ``TUPLE`` least are put back into text order and hashed together. Two
texts agree in a slot if they have the same k-mers in the same order there, which follows the edit distance rather than
the set of k-mers.

The orders are those of ``HASHES`` independent hash functions, each read from ``TURNS`` starting points around the circle of
its values: a k-mer's rank is how far its hash lies beyond the start. Every one is a uniformly random order of all
k-mers, as for one-permutation hashing with rotation; one sort serves ``TURNS`` of them.

Null and empty texts have the empty fingerprint: alike to each other (1) and to nothing else (0).
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import store

TOKEN_CHARS = 64
KMER = 2
TUPLE = 2
HASHES = 4
TURN_BITS = 3
TURNS = 1 << TURN_BITS
SLOTS = HASHES * TURNS
POSITION_BITS = 26
_POSITION = (1 << POSITION_BITS) - 1
_START = (1 << 64 - TURN_BITS) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hash_masks(hashes: int = HASHES) -> list[int]:
    """Masks that make hash functions by rule: XXH64 of ``order 0``, ``order 1``, ..., as signed longs."""
    return [_signed(xxhash.xxh64_intdigest(f"order {j}")) for j in range(hashes)]


def turn_starts() -> list[int]:
    """The starting points, ascending as signed longs."""
    return [(k - TURNS // 2) << 64 - TURN_BITS for k in range(TURNS)]


def with_signature(df: DataFrame, text: str, out: str, hashes: int = HASHES) -> DataFrame:
    """``df`` with column ``out``: an array of one long per slot, empty for null, empty and blank texts.

    Each step is a column of its own, and is used at least twice by the next, so that Catalyst keeps it as one value
    and doesn't put the whole expression into the lambdas. A k-mer is its hash with its place in the low bits, from 1;
    places of texts of over 2 ** ``POSITION_BITS`` tokens begin again.
    """
    t, v, d, b = (f"__{out}_{x}" for x in "tvdb")
    high, low = F.lit(~_POSITION).cast("long"), F.lit(_POSITION).cast("long")

    def hash_of(x: Column) -> Column:
        return x.bitwiseAND(high)

    def place_of(x: Column) -> Column:
        return x.bitwiseAND(low)

    ends = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    pieces = F.regexp_replace(ends, r"([^\x20\x09-\x0D]{%d})(?=[^\x20\x09-\x0D])" % TOKEN_CHARS, "$1 ")
    cut = F.when(ends.rlike(r"[^\x20\x09-\x0D]{%d}" % (TOKEN_CHARS + 1)), pieces).otherwise(ends)
    tokens = F.when(F.length(ends) > 0, F.split(cut, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    n = F.size(t)
    positions = F.when(n >= KMER, F.sequence(F.lit(0), n - KMER)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    kmers = F.sort_array(F.transform(positions, lambda i: F.xxhash64(*[F.get(F.col(t), i + j) for j in range(KMER)]).bitwiseAND(high).bitwiseOR((i % _POSITION + 1).cast("long"))))
    again = F.filter(F.col(v), lambda x, i: (i > 0) & (hash_of(F.coalesce(F.get(F.col(v), i - 1), F.lit(0))) == hash_of(x)))
    first = F.filter(F.col(v), lambda x, i: (i == 0) | (hash_of(F.coalesce(F.get(F.col(v), i - 1), F.lit(0))) != hash_of(x)))
    # Occurrences 1, 2, ... of a k-mer: the runs of equal hashes among the repeats, which are still sorted.
    starts = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda i: (i == 0) | (hash_of(F.coalesce(F.get(F.col(d), i - 1), F.lit(0))) != hash_of(F.get(F.col(d), i))))
    stops = F.concat(F.slice(F.col(f"{d}s"), 2, F.size(d)), F.array(F.size(d)))
    numbered = F.flatten(
        F.zip_with(
            F.col(f"{d}s"),
            F.col(f"{d}e"),
            lambda a, e: F.transform(F.slice(F.col(d), a + 1, e - a), lambda x, i: F.xxhash64(hash_of(x), i + 1).bitwiseAND(high).bitwiseOR(place_of(x))),
        )
    )
    every = F.when(F.size(d) > 0, F.concat(first, F.col(f"{d}n"))).otherwise(F.col(v))
    cuts = F.array(*[F.lit(x).cast("long") for x in turn_starts()])

    def circle(mask: int) -> Column:
        """All k-mers by their hash under ``mask``, among them the starting points."""
        return F.sort_array(F.concat(cuts, F.transform(F.col(b), lambda x: F.xxhash64(hash_of(x).bitwiseXOR(F.lit(mask))).bitwiseAND(high).bitwiseOR(place_of(x)))))

    def slot(ring: Column, start: int, number: int) -> Column:
        """The ``TUPLE`` least k-mers from ``start`` on, in text order, as one hash; starting points on the way are no k-mers."""
        ahead = F.slice(ring, F.array_position(ring, F.lit(start)).cast("int") + 1, TUPLE + TURNS)
        least = F.slice(F.filter(ahead, lambda x: x.bitwiseAND(F.lit(_START)) != 0), 1, F.least(F.size(b), F.lit(TUPLE)))
        ordered = F.array_sort(F.transform(least, lambda x: F.struct(place_of(x).alias("p"), hash_of(x).alias("h"))))
        return F.aggregate(ordered, F.lit(number).cast("long"), lambda s, x: F.xxhash64(s, x["h"]))

    df = df.withColumn(t, tokens).withColumn(v, kmers).withColumn(d, again)
    df = df.withColumn(f"{d}s", F.when(F.size(d) > 0, starts).otherwise(F.array().cast("array<int>")))
    df = df.withColumn(f"{d}e", stops)
    df = df.withColumn(f"{d}n", F.when(F.size(d) > 0, numbered).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(b, every)
    rings = [f"__{out}_c{k}" for k in range(hashes)]
    for ring, mask in zip(rings, hash_masks(hashes), strict=True):
        df = df.withColumn(ring, circle(mask))
    for ring in rings:
        df = df.withColumn(f"{ring}r", F.concat(ring, F.slice(F.col(ring), 1, TUPLE + TURNS)))
    slots = [slot(F.col(f"{ring}r"), start, k * TURNS + j) for k, ring in enumerate(rings) for j, start in enumerate(turn_starts())]
    df = df.withColumn(out, F.when(F.size(b) > 0, F.array(*slots)).otherwise(F.array().cast("array<bigint>")))
    return df.drop(t, v, d, f"{d}s", f"{d}e", f"{d}n", b, *rings, *(f"{ring}r" for ring in rings))


def likeness(a: Column, b: Column) -> Column:
    """Share of slots that agree, 0 to 1; two empty fingerprints: 1; one: 0."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda hit: hit))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / F.size(a))


def as_text(signature: Column) -> Column:
    """Eight hex digits a slot."""
    return F.array_join(F.transform(signature, lambda x: F.right(F.lpad(F.lower(F.hex(x)), 16, "0"), F.lit(8))), "")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id and signature of every row of ``docs``; repeated rows are kept, other columns ignored."""
    return with_signature(docs.select("doc_id", "text"), "text", "signature").select("doc_id", "signature")


def with_next(docs: DataFrame, rows_per_range: int = 500, quantiles: int = 256) -> DataFrame:
    """doc_id, text, signature, next_text and next_signature: those of the next row by ascending doc_id (null first).

    The last row is followed by the first. Rows of equal doc_id follow each other by text. Rows are dealt by ranges of
    doc_id: at most ``quantiles`` approximate quantiles, each cut evenly into so many ranges that one has about
    ``rows_per_range`` rows; every range is a window partition of its own, and a range's last row takes the first row
    of the next range that has rows.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count, low, high = base.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    wanted = max(1, count // rows_per_range)
    cuts = min(wanted, quantiles)
    bounds = []
    if cuts > 1 and low is not None:
        bounds = [int(x) for x in base.approxQuantile("doc_id", [k / cuts for k in range(1, cuts)], 0.2 / cuts)]
    bounds = sorted({low or 0, *bounds, (high or 0) + 1})
    edges = F.array(*[F.lit(x).cast("long") for x in bounds])
    inner = -(-wanted // cuts)
    place = F.size(F.filter(edges, lambda x: x <= F.col("doc_id")))
    start, stop = F.get(edges, F.col("place") - 1), F.get(edges, F.col("place"))
    part = F.floor((F.col("doc_id") - start) * inner / (stop - start))
    dealt = base.withColumn("place", F.when(F.col("doc_id").isNull(), -1).otherwise(place))
    dealt = dealt.withColumn("bucket", F.when(F.col("place") < 0, -1).otherwise(F.col("place") * inner + part).cast("long")).drop("place")
    heads = store(dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("head")).select("bucket", "head.text"), "heads")
    heads = with_signature(heads, "text", "signature")
    order = Window.orderBy("bucket")
    ends = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("bucket").select("bucket", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(ends)).alias("after"))
    heads = after.join(heads.select(F.col("bucket").alias("after"), F.col("text").alias("head_text"), F.col("signature").alias("head_signature")), "after")
    inside = Window.partitionBy("bucket").orderBy("doc_id", "text")
    linked = with_signature(dealt, "text", "signature")
    linked = linked.withColumn("last", F.lead("bucket").over(inside).isNull())
    for name in ("text", "signature"):
        linked = linked.withColumn(f"next_{name}", F.lead(name).over(inside))
    linked = linked.join(heads.drop("after"), "bucket")
    pick = lambda name: F.when(F.col("last"), F.col(f"head_{name}")).otherwise(F.col(f"next_{name}")).alias(f"next_{name}")
    return linked.select("doc_id", "text", "signature", pick("text"), pick("signature"))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/2) characters replaced by as many first ones of ``following``, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its fingerprint, that of its edited text (see ``edited``) and how alike they and the next row's are.

    Nulls count as empty texts; an empty table gives none; a single row follows itself. Columns besides doc_id and
    text are ignored.
    """
    rows = with_next(docs).withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "edited_text", "signature", "next_signature")
    rows = with_signature(rows, "edited_text", "edited_signature")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
