"""SimHash near-duplicates: pivot distance tables, coordinate pruning and verification.

Fingerprints are compared through a table of their Hamming distances to fixed reference fingerprints (pivots). By the
triangle inequality two fingerprints at distance r differ by at most r in every coordinate, so a pair whose largest
coordinate difference is above r is discarded without comparing it; the rest are verified.

Which pairs meet at all: the 64 bits are four blocks of 16. A pair at distance 2 or less agrees on at least two whole
blocks, so pairs meet in one of six tables keyed by two blocks. Buckets of more than ``bucket_limit`` different
fingerprints are not paired: their members are linked by an exact linear way, through every fingerprint at distance 1
or less of them (two fingerprints are within 2 bits exactly if they share such a neighbour).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import small_batches, store

MAX_DISTANCE = 2
PIVOTS = 16
BUCKET_LIMIT = 24

_OFFSETS = np.arange(8, dtype=np.int64) * 256
_BITS = np.array([[value >> bit & 1 for bit in range(8)] for value in range(256)], dtype=np.float64)
_PLACES = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle, A-Z lower-cased, repeats included; fewer words: of all of them together."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - n] if n > 1 else ends - lengths
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist(), strict=True)], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half the hashes; no hashes: zero."""
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS
    counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int((_PLACES * (counts.ravel() * 2 > len(hashes))).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """doc_id and fp (the 64-bit fingerprint as a signed long) per row of ``docs``; null and blank texts: 0."""
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.array([simhash(shingle_hashes(t.as_py(), ngram)) for t in part.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, fp long")


def pivot_values(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints by rule: XXH64 of ``pivot 0``, ``pivot 1``, ..., as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"pivot {i}")).astype(np.int64)) for i in range(count)]


def distance_table(fp: Column, pivots: list[int]) -> Column:
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("tinyint") for p in pivots])


def within(a: Column, b: Column, coordinates: int, most: int) -> Column:
    """Largest coordinate difference is at most ``most``."""
    return F.greatest(*[F.abs(a[i] - b[i]) for i in range(coordinates)]) <= most


def _keys() -> Column:
    masks = [sum(0xFFFF << 16 * block for block in pair) for pair in combinations(range(4), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])).alias("k")


def links(distinct: DataFrame, pivots: int = PIVOTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (src, dst) between the different fingerprints of column ``fp`` that differ in at most 2 bits.

    All links between fingerprints of buckets within the limit; for larger buckets as many as connect the same
    fingerprints. Linear in the number of fingerprints for any size of group.
    """
    refs = pivot_values(pivots)
    keyed = distinct.select("fp", _keys()).select("fp", "k.t", "k.key")
    sizes = store(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = store(keyed.join(sizes, ["t", "key"]).select("t", "key", "n", "fp", distance_table(F.col("fp"), refs).alias("d")), "members")
    small = members.where(F.col("n") <= bucket_limit)
    a, b = small.alias("a"), small.alias("b")
    survivors = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & within(F.col("a.d"), F.col("b.d"), pivots, MAX_DISTANCE))
    found = survivors.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_DISTANCE).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    crowd = members.where(F.col("n") > bucket_limit).select("fp").distinct()
    ones = [0, *[1 << i for i in range(63)], -(1 << 63)]
    balls = crowd.select("fp", F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in ones]), lambda x: F.col("fp").bitwiseXOR(x))).alias("z"))
    centres = store(balls.groupBy("z").agg(F.min("fp").alias("dst"), F.max("fp").alias("most")).where("dst < most").select("z", "dst"), "balls")
    linked = balls.join(centres, "z").where("fp <> dst").select(F.col("fp").alias("src"), "dst")
    return found.union(linked).distinct()


def near_duplicates(docs: DataFrame, ngram: int = 3, pivots: int = PIVOTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fp and component_id, the smallest doc_id its fingerprint reaches by links.

    Null and blank texts have fingerprint 0 and are linked like any other. Rows of equal id are all kept; a row without
    an id takes part and has the component of its fingerprint (null if no row there has an id). Other columns are
    ignored; an empty table gives none.
    """
    prints = store(fingerprints(docs, ngram), "fingerprints")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least_doc")), "distinct")
    joined = connected_components(links(distinct, pivots, bucket_limit))
    grouped = distinct.join(joined, distinct.fp == joined.id)
    least = store(grouped.groupBy("component").agg(F.min("least_doc").alias("component_id")), "least")
    named = joined.join(least, "component").select(F.col("id").alias("fp"), "component_id")
    named = store(distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least_doc").alias("component_id")), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
