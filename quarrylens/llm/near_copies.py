"""Near copies by SimHash, then by word shingles: an exact set join for what fingerprints miss, the Jaccard index to verify.

A link is a pair of texts whose sets of five-word shingles have a Jaccard index of ``LEAST`` or more. First come the pairs
that SimHash links (pivot distance tables, coordinate pruning, 2 bits or fewer apart, as in ``simhash``); those whose sets
verify are links. Many links are further apart than 2 bits, so the set join follows for all pairs that aren't linked yet.
Two sets that are a link share one of the first n - ceil(LEAST * n) + 1 of their n shingles in any order all texts share, so the pairs that
meet in a bucket of such a shingle and pass the length bound are all that can be links. The order puts the shingles
last that are common in a sample of texts; the sample decides how many pairs meet, never which links are found.
What two sets share stands at or after their first common shingle, so a bucket pairs two members only if enough of
both sets is left from its shingle on; the bucket of the first common one always does that for a link.

Each set also has a parity sketch: bit i is the parity of the number of its shingles whose hash is i modulo the length.
Two sketches differ in no more bits than the sets have elements in only one of them, and a link allows
(1 - LEAST) / (1 + LEAST) of both sizes together for these. So a pair with more differing bits is no link, and only the
sets of the remaining pairs are fetched and compared; the sketch is about a sixtieth of a set.

Texts with equal sets are one class. Buckets of up to ``BUCKET_LIMIT`` classes are paired in full. In larger ones, which
large groups of near copies make, every member is first verified against two members all have in common, then those not yet linked against
``HUBS`` more, which links most of a group by a number of pairs linear in its size. Then all pairs of members not yet in one component are
compared by sketch, in tiles of ``TILE``, and verified: a pair is left out only if its texts are linked through others already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import connected_components
from .shared import forget, free_shuffles, small_batches, store
from .simhash import shingle_hashes

NGRAM = 5
SIMHASH_NGRAM = 3
LEAST = 0.8
BUCKET_LIMIT = 8
TILE = 1024
STARS = 2
HUBS = 8
SHORTEST_SKETCH = 512
ORDER_TEXTS = 20_000
ORDER_SHINGLES = 1 << 17


def shingle_set(text: str | None, ngram: int = NGRAM) -> np.ndarray:
    return np.unique(shingle_hashes(text, ngram))


def common_shingles(docs: DataFrame, ngram: int = NGRAM, texts: int = ORDER_TEXTS, most: int = ORDER_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent shingles of about ``texts`` texts, sorted, and their counts. They only set an order."""
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingle_set(t.as_py(), ngram) for t in part.column("text")]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["s"])

    rows = docs.select(F.col("text").cast("string"))
    share = min(1.0, texts / max(1, rows.count()))
    picked = rows.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))
    seen = picked.mapInArrow(batches, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(most).collect()
    hashes = np.array([r.s for r in seen], dtype=np.int64).view(np.uint64)
    places = np.argsort(hashes)
    return hashes[places], np.array([r.n for r in seen], dtype=np.int64)[places]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float = LEAST) -> np.ndarray:
    """The first shingles in the shared order; sets with a Jaccard index of ``least`` or more have one of them in common."""
    if not len(shingles):
        return shingles
    hashes, counts = common
    level = np.zeros(len(shingles), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
        level = np.where(hashes[at] == shingles, counts[at], 0)
    length = len(shingles) - int(np.ceil(least * len(shingles) - 1e-9)) + 1
    return shingles[np.lexsort((shingles, level))[:length]]


def sketch(shingles: np.ndarray) -> bytes:
    """Parity sketch of a set: as many bits as it has elements, rounded up to a power of two, ``SHORTEST_SKETCH`` at least."""
    bits = max(SHORTEST_SKETCH, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(value: int, bits: int, to: int) -> int:
    """A sketch of ``bits`` as the shorter one of ``to`` bits."""
    while bits > to:
        bits //= 2
        value = value >> bits ^ value & (1 << bits) - 1
    return value


def short_sketch(sketch: bytes) -> np.ndarray:
    """The sketch folded to ``SHORTEST_SKETCH`` bits, as longs."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.int64).reshape(-1, SHORTEST_SKETCH // 64), axis=0)


def most_apart(a: int, b: int, least: float) -> float:
    """Number of elements that may be in only one of two sets of ``a`` and ``b`` elements that are a link."""
    return (1 - least) / (1 + least) * (a + b) + 1e-6


def prints(docs: DataFrame, ngram: int = NGRAM, least: float = LEAST) -> DataFrame:
    """doc_id, h (hash of the text) and of each text g (hash of its shingle set), size of the set, SimHash fingerprint fp, sketch and keys (its prefix)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, ngram))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            sets = [shingle_set(t.as_py(), ngram) for t in part.column("text")]
            own = [np.int64(h) if not len(s) else np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64) for s, h in zip(sets, part.column("h").to_pylist(), strict=True)]
            keys = pa.array([prefix(s, sent.value, least).view(np.int64) for s in sets], pa.list_(pa.int64()))
            fps = np.array([simhash.simhash(shingle_hashes(t.as_py(), SIMHASH_NGRAM)) for t in part.column("text")], np.uint64).view(np.int64)
            columns = [part.column("doc_id"), part.column("h"), pa.array(own, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps), pa.array([sketch(s) for s in sets], pa.binary()), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "g", "size", "fp", "sketch", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    return rows.mapInArrow(batches, "doc_id long, h long, g long, size int, fp long, sketch binary, keys array<long>")


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``classes`` (h, size, fp) that SimHash links: of equal fingerprints with the least text, of linked ones their least texts."""
    texts = classes.where("size > 0").select("h", "fp")
    least = store(texts.groupBy("fp").agg(F.min("h").alias("hub")), "fingerprints")
    equal = texts.join(least, "fp").where("h <> hub").select(*_in_order(F.col("h"), F.col("hub")))
    side = lambda s: least.select(F.col("fp").alias(s), F.col("hub").alias(f"hub_{s}"))
    linked = simhash.links(least.select("fp")).join(side("src"), "src").join(side("dst"), "dst").select(*_in_order(F.col("hub_src"), F.col("hub_dst")))
    return equal.union(linked).distinct()


def unlinked(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that are not in one component of ``linked`` (id, component)."""
    side = lambda s: linked.select(F.col("id").alias(s), F.col("component").alias(f"c{s}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def buckets(classes: DataFrame) -> DataFrame:
    """key, h, size, place (of the key in the prefix) and n (members) for each prefix shingle that several of ``classes`` (h, size, keys) have."""
    keyed = classes.select("h", "size", F.posexplode("keys").alias("place", "key"))
    counts = store(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    free_shuffles(classes.sparkSession)
    members = store(keyed.hint("merge").join(counts, "key"), "members")
    forget(counts)
    free_shuffles(classes.sparkSession)
    return members


def _alike(a: Column, b: Column, least: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(least) - F.lit(1e-9)


def _enough_left(least: float) -> Column:
    """Whether rows a and b of a bucket may share as many shingles, from the bucket's own on, as a link of their sizes needs."""
    left = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    return left >= (F.col("a.size") + F.col("b.size")) * F.lit(least / (1 + least)) - F.lit(1e-6)


def _in_order(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def first_pairs(members: DataFrame, least: float = LEAST) -> DataFrame:
    """All pairs (a, b) of buckets within ``BUCKET_LIMIT``, and of the larger ones those with their least and greatest member."""
    small, crowd = members.where(F.col("n") <= BUCKET_LIMIT), members.where(F.col("n") > BUCKET_LIMIT)
    a, b = small.alias("a"), small.alias("b")
    found = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.h") < F.col("b.h")) & _alike(F.col("a.size"), F.col("b.size"), least) & _enough_left(least)).select(F.col("a.h").alias("a"), F.col("b.h").alias("b"))
    hubs = crowd.groupBy("key").agg(F.array(F.min("h"), F.max("h")).alias("hubs"))
    stars = crowd.select("key", "h").hint("merge").join(hubs, "key").select("h", F.explode("hubs").alias("hub")).where("h <> hub")
    return found.union(stars.select(*_in_order(F.col("h"), F.col("hub")))).distinct()


def unsettled(members: DataFrame, linked: DataFrame, turn: int) -> DataFrame:
    """Members of crowded buckets that hold several components: key, h, size, place, c (component), n and ``HUBS`` members as hubs (h, c)."""
    crowd = members.where(F.col("n") > BUCKET_LIMIT).select("key", "h", "size", "place").join(linked, F.col("h") == linked.id, "left").select("key", "h", "size", "place", F.coalesce("component", "h").alias("c"))
    crowd = store(crowd, "crowd")
    hubs = F.array(*[F.min(F.struct(F.xxhash64("h", F.lit(turn * HUBS + k)).alias("x"), "h", "c")) for k in range(HUBS)])
    several = crowd.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.array_distinct(hubs).alias("hubs")).where("low < high")
    several = store(several.select("key", "n", F.transform("hubs", lambda x: F.struct(x["h"].alias("h"), x["c"].alias("c"))).alias("hubs")), "several")
    rest = store(crowd.hint("merge").join(several, "key"), "unsettled")
    forget(crowd, several)
    return rest


def cross_pairs(rest: DataFrame, sketches: DataFrame, least: float = LEAST) -> DataFrame:
    """All pairs (a, b) of a bucket whose components differ and whose sizes, places of the key and short sketches allow a link; buckets are joined in tiles."""
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rest = rest.hint("merge").join(sketches.select(F.col("h").alias("own"), "short"), F.col("h") == F.col("own"))
    rest = store(rest.select("key", "h", "size", "place", "c", "n", *[F.col("short")[k].alias(f"s{k}") for k in range(SHORTEST_SKETCH // 64)]), "rest")
    a = rest.withColumn("tile", F.pmod(F.xxhash64("h", "key"), tiles).cast("int")).alias("a")
    b = rest.withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1))).alias("b")
    apart = sum(F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in range(SHORTEST_SKETCH // 64))
    near = apart <= (F.col("a.size") + F.col("b.size")) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6)
    fits = (F.col("a.h") < F.col("b.h")) & (F.col("a.c") != F.col("b.c")) & _alike(F.col("a.size"), F.col("b.size"), least) & _enough_left(least) & near
    joined = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.tile") == F.col("b.tile")) & fits)
    return joined.select(F.col("a.h").alias("a"), F.col("b.h").alias("b")).distinct()


def sieved(pairs: DataFrame, sketches: DataFrame, least: float = LEAST) -> DataFrame:
    """The ``pairs`` (a, b) whose sketches allow a link."""

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for x, y, m, n in zip(*(part.column(c).to_pylist() for c in ("xa", "xb", "na", "nb")), strict=True):
                bits = 8 * min(len(x), len(y))
                apart = (folded(int.from_bytes(x, "little"), 8 * len(x), bits) ^ folded(int.from_bytes(y, "little"), 8 * len(y), bits)).bit_count()
                keep.append(min(m, n) >= least * max(m, n) - 1e-9 and apart <= most_apart(m, n, least))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: sketches.select(F.col("h").alias(s), F.col("sketch").alias(f"x{s}"), F.col("size").alias(f"n{s}"))
    joined = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    return joined.select("a", "b", "xa", "xb", "na", "nb").mapInArrow(near, "a long, b long")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, component) of the texts (hashes) of ``classes`` that have links: what all links connect, SimHash's first."""
    sketches = classes.select("h", "doc_id", "size", "sketch", "short")

    def verify(pairs: DataFrame) -> DataFrame:
        near = store(sieved(pairs, sketches), "pairs")
        wanted = near.select(F.col("a").alias("h")).union(near.select(F.col("b").alias("h"))).distinct()
        sets = shingle_sets(docs, wanted.join(sketches.select("h", "doc_id"), "h"))
        found = store(verified(sets, near), "links")
        forget(near, sets)
        return found

    found = verify(simhash_pairs(classes))
    linked = connected_components(found)
    members = buckets(classes)
    found = store(found.union(verify(unlinked(first_pairs(members), linked))), "links")
    forget(linked)
    linked = connected_components(found)
    for turn in range(STARS):
        rest = unsettled(members, linked, turn)
        if rest.isEmpty():
            break
        if turn < STARS - 1:
            more = rest.select("h", "c", F.explode("hubs").alias("hub")).where("c <> hub.c").select(*_in_order(F.col("h"), F.col("hub.h"))).distinct()
        else:
            more = cross_pairs(rest, sketches)
        found = store(found.union(verify(more)), "links")
        forget(rest, linked)
        linked = connected_components(found)
        free_shuffles(docs.sparkSession)
    forget(members)
    return linked


def bitmap(hashes: DataFrame, least: int = 1 << 16, most: int = 1 << 26) -> np.ndarray:
    """Bits by the lowest bits of the column ``h``: 32 for each row, but at most ``most``, 8 MB, whatever the table's size.

    Only a sieve: a set bit may be another row's, so what it lets pass is joined. Where it is full, all rows pass.
    """
    bits = min(most, max(least, 1 << (32 * hashes.count()).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = hashes.groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("b"))
    out = np.zeros(bits // 64, dtype=np.int64)
    for row in words.toLocalIterator():
        out[row.w] = row.b
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool) if bits <= 1 << 20 else out


def hits(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    if sieve.dtype == bool:
        return sieve[h & (len(sieve) - 1)]
    place = h & (len(sieve) * 64 - 1)
    return (sieve[place >> 6] >> (place & 63) & 1).astype(bool)


def sifted(rows: DataFrame, column: str, sieve: np.ndarray, keep: bool = True) -> DataFrame:
    """The rows whose ``column`` hits the sieve (or doesn't), without a shuffle."""
    sent = rows.sparkSession.sparkContext.broadcast(sieve)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(hits(sent.value, part.column(column).to_numpy()) == keep))

    return rows.mapInArrow(batches, rows.schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """h and s (the shingle set, as octets) of the texts whose hash is in ``wanted`` (h, doc_id: a row that has the text)."""
    wanted = store(wanted.select("h", F.xxhash64("doc_id", "h").alias("x")), "wanted")
    hashed = docs.select(F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    hashed = hashed.select("h", F.xxhash64("doc_id", "h").alias("x"), "text")
    texts = sifted(hashed, "x", bitmap(wanted.select(F.col("x").alias("h")))).hint("merge").join(wanted, ["x", "h"], "left_semi").groupBy("h").agg(F.first("text").alias("text"))

    def shingles(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column("h"), pa.array([shingle_set(t.as_py(), ngram).tobytes() for t in part.column("text")], pa.binary())], names=["h", "s"])

    found = store(texts.mapInArrow(shingles, "h long, s binary"), "shingles")
    forget(wanted)
    return found


def verified(sets: DataFrame, pairs: DataFrame, least: float = LEAST) -> DataFrame:
    """The ``pairs`` (a, b) whose shingle sets have a Jaccard index of ``least`` or more, as (src, dst)."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for x, y in zip(part.column("sa"), part.column("sb"), strict=True):
                a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and both / (len(a) + len(b) - both) >= least)
            yield part.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.hint("merge").join(sets.select(F.col("h").alias("a"), F.col("s").alias("sa")), "a").hint("merge").join(sets.select(F.col("h").alias("b"), F.col("s").alias("sb")), "b")
    return joined.select(F.col("a").alias("src"), F.col("b").alias("dst"), "sa", "sb").mapInArrow(compare, "src long, dst long")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, h and group (a text hash, the same for all texts it reaches) per row of ``docs``; equal texts share a group."""
    found = store(prints(docs), "prints")
    one = found.groupBy("g").agg(F.min(F.struct("h", "doc_id", "fp")).alias("x"), F.first(F.struct("size", "sketch", "keys")).alias("y")).select("g", "x.*", "y.*")

    def shortened(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.append_column("short", pa.array([short_sketch(x) for x in part.column("sketch").to_pylist()], pa.list_(pa.int64())))

    classes = store(one.mapInArrow(shortened, "g long, h long, doc_id long, fp long, size int, sketch binary, keys array<long>, short array<long>"), "classes")
    ids = store(found.select("doc_id", "h", "g"), "ids")
    forget(found)
    free_shuffles(docs.sparkSession)
    linked = links(docs, classes)
    named = store(classes.select("g", F.col("h").alias("least")).join(linked, F.col("least") == linked.id, "left").select("g", F.coalesce("component", "least").alias("group")), "named")
    forget(classes)
    return ids.join(named, "g").select("doc_id", "h", "group")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies of ``docs``, that with the smallest doc_id; all columns kept.

    Texts of under five words are near copies only of texts with the same words; null texts are one group, empty ones
    another. A row without id stays only where its whole group has none. Of rows that are equal in id and text one
    stays. An empty table gives none.
    """
    known = store(groups(docs), "groups")
    stays = known.groupBy("group").agg(F.min("doc_id").alias("stays"), F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first"))
    stays = store(stays.where("n > 1").select("group", "first.doc_id", "first.h"), "stays")
    keep = stays.select("group", F.col("doc_id").alias("stay_id"), F.col("h").alias("stay_h"))
    lost = known.join(keep, "group").where(~(F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("h") == F.col("stay_h")))).select(F.xxhash64("doc_id", "h").alias("lost_x"), F.col("doc_id").alias("lost_id"), F.col("h").alias("lost_h")).distinct()
    lost = store(lost, "lost")
    names = docs.columns
    own_h, own_x = _unused(names, "h"), _unused(names, "x")
    rows = docs.withColumn(own_h, F.xxhash64(F.col("text").cast("string")))
    rows = rows.withColumn(own_x, F.xxhash64(F.col("doc_id").cast("long"), own_h))
    sieve = bitmap(lost.select(F.col("lost_x").alias("h")))
    doubtful = sifted(rows, own_x, sieve)
    doubtful = doubtful.hint("merge").join(lost, (doubtful[own_x] == lost.lost_x) & (doubtful[own_h] == lost.lost_h) & doubtful.doc_id.eqNullSafe(lost.lost_id), "left_anti")
    left = sifted(rows, own_x, sieve, keep=False).union(doubtful)
    again = store(known.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again_id"), F.col("h").alias("again_h")), "again")
    if again.isEmpty():
        return left.select(*names)
    same = (F.col(own_h) == again.again_h) & F.col("doc_id").eqNullSafe(again.again_id)
    return left.join(again, same, "left_anti").union(left.join(again, same, "left_semi").dropDuplicates(["doc_id", own_h])).select(*names)


def _unused(names: list[str], stem: str) -> str:
    """A column name that none of ``names`` is."""
    taken = {n.lower() for n in names}
    return next(f"{stem}_{k}" for k in range(len(names) + 1) if f"{stem}_{k}" not in taken)
