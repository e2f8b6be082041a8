import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from quarrylens.llm import order_minhash as om

HIGH = ~om._POSITION & (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def long_hash(x, seed):
    return xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)


def int_hash(x, seed):
    return xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)


def tokens(text):
    return [w[k : k + om.TOKEN_CHARS] for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for k in range(0, len(w), om.TOKEN_CHARS)]


def test_slots_follow_the_definition(spark):
    """Each slot: of all occurrence-numbered k-mers the two least of its order, in text order, by brute force from the k-mers' hashes."""
    texts = ["a b c a b c a b d", "x", "", None, "  \t", "one two three four five six " * 30, "ü" * 300 + " end", "a b", "b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in om.signatures(df).collect()}
    pairs = sorted({tuple(t[i : i + 2]) for t in map(tokens, texts) for i in range(max(1, len(t) - 1)) if t})
    rows = [(k, p[0], p[1] if len(p) > 1 else None) for k, p in enumerate(pairs)]
    table = {pairs[r[0]]: r[1] & (1 << 64) - 1 for r in spark.createDataFrame(rows, "k int, a string, b string").select("k", F.xxhash64("a", "b")).collect()}
    numbers = {(h, o): v & (1 << 64) - 1 for h, o, v in spark.createDataFrame([(signed(h & HIGH), o) for h in table.values() for o in range(1, 61)], "h long, o int").select("h", "o", F.xxhash64("h", "o")).collect()}
    for i, text in enumerate(texts):
        t = tokens(text)
        seen, kmers = {}, []
        for p in range(max(1, len(t) - 1) if t else 0):
            h = signed(table[tuple(t[p : p + 2])] & HIGH)
            o = seen[h] = seen.get(h, -1) + 1
            kmers.append(((h if o == 0 else numbers[h, o]) & HIGH, p + 1))
        want = []
        for k, mask in enumerate(om.hash_masks()):
            own = [(long_hash(h ^ mask & (1 << 64) - 1, 42) & HIGH | p) for h, p in kmers]
            for j, start in enumerate(om.turn_starts()):
                least = sorted(own, key=lambda x: (x - start) % (1 << 64))[: om.TUPLE]
                s = k * om.TURNS + j
                for x in sorted(least, key=lambda x: x & om._POSITION):
                    s = long_hash(x & HIGH, long_hash(s, 42))
                want.append(signed(s))
        assert got[i] == (want if kmers else []), text


def test_edits(spark):
    rows = [(3, "c" * 9), (1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (None, None), (2, "z"), (9, "")]
    out = om.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string").withColumn("next_text", F.lit(1))).collect()
    order = sorted(((i is not None, i or 0, t or "", i) for i, t in rows))
    want = []
    for k, (_, _, text, i) in enumerate(order):
        half = len(text) // 2
        new = text[: len(text) - half] + order[(k + 1) % len(order)][2][:half]
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest()))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=key) == sorted(want, key=key)
    same = {r.doc_id: r for r in out if r.n_chars == 35}
    assert same[1].fingerprint == same[2].fingerprint and same[1].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_ranges_follow_each_other(spark):
    df = spark.range(0, 5000, 7).select((F.col("id") * F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = om.with_next(df, rows_per_range=10, quantiles=8).select("doc_id", "text", "next_text").orderBy("doc_id").collect()
    for k, row in enumerate(got):
        assert row.next_text == got[(k + 1) % len(got)].text
    assert om.with_next(df.limit(0)).count() == 0


def test_order_matters(spark):
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[30:] + words[:30]))], "doc_id long, text string")
    a, b = [r[1] for r in om.signatures(df).orderBy("doc_id").collect()]
    assert 0.2 < sum(x == y for x, y in zip(a, b)) / len(a) < 0.95


def test_likeness_falls_with_the_edit_distance(spark):
    """Two equal k-mers in equal order per slot: likeness near the square of the share of common k-mers for substitutions, over 200 texts."""
    rows = []
    for i in range(200):
        words = [f"w{i}n{k}" for k in range(200)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join("x" if k % 20 == 7 else w for k, w in enumerate(words))), (3 * i + 2, " ".join("x" if k % 5 == 2 else w for k, w in enumerate(words)))]
    got = {r[0]: r[1] for r in om.signatures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(got[a], got[b])) / len(got[a])
    near, far = (sum(like(3 * i, 3 * i + e) for i in range(200)) / 200 for e in (1, 2))
    jaccard = lambda common: common / (2 * 199 - common)
    assert abs(near - jaccard(179) ** 2) < 0.06 and abs(far - jaccard(119) ** 2) < 0.06
