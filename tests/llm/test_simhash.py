import re

import xxhash
from pyspark.sql import functions as F

from quarrylens.llm import simhash as sh


def brute(rows, n=3, most=2):
    prints = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    parent = {f: f for _, f in prints}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in list(parent):
        for b in list(parent):
            if a < b and bin(a ^ b).count("1") <= most:
                parent[top(a)] = top(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[top(f)] = min(least.get(top(f), i), i)
    return sorted((i if i is not None else -1, f"{f:016x}", least.get(top(f))) for i, f in prints)


def result(df):
    out = df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id").collect()
    return sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in out)


ROWS = [(1, "a b c d e"), (2, "A B  C\td e"), (3, None), (4, "   "), (5, "x"), (5, "x"), (None, "a b c d e"), (7, "Été à la plage où"), (8, "b " * 4000)]


def test_edge_cases_match_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    assert result(sh.near_duplicates(docs)) == brute(ROWS)


def test_empty(spark):
    assert sh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_and_crowds_agree(spark):
    base = "t%d u v w x y z " * 1
    rows = [(i, " ".join(f"w{(i // 40) * 7 + k}" for k in range(120)) + (f" tail{i % 40}" if i % 3 else "")) for i in range(240)]
    rows += [(1000 + i, base % (i % 5)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert result(sh.near_duplicates(docs, bucket_limit=1000)) == want
    assert result(sh.near_duplicates(docs, bucket_limit=2)) == want
