"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Tokens are 64-bit hashes of words (A-Z lower-cased) and one end token a text. Counting: every task sums its bigrams
before the shuffle and packs them by shard of the context; a shard's task merges its packs, writes the sorted bigram
and context arrays, and passes on how many contexts each word follows. A second, smaller shuffle by shard of the word
gives the word arrays: count and continuation count. Scoring maps the arrays and looks up all bigrams of a batch at
once, so a worker's memory holds a batch and not the model.

A shard holds what falls on it by the first bits of a bigram's key: those of its context, or, for the ``HEAVY`` contexts
of a sample, of context and word together, so that a frequent context is spread over all shards. Its sums are then
those of its parts, added in the second shuffle. The sample decides only where bigrams are kept.

    P(w | u) = max(c(uw) - D(c(uw)), 0) / c(u) + (D1 N1(u) + D2 N2(u) + D3 N3+(u)) / c(u) * P(w)
    P(w)     = max(k(w) - E(k(w)), 0) / K + (E1 T1 + E2 T2 + E3 T3+) / K / (V + 1)

with k(w) the number of different words before w, K its sum, and D, E the discounts from counts of counts. An unknown
context leaves P(w); an unknown word has only the last term.
"""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, new_folder, small_batches, store

START = np.uint64(0x9E3779B97F4A7C15)
END = np.uint64(0xC2B2AE3D27D4EB4F)
SHARD_BITS = 20
FLUSH_TOKENS = 3_000_000
SHARD_CHARS = 1 << 24
HEAVY_TEXTS = 10_000
HEAVY_SHARE = 1 / 2000
_U = np.uint64


class Hashes(dict):
    """Word to hash, kept between texts; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value


def tokens_of(text: str | None, hashes: Hashes) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(hashes) > 400_000:
        hashes.clear()
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    out[-1] = END
    return out


def bigram_keys(context: np.ndarray, word: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Sortable keys: the first ``SHARD_BITS`` bits are the context's, so that its bigrams stay in its shard, unless it is ``heavy``."""
    mixed = (context * _U(0x9FB21C651E98DF25)) ^ (word + _U(0xD6E8FEB86659FD93))
    mixed ^= mixed >> _U(32)
    mixed *= _U(0xD6E8FEB86659FD93)
    mixed ^= mixed >> _U(29)
    mixed *= _U(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> _U(32)
    top = context
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, context), len(heavy) - 1)
        top = np.where(heavy[at] == context, mixed << _U(64 - SHARD_BITS), context)
    low = _U((1 << 64 - SHARD_BITS) - 1)
    return top & ~low | mixed >> _U(SHARD_BITS)


def contexts_of(tokens: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The token before each token; the start token before a text's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = START
    return before


def _npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def _save(folder: str, name: str, array: np.ndarray, attempt: int) -> None:
    target, root = fs.FileSystem.from_uri(folder)
    target.create_dir(root, recursive=True)
    with target.open_output_stream(f"{root}/{name}.{attempt}") as out:
        out.write(_npy(array))
    target.move(f"{root}/{name}.{attempt}", f"{root}/{name}.npy")


def discounts(counts: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2, 3 and more from the numbers of 1s, 2s, 3s and 4s; between 0 and the count itself."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.75, 1.0])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([0.0, *[min(max(x, 0.05), k) for k, x in enumerate(d, 1)]])


@dataclass(frozen=True)
class Model:
    folder: str
    bits: int
    train_tokens: int
    distinct: int
    continuations: int
    bigram_discounts: tuple[float, ...]
    word_discounts: tuple[float, ...]
    left: float
    heavy: tuple[int, ...] = ()

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed unigram share of tokens with these training counts."""
        return np.log10((counts + 0.5) / (self.train_tokens + 0.5 * (self.distinct + 1)))


def _pack(tokens: list[np.ndarray], bits: int, heavy: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Distinct bigrams of some texts with their counts, by shard of the context."""
    lengths = [len(t) for t in tokens]
    word = np.concatenate(tokens)
    context = contexts_of(word, lengths)
    keys, first, counts = np.unique(bigram_keys(context, word, heavy), return_index=True, return_counts=True)
    context, word = context[first], word[first]
    shards = (keys >> _U(64 - bits)).astype(np.int64)
    cuts = np.searchsorted(shards, np.arange((1 << bits) + 1))
    for shard in np.unique(shards):
        a, b = cuts[shard], cuts[shard + 1]
        order = np.argsort(context[a:b], kind="stable")
        own = context[a:b][order]
        heads, sizes = np.unique(own, return_counts=True)
        parts = [np.array([len(heads), b - a], dtype="<i8"), heads, sizes.astype("<u4"), word[a:b][order], counts[a:b][order].astype("<u4")]
        yield int(shard), b"".join(p.tobytes() for p in parts[:2]) + parts[3].tobytes() + zlib.compress(parts[2].tobytes() + parts[4].tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    heads = np.frombuffer(blob, np.uint64, n, 16)
    words = np.frombuffer(blob, np.uint64, m, 16 + 8 * n)
    rest = np.frombuffer(zlib.decompress(blob[16 + 8 * n + 8 * m :]), "<u4")
    return np.repeat(heads, rest[:n]), words, rest[n:].astype(np.int64)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, the place of one row of each, and the values' sums."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return (sorted_keys[starts], order[starts], *[np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values])


def heavy_contexts(docs: DataFrame, texts: int = HEAVY_TEXTS, share: float = HEAVY_SHARE) -> np.ndarray:
    """Sorted contexts that are ``share`` of the tokens of about ``texts`` texts or more, so at most 1 / ``share`` of them."""
    rows = docs.select(F.col("text").cast("string"))
    part = min(1.0, texts / max(1, rows.count()))
    picked = rows.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 20)) < int(part * (1 << 20)))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found = Hashes(), Counter()
        for batch in parts:
            for text in batch.column("text"):
                words, counts = np.unique(tokens_of(text.as_py(), hashes)[:-1], return_counts=True)
                found.update(dict(zip(words.tolist(), counts.tolist(), strict=True)))
                found[int(START)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), dtype=np.uint64).view(np.int64)), pa.array(list(found.values()), pa.int64())], names=["c", "n"])

    counted = picked.mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    counted = store(counted, "contexts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = counted.where(F.col("n") >= max(1.0, total * share)).collect()
    return np.sort(np.array([r.c for r in found], dtype=np.int64).view(np.uint64))


def train(docs: DataFrame, folder: str | None = None, bits: int | None = None) -> Model:
    """Count the texts of ``docs`` (column text; null: empty, which still has its end token) and write the arrays.

    ``bits``: log2 of the number of shards; by default a shard for ``SHARD_CHARS`` characters, rounded up, 8 at least
    and 2 ** ``SHARD_BITS`` at most. Repeated rows count as often as they occur. Without rows the model knows no word.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "kneser-ney")
    if bits is None:
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        bits = min(SHARD_BITS, max(3, (chars // SHARD_CHARS).bit_length()))
    heavy = heavy_contexts(docs, HEAVY_TEXTS, HEAVY_SHARE)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = Hashes(), [], 0

        def batch() -> pa.RecordBatch:
            rows = list(_pack(held, bits, heavy))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "blob"])

        for part in parts:
            for text in part.column("text"):
                held.append(tokens_of(text.as_py(), hashes))
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield batch()
                    size = 0
        if held:
            yield batch()

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        from pyspark import TaskContext

        attempt, shard = TaskContext.get().taskAttemptId(), int(key[0])
        columns = [np.concatenate(x) for x in zip(*map(_unpack, group.pop("blob")), strict=True)]
        keys, at, total = _summed(bigram_keys(columns[0], columns[1], heavy), columns[2])
        context, word = columns[0][at], columns[1][at]
        _save(folder, f"bigram-key-{shard}", keys, attempt)
        _save(folder, f"bigram-count-{shard}", total.astype(np.uint32 if not len(total) or total.max() < 1 << 32 else np.int64), attempt)
        heads, _, *sums = _summed(context, total, *[(total == k).astype(np.int64) for k in (1, 2)], (total > 2).astype(np.int64))
        parted = np.isin(heads, heavy)
        _save(folder, f"context-key-{shard}", heads[~parted], attempt)
        _save(folder, f"context-sums-{shard}", np.stack(sums, axis=1)[~parted], attempt)
        words, _, before, seen = _summed(word, np.ones_like(total), total)
        counts = [int((total == k).sum()) for k in (1, 2, 3, 4)]
        # kind 0: of a word; 1: counts of counts; 2: the sums of a heavy context's part.
        rows = [(0, words.view(np.int64), before, seen, 0 * before, 0 * before), (1, np.arange(1, 5), np.array(counts), *[np.zeros(4, np.int64)] * 3), (2, heads[parted].view(np.int64), *[x[parted] for x in sums])]
        columns = [np.concatenate([r[k] for r in rows]) for k in range(1, 6)]
        return pd.DataFrame({"kind": np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]), **dict(zip(("h", "before", "seen", "two", "more"), columns, strict=True))})

    packs = docs.select(F.col("text").cast("string")).mapInArrow(count, "shard int, blob binary")
    merged = store(packs.groupBy("shard").applyInPandas(merge, "kind int, h long, before long, seen long, two long, more long"), "words")

    def words(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        from pyspark import TaskContext

        attempt, shard = TaskContext.get().taskAttemptId(), int(key[0])
        keys, _, before, seen = _summed(group.h.to_numpy().view(np.uint64), group.before.to_numpy(), group.seen.to_numpy())
        _save(folder, f"word-key-{shard}", keys, attempt)
        _save(folder, f"word-sums-{shard}", np.stack([seen, before], axis=1), attempt)
        return pd.DataFrame([[len(keys), int(seen.sum()), int(before.sum()), *[int((before == k).sum()) for k in (1, 2, 3, 4)], int((before > 2).sum())]], columns=["v", "n", "k", "t1", "t2", "t3", "t4", "t3up"])

    shard = F.shiftrightunsigned("h", 64 - bits).cast("int")
    rows = merged.where("kind = 0").select(shard.alias("shard"), "h", "before", "seen").groupBy("shard").applyInPandas(words, "v long, n long, k long, t1 long, t2 long, t3 long, t4 long, t3up long")
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns]).first()
    seen = dict(merged.where("kind = 1").groupBy("h").agg(F.sum("before")).collect())
    parts = merged.where("kind = 2").groupBy("h").agg(*[F.sum(c).alias(c) for c in ("before", "seen", "two", "more")]).collect()
    parts.sort(key=lambda r: r.h & (1 << 64) - 1)
    _save(folder, "heavy-key", np.array([r.h for r in parts], dtype=np.int64).view(np.uint64), 0)
    _save(folder, "heavy-sums", np.array([r[1:] for r in parts], dtype=np.int64).reshape(-1, 4), 0)
    d = discounts(np.array([seen.get(k) or 0 for k in (1, 2, 3, 4)]))
    e = discounts(np.array([total.t1, total.t2, total.t3, total.t4]))
    left = float(e[1] * total.t1 + e[2] * total.t2 + e[3] * total.t3up) / total.k if total.k else 1.0
    return Model(folder, bits, int(total.n), int(total.v), int(total.k), tuple(d.tolist()), tuple(e.tolist()), left, tuple(heavy.tolist()))


# --- scoring --------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=8192)
def _mapped(folder: str, name: str) -> np.ndarray | None:
    """An array of the model, memory-mapped; from a store that can't be mapped it is fetched and removed at exit."""
    source, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}.npy"
    if source.get_file_info(path).type == fs.FileType.NotFound:
        return None
    if urlparse(folder).scheme not in ("", "file"):
        local = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, local, True)
        with source.open_input_stream(path) as data, open(f"{local}/x.npy", "wb") as out:
            shutil.copyfileobj(data, out)
        path = f"{local}/x.npy"
    return np.load(path, mmap_mode="r") if source.get_file_info(path).size > 128 or path.endswith("x.npy") else np.load(path)


def _look_up(model: Model, kind: str, value: str, sorted_keys: np.ndarray, width: int) -> np.ndarray:
    """Values of sorted distinct keys, zeros where unknown."""
    out = np.zeros((len(sorted_keys), width), dtype=np.int64)
    cuts = np.searchsorted(sorted_keys >> _U(64 - model.bits), np.arange((1 << model.bits) + 1, dtype=np.uint64))
    for shard in np.flatnonzero(cuts[1:] > cuts[:-1]):
        a, b = cuts[shard], cuts[shard + 1]
        keys = _mapped(model.folder, f"{kind}-key-{shard}")
        if keys is None or not len(keys):
            continue
        at = np.minimum(np.searchsorted(keys, sorted_keys[a:b]), len(keys) - 1)
        hit = keys[at] == sorted_keys[a:b]
        values = _mapped(model.folder, f"{kind}-{value}-{shard}")
        out[a:b][hit] = values[at[hit]].reshape(-1, width)
    return out


def _heavy_sums(model: Model, sorted_keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """``sums`` of sorted contexts, those of heavy contexts put in."""
    keys = _mapped(model.folder, "heavy-key")
    if keys is not None and len(keys) and len(sorted_keys):
        at = np.minimum(np.searchsorted(keys, sorted_keys), len(keys) - 1)
        hit = keys[at] == sorted_keys
        sums[hit] = _mapped(model.folder, "heavy-sums")[at[hit]]
    return sums


def score_batch(model: Model, tokens: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, sum of base log10 shares, and log10 probability by the model."""
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    word = np.concatenate(tokens)
    context = contexts_of(word, lengths.tolist())
    d, e = np.array(model.bigram_discounts), np.array(model.word_discounts)
    words, which = np.unique(word, return_inverse=True)
    seen, before = _look_up(model, "word", "sums", words, 2).T
    low = np.maximum(before - e[np.minimum(before, 3)], 0) / max(model.continuations, 1) + model.left / (model.distinct + 1)
    heads, whose = np.unique(context, return_inverse=True)
    total, n1, n2, n3 = _heavy_sums(model, heads, _look_up(model, "context", "sums", heads, 4)).T
    weight = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1), 1.0)
    pairs, pair_of = np.unique(bigram_keys(context, word, np.array(model.heavy, dtype=np.uint64)), return_inverse=True)
    counts = _look_up(model, "bigram", "count", pairs, 1)[:, 0][pair_of]
    high = np.maximum(counts - d[np.minimum(counts, 3)], 0) / np.maximum(total, 1)[whose]
    logs = np.log10(high + weight[whose] * low[which])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return lengths, np.add.reduceat((seen > 0).astype(np.int64)[which], starts), np.add.reduceat(model.base(seen)[which], starts), np.add.reduceat(logs, starts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score per row of ``docs``; null and empty texts are their end token alone."""
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for part in parts:
            if not part.num_rows:
                continue
            columns = score_batch(model, [tokens_of(t.as_py(), hashes) for t in part.column("text")])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def train_and_score(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """Learn from the rows whose crc32(doc_id as text) mod ``modulus`` is not 1 and score all rows.

    Rows without doc_id are held out. Columns besides doc_id and text are ignored; an empty table gives none.
    """
    model = train(docs.where(~held_out(F.col("doc_id"), modulus)))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
