"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matching, exception phrases, length normalisation.

Folding: lower case, compatibility forms, look-alike letters of other scripts and digit substitutions put back,
marks that don't show taken out, everything that is no letter or digit a single space. The lexicon holds whole words and word stems with weights
learned from labelled rows: the log-odds of a document being toxic given the entry, by document counts in Spark. The
score is a logistic curve over the weights matched, divided by the root of the logarithm of the length in words.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, store
from .simhash import shingle_hashes

# Letters of other scripts that look like Latin ones, as pairs.
HOMOGLYPHS = dict(pair for pair in "аa вb сc еe нh іi јj кk мm оo рp ԛq ѕs тt υu ѵv ԝw хx уy αa βb εe ηn ιi κk νv οo ρp τt χx ɑa ɡg ıi ʏy ꜱs ᴏo".split())
# Digits and signs that stand for letters. l, 1 and i share a class, because 1 may mean either.
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i", "@": "a", "$": "s", "€": "e"}
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "class clown", "circus clown", "loser bracket", "idiot light", "pond scum", "soap scum")

_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTIONS)
_SIGN = re.compile(r"[!|](?=\w)")
_GAP = re.compile(r"[\W_]+")
# Soft hyphen, marks that combine with no letter to one, zero-width signs: they don't part a word.
_HIDDEN = re.compile("[\u00ad\u0300-\u036f\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")
MAX_LABELLED = 16_000
STEMS = range(4, 9)
# Odd multipliers of the least hashes by which near copies are told.
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
MAX_WORD = 40
LEVELS = 3
LEAST_BOUND = 2.0
MAX_WEIGHT = 6.0


def fold(text: str | None) -> str:
    """Words between single spaces, one at either end: lower case, look-alikes and substitutions put back, accents kept."""
    text = text or ""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if "!" in text or "|" in text:
        text = _SIGN.sub("i", text)
    return f" {_GAP.sub(' ', text.translate(_FOLD)).strip()} "


def unaccented(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def level(n: int, words: int) -> int:
    """1 to 3 for an entry that occurs ``n`` times: so many occurrences are needed as the square root of the length asks for."""
    return max(1, min(LEVELS, int(n / max(1.0, math.sqrt(words / 500)))))


@dataclass
class Lexicon:
    """entries: ``" word "`` (whole) or ``" stem"`` to a weight for each level; the logistic curve a * x + b over the normalised sum."""

    entries: dict[str, tuple[float, ...]]
    a: float = 4.0
    b: float = -4.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            machine = ahocorasick.Automaton()
            for entry in self.entries:
                machine.add_word(entry, (len(entry), entry))
            for phrase in self.exceptions:
                machine.add_word(whole := fold(phrase), (len(whole), None))
            if len(machine):
                machine.make_automaton()
            self._automaton = machine
        return self._automaton

    def density(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights matched by the root of log2(2 + words), and the number of matches; the longest match at a word counts.

        Whole words also match where only accents were put on them. What an exception phrase covers doesn't count.
        """
        folded = fold(text)
        machine = self.automaton()
        best: dict[int, tuple[int, str]] = {}
        spared: list[tuple[int, int]] = []
        if self.entries:
            for end, (length, entry) in machine.iter(folded):
                start = end - length + 1
                if entry is None:
                    spared.append((start, end))
                elif length > best.get(start, (0, ""))[0]:
                    best[start] = (length, entry)
        if spared:
            spared.sort()
            reach = list(accumulate((b for _, b in spared), max))
            inside = lambda a, b: (k := bisect.bisect_right(spared, (a, len(folded)))) and reach[k - 1] >= b
            best = {s: x for s, x in best.items() if not inside(s, s + x[0] - 1)}
        found = Counter(entry for _, entry in best.values())
        if self.entries and not folded.isascii():
            found.update(plain for w in folded.split() if not w.isascii() and (plain := f" {unaccented(w)} ") in self.entries)
        words = max(folded.count(" ") - 1, 0)
        return sum(self.entries[e][level(n, words) - 1] for e, n in found.items()) / math.sqrt(math.log2(2 + words)), found.total()

    def probability(self, density: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.a * density + self.b))))


def patterns(text: str | None) -> list[str]:
    """Candidate entries of a text with the levels they reach, as entry and digit: its folded words, whole, and their stems."""
    words = Counter(fold(text).split())
    found: Counter[str] = Counter()
    for w, n in words.items():
        if 2 < len(w) <= MAX_WORD:
            found[f" {w} "] += n
        for k in STEMS:
            if len(w) <= k:
                break
            found[f" {w[:k]}"] += n
    total = words.total()
    return [f"{e}{k}" for e, n in found.items() for k in range(1, 1 + (level(n, total) if n > 1 else 1))]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-5) -> tuple[float, float]:
    """Newton's method for P(y) = 1 / (1 + exp(-(a x + b))), with a small ridge so that separable data converge."""
    w = np.array([0.0, 0.0])
    v = np.ones(len(y)) if weight is None else weight / weight.mean()
    rows = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -40, 40)))
        gradient = rows.T @ (v * (p - y)) / len(y) + ridge * w
        hessian = (rows * (v * p * (1 - p))[:, None]).T @ rows / len(y) + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def choose(counts: list[tuple[str, float, float]], positives: float, negatives: float, least: int, most: int) -> dict[str, tuple[float, ...]]:
    """Entries whose log-odds are high beyond chance, from (entry and level, toxic documents, other documents).

    Weighed by the lower bound of the log-odds; an entry that extends a chosen stem, or is a stem of a chosen entry
    without reaching more documents, is left out. A level weighs at least as much as those under it.
    """
    weights: dict[str, dict[int, tuple[float, float]]] = {}
    for key, bad, good in counts:
        p, q = (bad + 0.5) / (positives + 1), (good + 0.5) / (negatives + 1)
        bound = math.log(p / q) - 1.64 * math.sqrt(1 / (bad + 0.5) + (1 / (good + 0.5) if good else 0))
        weights.setdefault(key[:-1], {})[int(key[-1])] = (bound, bad)
    scored = []
    for entry, levels in weights.items():
        bound, bad = max(x for x in levels.values())
        if bound > LEAST_BOUND and bad >= least:
            scored.append((round(bound, 1), entry.endswith(" "), bad, len(entry), entry))
    # The more documents an entry reaches at about the same bound the better; then whole words, then longer stems.
    scored.sort(key=lambda x: (-x[0], -x[2], not x[1], -x[3], x[4]))
    chosen: dict[str, tuple[float, ...]] = {}
    reach: Counter[str] = Counter()
    for _, _, bad, _, entry in scored:
        word = entry.rstrip(" ")
        if any(word[: k + 1] in chosen for k in STEMS if k < len(word)) or bad <= 1.05 * reach[word]:
            continue
        row, last = [], 0.0
        for k in range(1, LEVELS + 1):
            last = max(last, min(weights[entry].get(k, (0.0, 0))[0], MAX_WEIGHT))
            row.append(round(last, 4))
        chosen[entry] = tuple(row)
        for k in range(2, len(word) + 1):
            reach[word[:k]] = max(reach[word[:k]], bad)
        if len(chosen) >= most:
            break
    return chosen


def _weighed(rows: DataFrame) -> DataFrame:
    """Rows (text, toxic) with weight: one by the number of rows that share one of the least hashes of three-word shingles.

    Near copies share most of these hashes, so that a group of them counts about as much as one text; others share none.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingle_hashes(t, 3) for t in part.column("text").to_pylist()]
            least = [[int(x) for x in (s[:, None] * MIXERS).min(axis=0).view(np.int64)] if len(s) else [0] * len(MIXERS) for s in sets]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least, pa.list_(pa.int64()))], names=["x", "text", "toxic", "least"])

    rows = rows.select(F.xxhash64("text", "toxic").alias("x"), "text", "toxic")
    rows = store(rows.mapInArrow(batches, "x long, text string, toxic int, least array<long>"), "hashed")
    keyed = rows.select("x", F.posexplode("least").alias("k", "v"))
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n"))
    weight = keyed.join(sizes, ["k", "v"]).groupBy("x").agg((1 / F.max("n")).alias("weight"))
    return rows.join(weight, "x").select("text", "toxic", "weight")


def neighbours(text: str | None, lexicon: Lexicon) -> set[str]:
    """Phrases of a matched word and the word before or after it, folded."""
    words = fold(text).split()
    hit = [f" {w} " in lexicon.entries or any(f" {w[:k]}" in lexicon.entries for k in STEMS if k < len(w)) for w in words]
    return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x != y}


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, least: int = 6, most: int = 5000) -> Lexicon:
    """Lexicon and curve from labelled rows: docs (doc_id, text) and labels (doc_id, toxic 0/1).

    At most about ``max_labelled`` rows are used, chosen by a hash of doc_id; the counts are made in Spark, and the
    driver gets at most 20,000 candidate entries, 1,000 exception phrases and the densities of the rows used. Of rows of
    equal text and label one is used, and near copies share the weight of one. Phrases of a matched word and a neighbour that ``least`` clean rows and no toxic one
    have become exceptions. Rows with a null id, label or text, and labels of unknown documents, are not used; without
    rows of both labels the lexicon is empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = min(1.0, max_labelled / max(total, 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # At most about max_labelled rows of two numbers, so they can be sent to every task.
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")
    rows = store(rows.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).distinct(), "distinct")
    rows = store(_weighed(rows), "labelled")
    sizes = dict(rows.groupBy("toxic").agg(F.sum("weight")).collect())
    positives, negatives = sizes.get(1, 0), sizes.get(0, 0)
    if not positives or not negatives:
        return Lexicon({})

    def count(parts: Iterator[pa.RecordBatch], wanted: frozenset | None) -> Iterator[pa.RecordBatch]:
        found: defaultdict[str, float] = defaultdict(float)
        for part in parts:
            for text, weight in zip(part.column("text").to_pylist(), part.column("weight").to_pylist(), strict=True):
                for entry in patterns(text) if wanted is None else wanted.intersection(patterns(text)):
                    found[entry] += weight
            if len(found) > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(found.keys())), pa.array(list(found.values()), pa.float64())], names=["entry", "n"])
                found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.float64())], names=["entry", "n"])

    bad = rows.where("toxic = 1").mapInArrow(lambda parts: count(parts, None), "entry string, n double").groupBy("entry").agg(F.round(F.sum("n"), 6).alias("n"))
    frequent = bad.where(F.col("n") >= max(float(least), positives / 400)).orderBy(F.desc("n"), "entry").limit(20_000).collect()
    wanted = frozenset(r.entry for r in frequent)
    good = dict(rows.where("toxic = 0").mapInArrow(lambda parts: count(parts, wanted), "entry string, n double").groupBy("entry").agg(F.round(F.sum("n"), 6).alias("n")).collect())
    lexicon = Lexicon(choose([(r.entry, r.n, good.get(r.entry, 0)) for r in frequent], positives, negatives, least, most))

    def phrases(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: defaultdict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for part in parts:
            for text, toxic, weight in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "weight")), strict=True):
                for phrase in neighbours(text, lexicon):
                    found[phrase][toxic] += weight
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([x[k] for x in found.values()], pa.float64()) for k in (0, 1))], names=["phrase", "clean", "bad"])

    beside = rows.mapInArrow(phrases, "phrase string, clean double, bad double").groupBy("phrase").agg(F.round(F.sum("clean"), 6).alias("clean"), F.sum("bad").alias("bad"))
    harmless = beside.where(F.col("clean") >= least).where("bad = 0").orderBy(F.desc("clean"), "phrase").limit(1000).collect()
    lexicon = Lexicon(lexicon.entries, exceptions=(*EXCEPTIONS, *(r.phrase for r in harmless)))

    def densities(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.density(t)[0] for t in part.column("text").to_pylist()], pa.float64()), part.column("toxic"), part.column("weight")], names=["x", "y", "w"])

    seen = np.array(sorted(map(tuple, rows.mapInArrow(densities, "x double, y int, w double").collect())), dtype=float)
    lexicon.a, lexicon.b = logistic(seen[:, 0], seen[:, 1], seen[:, 2])
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score (0 to 1) and matches per row of ``docs``. Null and empty texts score as texts without matches."""
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [lexicon.density(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([lexicon.probability(d) for d, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())],
                names=["doc_id", "score", "matches"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, score double, matches long")


def reject(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``, all columns kept."""
    small_batches(docs.sparkSession)
    schema = docs.schema
    at = docs.columns.index("text")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array([lexicon.probability(lexicon.density(t)[0]) < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(batches, schema)
