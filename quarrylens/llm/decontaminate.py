"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of punctuation; numbers, units and names become typed placeholders, so that a
question with other values has the same template. Windows of ``WINDOW`` template tokens, or of half an item's tokens if
these are fewer, are hash-joined with those of the benchmark items. A document that shares windows with an item is then
aligned with it: the tokens that stand where the item's do must be at least ``LEAST_SHARE`` of the item's, and the
slots in the shared windows must be consistent: equal values of a type in the item stand against equal values in the
document and different against different ones, as they do in a re-parameterised question. Other slots count if they
are consistent with these.

Names are told by their capitals, which a copy may have lost: words in capitals only aren't names, and each item is also
indexed as if in lower case, so that such copies share windows with it too.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

WINDOW = 8
LEAST_SHARE = 0.6
SHORTEST = 5
BLOCK_TOKENS = 1_000_000

NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
# Number words and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
UNITS = frozenset(
    "mm cm km kg mg g lb lbs oz ml mph kmh km/h °c °f meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent".split()
)
_EDGE = re.compile(r"^[^\w$€£%°<>-]+|[^\w%°]+$")
_NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*(%|st|nd|rd|th|k|m|bn)?")
_STOP = (".", "!", "?", ":", '."', '!"', '?"', ".'", ".)")


def canonical(word: str) -> tuple[str, str]:
    """Template token and slot value of a word that isn't a name. Words of punctuation alone have the empty token."""
    bare = _EDGE.sub("", word.lower())
    if _NUMBER.fullmatch(bare):
        return NUMBER, bare.strip("$€£").rstrip(".,:/")
    if bare in NUMBER_WORDS:
        return NUMBER, bare
    if bare in UNITS:
        return UNIT, bare
    return bare, ""


@dataclass
class Template:
    """Token hashes of a text, with the places of its slots."""

    hashes: np.ndarray
    words: list[str]

    def slots(self, at: int) -> tuple[str, str]:
        """Type and value of the slot at a place; empty type for a plain word."""
        word = self.words[at]
        if self.hashes[at] == _NAME_HASH:
            return NAME, _EDGE.sub("", word).lower()
        token, value = canonical(word)
        return (token, value) if token in (NUMBER, UNIT) else ("", "")


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))


_NAME_HASH = np.uint64(_hash(NAME))
_PLAIN = {_hash(NUMBER), _hash(UNIT)}


class Words(dict):
    """Word to (hash, kind) with kind bits: 1 begins with a capital, 2 ends a sentence, 4 no token. Emptied when large."""

    def __missing__(self, word: str) -> tuple[int, int]:
        token, _ = canonical(word)
        value = _hash(token)
        bare = word.lstrip("\"'(«“[")
        capital = bare[:1].isupper() and not (len(bare) > 1 and bare.isupper()) and value not in _PLAIN
        self[word] = found = (value, capital + 2 * word.endswith(_STOP) + 4 * (not token))
        return found


def template(text: str | None, known: Words) -> Template:
    """A name is a capitalised word that doesn't begin a sentence or line of capitals; other words are as ``canonical``."""
    words = (text or "").split()
    if len(known) > 300_000:
        known.clear()
    if not words:
        return Template(np.empty(0, np.uint64), [])
    pairs = np.array([known[w] for w in words], dtype=np.uint64)
    hashes, kind = pairs[:, 0].copy(), pairs[:, 1]
    opens = np.concatenate([[True], (kind[:-1] & 2) > 0])
    hashes[((kind & 1) > 0) & ~opens] = _NAME_HASH
    real = (kind & 4) == 0
    if not real.all():
        hashes, words = hashes[real], [w for w, keep in zip(words, real.tolist(), strict=True) if keep]
    return Template(hashes, words)


def window_size(tokens: int, size: int) -> int:
    """Length of an item's windows: what one changed token leaves in a row, from ``SHORTEST`` to ``size`` tokens."""
    return min(size, max(SHORTEST, tokens // 2))


def windows(hashes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hash of each run of ``size`` tokens) for each of the ascending ``sizes`` the text is long enough for."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    for k in range(min(n, sizes[-1]) if sizes else 0):
        out = (out[: n - k] ^ hashes[k:]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        if k + 1 in sizes:
            yield k + 1, out


class Items:
    """A block of benchmark items with the sorted hashes of their template windows."""

    def __init__(self, rows: list[tuple[int, str]], size: int = WINDOW):
        known = Words()
        self.size = size
        both = [(i, template(text, known), template(text.lower(), known)) for i, text in rows]
        # Keys are (item, form); an item without names has one form.
        self.templates = {(i, form): t for i, *forms in both for form, t in enumerate(forms) if len(t.hashes) >= SHORTEST and not (form and np.array_equal(t.hashes, forms[0].hashes))}
        found = [(int(h), item, at) for item, t in self.templates.items() for _, own in windows(t.hashes, [window_size(len(t.hashes), size)]) for at, h in enumerate(own)]
        self.places: dict[int, list[tuple[tuple[int, int], int]]] = defaultdict(list)
        for h, item, at in found:
            self.places[h].append((item, at))
        self.keys = np.array(sorted(self.places), dtype=np.uint64)
        self.sizes = sorted({window_size(len(t.hashes), size) for t in self.templates.values()})
        self.filter = np.zeros(1 << 22, dtype=bool)
        self.filter[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(place in the document, window hash) of shared windows."""
        out = []
        for _, found in windows(hashes, self.sizes):
            maybe = np.flatnonzero(self.filter[(found & np.uint64((1 << 22) - 1)).astype(np.int64)])
            out += [(int(p), int(found[p])) for p in maybe if int(found[p]) in self.places]
        return out

    def judge(self, doc: Template) -> tuple[int, float, bool] | None:
        """Best item as (item, share covered, whether slot values differ), or None."""
        spans: dict[tuple[tuple[int, int], int], set[int]] = defaultdict(set)
        for place, value in self.hits(doc.hashes):
            for item, at in self.places[value]:
                spans[item, place - at].add(at)
        best = None
        by_item: dict[tuple[int, int], dict[int, set[int]]] = defaultdict(dict)
        for (item, shift), starts in spans.items():
            by_item[item][shift] = starts
        for item, shifts in by_item.items():
            own = self.templates[item]
            size = window_size(len(own.hashes), self.size)
            aligned = {shift: self._aligned(own, doc, shift) for shift in shifts}
            rising = sorted(shifts)
            for shift in shifts:
                # Shared windows of nearly the same shift belong to one passage; words may have been put in or left out.
                near = rising[bisect.bisect_left(rising, shift - 5) : bisect.bisect_right(rising, shift + 5)]
                nearest = sorted(near, key=lambda s: -abs(s - shift))
                near = {a: s for s in nearest for a in shifts[s]}
                covered = {a + k: s for a, s in near.items() for k in range(size)}
                others = {at: s for s in nearest for at in aligned[s] if at not in covered}
                most = (len(covered) + len(others)) / len(own.hashes)
                if most < LEAST_SHARE or best and most <= best[1]:
                    continue
                consistent, changed, fitting = self._slots(own, doc, covered, others)
                share = (len(covered) + fitting) / len(own.hashes)
                if consistent and share >= LEAST_SHARE and not (best and share <= best[1]):
                    best = (item[0], share, changed)
        return best

    @staticmethod
    def _aligned(own: Template, doc: Template, shift: int) -> list[int]:
        """Places of the item whose token is that of the document at the place moved by ``shift``."""
        low, high = max(0, -shift), min(len(own.hashes), len(doc.hashes) - shift)
        return (low + np.flatnonzero(own.hashes[low:high] == doc.hashes[low + shift : high + shift])).tolist()

    @staticmethod
    def _slots(own: Template, doc: Template, covered: dict[int, int], others: dict[int, int]) -> tuple[bool, bool, int]:
        """Whether the covered slots are consistent, whether any value differs, and how many of the others fit."""
        there: dict[tuple[str, str], str] = {}
        back: dict[tuple[str, str], str] = {}
        changed, fitting = False, 0
        for at, shift in [*covered.items(), *others.items()]:
            kind, value = own.slots(at)
            if kind:
                other_kind, other = doc.slots(at + shift)
                if other_kind != kind or there.get((kind, value), other) != other or back.get((kind, other), value) != value:
                    if at in covered:
                        return False, False, 0
                    continue
                there[kind, value], back[kind, other] = other, value
                changed |= other != value
            fitting += at not in covered
        return True, changed, fitting


def item_blocks(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> Iterator[Items]:
    """The benchmark (item_id, text) in blocks of about ``block_tokens`` words at most, by a hash of item_id."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_tokens))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text")
        yield Items([(r.item_id, r.text) for r in own.collect()])


def find(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per row of ``docs``: doc_id, item_id of the item it contains most of (null: none), share and changed (slots differ).

    The benchmark (item_id, text) is sent to all tasks in blocks of at most about ``block_tokens`` words, which bounds
    what is broadcast; the blocks follow each other, and a row keeps the best answer so far, the earlier of equal ones.
    Items of under ``SHORTEST`` tokens, or without id or text, can't be found. Null and empty documents contain nothing;
    repeated rows are answered each.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, text string, item_id long, share double, changed boolean"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("share"), F.lit(False).alias("changed"))
    for items in item_blocks(benchmark, block_tokens):

        def batches(parts: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            known = Words()
            for part in parts:
                before = zip(part.column("item_id").to_pylist(), part.column("share").to_pylist(), part.column("changed").to_pylist(), strict=True)
                found = [max(old, items.judge(template(t.as_py(), known)) or (None, 0.0, False), key=lambda f: f[1]) for t, old in zip(part.column("text"), before, strict=True)]
                columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), *columns], names=["doc_id", "text", "item_id", "share", "changed"])

        rows = rows.mapInArrow(batches, schema)
    return rows.select("doc_id", "item_id", "share", "changed")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, all columns kept."""
    small_batches(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema
    for found in item_blocks(benchmark):

        def batches(parts: Iterator[pa.RecordBatch], found: Items = found) -> Iterator[pa.RecordBatch]:
            known = Words()
            for part in parts:
                yield part.filter(pa.array([found.judge(template(t, known)) is None for t in part.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(batches, schema)
    return docs
