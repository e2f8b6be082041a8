"""Personal data: candidate spans judged by gradient-boosted trees.

Generators of high recall propose spans, which may overlap: the base kinds by their patterns, and looser forms (digit
groups, written-out addresses, assigned values and other words of mixed characters). Base spans that pass their checks
are always redacted. The other candidates are scored by boosted trees, learned from those of all rows, whose nature
another view decides than the one the trees see. The trees see the format alone; the truth of a base form is its
check (checksum, range or number of digits), of a digit group or a mixed word the cue before it (``card:``, ``token =``),
of a written-out address its top-level domain. So trees find uncued values of a format that cues go with. Platt's curve
and a cut for each kind are fitted on held-out candidates; a kind that doesn't reach the precision asked for adds nothing.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gbdt
from .shared import forget, small_batches, store

BASE = ("email", "ip", "card", "phone")
ADDED = ("contact", "number", "secret")
KINDS = BASE + ADDED
PRECISION = 0.98
HELD_HERE = 1 << 15

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CONTACT = re.compile(r"(?i)\b[a-z0-9][a-z0-9._%+-]{1,40}\s?(?:\[at\]|\(at\)| at )\s?[a-z0-9-]{2,40}\s?(?:\[dot\]|\(dot\)| dot )\s?[a-z]{2,10}\b")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{1,4}\)?(?:[ ./-]?[0-9]{2,7}){1,5}(?![0-9A-Za-z])")
_SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'`,;]{6,})")
_MIXED = re.compile(r"(?<![\w@.+/=-])(?=[A-Za-z_+/=-]*[0-9])(?=[0-9_+/=-]*[A-Za-z])[A-Za-z0-9_+/=-]{12,}(?![\w@+/=-])")
# Top-level domains that written-out addresses are known by.
_TOPS = frozenset("com org net edu gov io info de fr es uk eu it nl ch at us".split())
_CUES = re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|contact|ssn|iban|account|card|passport|id|mail|reach)\b|[:#=]\s*$")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, found from each ``@`` so that long runs cost no more."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            low = m.end()
            at = text.find("@", low)
        else:
            low = max(low, at + 1)
            at = text.find("@", at + 1)
    return out


def base_candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, passes its check) of every base match; failing ones are candidates only."""
    out = [("email", a, b, True) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        out.append(("ip", m.start(), m.end(), all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split("."))))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) >= 7:
            out.append(("card", m.start(), m.end(), 12 <= len(digits) <= 19 and _luhn(digits)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            out.append(("phone", m.start(), m.end(), 9 <= sum(c.isdigit() for c in m[0]) <= 15))
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    return [(k, a, b) for k, a, b, good in base_candidates(text or "") if good]


def loose_candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, a, b) for kind, a, b, _ in _loose(text)]


def _loose(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, label by the cue before it) of digit groups, written-out addresses, assigned values and mixed words."""
    out = [("number", m.start(), m.end(), int(bool(_CUES.search(text, max(0, m.start() - 24), m.start())))) for m in _NUMBER.finditer(text) if sum(c.isdigit() for c in m[0]) >= 7]
    if "dot" in text.lower():
        out += [("contact", m.start(), m.end(), int(re.search(r"[a-z]+$", m[0].lower())[0] in _TOPS)) for m in _CONTACT.finditer(text)]
    assigned = [(m.start(1), m.end(1)) for m in _SECRET.finditer(text)] if "=" in text or ":" in text else []
    known = Taken([("secret", a, b) for a, b in assigned])
    out += [("secret", a, b, 1) for a, b in assigned]
    out += [("secret", m.start(), m.end(), 0) for m in _MIXED.finditer(text) if not known.overlaps(m.start(), m.end())]
    return out


def features(text: str, start: int, end: int) -> list[float]:
    """Format of the span; nothing of the checks that name the base kinds, nor of the words around it."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    groups = re.findall(r"[0-9]+", span)
    turns = sum(x.isdigit() != y.isdigit() for x, y in zip(span, span[1:]))
    return [
        len(span),
        digits,
        letters,
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        span.count(" "),
        span.count("-"),
        span.count("."),
        span.count("(") + span.count("["),
        float(span[:1] == "+"),
        float("@" in span),
        len(set(span)) / max(1, len(span)),
        sum(c.isupper() for c in span) / max(1, len(span)),
        turns / max(1, len(span)),
        max((len(w) for w in re.split(r"[^A-Za-z]+", span)), default=0),
        float(span[:1] == "0"),
    ]


class Taken:
    """Places of spans, to ask whether another overlaps one of them."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans = sorted((a, b) for _, a, b in spans)
        self.reach = list(accumulate((b for _, b in self.spans), max))

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.spans, (end, 0))
        return k > 0 and self.reach[k - 1] > start


def candidates(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, label): of base forms whether they pass their check, of looser ones what the cue before them says."""
    text = text or ""
    found = base_candidates(text)
    taken = Taken([(k, a, b) for k, a, b, good in found if good])
    out = [(k, a, b, int(good)) for k, a, b, good in found if good or not taken.overlaps(a, b)]
    return out + [c for c in _loose(text) if not taken.overlaps(c[1], c[2])]


@dataclass(frozen=True)
class Judge:
    model: gbdt.Boosted | None
    cuts: dict[str, float]

    def added(self, text: str) -> list[tuple[str, int, int]]:
        """Spans besides the base ones that the trees select, without those that overlap a base span."""
        if self.model is None:
            return []
        taken = Taken(base_spans(text))
        rest = [c for c in loose_candidates(text) if self.cuts.get(c[0], 2.0) <= 1 and not taken.overlaps(*c[1:])]
        if not rest:
            return []
        p = self.model.probability(np.array([features(text, a, b) for _, a, b in rest]))
        return [c for c, value in zip(rest, p.tolist(), strict=True) if value >= self.cuts[c[0]]]

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        return ordered(base_spans(text) + self.added(text or ""))


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def as_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


def learn(docs: DataFrame, precision: float = PRECISION, held_here: int = HELD_HERE) -> Judge:
    """Trees, curve and cuts from the candidates of all rows; equal texts are in one part, so no copy is both learned and held out.

    Candidates are counted by kind, part, format and label before anything else, which is exact as trees see no more than
    that. Up to ``held_here`` different ones are learned from on the driver, more of them where they are stored, by the
    same sums. Rows with a null text aren't used; without positive and negative candidates nothing is added to the base
    spans. A kind of which held-out candidates exist but no positive one adds nothing; one without any is held to the cut
    of all kinds together, a half at least.
    """
    counted = store(counts(docs), "candidates")
    if counted.count() <= held_here:
        rows = counted.collect()
        kind, part, y, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1, 3, 4))
        x = np.frombuffer(b"".join(r.x for r in rows)).reshape(len(rows), len(features("", 0, 0)))
        judge = _learned(kind, part, x, y, n, precision)
    else:
        judge = _learned_apart(counted, precision)
    forget(counted)
    return judge


def counts(docs: DataFrame) -> DataFrame:
    """kind (its place in ``KINDS``), part (0 to 4, by text), x (features as octets), y (positive ones) and n of the candidates of all rows."""
    small_batches(docs.sparkSession)
    texts = docs.where("text is not null").select(F.col("text").cast("string"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            good: Counter[tuple[int, int, bytes]] = Counter()
            seen: Counter[tuple[int, int, bytes]] = Counter()
            for text, part in zip(rows.column("text").to_pylist(), rows.column("part").to_pylist(), strict=True):
                for kind, a, b, y in candidates(text):
                    key = KINDS.index(kind), part, np.array(features(text, a, b)).tobytes()
                    seen[key] += 1
                    good[key] += y
            keys = list(seen)
            columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.binary())]
            columns += [pa.array([c[k] for k in keys], pa.int64()) for c in (good, seen)]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "part", "x", "y", "n"])

    found = texts.select("text", F.pmod(F.xxhash64("text", F.lit(8)), F.lit(5)).cast("int").alias("part")).mapInArrow(batches, "kind int, part int, x binary, y long, n long")
    return found.groupBy("kind", "part", "x").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))


def _both(y: int, n: int) -> bool:
    return 0 < y < n


def _learned(kind: np.ndarray, part: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, precision: float) -> Judge:
    use, check, held = part > 1, part == 1, part == 0
    if not _both(y[use].sum(), n[use].sum()):
        return Judge(None, {})
    edges = [gbdt.bounds(x[use, j], n[use]) for j in range(x.shape[1])]
    bins = gbdt.binned(edges, x)
    model = gbdt.grow(gbdt.in_memory(bins[use], y[use], n[use]), edges)
    if check.any():
        model = gbdt.platt(model, gbdt.in_memory(bins[check], y[check], n[check]))
    p = model.of_bins(bins)
    own = lambda k: held & (kind == k) if (held & (kind == k)).any() else held
    return Judge(model, {name: max(0.5, gbdt.threshold(p[own(k)], y[own(k)], precision, n[own(k)])) for k, name in enumerate(KINDS)})


def _learned_apart(counted: DataFrame, precision: float) -> Judge:
    """As ``_learned`` from a stored table: the driver gets bin bounds, sums and cuts only."""
    width = len(features("", 0, 0))
    use = counted.where("part > 1")
    good, total = use.agg(F.sum("y"), F.sum("n")).first()
    if not _both(good or 0, total or 0):
        return Judge(None, {})

    def values(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            if rows.num_rows:
                x = np.frombuffer(b"".join(rows.column("x").to_pylist())).reshape(-1, width)
                columns = [pa.array(np.repeat(np.arange(width, dtype=np.int32), len(x))), pa.array(x.T.ravel()), pa.array(np.tile(rows.column("n").to_numpy(), width))]
                yield pa.RecordBatch.from_arrays(columns, names=["j", "v", "n"])

    by_value = use.mapInArrow(values, "j int, v double, n long").groupBy("j", "v").agg(F.sum("n").alias("n"))
    ends = by_value.select("j", "v", "n", F.sum("n").over(Window.partitionBy("j").orderBy("v")).alias("end"))
    at = F.explode(F.array(*[F.lit(k).cast("long") for k in gbdt.places(total)])).alias("at")
    chosen = ends.select("j", "v", "n", "end", at).where("at >= end - n and at < end").select("j", "v").distinct().collect()
    edges = [np.array(sorted(r.v for r in chosen if r.j == j)) for j in range(width)]

    def bins(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            x = np.frombuffer(b"".join(rows.column("x").to_pylist())).reshape(-1, width)
            yield rows.set_column(2, "x", pa.array([row.tobytes() for row in gbdt.binned(edges, x)], pa.binary()))

    binned = counted.mapInArrow(bins, counted.schema).groupBy("kind", "part", "x").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    binned = store(binned, "binned")

    def arrays(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(rows.column("x").to_pylist()), np.uint8).reshape(-1, width), rows.column("y").to_numpy(), rows.column("n").to_numpy()

    def sums(table: DataFrame) -> gbdt.Sums:
        def added(f: Callable[..., np.ndarray]) -> np.ndarray:
            def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                whole = None
                for rows in parts:
                    if rows.num_rows:
                        found = f(*arrays(rows))
                        whole = found if whole is None else whole + found
                if whole is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary()), pa.array([list(whole.shape)], pa.list_(pa.int32()))], names=["s", "shape"])

            return sum(np.frombuffer(r.s).reshape(r.shape) for r in table.mapInArrow(batches, "s binary, shape array<int>").toLocalIterator())

        return added

    model = gbdt.grow(sums(binned.where("part > 1")), edges)
    if not binned.where("part = 1").isEmpty():
        model = gbdt.platt(model, sums(binned.where("part = 1")))

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            yield pa.RecordBatch.from_arrays([rows.column("kind"), pa.array(model.of_bins(arrays(rows)[0])), rows.column("y"), rows.column("n")], names=["kind", "p", "y", "n"])

    held = binned.where("part = 0").mapInArrow(scored, "kind int, p double, y long, n long")
    held = held.select(F.explode(F.array("kind", F.lit(-1))).alias("kind"), "p", "y", "n").groupBy("kind", "p").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    down = Window.partitionBy("kind").orderBy(F.desc("p"))
    held = held.select("kind", "p", (F.sum("y").over(down) / F.sum("n").over(down)).alias("good"))
    cuts = {r.kind: r.cut for r in held.groupBy("kind").agg(F.coalesce(F.min(F.when(F.col("good") >= precision, F.col("p"))), F.lit(1.1)).alias("cut")).collect()}
    forget(binned)
    return Judge(model, {name: max(0.5, cuts.get(k, cuts.get(-1, 1.1))) for k, name in enumerate(KINDS)})


def find(docs: DataFrame, judge: Judge) -> DataFrame:
    """Per row of ``docs``: doc_id, the numbers of base spans of each kind, and base and all spans as text.

    Null and empty texts have none; positions are code points, the end exclusive. Repeated rows are each searched and
    other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text in part.column("text").to_pylist():
                base = base_spans(text)
                rows.append(([sum(k == name for k, _, _ in base) for name in BASE], as_text(base), as_text(base + judge.added(text or ""))))
            counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)]
            texts = [pa.array([r[k] for r in rows], pa.string()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, *texts], names=["doc_id", *(f"n_{k}" for k in BASE), "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, f"doc_id long, {', '.join(f'n_{k} long' for k in BASE)}, base string, spans string")


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are replaced together."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in ordered(spans):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, judge: Judge) -> DataFrame:
    """``docs`` with the spans in text replaced and n_chars, where there is such a column, counted anew; all rows kept."""
    small_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns = list(part.columns)
            texts = [redacted(t, judge.spans(t)) for t in part.column(at).to_pylist()]
            columns[at] = pa.array(texts, part.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = part.column(at).to_pylist()
                counts = [n if t is None or t == o else len(t) for t, o, n in zip(texts, old, part.column(k).to_pylist(), strict=True)]
                columns[k] = pa.array(counts, part.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(batches, schema)
