"""Gradient-boosted trees for a binary label over binned features, in numpy, and their calibration.

Rows are read only through ``Sums``: a function that adds what another makes of blocks of rows. So trees grow from
histograms of all rows, wherever these are kept, and the rows of a block may each stand for many equal ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np

BINS = 32
# Gradients are multiples of this, so sums of up to 2^33 rows are exact and the order of the rows is of no matter.
UNIT = 2.0**-20

#: Adds f(bins, y, n) over blocks of rows: bins per feature, how many of the equal rows are positive, how many there are.
Sums = Callable[[Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def in_memory(bins: np.ndarray, y: np.ndarray, n: np.ndarray) -> Sums:
    return lambda f: f(bins, y, n)


def bounds(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bin bounds of a feature: the different values at every 32nd part of all rows; ``n`` counts the rows of a value."""
    order = np.argsort(values, kind="stable")
    ends = np.cumsum(n[order])
    return np.unique(values[order][np.searchsorted(ends, places(int(ends[-1])), side="right")])


def places(total: int) -> list[int]:
    """Places, from 0, of the rows in order of a feature whose values bound its bins."""
    return [k * (total - 1) // BINS for k in range(1, BINS)]


def binned(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(edges)), np.uint8)


def _leaves(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    feature, cut, left, right, _ = tree
    node = np.zeros(len(bins), dtype=np.int64)
    while True:
        inner = feature[node] >= 0
        if not inner.any():
            return node
        goes_left = bins[np.arange(len(bins)), np.maximum(feature[node], 0)] <= cut[node]
        node = np.where(inner, np.where(goes_left, left[node], right[node]), node)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Boosted:
    """edges: bin bounds per feature; trees: arrays (feature, bin, left, right, value) per tree; a, b: Platt's curve."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, ...]]
    start: float
    a: float = 1.0
    b: float = 0.0

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for tree in self.trees:
            out += tree[4][_leaves(tree, bins)]
        return out

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        return _sigmoid(self.a * self.margin(bins) + self.b)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.of_bins(binned(self.edges, x))


def _histograms(model: Boosted, tree: tuple[np.ndarray, ...], level: list[int], bins: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per node of ``level``: sums of gradients, of second derivatives and of rows, by feature and bin."""
    q = np.round(_sigmoid(model.margin(bins)) / UNIT) * UNIT
    columns = n * q - y, n * np.maximum(np.round(q * (1 - q) / UNIT), 1) * UNIT, n
    node, out = _leaves(tree, bins), np.zeros((len(level), 3, len(model.edges), BINS))
    for i, k in enumerate(level):
        at = np.flatnonzero(node == k)
        for j in range(len(model.edges)):
            for c, column in enumerate(columns):
                out[i, c, j] = np.bincount(bins[at, j], column[at], BINS)
    return out


def _tree(sums: Sums, model: Boosted, depth: int, rate: float, ridge: float, least: int) -> tuple[np.ndarray, ...]:
    feature, cut, left, right, value = [], [], [], [], []

    def leaf(total: np.ndarray) -> int:
        for store, x in ((feature, -1), (cut, 0), (left, 0), (right, 0), (value, -rate * total[0] / (total[1] + ridge))):
            store.append(x)
        return len(feature) - 1

    arrays = lambda: tuple(np.array(x) for x in (feature, cut, left, right, value))
    level = [leaf(np.zeros(3))]
    for at in range(depth):
        found = sums(partial(_histograms, model, arrays(), level))
        below = []
        for node, sum_of in zip(level, found, strict=True):
            total = sum_of[:, 0].sum(axis=1)
            if at == 0:
                value[node] = -rate * total[0] / (total[1] + ridge)
            g, h, size = low = np.cumsum(sum_of, axis=2)[:, :, :-1]
            gain = g**2 / (h + ridge) + (total[0] - g) ** 2 / (total[1] - h + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(size < least) | (total[2] - size < least)] = 0
            j, k = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, k] > 1e-6:
                feature[node], cut[node] = int(j), int(k)
                left[node], right[node] = leaf(low[:, j, k]), leaf(total - low[:, j, k])
                below += [left[node], right[node]]
        level = below
        if not level:
            break
    return arrays()


def _totals(bins: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.array([y.sum(), n.sum()], dtype=np.float64)


def grow(sums: Sums, edges: list[np.ndarray], trees: int = 40, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: int = 5) -> Boosted:
    """Logistic loss, second-order leaf values; exact for repeated rows; features with one value are never split."""
    good, total = sums(_totals)
    p = float(np.clip(good / total, 1e-6, 1 - 1e-6))
    model = Boosted(edges, [], float(np.log(p / (1 - p))))
    for _ in range(trees):
        model.trees.append(_tree(sums, model, depth, rate, ridge, least))
    return model


def _newton(model: Boosted, w: np.ndarray, bins: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = model.margin(bins)
    p = _sigmoid(w[0] * x + w[1])
    d, v = n * p - y, n * p * (1 - p)
    return np.array([(d * x).sum(), d.sum(), (v * x * x).sum(), (v * x).sum(), v.sum(), n.sum()])


def platt(model: Boosted, sums: Sums, ridge: float = 1e-5) -> Boosted:
    """The same trees with Platt's curve fitted by Newton's method, with a small ridge so that separable data converge."""
    w = np.zeros(2)
    for _ in range(60):
        dx, d, vxx, vx, v, total = sums(partial(_newton, model, w))
        step = np.linalg.solve(np.array([[vxx, vx], [vx, v]]) / total + ridge * np.eye(2), np.array([dx, d]) / total + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return Boosted(model.edges, model.trees, model.start, float(w[0]), float(w[1]))


def fit(x: np.ndarray, y: np.ndarray, **settings: float) -> Boosted:
    """``grow`` on rows in memory."""
    one = np.ones(len(x))
    edges = [bounds(x[:, j], one) for j in range(x.shape[1])]
    return grow(in_memory(binned(edges, x), y, one), edges, **settings)


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> Boosted:
    """``platt`` on rows in memory that the trees weren't fitted on."""
    return platt(model, in_memory(binned(model.edges, x), y, np.ones(len(x))))


def threshold(p: np.ndarray, y: np.ndarray, precision: float, n: np.ndarray | None = None) -> float:
    """The least cut at which held-out precision is ``precision`` or more from there on up; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(y[order]) / np.cumsum((np.ones(len(p)) if n is None else n)[order])
    last = np.flatnonzero(np.concatenate([p[order][1:] != p[order][:-1], [True]]) & (good >= precision)) if len(p) else []
    return float(p[order][last[-1]]) if len(last) else 1.1
