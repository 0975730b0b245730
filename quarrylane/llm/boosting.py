"""Gradient-boosted decision trees for two classes, on binned features, with calibrated probabilities.

fit() learns from arrays; fit_table() does the same over a table of any size, whose tasks sum up histograms for each level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.session import table

#: Gradients are whole multiples of this part of one, so that sums are the same in any order.
UNIT = 1 << 20
#: Distinct binned rows of a partition in fit_table(), and the trees after which it writes down the rows' scores.
PART, WRITTEN = 1 << 18, 15


@dataclass
class Tree:
    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray  # rows with a value up to the cut go left
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)


@dataclass
class Forest:
    base: float
    trees: list[Tree] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def calibrated(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * score + self.shift)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.score(x))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Forest:
    """Boost `rounds` trees of a fixed depth by the logistic loss's gradient and curvature."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    rate_of_yes = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    forest = Forest(float(np.log(rate_of_yes / (1 - rate_of_yes))))
    score = np.full(len(y), forest.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, curve = y - p, p * (1 - p)
        size = (1 << (depth + 1)) - 1
        tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
        at = np.zeros(len(y), np.int64)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            g, h = grad[rows].sum(), curve[rows].sum()
            tree.value[node] = rate * g / (h + ridge)
            if node >= size // 2:
                continue
            best = (1e-6, -1, -1)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gs = np.cumsum(np.bincount(code[rows, j], grad[rows], len(e) + 1))[:-1]
                hs = np.cumsum(np.bincount(code[rows, j], curve[rows], len(e) + 1))[:-1]
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), j, k))
            if best[1] >= 0:
                _, j, k = best
                tree.feature[node], tree.cut[node] = j, edges[j][k]
                at[rows] = 2 * node + 1 + (code[rows, j] > k)
        forest.trees.append(tree)
        score += tree.predict(x)
    return forest


def quantiles(values: np.ndarray, n: np.ndarray, bins: int = 32) -> np.ndarray:
    """The edges of about `bins` bins of equal size: distinct values (in order) up to which the shares of all rows are reached."""
    upto = np.cumsum(n)
    return np.unique(values[np.searchsorted(upto, np.linspace(0, 1, bins + 1)[1:-1] * upto[-1], "left")]) if len(n) else np.zeros(0)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def _histograms(rows: DataFrame, forest: Forest, start: int, tree: Tree, level: int, features: int, bins: int) -> np.ndarray:
    """Sums (node of the level, feature, bin, gradient and curvature) over all rows; trees from `start` on are not in their score."""
    nodes, first = 1 << level, (1 << level) - 1
    size = nodes * features * bins
    new = Forest(0.0, forest.trees[start:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            code = _codes(batch, features)
            at = np.zeros(len(code), np.int64)
            for _ in range(level):
                f = tree.feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (code[np.arange(len(code)), np.maximum(f, 0)] > tree.cut[at]), 0)
            own = at >= first  # those whose node had no split are out
            code, at = code[own], at[own] - first
            y, n, score = (batch.column(c).to_numpy()[own] for c in ("y", "n", "score"))
            p = 1 / (1 + np.exp(-(score + new.score(code))))
            place = ((at[:, None] * features + np.arange(features)) * bins + code).reshape(-1)
            for k, part in enumerate((y - p, p * (1 - p))):  # whole numbers below 2^53: exact
                total[k] += np.bincount(place, np.repeat(np.rint(part * UNIT) * n, features), size)
        yield pa.record_batch({"g": pa.array([total[0]], pa.list_(pa.float64())), "h": pa.array([total[1]], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, "g array<double>, h array<double>").toArrow()
    sums = np.zeros((2, size))
    for k, name in enumerate("gh"):
        for chunk in parts.column(name).chunks:
            sums[k] += chunk.flatten().to_numpy().reshape(-1, size).sum(0)
    return (sums / UNIT).reshape(2, nodes, features, bins).transpose(1, 2, 3, 0)


def _codes(batch: pa.RecordBatch, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, features)


def fit_table(rows: DataFrame, edges: list[np.ndarray], rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Forest:
    """Boost as fit() does, over all rows (code binary: a byte for each feature's bin, y int, n long: how often) of a table.

    Each level of a tree is a job whose tasks send back one histogram each: a task has 2^18 distinct rows. Where rows are
    and in what order doesn't matter. Without rows of both classes no tree is made.
    """
    rows = table(rows.groupBy("code", "y").agg(F.sum("n").cast("long").alias("n")))
    number, yes, every = rows.agg(F.count("*"), F.sum(F.col("y") * F.col("n")), F.sum("n")).first()
    if not every or yes in (0, every):
        return Forest(0.0)
    features, bins = len(edges), 1 + max(map(len, edges))
    share = float(np.clip(yes / every, 1e-3, 1 - 1e-3))
    coded = Forest(float(np.log(share / (1 - share))))
    rows = table(rows.withColumn("score", F.lit(coded.base)).repartition(-(-number // PART)))
    size, start = (1 << (depth + 1)) - 1, 0
    for _ in range(rounds):
        tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
        for level in range(depth):
            sums = _histograms(rows, coded, start, tree, level, features, bins)
            for own, node in zip(sums, range((1 << level) - 1, (1 << (level + 1)) - 1), strict=True):
                g, h = own[0].sum(0)
                if node and not (tree.feature[(node - 1) // 2] >= 0):
                    continue
                tree.value[node] = rate * g / (h + ridge)
                gs, hs = np.cumsum(own, axis=1)[:, :-1].transpose(2, 0, 1)
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                j, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, k] > 1e-6:
                    tree.feature[node], tree.cut[node] = j, k
                    for child, (a, b) in enumerate(((gs[j, k], hs[j, k]), (g - gs[j, k], h - hs[j, k])), 2 * node + 1):
                        tree.value[child] = rate * a / (b + ridge)
            if not (tree.feature[(1 << level) - 1 : (1 << (level + 1)) - 1] >= 0).any():
                break
        if tree.feature[0] < 0:
            break
        coded.trees.append(tree)
        if len(coded.trees) - start == WRITTEN:
            rows, start = table(_scored(rows, Forest(0.0, coded.trees[start:]), features)), len(coded.trees)
    cut = lambda t: np.array([edges[j][int(k)] if j >= 0 else 0.0 for j, k in zip(t.feature, t.cut, strict=True)])
    return Forest(coded.base, [Tree(t.feature, cut(t), t.value) for t in coded.trees])


def _scored(rows: DataFrame, forest: Forest, features: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = batch.column("score").to_numpy() + forest.score(_codes(batch, features))
                yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(score))

    return rows.mapInArrow(run, rows.schema)


def calibrate(forest: Forest, x: np.ndarray, y: np.ndarray, steps: int = 50) -> Forest:
    """Platt scaling on rows that the trees have not seen."""
    return platt(forest, forest.score(x), y, np.ones(len(y)), steps)


def platt(forest: Forest, s: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> Forest:
    """Platt scaling on scores that occur n times, with its smoothed targets, by Newton steps."""
    if not len(y) or y.min() == y.max():
        return forest
    yes, no = (y * n).sum(), ((1 - y) * n).sum()
    target = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    a = np.array([1.0, 0.0])
    d = np.stack([s, np.ones(len(s))], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ a, -30, 30)))
        step = np.linalg.solve(d.T @ (d * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), d.T @ (n * (target - p)) - 1e-3 * (a - [1.0, 0.0]))
        a += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    forest.slope, forest.shift = float(max(a[0], 1e-3)), float(a[1])
    return forest


def threshold(probability: np.ndarray, y: np.ndarray, precision: float, n: np.ndarray | None = None) -> float:
    """The least threshold from which on the share of true rows is at least `precision`; 1.01 (none) where no such is."""
    order = np.argsort(-probability, kind="stable")
    n = np.ones(len(y)) if n is None else n
    p, hits, every = probability[order], np.cumsum((y * n)[order]), np.cumsum(n[order])
    last = np.append(p[1:] != p[:-1], True) if len(p) else np.zeros(0, bool)
    good = np.flatnonzero(last & (hits / every >= precision))
    return float(p[good[-1]]) if len(good) else 1.01
