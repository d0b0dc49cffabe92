"""Labelled samples and small models that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.llm.common import id_crc

FOLDS, HELD_OUT = 5, 0


def held_out(column: str = "doc_id"):
    """Whether a document's labels are kept for evaluation."""
    return F.pmod(id_crc(column), F.lit(FOLDS)) == HELD_OUT


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id, text, y (0 or 1) of at most ``max_rows`` labelled documents that are not held out.

    Where there are more, those with the smallest hashes of doc_id, then of
    the text, are taken; rows that repeat an id and its text count once. The
    sample's ids are few by that bound, so they are broadcast and only its own
    texts are shuffled. Null ids and null labels teach nothing; of labels that
    disagree the higher holds.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).join(F.broadcast(taken), "doc_id")
    once = found.groupBy("doc_id", "_h").agg(F.first("text").alias("text"), F.max("y").alias("y"))
    bounded = once.orderBy(F.xxhash64("doc_id"), "doc_id", "_h").limit(max_rows)
    return bounded.repartition("doc_id").select("doc_id", "text", "y")


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on scores, as knots for linear interpolation."""
    order = np.argsort(scores, kind="stable")
    s, starts = np.unique(scores[order], return_index=True)
    sums = np.add.reduceat(y[order].astype(float), starts)
    sizes = np.diff(np.append(starts, len(y))).astype(float)
    pools: list[list[float]] = []
    for at, (total, size) in enumerate(zip(sums, sizes)):
        pools.append([total, size, at, at])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total_, size_, _, end = pools.pop()
            pools[-1] = [pools[-1][0] + total_, pools[-1][1] + size_, pools[-1][2], end]
    x, v = [], []
    for total, size, first, last in pools:
        # One more of either kind keeps small pools off 0 and 1.
        value = (total + 0.5 * y.mean()) / (size + 0.5)
        for at in {first, last}:
            x.append(s[at])
            v.append(value)
    at = np.argsort(x, kind="stable")
    return np.array(x)[at], np.maximum.accumulate(np.array(v)[at])


class Trees:
    """Gradient-boosted trees for log loss over dense features, grown on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 12, penalty: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.penalty = rounds, depth, rate, bins, least, penalty
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # Rare features vary only above their quantiles.
        cuts = [np.unique(np.concatenate((c, np.quantile(v[v > 0], np.linspace(0, 1, 9)[:-1]) - 1e-12))) if (v > 0).any() else c for c, v in zip(cuts, x.T)]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
        width = max(len(c) for c in cuts) + 1
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, curve = y - p, p * (1 - p)
            size = (1 << self.depth) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(2 * size + 1)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first = (1 << level) - 1
                for at in range(first, 2 * first + 1):
                    rows = np.flatnonzero(node == at)
                    if len(rows) < 2 * self.least:
                        continue
                    best = self._split(binned[:, rows], gradient[rows], curve[rows], width)
                    if best is None:
                        continue
                    f, b = best
                    feature[at], cut[at] = f, cuts[f][b]
                    node[rows] = 2 * at + 1 + (binned[f, rows] > b)
            for at in np.unique(node):
                rows = node == at
                value[at] = self.rate * gradient[rows].sum() / (curve[rows].sum() + self.penalty)
            margin += value[node]
            self.trees.append((feature, cut, value))
        return self

    def _split(self, binned: np.ndarray, gradient: np.ndarray, curve: np.ndarray, width: int) -> tuple[int, int] | None:
        g, h = gradient.sum(), curve.sum()
        best, gain = None, 1e-6
        for f, b in enumerate(binned):
            gs, hs, ns = (np.bincount(b, w, width).cumsum() for w in (gradient, curve, None))
            fine = (ns >= self.least) & (len(b) - ns >= self.least)
            score = gs**2 / (hs + self.penalty) + (g - gs) ** 2 / (h - hs + self.penalty) - g**2 / (h + self.penalty)
            score = np.where(fine, score, -1.0)
            at = int(score.argmax())
            if score[at] > gain:
                best, gain = (f, at), score[at]
        return best

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = node < len(feature)
                at = np.where(inner, node, 0)
                f = feature[at]
                split = inner & (f >= 0)
                node = np.where(split, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[at]), node)
            out += value[node]
        return out
