"""Gradient-boosted trees for a binary target in numpy: histogram splits, logistic loss, calibrated thresholds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: a feature and a cut for each inner node, a value for each leaf."""

    depth: int
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, penalty: float = 1.0) -> Trees:
    """Newton boosting; each node takes the histogram split of largest gain, or none (cut +inf) where no split gains."""
    inner = 2**depth - 1
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(x), base)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first = 2**level - 1
            for k in range(first, first + 2**level):
                own = np.flatnonzero(node == k)
                best = 1e-6
                if not own.size:
                    continue
                total_g, total_h = g[own].sum(), h[own].sum()
                for j, e in enumerate(edges):
                    left_g = np.cumsum(np.bincount(code[own, j], g[own], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(code[own, j], h[own], len(e) + 1))[:-1]
                    if not len(e):
                        continue
                    gain = left_g**2 / (left_h + penalty) + (total_g - left_g) ** 2 / (total_h - left_h + penalty) - total_g**2 / (total_h + penalty)
                    i = int(np.argmax(gain))
                    if gain[i] > best:
                        best, feature[k], cut[k] = gain[i], j, e[i]
            here = node >= first
            node[here] = 2 * node[here] + 1 + (x[here, feature[node[here]]] > cut[node[here]])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + penalty)
        margin += value[leaf]
        out.append((feature, cut, value))
    return Trees(depth, *(np.array(v) for v in zip(*out)), base)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold at and above which the held-out rows reach the precision; over 1 where none does."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= precision) & (np.append(p[order][1:], -1) < p[order]))
    return float(p[order][good[-1]]) if good.size else 1.1
