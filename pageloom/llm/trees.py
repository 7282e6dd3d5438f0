"""Histogram gradient boosting for two classes, small enough to fit on the driver's bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32
#: Added to the sum of second derivatives of a leaf.
RIDGE = 1.0


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Inner bin edges of each feature, from its quantiles, where its distinct values are not fewer."""
    out = []
    for column in x.T:
        distinct = np.unique(column)
        if len(distinct) <= bins:
            out.append((distinct[1:] + distinct[:-1]) / 2)
        else:
            out.append(np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)], axis=1) if len(edges) else np.zeros((len(x), 0), int)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Boosted:
    """Trees as complete binary trees of one depth: feature, bin and leaf value tables."""

    edges: list[np.ndarray]
    start: float
    features: np.ndarray  # [tree, inner node]
    cuts: np.ndarray
    leaves: np.ndarray  # [tree, leaf]

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        out, rows, inner = np.full(len(x), self.start), np.arange(len(x)), self.features.shape[1]
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (bins[rows, f[at]] > c[at])
            out += leaf[at - inner]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, least: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; a node that no cut improves sends all rows left."""
    edges = edges_of(x)
    bins = binned(x, edges)
    n, m = bins.shape
    flat = bins + np.arange(m) * BINS
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(n, start)
    inner = 2**depth - 1
    features, cuts, leaves = np.zeros((trees, inner), int), np.full((trees, inner), BINS), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = sigmoid(margin)
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows) > 1:
                gs = np.bincount(flat[rows].ravel(), np.repeat(g[rows], m), m * BINS).reshape(m, BINS).cumsum(1)
                hs = np.bincount(flat[rows].ravel(), np.repeat(h[rows], m), m * BINS).reshape(m, BINS).cumsum(1)
                gt, ht = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hs < least) | (ht - hs < least)] = 0
                f, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[f, c] > 1e-6:
                    features[t, node], cuts[t, node] = f, c
            at[rows] = 2 * node + 1 + (bins[rows, features[t, node]] > cuts[t, node])
        leaf = at - inner
        gl, hl = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        leaves[t] = rate * gl / (hl + RIDGE)
        margin += leaves[t][leaf]
    return Boosted(edges, start, features, cuts, leaves)
