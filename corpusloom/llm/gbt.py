"""Gradient-boosted trees on histograms for binary labels, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Complete binary trees: feature and threshold of inner nodes, value of leaves."""

    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(self.leaf.shape[1]).bit_length() - 1
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (2**depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, smooth: float = 2.0, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; splits on quantile bins of each feature."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1) if n else np.zeros((0, m), np.int64)
    rate_of = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = (node - first) * BINS
            best = np.full(width, 1e-9)
            for j in range(m):
                if not len(edges[j]):
                    continue
                where = at + binned[:, j]
                gs = np.cumsum(np.bincount(where, g, width * BINS).reshape(width, BINS), axis=1)
                hs = np.cumsum(np.bincount(where, h, width * BINS).reshape(width, BINS), axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gr, hr = ga - gl, ha - hl
                gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - ga**2 / (ha + smooth)
                gain[(hl < least) | (hr < least)] = -1
                gain[:, len(edges[j]) :] = -1
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for w in np.flatnonzero(top > best):
                    best[w] = top[w]
                    out.feature[t, first + w], out.threshold[t, first + w] = j, edges[j][k[w]]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.threshold[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        out.leaf[t] = rate * gs / (hs + smooth)
        margin += out.leaf[t][leaf]
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit by pooling adjacent violators: knots (score, value)."""
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order].astype(float)
    cuts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))  # equal scores are one point
    weight = np.diff(np.append(cuts, len(s))).astype(float)
    value = np.add.reduceat(v, cuts) / weight
    blocks: list[list[float]] = []  # value, weight, first and last score
    for x, w, a in zip(value, weight, s[cuts], strict=True):
        blocks.append([x, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            x2, w2, _, b2 = blocks.pop()
            x1, w1, a1, _ = blocks[-1]
            blocks[-1] = [(x1 * w1 + x2 * w2) / (w1 + w2), w1 + w2, a1, b2]
    knots = np.array([[b[2], b[0]] for b in blocks] + [[b[3], b[0]] for b in blocks])
    knots = knots[np.lexsort((knots[:, 1], knots[:, 0]))]
    return knots[:, 0], knots[:, 1]


def calibrated(score: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Values between knots are interpolated; in [0, 1]."""
    return np.clip(np.interp(score, *knots), 0.0, 1.0)
