"""Gradient-boosted trees for two classes: histogram splits, logistic loss, Newton leaves; numpy only."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of ``depth`` levels; features are cut into at most ``bins`` ranges by quantile."""

    def __init__(self, trees: int = 50, depth: int = 4, bins: int = 32, rate: float = 0.2, l2: float = 1.0, least: int = 8) -> None:
        self.trees, self.depth, self.bins, self.rate, self.l2, self.least = trees, depth, bins, rate, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, m = x.shape
        w = np.ones(n) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        coded = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.int64)
        nodes = 2**self.depth - 1
        self.feature = np.zeros((self.trees, nodes), np.int32)
        self.cut = np.full((self.trees, nodes), np.inf)
        self.leaf = np.zeros((self.trees, 2**self.depth))
        share = np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = w * (p - y), w * p * (1 - p)
            at = np.zeros(n, np.int64)  # place in the level
            for level in range(self.depth):
                width = 2**level
                gs, hs, cs = (np.stack([np.bincount(at * self.bins + coded[j], v, width * self.bins).reshape(width, self.bins) for j in range(m)]) for v in (g, h, np.ones(n)))
                left_g, left_h, left_c = (v.cumsum(2)[:, :, :-1] for v in (gs, hs, cs))
                all_g, all_h, all_c = (v.sum(2)[:, :, None] for v in (gs, hs, cs))
                gain = left_g**2 / (left_h + self.l2) + (all_g - left_g) ** 2 / (all_h - left_h + self.l2) - all_g**2 / (all_h + self.l2)
                gain[(left_c < self.least) | (all_c - left_c < self.least)] = -np.inf
                flat = gain.transpose(1, 0, 2).reshape(width, -1)
                best = flat.argmax(1)
                f, b = best // (self.bins - 1), best % (self.bins - 1)
                split = flat[np.arange(width), best] > 1e-6
                first = width - 1
                self.feature[t, first : first + width] = np.where(split, f, 0)
                self.cut[t, first : first + width] = [self.edges[j][k] if s and k < len(self.edges[j]) else np.inf for j, k, s in zip(f, b, split, strict=True)]
                at = at * 2 + (x[np.arange(n), self.feature[t, first + at]] > self.cut[t, first + at])
            gs, hs = np.bincount(at, g, 2**self.depth), np.bincount(at, h, 2**self.depth)
            self.leaf[t] = -self.rate * gs / (hs + self.l2)
            z += self.leaf[t][at]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            z += leaf[at - (2**self.depth - 1)]
        return z
