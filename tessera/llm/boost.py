"""Gradient-boosted decision trees for binary labels, in numpy.

Features are small numbers (flags, counts, lengths), so every feature is cut at
its distinct values, at most ``BINS`` of them.  Logistic loss, depth-limited
trees grown level by level, Newton leaf values.  Deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 24


@dataclass
class Boosted:
    rounds: int = 60
    depth: int = 3
    rate: float = 0.25
    l2: float = 1.0
    sample: float = 1.0  # share of the rows that a tree is grown on, drawn anew for each
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, k = x.shape
        cuts = []
        for j in range(k):
            v = np.unique(x[:, j])
            mids = (v[1:] + v[:-1]) / 2
            cuts.append(mids if len(mids) <= BINS else np.quantile(mids, np.linspace(0, 1, BINS)))
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        width = max(len(c) for c in cuts) + 1
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(n, self.base)
        offsets = np.arange(k) * width
        draw = np.random.default_rng(0)
        whole = (x, y, binned, f)
        for _ in range(self.rounds):
            if self.sample < 1:
                own = np.flatnonzero(draw.random(len(whole[1])) < self.sample)
                x, y, binned, f = whole[0][own], whole[1][own], whole[2][own], whole[3][own]
                n = len(own)
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            size = 2 ** (self.depth + 1) - 1
            feat, cut, leaf = np.full(size, -1), np.zeros(size), np.zeros(size)
            node = np.zeros(n, int)
            for level in range(self.depth + 1):
                for m in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = np.flatnonzero(node == m)
                    if not len(own):
                        continue
                    sg, sh = g[own].sum(), h[own].sum()
                    leaf[m] = self.rate * sg / (sh + self.l2)
                    if level == self.depth or len(own) < 8:
                        continue
                    at = (binned[own] + offsets).ravel()
                    hg = np.bincount(at, np.repeat(g[own], k), k * width).reshape(k, width).cumsum(axis=1)
                    hh = np.bincount(at, np.repeat(h[own], k), k * width).reshape(k, width).cumsum(axis=1)
                    gain = hg**2 / (hh + self.l2) + (sg - hg) ** 2 / (sh - hh + self.l2) - sg**2 / (sh + self.l2)
                    gain[(hh < 1e-6) | (sh - hh < 1e-6)] = 0
                    j, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[j, b] < 1e-4 or b >= len(cuts[j]):
                        continue
                    feat[m], cut[m] = j, cuts[j][b]
                    node[own] = 2 * m + 1 + (x[own, j] > cut[m])
            self.trees.append((feat, cut, leaf))
            if self.sample < 1:
                whole[3][:] += self._leaf(self.trees[-1], whole[0])
            else:
                f += leaf[node]
        return self

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feat, cut, leaf = tree
        rows, node = np.arange(len(x)), np.zeros(len(x), int)
        for _ in range(self.depth):
            j = feat[node]
            node = np.where(j >= 0, 2 * node + 1 + (x[rows, np.maximum(j, 0)] > cut[node]), node)
        return leaf[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label."""
        f = np.full(len(x), self.base)
        for tree in self.trees:
            f += self._leaf(tree, x)
        return 1 / (1 + np.exp(-f))
