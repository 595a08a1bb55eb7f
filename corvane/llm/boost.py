"""Gradient-boosted trees for binary labels in numpy: small, deterministic, trained in the driver on a bounded sample."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of one depth over features cut into at most ``bins`` bins, fitted to the logistic loss.

    Scores are calibrated on held-out rows by isotonic regression, so that ``chance`` can be held against a threshold.
    """

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        q = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(self.cuts, x.T, strict=True)], 1)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score = np.full(len(y), self.base)
        nodes, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.cut, self.leaf = np.zeros((self.trees, nodes), int), np.full((self.trees, nodes), np.inf), np.zeros((self.trees, leaves))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h, at = y - p, p * (1 - p), np.zeros(len(y), int)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                best, f, c = self._split(q[rows], g[rows], h[rows]) if len(rows) >= 2 * self.least else (0, 0, None)
                if c is not None:
                    self.feature[t, node], self.cut[t, node] = f, self.cuts[f][c]
                at[rows] = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            at -= nodes
            for k in range(leaves):
                own = at == k
                self.leaf[t, k] = self.rate * g[own].sum() / (h[own].sum() + 1)
            score += self.leaf[t, at]
        self._calibrate(self.score(held_x), held_y)
        return self

    def _split(self, q: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int | None]:
        best, at, cut, all_g, all_h = 1e-6, 0, None, g.sum(), h.sum()
        for f in range(q.shape[1]):
            n = len(self.cuts[f])
            gl, hl, nl = (np.cumsum(np.bincount(q[:, f], w, minlength=n + 1))[:-1] for w in (g, h, np.ones(len(g))))
            if not n:
                continue
            gain = gl**2 / (hl + 1) + (all_g - gl) ** 2 / (all_h - hl + 1) - all_g**2 / (all_h + 1)
            gain[(nl < self.least) | (len(g) - nl < self.least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, at, cut = float(gain[k]), f, k
        return best, at, cut

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in range(self.trees):
            at, rows = np.zeros(len(x), int), np.arange(len(x))
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t, at - (2**self.depth - 1)]
        return out

    def _calibrate(self, score: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # score from, labels, rows
        for s, v in zip(score[order], y[order], strict=True):
            blocks.append([s, v, 1])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                b = blocks.pop()
                blocks[-1] = [blocks[-1][0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
        self.steps = np.array([b[0] for b in blocks])
        self.chances = np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])

    def chance(self, x: np.ndarray) -> np.ndarray:
        return self.chances[np.maximum(np.searchsorted(self.steps, self.score(x), side="right") - 1, 0)]
