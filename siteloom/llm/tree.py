"""A small CART classifier: fitted on a labelled table on the driver, applied to NumPy columns on the executors."""

from __future__ import annotations

import numpy as np


class Tree:
    """Binary or multi-class decision tree with Gini splits.

    ``fit`` takes a bounded labelled table (the caller states its bound); ``predict`` works on matrices of any height.
    """

    def __init__(self, max_depth: int = 6, min_leaf: int = 3):
        self.max_depth, self.min_leaf = max_depth, min_leaf

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Tree":
        x, y = np.asarray(x, np.float64), np.asarray(y, np.int64)
        self.k = int(y.max()) + 1 if len(y) else 1
        w = np.ones(len(y)) if weight is None else np.asarray(weight, np.float64)
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []
        self._grow(x, y, w, 0)
        for name in ("feature", "cut", "left", "right", "value"):
            setattr(self, name, np.array(getattr(self, name)))
        return self

    def _node(self, y, w) -> int:
        shares = np.bincount(y, weights=w, minlength=self.k)
        for into, what in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, shares / max(shares.sum(), 1e-12))):
            into.append(what)
        return len(self.feature) - 1

    def _grow(self, x, y, w, depth) -> int:
        node = self._node(y, w)
        if depth == self.max_depth or len(np.unique(y)) < 2 or len(y) < 2 * self.min_leaf:
            return node
        hot = np.zeros((len(y), self.k))
        hot[np.arange(len(y)), y] = w
        best = (1e-9, -1, 0.0)
        whole = hot.sum(0)
        base = whole.sum() - (whole**2).sum() / whole.sum()
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(hot[order], 0)
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= self.min_leaf) & (len(y) - at - 1 >= self.min_leaf)]
            if not len(at):
                continue
            a, b = c[at], whole - c[at]
            gain = base - (a.sum(1) - (a**2).sum(1) / a.sum(1)) - (b.sum(1) - (b**2).sum(1) / b.sum(1))
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], f, (v[at[i]] + v[at[i] + 1]) / 2)
        if best[1] < 0:
            return node
        go = x[:, best[1]] <= best[2]
        self.feature[node], self.cut[node] = best[1], best[2]
        self.left[node] = self._grow(x[go], y[go], w[go], depth + 1)
        self.right[node] = self._grow(x[~go], y[~go], w[~go], depth + 1)
        return node

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Class shares of the leaf of each row."""
        at = np.zeros(len(x), np.int64)
        for _ in range(self.max_depth):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= self.cut[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
        return self.value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.shares(x).argmax(1) if len(x) else np.zeros(0, np.int64)
