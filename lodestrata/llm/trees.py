"""Bagged decision trees: fitted on the driver over a bounded sample, exported to SQL, applied natively."""

from __future__ import annotations

import numpy as np


class Tree:
    """A binary classification tree by Gini impurity."""

    def __init__(self, depth: int = 5, least: int = 8):
        self.depth, self.least = depth, least
        self.root: tuple | float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.root = self._grow(x, y, self.depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> tuple | float:
        share = float(y.mean()) if len(y) else 0.0
        if depth == 0 or len(y) < 2 * self.least or share in (0.0, 1.0):
            return share
        best = (len(y) * share * (1 - share) - 1e-9, -1, 0.0)
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, t = x[order, k], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            left, right = t[:-1], t[-1] - t[:-1]
            cost = left * (1 - left / n[:-1]) + right * (1 - right / (len(y) - n[:-1]))
            ok = (v[1:] > v[:-1]) & (n[:-1] >= self.least) & (len(y) - n[:-1] >= self.least)
            if ok.any():
                cost = np.where(ok, cost, np.inf)
                i = int(cost.argmin())
                if cost[i] < best[0]:
                    best = (float(cost[i]), k, float((v[i] + v[i + 1]) / 2))
        if best[1] < 0:
            return share
        go = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[go], y[go], depth - 1), self._grow(x[~go], y[~go], depth - 1)

    def sql(self, names: list[str], node: tuple | float | None = None) -> str:
        node = self.root if node is None else node
        if not isinstance(node, tuple):
            return f"{node:.6f}D"
        k, at, low, high = node
        return f"CASE WHEN {names[k]} <= {at!r}D THEN {self.sql(names, low)} ELSE {self.sql(names, high)} END"


def bagged(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 5, seed: int = 7) -> list[Tree]:
    """Each tree sees a bootstrap sample of the rows; the seed is fixed, so the same sample gives the same trees."""
    draw = np.random.default_rng(seed)
    return [Tree(depth).fit(x[i], y[i]) for i in (draw.integers(0, len(y), len(y)) for _ in range(trees))]


def sql(forest: list[Tree], names: list[str]) -> str:
    """The mean vote as one SQL expression."""
    return "(" + " + ".join(t.sql(names) for t in forest) + f") / {len(forest)}D"
