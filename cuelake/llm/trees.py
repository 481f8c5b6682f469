"""Small decision trees, boosted or bagged, grown in numpy on a bounded sample on the driver."""

from __future__ import annotations

import numpy as np

#: A leaf's value, or (feature, threshold, where at most the threshold, where above).
Tree = float | tuple


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, columns: np.ndarray, least: float = 5.0, ridge: float = 1.0, cuts: int = 24) -> Tree:
    """A regression tree on gradients: leaves are -sum(grad) / (sum(hess) + ridge)."""

    def leaf(g: float, h: float) -> float:
        return float(-g / (h + ridge))

    g, h = grad.sum(), hess.sum()
    if depth == 0 or h < 2 * least:
        return leaf(g, h)
    best = (1e-9, 0, 0.0)
    for j in columns:
        values = np.unique(x[:, j])
        if len(values) < 2:
            continue
        middle = (values[1:] + values[:-1]) / 2
        at = middle if len(middle) <= cuts else middle[np.linspace(0, len(middle) - 1, cuts).astype(int)]
        side = np.searchsorted(at, x[:, j], side="left")  # x <= at[k] exactly if side <= k
        gl = np.cumsum(np.bincount(side, grad, len(at) + 1))[:-1]
        hl = np.cumsum(np.bincount(side, hess, len(at) + 1))[:-1]
        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
        gain[(hl < least) | (h - hl < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(j), float(at[k]))
    if best[0] <= 1e-9:
        return leaf(g, h)
    low = x[:, best[1]] <= best[2]
    return (
        best[1],
        best[2],
        grow(x[low], grad[low], hess[low], depth - 1, columns, least, ridge, cuts),
        grow(x[~low], grad[~low], hess[~low], depth - 1, columns, least, ridge, cuts),
    )


def predict(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, at, low, high = tree
    out, left = np.empty(len(x)), x[:, j] <= at
    out[left], out[~left] = predict(low, x[left]), predict(high, x[~left])
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float) -> list[Tree]:
    """Gradient boosting on the logistic loss."""
    z, trees, columns = np.zeros(len(y)), [], np.arange(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(z)
        tree = grow(x, p - y, p * (1 - p), depth, columns)
        trees.append(tree)
        z += rate * predict(tree, x)
    return trees


def margin(trees: list[Tree], x: np.ndarray, rate: float) -> np.ndarray:
    return rate * sum((predict(t, x) for t in trees), np.zeros(len(x)))


def bag(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int) -> list[Tree]:
    """A random forest: each tree sees a bootstrap of the rows and about half of the features; a leaf holds the share of y = 1."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        columns = np.sort(rng.choice(x.shape[1], max(1, (x.shape[1] + 1) // 2), replace=False))
        out.append(grow(x[rows], -y[rows].astype(float), np.ones(len(rows)), depth, columns, least=3, ridge=1e-9))
    return out
