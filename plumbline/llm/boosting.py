"""Gradient boosted trees for a few thousand rows of numbers: logistic loss, shallow trees, exact splits."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: int = 5) -> tuple:
    """(prior, rate, trees); a tree is nested tuples (feature, limit, left, right) or a leaf value."""
    prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, trees = np.full(len(y), prior), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, least)
        trees.append(tree)
        score += rate * _tree_value(tree, x)
    return prior, rate, trees


def _grow(x, grad, hess, rows, depth, least):
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = float(np.clip(g / (h + 1.0), -4, 4))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        order = rows[np.argsort(x[rows, f], kind="stable")]
        v = x[order, f]
        gl, hl = np.cumsum(grad[order])[:-1], np.cumsum(hess[order])[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(v[1:] == v[:-1])] = -1
        gain[: least - 1] = gain[len(gain) - least + 1 :] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], f, (v[k] + v[k + 1]) / 2)
    if best[1] is None:
        return leaf
    _, f, limit = best
    low = x[rows, f] <= limit
    return f, float(limit), _grow(x, grad, hess, rows[low], depth - 1, least), _grow(x, grad, hess, rows[~low], depth - 1, least)


def _tree_value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, limit, left, right = tree
    low = x[:, f] <= limit
    out = np.empty(len(x))
    out[low], out[~low] = _tree_value(left, x[low]), _tree_value(right, x[~low])
    return out


def predict(model: tuple, x: np.ndarray) -> np.ndarray:
    """Probabilities."""
    prior, rate, trees = model
    score = np.full(len(x), prior)
    for tree in trees:
        score += rate * _tree_value(tree, x)
    return 1 / (1 + np.exp(-score))
