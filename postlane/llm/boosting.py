"""Gradient-boosted trees over small integer features, in numpy."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, least: int = 8, l2: float = 1.0) -> dict:
    """Logistic boosting on ``x`` (rows x features, uint8) and ``y`` (0 or 1); equal rows are counted, not repeated."""
    rows, weight_of = np.unique(np.c_[x, y[:, None]], axis=0, return_counts=True)
    x, y, w = rows[:, :-1].astype(np.int64), rows[:, -1].astype(float), weight_of.astype(float)
    bins = int(x.max(initial=0)) + 1
    base = float(np.log((w @ y + 1) / (w @ (1 - y) + 1)))
    score, model = np.full(len(y), base), []
    offsets = np.arange(x.shape[1]) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * np.maximum(p * (1 - p), 1e-6)
        nodes = [(np.arange(len(y)), 0)]
        feature, cut, left, right, value = [], [], [], [], []

        def node():
            for v in (feature, cut, left, right):
                v.append(-1)
            value.append(0.0)
            return len(value) - 1

        stack = [(np.arange(len(y)), 0, node())]
        while stack:
            at, level, k = stack.pop()
            gs, hs = g[at].sum(), h[at].sum()
            value[k] = rate * gs / (hs + l2)
            if level == depth or w[at].sum() < 2 * least:
                continue
            flat = (x[at] + offsets).ravel()
            many = x.shape[1]
            gh = np.bincount(flat, np.repeat(g[at], many), bins * many).reshape(many, bins).cumsum(1)
            hh = np.bincount(flat, np.repeat(h[at], many), bins * many).reshape(many, bins).cumsum(1)
            wh = np.bincount(flat, np.repeat(w[at], many), bins * many).reshape(many, bins).cumsum(1)
            gain = gh**2 / (hh + l2) + (gs - gh) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2)
            gain[(wh < least) | (w[at].sum() - wh < least)] = -1
            f, c = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, c] <= 1e-6:
                continue
            goes = x[at, f] <= c
            feature[k], cut[k] = int(f), int(c)
            left[k], right[k] = node(), node()
            stack += [(at[goes], level + 1, left[k]), (at[~goes], level + 1, right[k])]
        tree = tuple(np.array(v) for v in (feature, cut, left, right, value))
        model.append(tree)
        score += _walk(tree, x, depth)
    return {"base": base, "trees": model, "depth": depth}


def _walk(tree, x: np.ndarray, depth: int) -> np.ndarray:
    feature, cut, left, right, value = tree
    at = np.zeros(len(x), dtype=np.int64)
    for _ in range(depth):
        f = feature[at]
        inner = f >= 0
        goes = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
        at = np.where(inner, np.where(goes, left[at], right[at]), at)
    return value[at]


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """The probability of 1; equal rows are walked once."""
    if not len(x):
        return np.zeros(0)
    x = np.ascontiguousarray(x, dtype=np.uint8)
    keys = x.view([("", np.void, x.shape[1])]).ravel() if x.shape[1] else np.zeros(len(x))
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    rows = x[first].astype(np.int64)
    score = np.full(len(rows), model["base"])
    for tree in model["trees"]:
        score += _walk(tree, rows, model["depth"])
    return (1 / (1 + np.exp(-score)))[back]
