"""Gradient-boosted trees of fixed depth with logistic loss, on arrays."""

from __future__ import annotations

import numpy as np

BINS = 32


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2,
              least_weight: float = 5.0, ridge: float = 1.0) -> dict:
    """Trees as flat arrays: inner node n has children 2n+1 (value <= cut) and 2n+2.

    Cuts are quantiles of each feature; gains use first and second derivatives of
    the logistic loss; equal gains go to the first feature and cut.
    """
    inner, leaves = 2 ** depth - 1, 2 ** depth
    cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(x) else np.zeros((x.shape[1], BINS - 1))
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(x), start)
    feature, cut, value = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(x), np.int64)
        tree_f, tree_c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            for node in range(2 ** level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                best = (1e-6, 0, np.inf, BINS)
                if len(rows):
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for f in range(x.shape[1]):
                        left_g = np.bincount(binned[rows, f], g[rows], BINS).cumsum()[:-1]
                        left_h = np.bincount(binned[rows, f], h[rows], BINS).cumsum()[:-1]
                        right_g, right_h = total_g - left_g, total_h - left_h
                        gain = left_g ** 2 / (left_h + ridge) + right_g ** 2 / (right_h + ridge) - total_g ** 2 / (total_h + ridge)
                        gain[(left_h < least_weight / 4) | (right_h < least_weight / 4)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, float(cuts[f, k]), k)
                tree_f[node], tree_c[node] = best[1], best[2]
                at[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[3])
        leaf = at - inner
        sums_g, sums_h = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        out = rate * sums_g / (sums_h + ridge)
        margin += out[leaf]
        feature.append(tree_f)
        cut.append(tree_c)
        value.append(out)
    return {"start": start, "depth": depth, "feature": np.array(feature), "cut": np.array(cut), "value": np.array(value)}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-odds of every row."""
    out = np.full(len(x), model["start"])
    rows = np.arange(len(x))
    inner = 2 ** model["depth"] - 1
    for feature, cut, value in zip(model["feature"], model["cut"], model["value"]):
        at = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        out += value[at - inner]
    return out
