"""Histogram gradient-boosted trees for two classes, in numpy, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees' nodes end to end. A leaf is its own child, so a traversal of ``depth`` steps ends on a leaf."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.root, (len(x), len(self.root)))
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(axis=1))))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner bin edges of each column, at quantiles of its distinct values."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        out.append(middle if len(middle) < bins else np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])))
    return out


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 48,
    l2: float = 2.0,
    least: float = 3.0,
    monotone: np.ndarray | None = None,
) -> Forest:
    """Newton boosting of the logistic loss on binned columns.

    ``monotone`` has +1, -1 or 0 for each column: the score never falls (+1) or never rises (-1)
    as that column grows. A split that breaks this is refused, and the middle of its two values
    bounds all values below either side. ``least`` is the smallest sum of second derivatives on a
    side. With one class only, the forest has no trees and gives that class's smoothed share.
    """
    n, d = x.shape
    signs = np.zeros(d, int) if monotone is None else np.asarray(monotone, int)
    share = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = _edges(x, bins)
        width = max(len(e) for e in edges) + 1
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        flat = binned + np.arange(d) * width
        margin = np.full(n, bias)

        def leaf_value(g: np.ndarray, h: np.ndarray, low: float, high: float) -> np.ndarray:
            return np.clip(-rate * g / (h + l2), low, high)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            me = len(nodes)
            value = float(leaf_value(g[rows].sum(), h[rows].sum(), low, high))
            nodes.append([0, 0.0, me, me, value])
            best = None
            if level < depth and len(rows) > 1:
                at = flat[rows].ravel()
                hist_g = np.bincount(at, np.repeat(g[rows], d), d * width).reshape(d, width).cumsum(axis=1)
                hist_h = np.bincount(at, np.repeat(h[rows], d), d * width).reshape(d, width).cumsum(axis=1)
                gl, hl, gt, ht = hist_g[:, :-1], hist_h[:, :-1], hist_g[:, -1:], hist_h[:, -1:]
                gr, hr = gt - gl, ht - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2)
                vl, vr = leaf_value(gl, hl, low, high), leaf_value(gr, hr, low, high)
                gain[(hl < least) | (hr < least) | (signs[:, None] * (vr - vl) < 0)] = 0
                best = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[best] <= 1e-6:
                    best = None
            if best is None:
                margin[rows] += value
                return me
            column, cut = int(best[0]), int(best[1])
            goes = binned[rows, column] <= cut
            middle = float(vl[best] + vr[best]) / 2
            left_high, right_low = (middle if signs[column] > 0 else high), (middle if signs[column] > 0 else low)
            left_low, right_high = (middle if signs[column] < 0 else low), (middle if signs[column] < 0 else high)
            left = grow(rows[goes], g, h, level + 1, left_low, left_high)
            right = grow(rows[~goes], g, h, level + 1, right_low, right_high)
            nodes[me] = [column, float(edges[column][cut]), left, right, 0.0]
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
    table = np.array(nodes or [[0, 0.0, 0, 0, 0.0]])
    return Forest(
        np.array(roots, int), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], bias, depth
    )
