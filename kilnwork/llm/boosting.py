"""Gradient-boosted trees for logistic loss, in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth. Node i of a tree goes to 2i+1 if its feature is at most its threshold, else to 2i+2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row, all rows of a tree level at once."""
        out, row = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, f[at]] > t[at])
            out += v[at - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def constant(y: np.ndarray) -> Trees:
    """Without rows of both labels there is nothing to split: the smoothed log-odds."""
    p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.99
    return Trees(float(np.log(p / (1 - p))), 1, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))


def fit(x: np.ndarray, y: np.ndarray, *, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 2.0, bins: int = 64, least: float = 5.0) -> Trees:
    """monotone: by feature +1 (the score never falls as it grows) or -1. A split that would break a constraint isn't made, and
    its children's values stay on their side of the middle of the parent's two."""
    if len(np.unique(y)) < 2:
        return constant(y)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], 1)  # x <= edge: bin at most its index
    sign = np.array([(monotone or {}).get(f, 0) for f in range(width)])
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = y - prob, prob * (1 - prob)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at, first = np.zeros(n, np.int64), 0
        low, high, weight = np.full(1, -np.inf), np.full(1, np.inf), None
        for level in range(depth):
            nodes = 2**level
            key = (at[:, None] * width + np.arange(width)) * bins + code
            gs, hs = (np.bincount(key.ravel(), np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins) for v in (g, h))
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            bound = lambda v: np.clip(v, low[:, None, None], high[:, None, None])  # noqa: B023, E731
            vl, vr = bound(gl / (hl + ridge)), bound((gt - gl) / (ht - hl + ridge))
            gain_of = lambda G, H, v: G * v - 0.5 * (H + ridge) * v * v
            gain = gain_of(gl, hl, vl) + gain_of(gt - gl, ht - hl, vr) - gain_of(gt, ht, bound(gt / (ht + ridge)))
            bad = (hl < least / 4) | (ht - hl < least / 4) | ((vr - vl) * sign[None, :, None] < 0)
            for f in range(width):
                bad[:, f, len(edges[f]) :] = True
            gain[bad] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            f, b = best // bins, best % bins
            split = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            new_low, new_high = np.repeat(low, 2), np.repeat(high, 2)
            for i in np.flatnonzero(split):
                feature[first + i], threshold[first + i] = f[i], edges[f[i]][b[i]]
                if s := sign[f[i]]:
                    middle = (vl[i, f[i], b[i]] + vr[i, f[i], b[i]]) / 2
                    (new_high if s > 0 else new_low)[2 * i] = middle
                    (new_low if s > 0 else new_high)[2 * i + 1] = middle
            low, high = new_low, new_high
            at = 2 * at + (x[np.arange(n), feature[first + at]] > threshold[first + at])
            first += nodes
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        value = rate * np.clip(gs / (hs + ridge), low, high)
        score += value[at]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    return Trees(base, depth, np.array(out_f), np.array(out_t), np.array(out_v))
