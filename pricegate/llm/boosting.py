"""Gradient-boosted trees with monotone constraints: grown on histograms, scored as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Trees, their depth, the step of each, least rows of a leaf, weight of leaves' squares, bins of a feature.
TREES, DEPTH, RATE, LEAF, L2, BINS = 60, 4, 0.15, 20, 1.0, 64


@dataclass
class Trees:
    """Nodes of all trees, one after another. A row goes left where its feature is at most the threshold; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds: every row steps down all trees at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -700, 700)))


def _leaf(g: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A leaf's best value within its bounds, and the loss that it takes off."""
    w = np.clip(-g / (h + L2), lo, hi)
    return w, -(g * w + 0.5 * (h + L2) * w * w)


def _split(code: np.ndarray, g: np.ndarray, h: np.ndarray, signs: np.ndarray, lo: float, hi: float) -> tuple[int, int, float] | None:
    """(feature, bin, middle of the children's values) of the best split of some rows, or None.

    A split on a constrained feature must not go against its sign; the children's values are
    then kept on either side of their middle, which holds for all below them too.
    """
    n, p = code.shape
    flat = (code + np.arange(p) * BINS).ravel()
    sums = [np.bincount(flat, np.repeat(v, p) if v is not None else None, minlength=p * BINS).reshape(p, BINS).cumsum(1) for v in (g, h, None)]
    (gl, hl, nl), (gt, ht) = sums, (g.sum(), h.sum())
    wl, won_l = _leaf(gl, hl, lo, hi)
    wr, won_r = _leaf(gt - gl, ht - hl, lo, hi)
    gain = won_l + won_r - _leaf(gt, ht, lo, hi)[1]
    gain[(nl < LEAF) | (n - nl < LEAF) | (signs[:, None] * (wr - wl) < 0)] = 0
    best = int(gain.argmax())
    f, k = divmod(best, BINS)
    return (f, k, float(wl[f, k] + wr[f, k]) / 2) if gain[f, k] > 1e-6 else None


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Logistic loss. ``signs``: of each feature 1 if the score may not fall as it grows, -1 if it may not grow, 0 for no constraint.

    Rows of one class, or none, give no trees but a score near that class, or one half.
    """
    n, p = x.shape
    share = (y.sum() + 1) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1], method="lower")) if n else np.zeros(1) for f in range(p)]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1) if n else np.zeros((0, p), np.int64)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, raw = [], np.full(n, bias)

    def grow(rows: np.ndarray, lo: float, hi: float, level: int) -> int:
        at = len(nodes)
        value = float(_leaf(g[rows].sum(), h[rows].sum(), lo, hi)[0])
        nodes.append([0, np.inf, at, at, RATE * value])
        found = _split(code[rows], g[rows], h[rows], signs, lo, hi) if level < depth and len(rows) >= 2 * LEAF else None
        if found and found[1] < len(edges[found[0]]):
            f, k, middle = found
            under = code[rows, f] <= k
            bounds = [(lo, hi), (lo, hi)] if not signs[f] else [(lo, middle), (middle, hi)] if signs[f] > 0 else [(middle, hi), (lo, middle)]
            children = [grow(rows[side], *b, level + 1) for side, b in ((under, bounds[0]), (~under, bounds[1]))]
            nodes[at] = [f, float(edges[f][k]), *children, 0.0]
        else:
            raw[rows] += RATE * value
        return at

    if n and 0 < y.sum() < n:
        for _ in range(trees):
            q = 1 / (1 + np.exp(-raw))
            g, h = q - y, q * (1 - q)
            roots.append(grow(np.arange(n), -np.inf, np.inf, 0))
    columns = list(zip(*nodes, strict=True)) if nodes else [(), (), (), (), ()]
    feature, threshold, left, right, value = (np.array(c, t) for c, t in zip(columns, (np.int32, float, np.int32, np.int32, float), strict=True))
    return Trees(np.array(roots, np.int32), feature, threshold, left, right, value, depth, bias)
