"""Gradient-boosted trees for a yes/no target, kept as flat NumPy arrays.

Trees are grown level by level on quantile bins with the usual second-order
gain. A feature may be bound to a rising (+1) or falling (-1) effect: a split
that would break the direction is refused, and the children's values are kept
on their side of the split's middle, so the whole score is monotonic in it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FlatTrees:
    """Nodes of all trees in parallel arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        index = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            for _ in range(self.depth):
                low = rows[index, self.feature[at]] <= self.threshold[at]
                at = np.where(low, self.left[at], self.right[at])
            total += self.value[at]
        return total

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(rows), -40.0, 40.0)))


def fit_trees(
    rows: np.ndarray,
    target: np.ndarray,
    monotone: Sequence[int],
    *,
    trees: int = 40,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 1.0,
    least_weight: float = 2.0,
) -> FlatTrees:
    """Fit on finite ``rows``; ``target`` holds 0 and 1."""
    rows = np.asarray(rows, float)
    target = np.asarray(target, float)
    edges = [
        np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
        for column in rows.T
    ]
    binned = np.stack(
        [np.searchsorted(e, c, "left") for e, c in zip(edges, rows.T)], axis=1
    )
    prior = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(len(rows), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def leaf(value: float) -> int:
        me = len(nodes)
        nodes.append([0, np.inf, me, me, value])
        return me

    for _ in range(trees):
        chance = 1.0 / (1.0 + np.exp(-margin))
        slope, curve = chance - target, chance * (1.0 - chance)

        def grow(members: np.ndarray, left_depth: int, low: float, high: float) -> int:
            g, h = slope[members].sum(), curve[members].sum()
            own = float(np.clip(-g / (h + ridge), low, high))
            best = None
            if left_depth and len(members) > 1:
                best = _best_split(
                    binned[members], slope[members], curve[members],
                    edges, monotone, ridge, least_weight, low, high,
                )
            if best is None:
                margin[members] += rate * own
                return leaf(rate * own)
            feature, cut, down, up = best
            me = leaf(0.0)
            goes_left = binned[members, feature] <= cut
            middle = (down + up) / 2
            sides = [(low, high), (low, high)]
            if monotone[feature] > 0:
                sides = [(low, middle), (middle, high)]
            elif monotone[feature] < 0:
                sides = [(middle, high), (low, middle)]
            nodes[me] = [
                feature,
                float(edges[feature][cut]),
                grow(members[goes_left], left_depth - 1, *sides[0]),
                grow(members[~goes_left], left_depth - 1, *sides[1]),
                0.0,
            ]
            return me

        roots.append(grow(np.arange(len(rows)), depth, -np.inf, np.inf))
    table = np.array(nodes)
    return FlatTrees(
        table[:, 0].astype(np.int64),
        table[:, 1],
        table[:, 2].astype(np.int64),
        table[:, 3].astype(np.int64),
        table[:, 4],
        np.array(roots),
        depth,
        base,
    )


def _best_split(binned, slope, curve, edges, monotone, ridge, least_weight, low, high):
    """Feature, bin and the two values of the best allowed split, or None."""
    g, h = slope.sum(), curve.sum()
    best, gain = None, 1e-9
    for feature, cuts in enumerate(edges):
        if len(cuts) == 0:
            continue
        size = len(cuts) + 1
        gl = np.cumsum(np.bincount(binned[:, feature], slope, size))[:-1]
        hl = np.cumsum(np.bincount(binned[:, feature], curve, size))[:-1]
        gr, hr = g - gl, h - hl
        down = np.clip(-gl / (hl + ridge), low, high)
        up = np.clip(-gr / (hr + ridge), low, high)
        value = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g**2 / (h + ridge)
        allowed = (hl >= least_weight) & (hr >= least_weight)
        if monotone[feature]:
            allowed &= monotone[feature] * (up - down) >= 0
        value = np.where(allowed, value, -np.inf)
        at = int(np.argmax(value))
        if value[at] > gain:
            best, gain = (feature, at, float(down[at]), float(up[at])), value[at]
    return best
