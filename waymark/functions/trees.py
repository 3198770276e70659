"""Array form of fitted tree ensembles for scoring and explanation in tasks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Rows that walk a tree together.
SHAP_ROWS = 8192


@dataclass(frozen=True)
class Tree:
    """Nodes by position; ``feature`` is -1 at a leaf, left means <= threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), dtype=int)
        while True:
            split = self.feature[node]
            inner = split >= 0
            if not inner.any():
                return self.value[node]
            at = rows[np.arange(len(rows)), np.maximum(split, 0)]
            step = np.where(at <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(inner, step, node)

    def leaves(self):
        """Yield (value, {feature: (low, high, cover share)}) of every leaf."""
        pending = [(0, {})]
        while pending:
            node, path = pending.pop()
            split = int(self.feature[node])
            if split < 0:
                yield float(self.value[node]), path
                continue
            low, high, kept = path.get(split, (-np.inf, np.inf, 1.0))
            cut = float(self.threshold[node])
            for child, bounds in (
                (int(self.left[node]), (low, min(high, cut))),
                (int(self.right[node]), (max(low, cut), high)),
            ):
                fraction = kept * float(self.cover[child] / self.cover[node])
                pending.append((child, {**path, split: (*bounds, fraction)}))


    @cached_property
    def path_features(self) -> int:
        """The most different features on one path."""
        most, pending = 0, [(0, frozenset())]
        while pending:
            node, path = pending.pop()
            split = int(self.feature[node])
            if split < 0:
                most = max(most, len(path))
            else:
                longer = path | {split}
                pending += [(int(self.left[node]), longer), (int(self.right[node]), longer)]
        return most

    def shap(self, rows: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values of the tree's output, for all rows at once.

        A leaf is a product game over the features on its path: a known feature
        counts 1 if the row goes that way and 0 if not (p), an unknown one the
        share of training rows that do (q). The value of feature i in it is the
        integral from 0 to 1 of (p_i - q_i) times the product of
        ``q_j (1 - x) + p_j x`` over the others. A few points make that integral
        exact, and the products at these points are carried down the tree once
        for all leaves; on the way back each edge pays its feature.
        """
        out = np.zeros(rows.shape)
        # Exact for polynomials of one degree less than a path has features.
        at, weight = np.polynomial.legendre.leggauss(max(1, -(-self.path_features // 2)))
        x, weight = (at + 1) / 2, weight / 2
        everyone = np.ones(len(rows), np.int8)
        columns = np.ascontiguousarray(rows.T)

        def factors(p: tuple[int, ...], q: float) -> np.ndarray:
            found = np.array([q * (1 - x) + one * x for one in p])
            return np.where(found > 0, found, 1.0)

        def visit(node: int, product: np.ndarray, path: dict) -> np.ndarray:
            split = int(self.feature[node])
            if split < 0:
                return self.value[node] * product
            below = columns[split] <= self.threshold[node]
            p_old, q_old = path.get(split, (everyone, 1.0))
            # Rows fall into three kinds: (p before, p now) is (0, 0), (1, 0) or (1, 1).
            was, now = (0, 1, 1), (0, 0, 1)
            old = factors(was, q_old)
            total = None
            for child, goes in ((self.left[node], below), (self.right[node], ~below)):
                q = q_old * float(self.cover[child] / self.cover[node])
                p = p_old * goes
                kind = p_old + p
                new = factors(now, q)
                # A deeper split on a feature replaces the payment of the one above.
                pay = weight * (
                    (np.array(now)[:, None] - q) / new - (np.array(was)[:, None] - q_old) / old
                )
                longer = {**path, split: (p, q)}
                inner = visit(int(child), product * (new / old).T.take(kind, axis=1), longer)
                out[:, split] += np.choose(kind, pay @ inner)
                total = inner if total is None else np.add(total, inner, out=total)
            return total

        visit(0, np.ones((len(x), len(rows))), {})
        return out


@dataclass(frozen=True)
class TreeEnsemble:
    """Weighted sum of trees; ``logistic`` turns the sum into a probability."""

    trees: list[Tree]
    weights: list[float]
    logistic: bool

    def margin(self, rows: np.ndarray) -> np.ndarray:
        rows = np.asarray(rows, dtype=float)
        total = np.zeros(len(rows))
        for weight, tree in zip(self.weights, self.trees, strict=True):
            total += weight * tree.predict(rows)
        return total

    def predict_proba(self, rows: np.ndarray) -> np.ndarray:
        positive = self.margin(rows)
        if self.logistic:
            positive = 1 / (1 + np.exp(-positive))
        return np.stack([1 - positive, positive], axis=1)

    def shap(self, rows: np.ndarray) -> tuple[np.ndarray, float]:
        """Path-dependent Shapley values of the margin, and the base value."""
        rows = np.asarray(rows, dtype=float)
        result, base = np.zeros(rows.shape), 0.0
        for weight, tree in zip(self.weights, self.trees, strict=True):
            for value, path in tree.leaves():
                base += weight * value * float(np.prod([part[2] for part in path.values()]))
            for begin in range(0, len(rows), SHAP_ROWS):
                part = slice(begin, begin + SHAP_ROWS)
                result[part] += weight * tree.shap(rows[part])
        return result, base
