"""A skip-chain conditional random field over the doubtful tokens of texts.

Nodes are tokens with features; chain edges join neighbours, skip edges join
repeated or similar tokens however far apart. Weights come from labelled nodes
piece by piece: features by softmax regression, edges by how much oftener two
labels meet than by chance. Loopy message passing gives each node's marginals.
All texts of a slice are one graph, so messages are a few array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS = 10
_DAMPING = 0.5


@dataclass(frozen=True)
class Field:
    """Weights of features by label, and of label pairs on both edge kinds."""

    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    most = values.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(values - most).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_features(
    features: np.ndarray,
    labels: np.ndarray,
    size: int,
    kinds: int,
    times: np.ndarray,
    steps: int = 300,
) -> np.ndarray:
    """Softmax regression; ``features`` holds the feature ids of each node, and
    ``times`` how often it occurs."""
    rows, of = np.unique(features, axis=0, return_inverse=True)
    count = np.zeros((len(rows), kinds))
    np.add.at(count, (of.ravel(), labels), times)
    total = count.sum(axis=1, keepdims=True)
    weights = np.zeros((size, kinds))
    scale = np.full((size, kinds), 1e-8)
    for _ in range(steps):
        score = weights[rows].sum(axis=1)
        chance = np.exp(score - _log_sum(score, 1)[:, None])
        slope = total * chance - count
        gradient = 0.1 * weights
        np.add.at(gradient, rows, slope[:, None, :])
        scale += gradient**2
        weights -= 0.5 * gradient / np.sqrt(scale)
    return weights


def pair_weights(
    first: np.ndarray, second: np.ndarray, kinds: int, times: np.ndarray, most: float = 3.0
) -> np.ndarray:
    """Log ratio of how often two labels meet and would meet by chance."""
    pairs = np.full((kinds, kinds), 0.5)
    np.add.at(pairs, (first, second), times)
    chance = pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True) / pairs.sum()
    return np.clip(np.log(pairs / chance), -most, most)


def marginals(
    field: Field, features: np.ndarray, chain: np.ndarray, skip: np.ndarray
) -> np.ndarray:
    """Each node's chance of each label; edges are pairs of node numbers."""
    score = field.features[features].sum(axis=1)
    tables = [
        np.broadcast_to(table, (len(edges), *table.shape))
        for table, edges in ((field.chain, chain), (field.skip, skip))
    ]
    edges = np.concatenate([chain, skip])
    belief = score
    if len(edges):
        table = np.concatenate(tables)
        # Both directions of each edge; the reverse of message k is at k + E.
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        message = np.zeros((len(source), score.shape[1]))
        back = np.roll(np.arange(len(source)), -len(edges))
        for _ in range(ROUNDS):
            belief = score.copy()
            np.add.at(belief, target, message)
            inner = belief[source] - message[back]
            new = _log_sum(inner[:, :, None] + table, 1)
            new -= _log_sum(new, 1)[:, None]
            message = _DAMPING * message + (1 - _DAMPING) * new
        belief = score.copy()
        np.add.at(belief, target, message)
    return np.exp(belief - _log_sum(belief, 1)[:, None])
