"""Cross-validated AUC gain of every feature over all the others.

All models, one per left-out feature and held-out fold, advance together: a
Newton step is one pass over the rows. Each partition keeps one packed array a
model, the upper triangle of its Hessian and the gradient; arrays are added up in
a tree of tasks, and the task that holds a model's sum takes its step. Only
coefficients reach the driver.

The models with all features are fitted first. Leaving a feature out then starts
from the full solution: removing a row and a column of its Hessian tells how the
other coefficients move when that one is forced to zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import Columns
from ..functions.scores import LOGIT_LIMIT
from ..session import written
from .ranking import INCREMENTAL_AUC, TARGET, class_counts, direction, method_rows, score_auc
from .sampling import fold_count, stratified_folds

# Solver settings that results depend on.
NEWTON_STEPS = 50
STEP_TOLERANCE = 1e-7
HESSIAN_RIDGE = 1e-4
WEIGHT_FLOOR = 1e-6

#: Partial sums of a model that one task of the first level adds up.
SUM_SHARDS = 32
_SUMS = "model int, shard int, sums array<double>"


@dataclass
class FoldModel:
    """Logistic model on some features, trained without one fold."""

    fold: int
    used: list[int]
    coefficients: np.ndarray = field(init=False)
    done: bool = False

    def __post_init__(self) -> None:
        self.coefficients = np.zeros(len(self.used) + 1)


def logistic(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -LOGIT_LIMIT, LOGIT_LIMIT)))


def training_scales(
    frame: DataFrame, features: Sequence[str], folds: int
) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation per held-out fold from per-fold moments."""
    rows = (
        frame.groupBy("fold")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.avg(name) for name in features]).alias("mean"),
            F.array(*[F.var_pop(name) for name in features]).alias("var"),
        )
        .collect()
    )
    size, mean, var = np.zeros(folds), *np.zeros((2, folds, len(features)))
    for row in rows:
        size[row.fold], mean[row.fold], var[row.fold] = row.n, row["mean"], row["var"]
    means, scales = np.zeros_like(mean), np.ones_like(mean)
    for held in range(folds):
        weight = np.where(np.arange(folds) == held, 0.0, size)[:, None]
        weight = weight / weight.sum()
        means[held] = (weight * mean).sum(axis=0)
        spread = (weight * (var + (mean - means[held]) ** 2)).sum(axis=0)
        scales[held] = np.where(spread > 0, np.sqrt(spread), 1.0)
    return means, scales


def _design(rows: np.ndarray, used: Sequence[int]) -> np.ndarray:
    return np.column_stack([np.ones(len(rows)), rows[:, used]])


def packed(matrix: np.ndarray) -> np.ndarray:
    """The upper triangle of a symmetric matrix, row after row."""
    return matrix[np.triu_indices(len(matrix))]


def unpacked(triangle: np.ndarray, width: int) -> np.ndarray:
    matrix = np.zeros((width, width))
    matrix[np.triu_indices(width)] = triangle
    return matrix + np.triu(matrix, 1).T


def newton_sums(
    frame: DataFrame,
    features: Sequence[str],
    models: Sequence[FoldModel],
    means: np.ndarray,
    scales: np.ndarray,
    target: str = TARGET,
) -> DataFrame:
    """Rows of each unfinished model, at most one a shard of a large table: packed
    Hessian, then gradient."""
    names, size = list(features), len(features) + 1
    open_ = [(k, m.fold, [0, *[i + 1 for i in m.used]]) for k, m in enumerate(models) if not m.done]
    weights = np.zeros((size, len(open_)))
    for place, (k, _, used) in enumerate(open_):
        weights[used, place] = models[k].coefficients

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch[names].to_numpy(dtype=float)
            y, fold = batch[target].to_numpy(dtype=float), batch["fold"].to_numpy()
            for held in {f for _, f, _ in open_}:
                train = fold != held
                of_fold = [p for p, (_, f, _) in enumerate(open_) if f == held]
                # All models of the fold share the design, margins and gradients.
                design = _design((values[train] - means[held]) / scales[held], range(size - 1))
                chance = logistic(design @ weights[:, of_fold])
                gradient = design.T @ (y[train][:, None] - chance)
                spread = np.maximum(chance * (1 - chance), WEIGHT_FLOOR)
                for column, place in enumerate(of_fold):
                    index, _, used = open_[place]
                    hessian = design.T @ (design * spread[:, column, None])
                    both = np.concatenate(
                        [packed(hessian[np.ix_(used, used)]), gradient[used, column]]
                    )
                    sums[index] = sums.get(index, 0.0) + both
        shard = TaskContext.get().partitionId() % SUM_SHARDS
        for index, total in sums.items():
            yield pd.DataFrame({"model": [index], "shard": [shard], "sums": [total]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        first = parts.iloc[:1].copy()
        first["sums"] = [np.sum(np.stack(parts["sums"].to_list()), axis=0)]
        return first

    partials = frame.select(target, "fold", *names).mapInPandas(partial, _SUMS)
    if len(frame.inputFiles()) <= SUM_SHARDS:
        # So few partial sums are added up where the step is taken.
        return partials
    return partials.groupBy("model", "shard").applyInPandas(add, _SUMS)


def newton_step(hessian: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(hessian, gradient)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(hessian, gradient, rcond=None)[0]


def starts_without(hessian: np.ndarray, coefficients: np.ndarray) -> list[np.ndarray]:
    """For each feature, the other coefficients when its own is forced to zero.

    They minimise the quadratic whose curvature is the Hessian.
    """
    inverse = np.linalg.pinv(hessian)
    out = []
    for j in range(1, len(coefficients)):
        move = inverse[:, j] * (coefficients[j] / inverse[j, j] if inverse[j, j] > 0 else 0.0)
        out.append(np.delete(coefficients - move, j))
    return out


def fit_models(
    frame: DataFrame,
    features: Sequence[str],
    models: Sequence[FoldModel],
    means: np.ndarray,
    scales: np.ndarray,
) -> dict[int, list[np.ndarray]]:
    """Damped Newton steps toward the unregularised fit, all models at once.

    Returns, for each finished model, where to start without one feature.
    """
    starts: dict[int, list[np.ndarray]] = {}
    for _ in range(NEWTON_STEPS):
        if all(model.done for model in models):
            break
        known = [(m.coefficients, len(m.used)) for m in models]

        def step(parts: pd.DataFrame) -> pd.DataFrame:
            index = int(parts["model"].iloc[0])
            coefficients, width = known[index][0], known[index][1] + 1
            total = np.sum(np.stack(parts["sums"].to_list()), axis=0)
            hessian = unpacked(total[:-width], width)
            # The intercept is not damped.
            hessian[np.arange(1, width), np.arange(1, width)] += HESSIAN_RIDGE
            move = newton_step(hessian, total[-width:])
            done = bool(np.abs(move).max() < STEP_TOLERANCE)
            after = coefficients + move
            without = [s.tolist() for s in starts_without(hessian, after)] if done else []
            return pd.DataFrame(
                {"model": [index], "coefficients": [after], "done": [done], "starts": [without]}
            )

        sums = newton_sums(frame, features, models, means, scales)
        steps = sums.groupBy("model").applyInPandas(
            step,
            "model int, coefficients array<double>, done boolean, starts array<array<double>>",
        )
        # A row of one model's coefficients each.
        for row in steps.collect():
            model = models[row.model]
            model.coefficients, model.done = np.array(row.coefficients), row.done
            if row.done:
                starts[row.model] = [np.array(s) for s in row.starts]
    return starts


def out_of_fold_scores(
    frame: DataFrame,
    features: Sequence[str],
    models: Sequence[FoldModel],
    means: np.ndarray,
    scales: np.ndarray,
    feature_sets: Sequence[Sequence[int]],
    target: str = TARGET,
) -> DataFrame:
    """Score each row by the models that did not train on it: one row per set."""
    names, current = list(features), list(models)
    place = {tuple(used): index for index, used in enumerate(feature_sets)}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[names].to_numpy(dtype=float)
            fold = batch["fold"].to_numpy()
            scores = np.full((len(batch), len(place)), 0.5)
            for model in current:
                held = fold == model.fold
                scaled = (values[held] - means[model.fold]) / scales[model.fold]
                margin = _design(scaled, model.used) @ model.coefficients
                scores[held, place[tuple(model.used)]] = logistic(margin)
            yield pd.DataFrame(
                {
                    "set": np.repeat(np.arange(len(place)), len(batch)),
                    "score": scores.T.ravel(),
                    target: np.tile(batch[target].to_numpy(), len(place)),
                }
            )

    return frame.select(target, "fold", *names).mapInPandas(
        score, f"set int, score double, {target} int"
    )


def cross_validated_auc(
    frame: DataFrame,
    features: Sequence[str],
    feature_sets: Sequence[Sequence[int]],
    columns: Columns = Columns(),
    *,
    seed: int = 7,
) -> list[float]:
    """Pooled out-of-fold AUC of each feature set; an empty set scores 0.5."""
    folds = fold_count(*class_counts(frame))
    # Every Newton step reads these rows again, so they are a table.
    rows = written(
        stratified_folds(frame, TARGET, folds, columns, seed=seed).select(
            TARGET, "fold", *features
        ),
        "folds",
    )
    means, scales = training_scales(rows, features, folds)
    every = list(range(len(features)))
    wanted = [list(used) for used in feature_sets if used]
    full = [FoldModel(held, every) for held in range(folds)] if every in wanted else []
    starts = fit_models(rows, features, full, means, scales)
    part = [FoldModel(held, used) for used in wanted if used != every for held in range(folds)]
    for model in part:
        left_out = [i for i in every if i not in model.used]
        if len(left_out) == 1 and model.fold in starts:
            model.coefficients = starts[model.fold][left_out[0]]
    fit_models(rows, features, part, means, scales)
    scored = out_of_fold_scores(rows, features, [*full, *part], means, scales, wanted)
    found = score_auc(scored, "set", "score")
    by_set = {row.set: row.score for row in found.collect()} if wanted else {}
    auc = iter(range(len(wanted)))
    return [by_set[next(auc)] if used else 0.5 for used in feature_sets]


def incremental_auc(
    frame: DataFrame,
    features: Sequence[str],
    columns: Columns = Columns(),
    *,
    seed: int = 7,
) -> DataFrame:
    """AUC of all features minus AUC without the one in question."""
    every = list(range(len(features)))
    sets = [every, *[[i for i in every if i != left_out] for left_out in every]]
    full, *reduced = cross_validated_auc(
        frame, features, sets, columns, seed=seed
    )
    gains = [(name, full - auc) for name, auc in zip(features, reduced, strict=True)]
    scores = frame.sparkSession.createDataFrame(gains, "feature string, score double")
    score = F.col("score")
    return method_rows(
        scores,
        INCREMENTAL_AUC,
        importance=F.greatest(score, F.lit(0.0)),
        shown=direction(score),
    )
