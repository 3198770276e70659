"""Shapley values of model scores and the tables drawn from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import Columns
from ..functions.scores import share
from ..functions.trees import TreeEnsemble
from ..session import written
from ..sources.models import LinearModel, ModelSpec
from .ordering import value_ranks
from .ranking import SHAP, method_rows
from .sampling import BACKGROUND_ROWS, background_rows

EXPLAINERS = ("Auto", "Tree", "Linear", "Permutation")
# Features whose coalitions are still enumerated; beyond, rounds must be stated.
MOST_ENUMERATED = 15
# Numbers of a row-by-background table built at a time.
MIXED_CELLS = 2_000_000

# Layout of the density view.
DENSITY_BINS = (8, 40)
DENSITY_HEIGHT = 0.7


def choose_explainer(spec: ModelSpec, explainer: str = "Auto") -> str:
    """Tree for ensembles, Linear for fitted linear models, else Permutation."""
    if explainer not in EXPLAINERS:
        raise ValueError(f"Unsupported SHAP explainer: {explainer!r}.")
    trees = isinstance(spec.model, TreeEnsemble)
    linear = isinstance(spec.model, LinearModel)
    if explainer == "Auto":
        # A model file only promises probabilities; a fitted one its coefficients.
        fitted = linear and spec.model.path is None
        return "Tree" if trees else "Linear" if fitted else "Permutation"
    if (explainer == "Tree" and not trees) or (explainer == "Linear" and not linear):
        raise ValueError(
            f"The {explainer} SHAP explainer is not compatible with model {spec.name!r}."
        )
    return explainer


def shap_contributions(
    frame: DataFrame,
    spec: ModelSpec,
    columns: Columns = Columns(),
    *,
    explainer: str = "Auto",
    seed: int = 7,
    background: int = BACKGROUND_ROWS,
    rounds: int | None = None,
) -> DataFrame:
    """One row per input row: row id, ``base_value`` and a contribution array.

    ``contributions`` holds ``feature, feature_value, shap_value`` in model
    order. The features must have no gaps. Linear and Permutation measure
    against the first ``background`` rows. Permutation enumerates all coalitions
    of features; with ``rounds`` it averages that many seeded orders instead.
    """
    kind = choose_explainer(spec, explainer)
    names = list(spec.features)
    if kind == "Linear":
        values, base = _linear_values(frame, spec, columns, background)
    else:
        packed = F.struct(*[F.col(name).cast("double").alias(name) for name in names])
        if kind == "Tree":
            kernel = _tree_kernel(frame, spec)
        else:
            kernel = _permutation_kernel(frame, spec, columns, seed, background, rounds)
        frame = frame.withColumn(
            "__shap", F.pandas_udf(kernel, "array<double>")(packed)
        )
        values = [F.get("__shap", F.lit(i)) for i in range(len(names))]
        base = F.get("__shap", F.lit(len(names)))
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            F.col(name).cast("double").alias("feature_value"),
            value.alias("shap_value"),
        )
        for name, value in zip(names, values, strict=True)
    ]
    return frame.select(
        columns.row, base.alias("base_value"), F.array(*entries).alias("contributions")
    )


def _linear_values(
    frame: DataFrame, spec: ModelSpec, columns: Columns, limit: int
) -> tuple[list[Column], Column]:
    """Closed form on the margin: weight times distance from the background mean."""
    background = background_rows(
        frame.select(columns.row, *spec.features), columns, limit=limit
    )
    means = background.agg(*[F.avg(name).alias(name) for name in spec.features]).first()
    weights = dict(zip(spec.features, spec.model.weights, strict=True))
    values = [
        F.lit(weight) * (F.col(name).cast("double") - F.lit(float(means[name])))
        for name, weight in weights.items()
    ]
    base = spec.model.intercept + sum(w * means[name] for name, w in weights.items())
    return values, F.lit(float(base))


def _tree_kernel(frame: DataFrame, spec: ModelSpec) -> Callable:
    shared = share(frame.sparkSession, spec.model)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        ensemble = shared()
        for batch in batches:
            values, base = ensemble.shap(batch.to_numpy(dtype=float))
            yield pd.Series(list(np.column_stack([values, np.full(len(values), base)])))

    return explain


def coalition_plan(
    size: int, seed: int, rounds: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions to evaluate and the weights turning their values into Shapley
    values.

    All coalitions are enumerated, which is exact; with ``rounds`` that many
    seeded orders are averaged, each walked forwards and backwards.
    """
    if rounds is None and size > MOST_ENUMERATED:
        raise ValueError(
            f"{size} features have too many coalitions; state the rounds to average."
        )
    index: dict[tuple[bool, ...], int] = {}
    terms: list[tuple[int, tuple[bool, ...], float]] = []

    def add(feature: int, members: Sequence[int], weight: float) -> None:
        without = tuple(i in members for i in range(size))
        having = tuple(i in members or i == feature for i in range(size))
        for mask, sign in ((having, 1.0), (without, -1.0)):
            index.setdefault(mask, len(index))
            terms.append((feature, mask, sign * weight))

    if rounds is None:
        for feature in range(size):
            others = [i for i in range(size) if i != feature]
            for count in range(size):
                weight = factorial(count) * factorial(size - count - 1) / factorial(size)
                for members in combinations(others, count):
                    add(feature, members, weight)
    else:
        random = np.random.default_rng(seed)
        for _ in range(rounds):
            order = [int(i) for i in random.permutation(size)]
            for walk in (order, order[::-1]):
                for k, feature in enumerate(walk):
                    add(feature, walk[:k], 0.5 / rounds)
    masks = np.array(list(index), dtype=bool).reshape(-1, size)
    weights = np.zeros((size, len(index)))
    for feature, mask, weight in terms:
        weights[feature, index[mask]] += weight
    return masks, weights


def _permutation_kernel(
    frame: DataFrame,
    spec: ModelSpec,
    columns: Columns,
    seed: int,
    limit: int,
    rounds: int | None,
) -> Callable:
    """Features outside a coalition take every background value in turn."""
    names = list(spec.features)
    # As many rows as the caller states.
    background = (
        background_rows(frame.select(columns.row, *names), columns, limit=limit)
        .select(*names)
        .toPandas()
        .to_numpy(dtype=float)
    )
    masks, weights = coalition_plan(len(names), seed, rounds)
    shared = share(frame.sparkSession, (spec, background, masks, weights))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model, reference, wanted, shapley = shared()
        base = float(np.mean(_scores(model, reference)))
        for batch in batches:
            rows = batch.to_numpy(dtype=float)
            means = np.empty((len(wanted), len(rows)))
            for k, mask in enumerate(wanted):
                means[k] = _mean_scores(model, rows, reference, mask)
            values = (shapley @ means).T
            yield pd.Series(list(np.column_stack([values, np.full(len(rows), base)])))

    return explain


def _scores(spec: ModelSpec, rows: np.ndarray) -> np.ndarray:
    return spec.scores(pd.DataFrame(rows, columns=list(spec.features)))


def _mean_scores(
    spec: ModelSpec, rows: np.ndarray, reference: np.ndarray, mask: np.ndarray
) -> np.ndarray:
    """Mean score of each row with the unmasked features from the background."""
    if mask.all():
        return _scores(spec, rows)
    if not mask.any():
        return np.full(len(rows), _scores(spec, reference).mean())
    means = np.empty(len(rows))
    chunk = max(1, MIXED_CELLS // reference.size)
    for start in range(0, len(rows), chunk):
        part = rows[start : start + chunk]
        mixed = np.where(mask, part[:, None, :], reference[None, :, :])
        scores = _scores(spec, mixed.reshape(-1, rows.shape[1]))
        means[start : start + chunk] = scores.reshape(len(part), -1).mean(axis=1)
    return means


def shap_rows(
    contributions: DataFrame,
    columns: Columns = Columns(),
    *,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """One row per input row and feature."""
    long = contributions.select(
        F.col(columns.row).alias("row_index"), "base_value", F.inline_outer("contributions")
    )
    return long if features is None else long.filter(F.col("feature").isin(list(features)))


def shap_importance(rows: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature in the common result layout."""
    scores = rows.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("score"))
    return method_rows(
        scores, SHAP, importance=F.col("score"), shown=F.lit("non-directional")
    )


def shap_density(rows: DataFrame) -> DataFrame:
    """Relative feature value and vertical offset of every point of the beeswarm.

    Within a feature, values falling into the same of 8..40 bins are stacked in
    row order around zero; the fullest bin sets the scale. The contributions are
    written once, as several steps read them.
    """
    rows = written(rows, "contributions")
    low, high = DENSITY_BINS
    stats = rows.groupBy("feature").agg(
        F.min("feature_value").alias("fmin"),
        F.max("feature_value").alias("fmax"),
        F.min("shap_value").alias("smin"),
        F.max("shap_value").alias("smax"),
        F.least(
            F.greatest(F.bround(F.sqrt(F.count(F.lit(1))) * 2), F.lit(low)), F.lit(high)
        ).alias("bins"),
    )
    # One row per model feature.
    placed = rows.join(F.broadcast(stats), "feature")
    span = F.col("fmax") - F.col("fmin")
    width = (F.col("smax") - F.col("smin")) / F.col("bins")
    position = F.floor((F.col("shap_value") - F.col("smin")) / width)
    binned = placed.select(
        "feature",
        "row_index",
        "feature_value",
        (
            (F.col("feature_value") - F.col("fmin"))
            / F.when(span == 0, F.lit(1.0)).otherwise(span)
        ).alias("relative_value"),
        "shap_value",
        # NULL where all contributions of the feature are equal.
        F.when(width > 0, F.least(position, F.col("bins") - 1)).cast("int").alias("bin"),
    )
    ranked = value_ranks(binned, ["feature", "bin"], "row_index", rank="place", total="stack")
    fullest = F.broadcast(
        binned.groupBy("feature", "bin")
        .agg(F.count(F.lit(1)).alias("m"))
        .groupBy("feature")
        .agg(F.max("m").alias("fullest"))
    )
    offset = (
        (F.col("place") - 1 - (F.col("stack") - 1) / 2)
        * F.lit(DENSITY_HEIGHT)
        / F.col("fullest")
    )
    return (
        ranked.join(fullest, "feature")
        .select(
            "feature",
            "row_index",
            "feature_value",
            "relative_value",
            "shap_value",
            F.when(F.col("bin").isNull(), F.lit(0.0)).otherwise(offset).alias(
                "density_offset"
            ),
        )
    )


def shap_beeswarm(density: DataFrame) -> DataFrame:
    """Density table with ``plot_y``: features stacked by rising importance.

    The feature's place, from 0, is its rank by mean absolute contribution.
    """
    # One row per model feature.
    importance = density.groupBy("feature").agg(
        F.avg(F.abs("shap_value")).alias("importance")
    )
    by_importance = Window.orderBy("importance", "feature")
    places = importance.select(
        "feature", (F.row_number().over(by_importance) - 1).alias("place")
    )
    return density.join(F.broadcast(places), "feature").select(
        *density.columns, (F.col("place") + F.col("density_offset")).alias("plot_y")
    )


def shap_waterfall(
    contributions: DataFrame, columns: Columns = Columns(), *, top: int | None = None
) -> DataFrame:
    """Contributions of a row, largest first, as steps from the base value.

    A row's contributions are one array, so ordering and running sums need no
    shuffle. Equal sizes keep model order.
    """
    keyed = F.transform(
        "contributions",
        lambda part, i: F.struct(
            (-F.abs(part["shap_value"])).alias("key"), i.alias("at"), part.alias("part")
        ),
    )
    ordered = F.transform(F.array_sort(keyed), lambda item: item["part"])
    steps = contributions.withColumn("ordered", ordered)
    before = F.aggregate(
        F.slice("ordered", F.lit(1), F.col("pos")),
        F.col("base_value"),
        lambda total, part: total + part["shap_value"],
    )
    result = (
        steps.select("*", F.posexplode_outer("ordered").alias("pos", "part"))
        .withColumn("start", before)
        .select(
            F.col(columns.row).alias("row_index"),
            (F.col("pos") + 1).alias("step"),
            F.col("part.feature").alias("feature"),
            F.col("part.feature_value").alias("feature_value"),
            F.col("part.shap_value").alias("contribution"),
            "start",
            (F.col("start") + F.col("part.shap_value")).alias("end"),
            F.when(F.col("part.shap_value") >= 0, F.lit("Increases output"))
            .otherwise(F.lit("Decreases output"))
            .alias("direction"),
        )
    )
    return result if top is None else result.filter(F.col("step") <= top)


def shap_range(waterfall: DataFrame) -> DataFrame:
    """Lowest and highest output on the way, padded by 5 %, at least 0.01."""
    ends = waterfall.agg(
        F.min(F.least("start", "end")).alias("lo"),
        F.max(F.greatest("start", "end")).alias("hi"),
    )
    padding = F.greatest((F.col("hi") - F.col("lo")) * 0.05, F.lit(0.01))
    return ends.select(
        F.coalesce(F.col("lo") - padding, F.lit(-1.0)).alias("lower"),
        F.coalesce(F.col("hi") + padding, F.lit(1.0)).alias("upper"),
    )
