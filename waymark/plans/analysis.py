"""Feature analysis: one prepared sample, several methods, one result table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame

from ..columns import Columns, require_columns
from ..operators import explain, ranking
from ..operators.incremental import incremental_auc
from ..operators.permutation import permutation_importance
from ..operators.sampling import sample_rows
from ..sources.models import ModelSpec

RESULT_SCHEMA = (
    "feature string, method string, score double, importance double, direction string"
)


def analyze_features(
    points: DataFrame,
    features: Iterable[str],
    methods: Iterable[str],
    *,
    label: str,
    positive: object,
    columns: Columns = Columns(),
    model: ModelSpec | None = None,
    explainer: str = "Auto",
    sample_size: int | None = None,
    group: str | None = None,
    seed: int = 7,
) -> DataFrame:
    """Rank features by the chosen methods.

    ``sample_size=None`` analyses every row and stays lazy; a sample is drawn
    once and the finished result returned. The full correlation matrix has a
    table of its own, see :func:`correlation_matrix`.
    """
    features, methods = list(dict.fromkeys(features)), list(dict.fromkeys(methods))
    unknown = sorted(set(methods) - set(ranking.METHODS))
    if not features or not methods or unknown:
        known = ", ".join(ranking.METHODS)
        raise ValueError(
            f"A ranking takes at least one feature and one method of {known}; "
            f"unknown are {unknown}."
        )
    require_columns(points, [*features, label])
    used = _model_features(features, methods, model)
    if points.isEmpty():
        raise ValueError("There are no rows to rank features by.")

    def results(rows: DataFrame) -> DataFrame:
        return _results(
            rows, features, methods, label, positive, columns, model, used, explainer,
            seed,
        )

    if sample_size is None:
        return results(points)
    sample = sample_rows(points, sample_size, columns, group=group, seed=seed)
    return _settled(sample, results)


def _settled(sample: DataFrame, results: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Draw a sample once, let every method read it, and return the finished rows.

    The results have a few rows per feature, whatever the size of the table.
    """
    sample = sample.persist()
    try:
        found = results(sample)
        return found.sparkSession.createDataFrame(found.collect(), found.schema)
    finally:
        sample.unpersist()


def _results(
    points: DataFrame,
    features: list[str],
    methods: list[str],
    label: str,
    positive: object,
    columns: Columns,
    model: ModelSpec | None,
    used: list[str],
    explainer: str,
    seed: int,
) -> DataFrame:
    inputs = list(model.features) if used and model is not None else []
    frame = ranking.labelled_features(
        points,
        list(dict.fromkeys([*features, *inputs])),
        label,
        positive,
        columns,
    )
    parts = []
    if ranking.CORRELATION in methods:
        parts.append(ranking.point_biserial(frame, features))
    if {ranking.INFORMATION, ranking.UNIVARIATE_AUC} & set(methods):
        profile = ranking.class_profile(frame, features)
        if ranking.INFORMATION in methods:
            parts.append(ranking.mutual_information(profile))
        if ranking.UNIVARIATE_AUC in methods:
            parts.append(ranking.univariate_auc(profile))
    if ranking.INCREMENTAL_AUC in methods:
        parts.append(incremental_auc(frame, features, columns, seed=seed))
    if ranking.PERMUTATION in methods:
        parts.append(
            permutation_importance(frame, model, used, columns, seed=seed)
        )
    if ranking.SHAP in methods:
        contributions = explain.shap_contributions(
            frame, model, columns, explainer=explainer, seed=seed
        )
        rows = explain.shap_rows(contributions, columns, features=used)
        parts.append(explain.shap_importance(rows))
    if not parts:
        return points.sparkSession.createDataFrame([], RESULT_SCHEMA)
    return ranking.sorted_results(reduce(DataFrame.unionByName, parts))


def correlation_matrix(
    points: DataFrame,
    features: Sequence[str],
    *,
    label: str,
    positive: object,
    columns: Columns = Columns(),
    sample_size: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """Pairwise correlations over a plain sample of rows, never of groups."""

    def results(rows: DataFrame) -> DataFrame:
        return ranking.correlation_matrix(rows, features, label, positive)

    if sample_size is None:
        return results(points)
    return _settled(sample_rows(points, sample_size, columns, seed=seed), results)


def _model_features(
    features: Sequence[str], methods: Sequence[str], model: ModelSpec | None
) -> list[str]:
    """Selected features the model reads; needed by model methods only."""
    if not {ranking.PERMUTATION, ranking.SHAP} & set(methods):
        return []
    if model is None:
        raise ValueError("Permutation importance and SHAP explain a model: pass one.")
    used = [name for name in features if name in model.features]
    if not used:
        raise ValueError(f"The model reads none of {features}.")
    return used
