"""Loss of AUC when one feature of a model is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import Columns
from ..functions.bijection import round_keys, shuffled
from ..functions.scores import score_column
from ..sources.models import ModelSpec
from .ordering import numbered
from .ranking import PERMUTATION, TARGET, direction, method_rows, score_auc

_BASELINE = ""


def shuffled_copies(
    frame: DataFrame,
    features: Sequence[str],
    inputs: Sequence[str],
    columns: Columns = Columns(),
    *,
    seed: int = 7,
) -> DataFrame:
    """One copy of every row per feature, with ``drawn`` holding a value of that
    feature from a random row; each value is used exactly once.

    Rows are numbered once. Where a value goes is computed from its row's number,
    so nothing is sorted for a feature, and what travels is the place and the
    value; the other inputs stay where they are until their copies are scored.
    """
    row = columns.row
    rows, size = numbered(
        frame.select(row, TARGET, *dict.fromkeys([*inputs, *features])), row, "__number"
    )
    sent = rows.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        shuffled(F.col("__number"), size, round_keys(seed, place)).alias("__number"),
                        F.lit(place).alias("place"),
                        F.col(name).alias("drawn"),
                    )
                    for place, name in enumerate(features)
                ]
            )
        )
    )
    # One value of each feature arrives at every number.
    arrived = sent.groupBy("__number").agg(
        F.array_sort(F.collect_list(F.struct("place", "drawn"))).alias("__arrived")
    )
    names = F.array(*[F.lit(name) for name in features])
    return (
        rows.join(arrived, "__number")
        .select(row, TARGET, *inputs, F.explode("__arrived").alias("__one"))
        .select(
            row,
            TARGET,
            *inputs,
            F.get(names, F.col("__one.place")).alias("feature"),
            F.col("__one.drawn").alias("drawn"),
        )
    )


def permutation_importance(
    frame: DataFrame,
    spec: ModelSpec,
    features: Sequence[str],
    columns: Columns = Columns(),
    *,
    seed: int = 7,
) -> DataFrame:
    """Baseline AUC minus the AUC with the feature shuffled, for all features."""
    inputs = list(spec.features)
    copies = shuffled_copies(frame, features, inputs, columns, seed=seed)
    baseline = frame.select(
        TARGET,
        F.lit(_BASELINE).alias("feature"),
        score_column(spec, frame).alias("score"),
    )
    replaced = [
        F.when(F.col("feature") == name, F.col("drawn")).otherwise(F.col(name))
        for name in inputs
    ]
    shuffled = copies.select(
        TARGET, "feature", score_column(spec, copies, replaced).alias("score")
    )
    auc = score_auc(
        baseline.unionByName(shuffled), "feature", "score"
    )
    # One row per feature: the baseline is spread over them.
    merged = auc.agg(
        F.max(F.when(F.col("feature") == _BASELINE, F.col("score"))).alias("baseline"),
        F.collect_list(F.struct("feature", "score")).alias("all"),
    )
    loss = merged.select("baseline", F.inline("all").alias("feature", "auc")).filter(
        F.col("feature") != _BASELINE
    )
    scores = loss.select("feature", (F.col("baseline") - F.col("auc")).alias("score"))
    score = F.col("score")
    return method_rows(
        scores, PERMUTATION, importance=F.abs(score), shown=direction(score)
    )
