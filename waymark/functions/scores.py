"""Score columns of models and the 0/1 columns made from a threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING, Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import require_columns

if TYPE_CHECKING:
    from ..sources.models import ModelSpec

LOGIT_LIMIT = 30.0


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast any picklable value; workers call the result to open it."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def opened() -> Any:
        return cloudpickle.loads(packed.value)

    return opened


def linear_margin(weights: Sequence[float], intercept: float, inputs: Sequence[Column]) -> Column:
    """Weighted sum as one expression; a NULL input gives NaN, not NULL."""
    total = F.lit(float(intercept))
    for weight, value in zip(weights, inputs, strict=True):
        number = F.coalesce(value.cast("double"), F.lit(float("nan")))
        total = total + F.lit(float(weight)) * number
    return total


def sigmoid(margin: Column) -> Column:
    """Logistic function of a clipped margin; NaN stays NaN.

    ``least`` and ``greatest`` treat NaN as the largest number and would turn a
    missing input into a confident score.
    """
    clipped = F.greatest(F.least(margin, F.lit(LOGIT_LIMIT)), F.lit(-LOGIT_LIMIT))
    return F.when(F.isnan(margin), F.lit(float("nan"))).otherwise(
        F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))
    )


def fires(score: Column, threshold: float) -> Column:
    """0/1 path column; NULL and NaN scores never fire."""
    reached = score.isNotNull() & ~F.isnan(score) & (score >= F.lit(float(threshold)))
    return F.coalesce(reached, F.lit(False)).cast("tinyint")


def score_column(spec: ModelSpec, df: DataFrame, inputs: Sequence[Column] | None = None) -> Column:
    """Positive-class score of each row.

    Models that can express themselves as a Spark expression stay in the JVM.
    Others are scored in Arrow batches; only their feature columns travel.
    """
    if inputs is None:
        missing = sorted(set(spec.features) - set(df.columns))
        if missing:
            raise ValueError(
                f"ML model {spec.name!r} is missing input features: {missing}"
            )
        inputs = [F.col(name) for name in spec.features]
    expression = getattr(spec.model, "score_expression", None)
    if expression is not None and spec.positive_class_index == 1:
        return expression(inputs)

    shared = share(df.sparkSession, spec)

    def score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = shared()
        for batch in batches:
            yield pd.Series(model.scores(batch), dtype="float64")

    packed = F.struct(
        *[
            value.cast("double").alias(name)
            for name, value in zip(spec.features, inputs, strict=True)
        ]
    )
    # The Arrow transfer turns NaN into NULL; both kinds of model return NaN.
    scored = F.pandas_udf(score_batches, "double")(packed)
    return F.coalesce(scored, F.lit(float("nan")))


def with_model_path(df: DataFrame, path: str, spec: ModelSpec, threshold: float) -> DataFrame:
    """Add ``{path}_score`` and the 0/1 column ``path``."""
    require_columns(df, spec.features)
    scored = df.withColumn(f"{path}_score", score_column(spec, df))
    return scored.withColumn(path, fires(F.col(f"{path}_score"), threshold))


def positive_scores(model, frame: pd.DataFrame, class_index: int, name: str) -> np.ndarray:
    """Scores of one batch from ``predict_proba``, ``predict`` or a callable."""
    if hasattr(model, "predict_proba"):
        table = np.asarray(model.predict_proba(frame.to_numpy()), dtype=float)
        scores = table[:, class_index] if len(table) else np.empty(0)
    elif hasattr(model, "predict"):
        scores = np.asarray(model.predict(frame.to_numpy()), dtype=float)
    elif callable(model):
        scores = np.asarray(model(frame), dtype=float)
    else:
        raise TypeError(
            f"ML model {name!r} needs predict_proba, predict, or to be callable."
        )
    if scores.shape != (len(frame),):
        raise ValueError(
            f"ML model {name!r} returned {scores.size} scores for "
            f"{len(frame)} measurements."
        )
    return scores
