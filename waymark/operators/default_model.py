"""Default classifiers fitted with Spark ML and exported for scoring."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any
from uuid import uuid4

import numpy as np
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import Columns
from ..functions.trees import Tree, TreeEnsemble
from ..session import remove_folder, scratch_directory
from ..sources.models import LinearModel, ModelSpec
from .ranking import TARGET, class_counts, labelled_features

# Model names, weight modes and starting parameters.
MODEL_TYPES = ("Logistic regression", "Random forest", "Gradient boosting")
WEIGHT_MODES = ("None", "Balanced", "Custom")
LOGISTIC_DEFAULTS = {"C": 1.0, "penalty": "l2", "max_iter": 1000, "fit_intercept": True}
FOREST_DEFAULTS = {
    "n_estimators": 200,
    "max_depth": None,
    "min_samples_leaf": 2,
    "max_features": "sqrt",
    "criterion": "gini",
    "bootstrap": True,
}
BOOSTING_DEFAULTS = {
    "n_estimators": 100,
    "learning_rate": 0.1,
    "max_depth": 3,
    "min_samples_leaf": 1,
    "subsample": 1.0,
}

#: Relative change of the objective at which a logistic fit ends.
LOGISTIC_TOLERANCE = 1e-13

# Spark ML's own limit on the depth of a tree.
DEEPEST_TREE = 30


def build_default_model(
    points: DataFrame,
    features: Iterable[str],
    label: str,
    positive: object,
    model_type: str,
    columns: Columns = Columns(),
    *,
    class_weight_mode: str = "None",
    positive_weight: float = 1.0,
    negative_weight: float = 1.0,
    parameters: Mapping[str, Any] | None = None,
    seed: int = 7,
) -> ModelSpec:
    """Fit a classifier over median-imputed features and return its spec."""
    features = list(dict.fromkeys(features))
    for given, known, what in (
        (model_type, MODEL_TYPES, "model type"),
        (class_weight_mode, WEIGHT_MODES, "class-weight mode"),
    ):
        if given not in known:
            raise ValueError(f"{given!r} is no {what}; there are {', '.join(known)}.")
    if not features or min(positive_weight, negative_weight) <= 0:
        raise ValueError("A fit takes at least one feature and weights above zero.")
    frame = labelled_features(points, features, label, positive, columns)
    positives, negatives = class_counts(frame)
    weights = (1.0, 1.0)
    if class_weight_mode == "Balanced":
        total = positives + negatives
        weights = (total / (2 * positives), total / (2 * negatives))
    elif class_weight_mode == "Custom":
        weights = (positive_weight, negative_weight)
    weighted = frame.withColumn(
        "__weight",
        F.when(F.col(TARGET) == 1, F.lit(weights[0])).otherwise(F.lit(weights[1])),
    ).withColumn(TARGET, F.col(TARGET).cast("double"))
    total_weight = positives * weights[0] + negatives * weights[1]
    fit = {
        "Logistic regression": _fit_logistic,
        "Random forest": _fit_forest,
        "Gradient boosting": _fit_boosting,
    }[model_type]
    model = fit(weighted, features, dict(parameters or {}), total_weight, seed)
    return ModelSpec(f"Default {model_type}", model, tuple(features))


def _settings(defaults: Mapping[str, Any], given: Mapping[str, Any]) -> dict[str, Any]:
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"Unsupported model parameters: {unknown}")
    return {**defaults, **given}


def _assembled(frame: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__features").transform(
        frame.select(TARGET, "__weight", *features)
    )


def _columns_of(estimator):
    return (
        estimator.setFeaturesCol("__features").setLabelCol(TARGET).setWeightCol("__weight")
    )


def _fit_logistic(frame, features, given, total_weight, seed) -> LinearModel:
    settings = _settings(LOGISTIC_DEFAULTS, given)
    if settings["penalty"] not in ("l1", "l2"):
        raise ValueError(f"Unsupported penalty: {settings['penalty']!r}.")
    # Population scaling as expressions; Spark's scaler uses the sample formula.
    stats = frame.agg(
        *[F.avg(name).alias(f"m{i}") for i, name in enumerate(features)],
        *[F.stddev_pop(name).alias(f"s{i}") for i, name in enumerate(features)],
    ).first()
    mean = np.array([stats[f"m{i}"] for i in range(len(features))])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(len(features))])
    scaled = frame.withColumns(
        {
            name: (F.col(name) - F.lit(float(mean[i]))) / F.lit(float(scale[i]))
            for i, name in enumerate(features)
        }
    )
    estimator = _columns_of(LogisticRegression()).setStandardization(False)
    estimator = (
        estimator.setRegParam(1.0 / (settings["C"] * total_weight))
        .setElasticNetParam(1.0 if settings["penalty"] == "l1" else 0.0)
        .setMaxIter(int(settings["max_iter"]))
        .setTol(LOGISTIC_TOLERANCE)
        .setFitIntercept(bool(settings["fit_intercept"]))
    )
    fitted = estimator.fit(_assembled(scaled, features))
    # Fold the scaling into the weights: the model then reads raw features.
    weights = fitted.coefficients.toArray() / scale
    return LinearModel(weights, float(fitted.intercept - weights @ mean))


def _depth(stated: int | None) -> int:
    """The stated depth; an unlimited tree gets the deepest there is."""
    if stated is not None and stated > DEEPEST_TREE:
        raise ValueError(f"Spark ML grows trees of depth {DEEPEST_TREE} at most.")
    return DEEPEST_TREE if stated is None else int(stated)


def _fit_forest(frame, features, given, total_weight, seed) -> TreeEnsemble:
    settings = _settings(FOREST_DEFAULTS, given)
    criteria = {"gini": "gini", "entropy": "entropy", "log_loss": "entropy"}
    estimator = (
        _columns_of(RandomForestClassifier())
        .setNumTrees(int(settings["n_estimators"]))
        .setMaxDepth(_depth(settings["max_depth"]))
        .setMinInstancesPerNode(int(settings["min_samples_leaf"]))
        .setFeatureSubsetStrategy(str(settings["max_features"] or "all"))
        .setImpurity(criteria[settings["criterion"]])
        .setBootstrap(bool(settings["bootstrap"]))
        .setSeed(seed)
    )
    fitted = estimator.fit(_assembled(frame, features))

    def node_value(prediction: float, stats: list[float]) -> tuple[float, float]:
        cover = sum(stats)
        return stats[1] / cover, cover

    trees = _exported_trees(frame, fitted, node_value)
    return TreeEnsemble(trees, [1.0 / len(trees)] * len(trees), logistic=False)


def _fit_boosting(frame, features, given, total_weight, seed) -> TreeEnsemble:
    settings = _settings(BOOSTING_DEFAULTS, given)
    if not 0 < settings["learning_rate"] <= 1:
        raise ValueError("Spark ML accepts learning rates above 0 and up to 1.")
    estimator = (
        _columns_of(GBTClassifier())
        .setMaxIter(int(settings["n_estimators"]))
        .setStepSize(float(settings["learning_rate"]))
        .setMaxDepth(_depth(settings["max_depth"]))
        .setMinInstancesPerNode(int(settings["min_samples_leaf"]))
        .setSubsamplingRate(float(settings["subsample"]))
        .setSeed(seed)
    )
    fitted = estimator.fit(_assembled(frame, features))
    # The fitted sum is half the log-odds.
    weights = [2.0 * weight for weight in fitted.treeWeights]
    trees = _exported_trees(frame, fitted, lambda prediction, stats: (prediction, stats[0]))
    return TreeEnsemble(trees, weights, logistic=True)


def _exported_trees(frame: DataFrame, fitted, node_value) -> list[Tree]:
    """Read the node table that Spark ML saves with a model.

    Its size is that of the model, which the driver holds anyway.
    """
    spark = frame.sparkSession
    folder = f"{scratch_directory(spark)}/model-{uuid4().hex}"
    fitted.write().save(folder)
    try:
        return _read_trees(spark, folder, node_value)
    finally:
        remove_folder(spark, folder)


def _read_trees(spark: SparkSession, folder: str, node_value) -> list[Tree]:
    nodes = (
        spark.read.parquet(f"{folder}/data")
        .select("treeID", "nodeData.*")
        .select(
            "treeID",
            "id",
            "prediction",
            "impurityStats",
            "leftChild",
            "rightChild",
            F.col("split.featureIndex").alias("feature"),
            F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        )
        .orderBy("treeID", "id")
        .toPandas()
    )
    trees = []
    for _, part in nodes.groupby("treeID", sort=True):
        values, covers = zip(
            *[
                node_value(prediction, list(stats))
                for prediction, stats in zip(part["prediction"], part["impurityStats"])
            ],
            strict=True,
        )
        trees.append(
            Tree(
                feature=part["feature"].to_numpy(dtype=int),
                threshold=part["threshold"].to_numpy(dtype=float),
                left=part["leftChild"].to_numpy(dtype=int),
                right=part["rightChild"].to_numpy(dtype=int),
                value=np.array(values, dtype=float),
                cover=np.array(covers, dtype=float),
            )
        )
    return trees
