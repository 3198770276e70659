"""Feature statistics against a binary label, all features in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..columns import Columns, is_numeric, require_columns
from .ordering import cumulative_counts, median_of

# Method names as they appear in results.
CORRELATION = "Point-biserial correlation"
INFORMATION = "Mutual information"
MATRIX = "Full correlation matrix"
UNIVARIATE_AUC = "Univariate ROC AUC"
INCREMENTAL_AUC = "Incremental CV ROC AUC"
PERMUTATION = "Permutation importance"
SHAP = "SHAP"
METHODS = (
    CORRELATION, INFORMATION, MATRIX, UNIVARIATE_AUC, INCREMENTAL_AUC, PERMUTATION, SHAP,
)

#: Pairs of columns up to which a correlation matrix is one aggregate: with more,
#: its code takes longer to compile than tiles take to add up.
EXPRESSION_PAIRS = 6
#: Columns of a tile of a larger matrix, and partial sums a task adds up.
TILE_COLUMNS, SUM_SHARDS = 128, 32

TARGET = "__target"
MAX_INFORMATION_BINS = 10


def require_numeric(points: DataFrame, features: Sequence[str]) -> None:
    require_columns(points, features)
    for name in features:
        if not is_numeric(points, name):
            raise ValueError(f"Feature {name!r} must be numeric.")


def feature_medians(
    points: DataFrame, features: Sequence[str]
) -> dict[str, float]:
    """Exact median per feature, 0.0 where a feature has no value at all.

    NaN counts as the largest value. The built-in median would hold every
    distinct value in one task; bucketed counts do not.
    """
    if not features:
        return {}
    running = cumulative_counts(
        long_features(points, features).filter(F.col("value").isNotNull()),
        ["feature"],
        "value",
        {"n": F.lit(1)},
    )
    medians = running.groupBy("feature").agg(median_of("value", "n").alias("m"))
    # One row per feature.
    found = {row.feature: row.m for row in medians.collect()}
    return {name: 0.0 if found.get(name) is None else found[name] for name in features}


def imputed(
    points: DataFrame,
    features: Sequence[str],
    *,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Features as doubles with NULL and NaN replaced by the column median.

    Medians are computed only for features that have gaps.
    """
    require_numeric(points, features)
    gaps = points.agg(*_gap_counts(features)).first()
    return _filled(points, features, gaps, keep)


def _gap_counts(features: Sequence[str]) -> list[Column]:
    numbers = [F.col(name).cast("double") for name in features]
    return [
        F.count_if(number.isNull() | F.isnan(number)).alias(f"gap_{i}")
        for i, number in enumerate(numbers)
    ]


def _filled(
    points: DataFrame,
    features: Sequence[str],
    gaps: Row,
    keep: Sequence[str],
) -> DataFrame:
    incomplete = [name for i, name in enumerate(features) if gaps[f"gap_{i}"]]
    medians = feature_medians(points, incomplete)
    filled = []
    for name in features:
        number = F.col(name).cast("double")
        if name in medians:
            known = F.when(~F.isnan(number), number)
            number = F.coalesce(known, F.lit(float(medians[name])))
        filled.append(number.alias(name))
    return points.select(*[name for name in keep if name not in features], *filled)


def binary_target(label: str, positive: object) -> Column:
    return (F.col(label) == F.lit(positive)).cast("int")


def _class_counts(target: str) -> list[Column]:
    return [
        F.count_if(F.col(target) == 1).alias("positives"),
        F.count_if(F.col(target) == 0).alias("negatives"),
    ]


def class_counts(frame: DataFrame, target: str = TARGET) -> tuple[int, int]:
    """Positive and negative row counts."""
    row = frame.agg(*_class_counts(target)).first()
    return row.positives, row.negatives


def labelled_features(
    points: DataFrame,
    features: Sequence[str],
    label: str,
    positive: object,
    columns: Columns = Columns(),
) -> DataFrame:
    """Imputed features with the 0/1 target; rows without a label are dropped.

    One pass counts both classes and the gaps of every feature.
    """
    require_columns(points, [label])
    require_numeric(points, features)
    known = points.filter(F.col(label).isNotNull()).withColumn(
        TARGET, binary_target(label, positive)
    )
    keep = [TARGET] + [c for c in (columns.row,) if c in points.columns]
    counts = known.agg(*_class_counts(TARGET), *_gap_counts(features)).first()
    if not counts.positives or not counts.negatives:
        raise ValueError("Ranking needs rows of both label classes.")
    return _filled(known, features, counts, keep)


def long_features(
    frame: DataFrame, features: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per row and feature: ``feature, value`` and the kept columns."""
    entries = [
        F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("value"))
        for name in features
    ]
    return frame.select(*keep, F.inline(F.array(*entries)))


def direction(score: Column) -> Column:
    return (
        F.when(score > 0, F.lit("positive"))
        .when(score < 0, F.lit("negative"))
        .otherwise(F.lit("none"))
    )


def method_rows(
    scores: DataFrame, method: str, *, importance: Column, shown: Column
) -> DataFrame:
    """Bring ``feature, score`` into the common result layout."""
    return scores.select(
        "feature",
        F.lit(method).alias("method"),
        F.col("score").cast("double").alias("score"),
        importance.cast("double").alias("importance"),
        shown.alias("direction"),
    )


def point_biserial(
    frame: DataFrame, features: Sequence[str], target: str = TARGET
) -> DataFrame:
    """Correlation of every feature with the target, in one aggregate."""
    y = F.col(target).cast("double")
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            _safe_correlation(F.col(name).cast("double"), y).alias("score"),
        )
        for name in features
    ]
    scores = frame.agg(F.array(*entries).alias("all")).select(F.inline("all"))
    score = F.col("score")
    return method_rows(
        scores, CORRELATION, importance=F.abs(score), shown=direction(score)
    )


def _safe_correlation(x: Column, y: Column) -> Column:
    """Pairwise Pearson correlation; no variance or no overlap gives 0.

    Spark's own ``corr`` raises a division error on a constant column.
    """
    both_x = F.when(y.isNotNull(), x)
    both_y = F.when(x.isNotNull(), y)
    spread = F.stddev_pop(both_x) * F.stddev_pop(both_y)
    ratio = F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
    return F.coalesce(F.nanvl(ratio, F.lit(None).cast("double")), F.lit(0.0))


def correlation_matrix(
    points: DataFrame,
    features: Sequence[str],
    label: str,
    positive: object,
) -> DataFrame:
    """All pairs of features and the label indicator: ``row, column, correlation``.

    Missing values are dropped pair by pair. Few columns are one aggregate of
    expressions. For many, the columns are cut into tiles: a task adds up matrix
    products, one packed row a pair of tiles, of what is left after subtracting
    the column means, and the rows are added up in a tree of tasks. Both give the
    same correlations; which one runs follows from their cost.
    """
    require_numeric(points, features)
    indicator = f"{label} = {positive}"
    names = [*features, indicator]
    numbers = [F.col(name).cast("double") for name in features]
    frame = points.select(
        *[F.when(~F.isnan(n), n).alias(f"c{i}") for i, n in enumerate(numbers)],
        binary_target(label, positive).cast("double").alias(f"c{len(features)}"),
    )
    if len(names) * (len(names) + 1) // 2 <= EXPRESSION_PAIRS:
        upper = _pairs_from_expressions(frame)
    else:
        stats = frame.agg(
            *[F.avg(name).alias(f"{name}_mean") for name in frame.columns]
        ).first()
        means = [stats[f"{name}_mean"] or 0.0 for name in frame.columns]
        upper = _pairs_from_tiles(frame, means)
    mirrored = upper.select(
        "correlation",
        F.explode(
            F.when(
                F.col("i") == F.col("j"),
                F.array(F.struct(F.col("i").alias("r"), F.col("j").alias("c"))),
            ).otherwise(
                F.array(
                    F.struct(F.col("i").alias("r"), F.col("j").alias("c")),
                    F.struct(F.col("j").alias("r"), F.col("i").alias("c")),
                )
            )
        ).alias("cell"),
    )
    name_of = F.array(*[F.lit(name) for name in names])
    return mirrored.select(
        F.get(name_of, F.col("cell.r")).alias("row"),
        F.get(name_of, F.col("cell.c")).alias("column"),
        "correlation",
    )


def matrix_labels(matrix: DataFrame) -> DataFrame:
    """Correlation matrix with the two-digit text shown in its cells."""
    shown = F.round("correlation", 2).cast("string")
    return matrix.withColumn("display_value", shown)


def _pairs_from_expressions(frame: DataFrame) -> DataFrame:
    """``i, j, correlation`` of the upper triangle, from one aggregate."""
    names = frame.columns
    cells = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            _safe_correlation(F.col(names[i]), F.col(names[j])).alias("correlation"),
        )
        for i in range(len(names))
        for j in range(i, len(names))
    ]
    return frame.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def _pairs_from_tiles(frame: DataFrame, means: Sequence[float]) -> DataFrame:
    """``i, j, correlation`` of the upper triangle, from products of tiles."""
    shift = np.array(means, dtype=float)
    size = len(shift)
    tiles = [slice(at, min(at + TILE_COLUMNS, size)) for at in range(0, size, TILE_COLUMNS)]
    packed = "a int, b int, shard int, sums array<double>"

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            values = batch.to_numpy(dtype=float) - shift
            known = ~np.isnan(values)
            filled, present = np.where(known, values, 0.0), known.astype(float)
            squares = filled**2
            for a, left in enumerate(tiles):
                for b, right in list(enumerate(tiles))[a:]:
                    here, there = present[:, left], present[:, right]
                    sums = np.stack(
                        [
                            here.T @ there,
                            filled[:, left].T @ there,
                            here.T @ filled[:, right],
                            squares[:, left].T @ there,
                            here.T @ squares[:, right],
                            filled[:, left].T @ filled[:, right],
                        ]
                    )
                    total[a, b] = total.get((a, b), 0.0) + sums
        shard = TaskContext.get().partitionId() % SUM_SHARDS
        for (a, b), sums in total.items():
            yield pd.DataFrame({"a": [a], "b": [b], "shard": [shard], "sums": [sums.ravel()]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        one = parts.iloc[:1].copy()
        one["sums"] = [np.sum(np.stack(parts["sums"].to_list()), axis=0)]
        return one

    def correlate(parts: pd.DataFrame) -> pd.DataFrame:
        left, right = tiles[int(parts["a"].iloc[0])], tiles[int(parts["b"].iloc[0])]
        shape = (6, left.stop - left.start, right.stop - right.start)
        sums = np.sum(np.stack(parts["sums"].to_list()), axis=0).reshape(shape)
        n, sx, sy, sxx, syy, sxy = sums
        # What is left of a constant column after centering is rounding noise.
        var_x, var_y = n * sxx - sx * sx, n * syy - sy * sy
        flat = (var_x <= 1e-12 * n * sxx) | (var_y <= 1e-12 * n * syy)
        ratio = np.where(flat, 0.0, n * sxy - sx * sy) / np.sqrt(np.where(flat, 1.0, var_x * var_y))
        i, j = np.indices(shape[1:])
        i, j = i.ravel() + left.start, j.ravel() + right.start
        upper = i <= j
        return pd.DataFrame(
            {"i": i[upper], "j": j[upper], "correlation": ratio.ravel()[upper]}
        )

    partial = frame.mapInPandas(multiply, packed)
    merged = partial.groupBy("a", "b", "shard").applyInPandas(add, packed)
    return merged.groupBy("a", "b").applyInPandas(correlate, "i int, j int, correlation double")


def class_profile(
    frame: DataFrame,
    features: Sequence[str],
    target: str = TARGET,
) -> DataFrame:
    """Cumulative positive and negative counts per feature value.

    Mutual information and AUC both start from this table; within one query
    Spark computes its exchange once.
    """
    hit = F.col(target).cast("long")
    return cumulative_counts(
        long_features(frame, features, [target]),
        ["feature"],
        "value",
        {"pos": hit, "neg": F.lit(1) - hit},
    )


def mutual_information(profile: DataFrame) -> DataFrame:
    """Mutual information in nats over at most ten quantile bins per feature.

    A value's bin is the number of cut positions its last occurrence has
    passed, which the running counts already tell: cuts need no second look at
    the data, and equal cuts fall together by themselves.
    """
    total = F.col("pos_total") + F.col("neg_total")
    upto = F.col("pos_upto") + F.col("neg_upto")
    bins = F.least(
        F.greatest(F.floor(F.sqrt(total)), F.lit(2)), F.lit(MAX_INFORMATION_BINS)
    )
    passed = F.lit(0)
    for cut in range(1, MAX_INFORMATION_BINS):
        position = F.least(F.floor(F.lit(cut) * total / bins), total - 1)
        passed = passed + ((F.lit(cut) < bins) & (position < upto)).cast("int")
    joint = (
        profile.withColumn("bin", passed)
        .groupBy("feature", "bin")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.max("pos_total").alias("pos_total"),
            F.max("neg_total").alias("neg_total"),
        )
    )
    in_bin = F.col("pos") + F.col("neg")

    def term(count: str) -> Column:
        share = F.col(count) / total
        expected = (in_bin / total) * (F.col(f"{count}_total") / total)
        return F.when(F.col(count) > 0, share * F.log(share / expected)).otherwise(0.0)

    scores = joint.groupBy("feature").agg(
        F.sum(term("pos") + term("neg")).alias("score")
    )
    return method_rows(
        scores, INFORMATION, importance=F.col("score"), shown=F.lit("non-directional")
    )


def grouped_auc(profile: DataFrame, group: str) -> DataFrame:
    """ROC AUC per group from cumulative class counts; ties count one half."""
    below = F.col("neg_upto") - F.col("neg") / 2
    pairs = F.sum(F.col("pos").cast("double") * below)
    every = F.max("pos_total").cast("double") * F.max("neg_total").cast("double")
    return profile.groupBy(group).agg((pairs / every).alias("score"))


def score_auc(
    scored: DataFrame,
    group: str,
    score: str,
    target: str = TARGET,
) -> DataFrame:
    """ROC AUC of a score column per group: ``group, score``."""
    hit = F.col(target).cast("long")
    profile = cumulative_counts(
        scored.select(group, score, target),
        [group],
        score,
        {"pos": hit, "neg": F.lit(1) - hit},
    )
    return grouped_auc(profile, group)


def univariate_auc(profile: DataFrame) -> DataFrame:
    """ROC AUC of each feature used alone as a score."""
    score = F.col("score")
    return method_rows(
        grouped_auc(profile, "feature"),
        UNIVARIATE_AUC,
        importance=F.greatest(score, F.lit(1.0) - score),
        shown=F.when(score >= 0.5, F.lit("positive")).otherwise(F.lit("negative")),
    )


def sorted_results(results: DataFrame) -> DataFrame:
    """Method ascending, importance descending; feature breaks ties."""
    return results.orderBy("method", F.col("importance").desc(), "feature")
