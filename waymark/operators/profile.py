"""Histograms and empirical distributions of one feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import cumulative_counts

MIN_BINS, DEFAULT_BINS, MAX_BINS = 5, 40, 200


def histogram(
    points: DataFrame,
    feature: str,
    *,
    group: str | None = None,
    bins: int = DEFAULT_BINS,
) -> DataFrame:
    """Counts per equal-width bin over the common range, empty bins left out.

    All groups share the edges; the maximum belongs to the last bin. NULL and
    NaN have no place on the axis and are not counted.
    """
    if not MIN_BINS <= bins <= MAX_BINS:
        raise ValueError(f"Bins must be between {MIN_BINS} and {MAX_BINS}.")
    keys = [group] if group is not None and group in points.columns else []
    values = points.select(*keys, F.col(feature).cast("double").alias("__x")).filter(
        F.col("__x").isNotNull() & ~F.isnan("__x")
    )
    edges = values.agg(F.min("__x").alias("lo"), F.max("__x").alias("hi")).first()
    lo = 0.0 if edges.lo is None else edges.lo
    hi = 1.0 if edges.hi is None else edges.hi
    if lo == hi:
        # A single value sits in the middle of a unit-wide axis.
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    position = F.floor((F.col("__x") - F.lit(lo)) / F.lit(width))
    return (
        values.withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            *keys,
            "bin",
            (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
            (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
            "rows",
        )
    )


def ecdf(
    points: DataFrame,
    feature: str,
    *,
    group: str | None = None,
) -> DataFrame:
    """Cumulative share of rows at or below each distinct value, per group.

    One row per distinct value with its row count; repeated rows of the same
    value all have the same share. NULL values are left out of the total.
    """
    keys = [group] if group is not None and group in points.columns else []
    running = cumulative_counts(
        points.select(*keys, feature).filter(F.col(feature).isNotNull()),
        keys,
        feature,
        {"n": F.lit(1)},
    )
    return running.select(
        *keys,
        feature,
        F.col("n").alias("rows"),
        (F.col("n_upto") / F.col("n_total")).alias("ecdf"),
    )
