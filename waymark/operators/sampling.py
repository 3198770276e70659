"""Seeded samples, stratified folds and background rows.

Every random choice orders rows by ``md5("seed:row id")``: the same rows on
any cluster, and again after a lost task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import Columns
from .ordering import hash_ranks, leading_share

BACKGROUND_ROWS = 100


def shuffle_key(seed: int, name: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string")))


def random_sample(
    points: DataFrame, size: int, columns: Columns = Columns(), *, seed: int = 7
) -> DataFrame:
    """``size`` rows by the order of their hashes: a filter, once the cut is known."""
    keyed = points.withColumn("__key", shuffle_key(seed, columns.row))
    first = leading_share(keyed.select("__key", columns.row), "__key", columns.row, size)
    return points if first is None else keyed.filter(first).drop("__key")


def group_sizes(points: DataFrame, group: str) -> DataFrame:
    return points.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))


def picked_groups(
    points: DataFrame, group: str, size: int, *, seed: int = 7
) -> DataFrame:
    """Randomly ordered groups until their rows reach ``size``."""
    sizes = (
        group_sizes(points, group)
        .filter(F.col(group).isNotNull())
        .withColumn("__key", shuffle_key(seed, group))
    )
    first = leading_share(sizes, "__key", group, size, "rows")
    return (sizes if first is None else sizes.filter(first)).select(group, "rows")


def group_sample(
    points: DataFrame,
    group: str,
    size: int,
    columns: Columns = Columns(),
    *,
    seed: int = 7,
) -> DataFrame:
    """All rows of the randomly picked groups; a small table stays as it is."""
    if len(points.select(F.lit(1)).take(size + 1)) <= size:
        return points
    chosen = picked_groups(points, group, size, seed=seed).select(group)
    return points.join(chosen, group, "left_semi").select(*points.columns)


def sample_rows(
    points: DataFrame,
    size: int,
    columns: Columns = Columns(),
    *,
    group: str | None = None,
    seed: int = 7,
) -> DataFrame:
    """Sample complete groups if the group column exists, else single rows."""
    if group is not None and group in points.columns:
        return group_sample(points, group, size, columns, seed=seed)
    return random_sample(points, size, columns, seed=seed)


def background_rows(
    points: DataFrame, columns: Columns = Columns(), *, limit: int = BACKGROUND_ROWS
) -> DataFrame:
    """The first rows in input order, which explanations are measured against."""
    return points.orderBy(columns.row).limit(limit)


def stratified_folds(
    points: DataFrame,
    target: str,
    folds: int,
    columns: Columns = Columns(),
    *,
    seed: int = 7,
) -> DataFrame:
    """Add ``fold`` so that each class is spread evenly over the folds."""
    ranked = hash_ranks(
        points, [target], shuffle_key(seed, columns.row), columns.row, rank="__rank"
    )
    fold = F.pmod(F.col("__rank") - 1, F.lit(folds)).cast("int")
    return ranked.withColumn("fold", fold).drop("__rank")


def fold_count(positives: int, negatives: int, limit: int = 5) -> int:
    folds = min(limit, positives, negatives)
    if folds < 2:
        raise ValueError("Two folds take two rows of each class.")
    return folds
