"""Filters, selections, labels and option lists of a point table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import Columns
from ..functions.ranges import RangeFilter, ValueFilter, conjunction

Filters = Iterable[RangeFilter | ValueFilter]


def filter_points(points: DataFrame, filters: Filters) -> DataFrame:
    """Keep the rows that pass every filter."""
    wanted = conjunction(filters)
    return points if wanted is None else points.filter(wanted)


def matching_tracks(
    points: DataFrame,
    filters: Filters,
    columns: Columns = Columns(),
) -> DataFrame:
    """Keep all rows of every track that has at least one passing row."""
    wanted = conjunction(filters)
    if wanted is None:
        return points.filter(F.col(columns.track).isNotNull())
    ids = points.filter(wanted).select(columns.track).distinct()
    return points.join(ids, columns.track, "left_semi").select(*points.columns)


def select_rows(
    points: DataFrame, row_ids: Sequence[int] | DataFrame, columns: Columns = Columns()
) -> DataFrame:
    """Keep the rows with the given ids; unknown ids are ignored.

    A list comes from a caller who picked rows by hand; larger selections are
    passed as a table with the row column.
    """
    if isinstance(row_ids, DataFrame):
        return points.join(row_ids.select(columns.row).distinct(), columns.row, "left_semi")
    return points.filter(F.col(columns.row).isin(list(row_ids)))


def selection_summary(
    selection: DataFrame, columns: Columns = Columns()
) -> DataFrame:
    """Row count and track count; a NULL track counts as one track."""
    per_track = selection.groupBy(columns.track).agg(F.count(F.lit(1)).alias("n"))
    return per_track.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
        F.count(F.lit(1)).alias("tracks"),
    )


def label_selection(
    points: DataFrame,
    selection: DataFrame,
    column: str,
    value: str,
    columns: Columns = Columns(),
) -> DataFrame:
    """Write ``value`` into a string column for the selected rows or tracks.

    The selection holds row ids (rows are labelled) or only track ids (whole
    tracks are labelled).
    """
    column = column.strip()
    if not column:
        raise ValueError("A label needs the name of a column.")
    if column in {columns.track, columns.row}:
        raise ValueError(f"{column!r} is reserved and cannot hold labels.")
    if column not in points.columns:
        points = points.withColumn(column, F.lit(None).cast("string"))
    elif not isinstance(points.schema[column].dataType, T.StringType):
        raise ValueError(f"{column!r} exists and does not hold strings.")
    if selection.isEmpty():
        raise ValueError("There are no rows to label.")

    key = columns.row if columns.row in selection.columns else columns.track
    chosen = selection.select(key).distinct().withColumn("__chosen", F.lit(True))
    marked = points.join(chosen, key, "left")
    relabelled = F.when(F.col("__chosen"), F.lit(value)).otherwise(F.col(column))
    return marked.withColumn(column, relabelled).select(*points.columns)


def value_options(
    points: DataFrame, feature: str, columns: Columns = Columns()
) -> DataFrame:
    """Distinct non-null values of a column in the order they first appear."""
    return (
        points.filter(F.col(feature).isNotNull())
        .groupBy(feature)
        .agg(F.min(columns.row).alias("first_row"))
        .orderBy("first_row")
    )


def filter_bounds(points: DataFrame, features: Sequence[str]) -> DataFrame:
    """Lower and upper slider bounds per feature, from one aggregate.

    Equal bounds are widened by 5 %, at least 1; an empty column gets 0..1.
    """
    sides = points.agg(
        *[F.min(f).cast("double").alias(f"lo{i}") for i, f in enumerate(features)],
        *[_largest(f).alias(f"hi{i}") for i, f in enumerate(features)],
    )
    long = sides.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("feature"),
                        F.col(f"lo{i}").alias("lo"),
                        F.col(f"hi{i}").alias("hi"),
                    )
                    for i, f in enumerate(features)
                ]
            )
        )
    )
    pad = F.when(
        F.col("lo") == F.col("hi"), F.greatest(F.abs("lo") * 0.05, F.lit(1.0))
    ).otherwise(F.lit(0.0))
    return long.select(
        "feature",
        F.coalesce(F.col("lo") - pad, F.lit(0.0)).alias("lower"),
        F.coalesce(F.col("hi") + pad, F.lit(1.0)).alias("upper"),
    )


def _largest(feature: str):
    """Aggregate: the largest value as a double, passing over NaN."""
    number = F.col(feature).cast("double")
    return F.coalesce(F.max(F.when(~F.isnan(number), number)), F.max(number))


def label_candidates(
    points: DataFrame,
    *,
    minimum: int = 2,
    maximum: int = 50,
    exclude: Iterable[str] = (),
) -> DataFrame:
    """Columns with ``minimum``..``maximum`` distinct non-null values.

    A constant-memory sketch first drops columns that are clearly too varied:
    its error is about 5 %, so none with at most ``maximum`` values comes near
    four times that. The others are counted exactly, with few values to shuffle.
    """
    names = [name for name in points.columns if name not in set(exclude)]
    sketch = points.agg(
        *[F.approx_count_distinct(name).alias(f"d{i}") for i, name in enumerate(names)]
    ).first()
    close = [n for i, n in enumerate(names) if sketch[f"d{i}"] <= 4 * maximum]
    if not close:
        return points.sparkSession.createDataFrame(
            [], "column string, distinct_values long"
        )
    distinct = points.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("column"),
                        F.col(name).cast("string").alias("value"),
                    )
                    for name in close
                ]
            )
        )
    ).distinct()
    return (
        distinct.groupBy("column")
        .agg(F.count("value").alias("distinct_values"))
        .filter(F.col("distinct_values").between(minimum, maximum))
    )


def class_options(points: DataFrame, label: str) -> DataFrame:
    """Distinct non-null label values, sorted as text."""
    values = points.select(label).filter(F.col(label).isNotNull()).distinct()
    return values.orderBy(F.col(label).cast("string"))


def binary_violations(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Names of columns holding anything but 0, 1 or NULL, from one aggregate."""
    if not names:
        return []
    checks = [
        F.coalesce(F.bool_and(F.col(n).cast("double").isin(0.0, 1.0)), F.lit(True))
        for n in names
    ]
    row = df.agg(*[check.alias(f"b{i}") for i, check in enumerate(checks)]).first()
    return [name for i, name in enumerate(names) if not row[f"b{i}"]]

