"""One row per track, and the active point-or-track frame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import Columns, categorical_columns, numeric_columns
from ..functions.ranges import RangeFilter, ValueFilter, conjunction
from .ordering import cumulative_counts, median_of
from .points import filter_points


def largest(value: Column) -> Column:
    """Aggregate: the largest value that is not NaN; NaN only if all are."""
    return F.coalesce(F.max(F.when(~F.isnan(value.cast("double")), value)), F.max(value))


# name -> expression over (value column, row order column). Entries added here
# become available to every roll-up.
AGGREGATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "mean": lambda value, row: F.avg(value),
    "median": lambda value, row: F.median(value),
    "min": lambda value, row: F.min(value),
    "max": lambda value, row: largest(value),
    "std": lambda value, row: F.stddev_samp(value),
    "sum": lambda value, row: F.coalesce(F.sum(value), F.lit(0)),
    "first": lambda value, row: F.min_by(value, row),
    "last": lambda value, row: F.max_by(value, row),
}


def aggregate_tracks(
    points: DataFrame,
    columns: Columns = Columns(),
    *,
    methods: Sequence[str] = (),
    methods_by_column: Mapping[str, Iterable[str]] | None = None,
    included: Iterable[str] | None = None,
    excluded: Iterable[str] = (),
    keep: Column | None = None,
) -> DataFrame:
    """Return ``track, track_length, {column}_{method}..., categoricals...``.

    ``keep`` is a row predicate: only tracks with a row satisfying it remain,
    decided inside the same aggregate, so complete tracks need no join.
    """
    wanted = {
        name: list(dict.fromkeys(methods))
        for name in numeric_columns(points, {columns.track, columns.row, *excluded})
    }
    if methods_by_column is not None:
        wanted = {n: list(dict.fromkeys(methods_by_column.get(n, ()))) for n in wanted}
    asked = set(methods).union(*(methods_by_column or {}).values())
    unknown = sorted(asked - AGGREGATIONS.keys())
    if unknown:
        raise ValueError(f"Unsupported aggregation methods: {unknown}")
    if included is not None:
        chosen = set(included)
        wanted = {name: m for name, m in wanted.items() if name in chosen}
    carried = categorical_columns(points, {columns.track, columns.row})

    # A built-in exact median keeps a value map per track; counts per track and
    # value are bounded however long a track is.
    simple = {
        name: [method for method in chosen if method != "median"]
        for name, chosen in wanted.items()
    }
    rolled = _aggregate(points, columns, simple, carried, keep)
    halved = [name for name, chosen in wanted.items() if "median" in chosen]
    if halved:
        found = track_medians(points, halved, columns.track)
        same = F.col(columns.track).eqNullSafe(F.col("__track"))
        rolled = rolled.join(found, same, "left").drop("__track")
    return rolled.select(
        columns.track,
        "track_length",
        *[f"{name}_{method}" for name, chosen in wanted.items() for method in chosen],
        *carried,
    )


def track_medians(points: DataFrame, names: Sequence[str], track: str) -> DataFrame:
    """``__track`` and the median of each column, from one table of all values.

    However many columns there are, the points are read once and their values go
    through one exchange as (track, column, value) counts.
    """
    values = F.array(
        *[
            F.struct(F.lit(place).alias("__place"), F.col(name).cast("double").alias("__value"))
            for place, name in enumerate(names)
        ]
    )
    running = cumulative_counts(
        points.select(F.col(track).alias("__track"), F.inline(values)).filter(
            F.col("__value").isNotNull()
        ),
        ["__track", "__place"],
        "__value",
        {"n": F.lit(1)},
    )
    of_place = {
        f"__value{place}": F.when(F.col("__place") == place, F.col("__value"))
        for place in range(len(names))
    }
    return (
        running.withColumns(of_place)
        .groupBy("__track")
        .agg(
            *[
                median_of(column, "n").alias(f"{name}_median")
                for column, name in zip(of_place, names, strict=True)
            ]
        )
    )


def _aggregate(
    points: DataFrame,
    columns: Columns,
    wanted: Mapping[str, Sequence[str]],
    carried: Sequence[str],
    keep: Column | None,
) -> DataFrame:
    row = F.col(columns.row)
    outputs = [F.count(F.lit(1)).alias("track_length")]
    for name, chosen in wanted.items():
        outputs += [
            AGGREGATIONS[method](F.col(name), row).alias(f"{name}_{method}")
            for method in chosen
        ]
    outputs += [first_known(name, row).alias(name) for name in carried]
    if keep is None:
        return points.groupBy(columns.track).agg(*outputs)
    rolled = points.groupBy(columns.track).agg(
        *outputs, F.bool_or(keep).alias("__keep")
    )
    # A NULL track id matches nothing, as in a join.
    return rolled.filter(F.col("__keep") & F.col(columns.track).isNotNull()).drop(
        "__keep"
    )


def first_known(name: str, row: Column) -> Column:
    """First non-null value in row order; rows without one are skipped."""
    known = F.col(name).isNotNull()
    return F.min_by(F.col(name), F.when(known, row))


def active_frame(
    points: DataFrame,
    filters: Iterable[RangeFilter | ValueFilter],
    columns: Columns = Columns(),
    *,
    level: str = "Point",
    methods_by_column: Mapping[str, Iterable[str]] | None = None,
    excluded: Iterable[str] = ("frame", "time"),
) -> DataFrame:
    """Filtered rows, or the roll-up of complete tracks with a passing row."""
    filters = list(filters)
    if level == "Point":
        return filter_points(points, filters)
    if level != "Track":
        raise ValueError(f"Analysis level must be Point or Track, not {level!r}.")
    chosen = methods_by_column or {}
    wanted = conjunction(filters)
    return aggregate_tracks(
        points,
        columns,
        methods_by_column=chosen,
        included=chosen,
        excluded=excluded,
        keep=F.lit(True) if wanted is None else wanted,
    )
