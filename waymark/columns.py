"""Column roles and schema checks made before a plan is built."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Added by the file source; user data may not carry it.
ROW_ID = "__row_id"


@dataclass(frozen=True)
class Columns:
    """Which column plays which role in a point table."""

    track: str = "track_id"
    time: str = "time"
    label: str = "label"
    row: str = ROW_ID


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"The table lacks the columns {', '.join(missing)}.")


def require_point_table(df: DataFrame, track: str) -> None:
    """Check a freshly read table before row ids are attached."""
    require_columns(df, [track])
    if ROW_ID in df.columns:
        raise ValueError(f"The name {ROW_ID!r} is reserved for row ids.")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        field.name
        for field in df.schema
        if field.name not in skip and isinstance(field.dataType, T.NumericType)
    ]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        field.name
        for field in df.schema
        if field.name not in skip
        and isinstance(field.dataType, (T.StringType, T.BooleanType))
    ]


def filter_kinds(df: DataFrame, columns: Columns = Columns()) -> dict[str, str]:
    """Map each filterable column to ``continuous`` or ``discrete``."""
    exclude = {columns.track, columns.row}
    numeric = set(numeric_columns(df, exclude))
    categorical = set(categorical_columns(df, exclude))
    return {
        name: "continuous" if name in numeric else "discrete"
        for name in df.columns
        if name in numeric or name in categorical
    }


def rollup_features(
    df: DataFrame,
    columns: Columns = Columns(),
    excluded: Iterable[str] = ("frame", "time"),
) -> list[str]:
    """Numeric columns that a track roll-up may aggregate."""
    return numeric_columns(df, {columns.track, columns.row, *excluded})


def feature_columns(df: DataFrame, columns: Columns = Columns()) -> list[str]:
    """Numeric columns of the active frame that can be analysed."""
    return numeric_columns(df, {columns.track, columns.row})


def grouping_columns(df: DataFrame, columns: Columns = Columns()) -> list[str]:
    return [name for name in df.columns if name not in {columns.track, columns.row}]


def unused_name(taken: Iterable[str], wanted: str) -> str:
    """Return ``wanted``, numbered if the name is already in use."""
    names = set(taken)
    candidate, number = wanted, 0
    while candidate in names:
        number += 1
        candidate = f"{wanted}_{number}"
    return candidate


def repeated(names: Iterable[str]) -> list[str]:
    seen: set[str] = set()
    again: set[str] = set()
    for name in names:
        (again if name in seen else seen).add(name)
    return sorted(again)
