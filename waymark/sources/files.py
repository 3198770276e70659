"""CSV and Parquet point tables, and exports of selected rows."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..columns import ROW_ID, require_point_table


def load_points(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Read a point table by its suffix.

    A ``schema`` spares CSV the extra pass that type inference takes. Quotes in
    quoted CSV cells are doubled; ``multiline`` also allows line breaks there,
    and then a file cannot be split between tasks.
    """
    suffix = PurePosixPath(str(path)).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(str(path))
    if suffix == ".csv":
        reader = spark.read.options(header=True, escape='"', multiLine=multiline)
        if schema is not None:
            return reader.schema(schema).csv(str(path))
        return reader.option("inferSchema", True).csv(str(path))
    raise ValueError(f"{path!s} is neither a .csv nor a .parquet file.")


def open_point_table(
    spark: SparkSession,
    path: str,
    *,
    track: str = "track_id",
    schema: T.StructType | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Read a point table, check it and number its rows in input order."""
    points = load_points(spark, path, schema=schema, multiline=multiline)
    require_point_table(points, track)
    return number_rows(points)


def number_rows(scan: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Add consecutive row numbers, from 0, in the order of a file scan.

    The order is that of file names, then of places in the file. Spark packs the
    parts of files into tasks by size, so the parts are told apart by file and
    offset: inside a part, generated ids keep its order, and the row counts of
    the earlier parts, one small row each, make the numbers consecutive. A table
    that is no file scan counts each partition as a part; it must be a
    checkpoint, as anything with a shuffle may lay its rows out anew.
    """
    position = F.monotonically_increasing_id()
    try:
        tagged = scan.select(
            "*",
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__offset"),
            position.alias("__position"),
        )
    except AnalysisException:
        tagged = scan.select(
            "*",
            F.lit("").alias("__file"),
            F.shiftright(position, 33).alias("__offset"),
            position.alias("__position"),
        )
    part = ["__file", "__offset"]
    earlier = Window.orderBy(*part).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    starts = (
        tagged.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("__rows"), F.min("__position").alias("__least"))
        .withColumn("__start", F.sum("__rows").over(earlier) - F.col("__rows"))
    )
    number = F.col("__start") + F.col("__position") - F.col("__least")
    return (
        tagged.join(starts, part)
        .withColumn(name, number)
        .select(name, *scan.columns)
    )


def export_csv(selection: DataFrame, path: str, *, row: str = ROW_ID) -> None:
    _require_rows(selection)
    selection.drop(row).write.mode("errorifexists").options(header=True, escape='"').csv(path)


def export_parquet(selection: DataFrame, path: str, *, row: str = ROW_ID) -> None:
    _require_rows(selection)
    selection.drop(row).write.mode("errorifexists").parquet(path)


def _require_rows(selection: DataFrame) -> None:
    if selection.isEmpty():
        raise ValueError("An export needs at least one row.")
