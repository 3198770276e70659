"""Small files, configurations and models, from wherever Spark can read."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

Place = str | Path


def has_scheme(place: Place) -> bool:
    return "://" in str(place) or str(place).startswith("file:")


def beside(folder: Place, file: str) -> Place:
    """A file named relative to a folder, either of them local or a URI."""
    if has_scheme(file):
        return file
    if has_scheme(folder):
        return file if file.startswith("/") else f"{str(folder).rstrip('/')}/{file}"
    return Path(folder) / file


def read_artifact(place: Place) -> bytes:
    """The bytes of one file: from the driver's disk, else by Spark's file source.

    Shared storage is thus read by the same connectors as tables are.
    """
    if not has_scheme(place) and Path(place).is_file():
        return Path(place).read_bytes()
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"No such file, and no session to look further: {place}")
    try:
        found = (
            spark.read.format("binaryFile")
            .load(str(place))
            .filter(F.col("length") >= 0)
            .select("content")
            .take(2)
        )
    except (AnalysisException, PySparkException) as error:
        raise ValueError(f"Nothing can be read at {place}") from error
    if len(found) != 1:
        raise ValueError(f"One file is wanted at {place}, there are {len(found)}")
    return bytes(found[0]["content"])
