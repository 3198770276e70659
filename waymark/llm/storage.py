"""Intermediate tables in the folder that all workers share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from waymark.session import scratch_directory

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session may lack one."""
    key = spark.sparkContext.applicationId
    if key not in _FOLDERS:
        _FOLDERS[key] = scratch_directory(spark)
    return _FOLDERS[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps start from the file, so a lost executor costs them nothing but
    its own tasks, and work before this point is done once. What the write
    shuffled is no longer needed; the driver's collector lets go of it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect(0)
    spark.sparkContext._jvm.System.gc()
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no frame in use reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
