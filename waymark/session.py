"""Session settings the library relies on."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[tuple[str, str]] = set()

# All of these can be changed at run time, so they also apply to a session
# that somebody else created.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even when a later aggregate then needs one
    # more exchange: the alternative is one task holding the hot key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark, Path(__file__).parent)
    return spark


def ship_package(spark: SparkSession, folder: Path) -> None:
    """Send a Python package to the workers, once per application.

    Functions that run in Python workers import it there; the workers need not
    have it installed.
    """
    known = (spark.sparkContext.applicationId, str(folder))
    if known in _SHIPPED:
        return
    with tempfile.TemporaryDirectory(prefix="waymark-") as clean:
        staged = Path(clean) / "source"
        shutil.copytree(
            folder, staged / folder.name, ignore=shutil.ignore_patterns("__pycache__")
        )
        archive = shutil.make_archive(
            str(Path(tempfile.mkdtemp(prefix="waymark-")) / folder.name), "zip", staged
        )
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(known)


def get_session(
    app_name: str = "waymark",
    *,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """Create or fetch a session; ``master`` stays with the cluster if unset."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config(
            "spark.sql.shuffle.partitions", str(shuffle_partitions)
        )
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def scratch_directory(spark: SparkSession) -> str:
    """Return the shared folder for intermediate files.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only
    a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder all workers share.")
    return tempfile.mkdtemp(prefix="waymark-")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Steps after it start from the file: what is before runs once, and a lost
    executor costs only its own tasks.
    """
    path = f"{scratch_directory(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage that nothing reads any more."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
