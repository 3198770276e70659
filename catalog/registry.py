"""Query registry and the bindings of the given tables to point-table roles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import Columns, configure
from waymark.session import ship_package
from waymark.sources.files import load_points

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

POINTS = Columns(track="track_id", time="time", label="label", row="row_id")
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None, *, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query under its function name, with doubles rounded."""

    def register(build: Query) -> Query:
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            ship_package(spark, Path(__file__).parent)
            return rounded(build(spark, sf_dir), digits)

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return run

    return register


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round double columns; adding 0.0 turns a negative zero into zero."""
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema
        ]
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_points(spark, f"{sf_dir}/{name}.parquet")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: a user is a track, time is microseconds since 2024."""
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("track_id"),
        F.expr(micros).alias("time"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        "event_type",
        F.when(F.col("event_type") == "error", F.lit("unmatched"))
        .otherwise(F.lit("matched"))
        .alias("label"),
    )


EV = """ev AS (
  SELECT event_id AS row_id, user_id AS track_id,
         epoch_us(ts) - 1704067200000000 AS time, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type,
         CASE WHEN event_type = 'error' THEN 'unmatched' ELSE 'matched' END AS label
  FROM events)"""


def gap_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event points with no value on views and NaN on clicks."""
    kind = F.col("event_type")
    return event_points(spark, sf_dir).withColumn(
        "value",
        F.when(kind == "click", F.lit(float("nan"))).when(kind != "view", F.col("value")),
    )


GAPS = EV + """, gp AS (
  SELECT * REPLACE (CASE WHEN event_type = 'click' THEN 'nan'::DOUBLE
                         WHEN event_type <> 'view' THEN value END AS value) FROM ev)"""


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points of an order; used where no row order is needed."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track_id"), *LINE_FEATURES, "l_returnflag"
    )


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels with the length of their document as a feature."""
    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("row_id"), "n_chars", "quality"
    )


def embedding_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The 64 numbers of every embedding as columns of their own."""
    names = [f"e{i:02d}" for i in range(64)]
    vectors = table(spark, sf_dir, "embeddings")
    return (
        vectors.select(
            F.col("vec_id").alias("row_id"),
            "label",
            *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)],
        ),
        names,
    )
