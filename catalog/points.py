"""Filters, roll-ups, selections, labels, sources and sinks."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from waymark.functions.ranges import RangeFilter, ValueFilter
from waymark.operators import points as ops
from waymark.operators.rollup import active_frame, aggregate_tracks
from waymark.session import scratch_directory
from waymark.sources.files import export_csv, export_parquet, load_points, number_rows

from .registry import (
    EV,
    GAPS,
    LINE_FEATURES,
    POINTS,
    event_points,
    gap_points,
    line_items,
    query,
    table,
)

STRONG = [RangeFilter("value", lower=240.0)]


@query(f"""WITH {EV} SELECT row_id, track_id, round(value, 6) AS value, k FROM ev
WHERE value >= 50 AND value <= 300 AND k >= 10""")
def range_filter_points(spark, sf_dir):
    filters = [RangeFilter("value", 50.0, 300.0), RangeFilter("k", lower=10.0)]
    return ops.filter_points(event_points(spark, sf_dir), filters).select(
        "row_id", "track_id", "value", "k"
    )


@query("""SELECT l_orderkey AS track_id, l_quantity, l_returnflag FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 10""")
def discrete_filter_points(spark, sf_dir):
    filters = [ValueFilter("l_returnflag", ["A", "R"]), RangeFilter("l_quantity", 10.0)]
    return ops.filter_points(line_items(spark, sf_dir), filters).select(
        "track_id", "l_quantity", "l_returnflag"
    )


@query(f"""WITH {EV} SELECT row_id, track_id, round(value, 6) AS value FROM ev
WHERE track_id IN (SELECT track_id FROM ev WHERE value >= 240)""")
def complete_matching_tracks(spark, sf_dir):
    return ops.matching_tracks(event_points(spark, sf_dir), STRONG, POINTS).select(
        "row_id", "track_id", "value"
    )


# Means of 64 rows end in a 5 at the seventh digit, so more digits are compared.
@query(f"""WITH {EV} SELECT track_id, count(*) AS track_length,
  round(avg(value), 9) AS value_mean, round(median(value), 9) AS value_median,
  min(value) AS value_min, max(value) AS value_max,
  round(stddev_samp(value), 9) AS value_std,
  round(coalesce(sum(value), 0), 9) AS value_sum,
  arg_min_null(value, row_id) AS value_first, arg_max_null(value, row_id) AS value_last,
  round(avg(k), 9) AS k_mean, round(median(k), 9) AS k_median,
  arg_min(event_type, row_id) AS event_type, arg_min(label, row_id) AS label
FROM ev WHERE track_id IN (SELECT track_id FROM ev WHERE value >= 240)
GROUP BY track_id""", digits=9)
def track_rollup(spark, sf_dir):
    every = ["mean", "median", "min", "max", "std", "sum", "first", "last"]
    return active_frame(
        event_points(spark, sf_dir),
        STRONG,
        POINTS,
        level="Track",
        methods_by_column={"value": every, "k": ["mean", "median"]},
    )


@query("""SELECT l_orderkey AS track_id, count(*) AS track_length,
  round(avg(l_quantity), 6) AS l_quantity_mean, max(l_quantity) AS l_quantity_max,
  round(coalesce(sum(l_extendedprice), 0), 2) AS l_extendedprice_sum,
  round(median(l_discount), 6) AS l_discount_median
FROM lineitem GROUP BY l_orderkey""")
def order_rollup(spark, sf_dir):
    rolled = active_frame(
        line_items(spark, sf_dir).drop("l_returnflag").withColumn("row_id", F.lit(0)),
        [],
        POINTS,
        level="Track",
        methods_by_column={
            "l_quantity": ["mean", "max"],
            "l_extendedprice": ["sum"],
            "l_discount": ["median"],
        },
    )
    total = F.round("l_extendedprice_sum", 2)
    return rolled.withColumn("l_extendedprice_sum", total)


@query(f"""WITH {EV} SELECT event_type, min(row_id) AS first_row FROM ev
WHERE event_type IS NOT NULL GROUP BY event_type""")
def filter_value_options(spark, sf_dir):
    return ops.value_options(event_points(spark, sf_dir), "event_type", POINTS)


def _bounds(name: str) -> str:
    return f"""SELECT '{name}' AS feature,
  lo - CASE WHEN lo = hi THEN greatest(abs(lo) * 0.05, 1.0) ELSE 0 END AS lower,
  hi + CASE WHEN lo = hi THEN greatest(abs(lo) * 0.05, 1.0) ELSE 0 END AS upper
FROM (SELECT min({name}) AS lo, max({name}) AS hi FROM lineitem)"""


@query(" UNION ALL ".join(_bounds(name) for name in LINE_FEATURES))
def filter_bounds(spark, sf_dir):
    return ops.filter_bounds(line_items(spark, sf_dir), LINE_FEATURES)


_LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query(
    'SELECT "column", distinct_values FROM ('
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", count(DISTINCT {name}) AS distinct_values FROM lineitem"""
        for name in _LINE_COLUMNS
    )
    + ") WHERE distinct_values BETWEEN 2 AND 50"
)
def label_column_candidates(spark, sf_dir):
    return ops.label_candidates(table(spark, sf_dir, "lineitem"))


@query("SELECT DISTINCT l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL")
def positive_class_options(spark, sf_dir):
    return ops.class_options(line_items(spark, sf_dir), "l_returnflag")


@query(f"""WITH {EV} SELECT row_id,
  CASE WHEN value >= 240 THEN 'strong' END AS review FROM ev""")
def label_selected_points(spark, sf_dir):
    points = event_points(spark, sf_dir)
    picked = ops.filter_points(points, STRONG)
    labelled = ops.label_selection(points, picked, "review", "strong", POINTS)
    return labelled.select("row_id", "review")


@query(f"""WITH {EV} SELECT row_id,
  CASE WHEN track_id IN (SELECT track_id FROM ev WHERE value >= 240)
       THEN 'strong' ELSE event_type END AS event_type FROM ev""")
def label_selected_tracks(spark, sf_dir):
    points = event_points(spark, sf_dir)
    tracks = ops.filter_points(points, STRONG).select("track_id")
    labelled = ops.label_selection(points, tracks, "event_type", "strong", POINTS)
    return labelled.select("row_id", "event_type")


@query(f"""WITH {EV} SELECT row_id, track_id FROM ev WHERE row_id IN
  (SELECT max(row_id) FROM ev GROUP BY track_id)""")
def selected_rows(spark, sf_dir):
    points = event_points(spark, sf_dir)
    last = points.groupBy("track_id").agg(F.max("row_id").alias("row_id"))
    return ops.select_rows(points, last, POINTS).select("row_id", "track_id")


@query(f"""WITH {EV} SELECT count(*) AS rows, count(DISTINCT track_id) AS tracks
FROM ev WHERE value >= 240""")
def selection_summary(spark, sf_dir):
    return ops.selection_summary(
        ops.filter_points(event_points(spark, sf_dir), STRONG), POINTS
    )


@query("""SELECT row_number() OVER (ORDER BY event_id) - 1 AS __row_id, event_id
FROM events""")
def numbered_rows(spark, sf_dir):
    return number_rows(table(spark, sf_dir, "events")).select("__row_id", "event_id")


_EXPORTED = f"""WITH {EV} SELECT track_id, time, round(value, 6) AS value, event_type
FROM ev WHERE value >= 100"""


def _selection(spark, sf_dir):
    picked = ops.filter_points(event_points(spark, sf_dir), [RangeFilter("value", 100.0)])
    return picked.select("row_id", "track_id", "time", "value", "event_type")


@query(_EXPORTED)
def export_roundtrip_csv(spark, sf_dir):
    path = f"{scratch_directory(spark)}/selection-{uuid4().hex}.csv"
    selection = _selection(spark, sf_dir)
    export_csv(selection, path, row="row_id")
    return load_points(spark, path, schema=selection.drop("row_id").schema)


@query(_EXPORTED)
def export_roundtrip_parquet(spark, sf_dir):
    path = f"{scratch_directory(spark)}/selection-{uuid4().hex}.parquet"
    export_parquet(_selection(spark, sf_dir), path, row="row_id")
    return load_points(spark, path)


@query("SELECT doc_id, text FROM documents")
def export_roundtrip_csv_texts(spark, sf_dir):
    """Texts with quotes, commas and line breaks keep every character."""
    path = f"{scratch_directory(spark)}/texts-{uuid4().hex}.csv"
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    export_csv(texts, path)
    return load_points(spark, path, schema=texts.schema, multiline=True)


@query(f"""WITH {GAPS} SELECT track_id, count(*) AS track_length,
  coalesce(round(max(value) FILTER (WHERE NOT isnan(value)), 6), max(value)) AS value_max,
  round(min(value), 6) AS value_min FROM gp GROUP BY track_id""")
def gap_rollup(spark, sf_dir):
    """NaN is not the largest value of a track that has others."""
    points = gap_points(spark, sf_dir).select("row_id", "track_id", "value")
    return aggregate_tracks(points, POINTS, methods=["max", "min"])


@query(f"""WITH {GAPS} SELECT 'value' AS feature, round(min(value), 6) AS lower,
  round(max(value) FILTER (WHERE NOT isnan(value)), 6) AS upper FROM gp""")
def gap_bounds(spark, sf_dir):
    return ops.filter_bounds(gap_points(spark, sf_dir), ["value"])
