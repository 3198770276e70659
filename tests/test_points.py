import pytest
from frames import column, filters_small, frame, tracks_small

from waymark.columns import (
    ROW_ID,
    Columns,
    feature_columns,
    filter_kinds,
    grouping_columns,
    require_point_table,
    rollup_features,
    unused_name,
)
from waymark.functions.ranges import RangeFilter, ValueFilter
from waymark.operators import points as ops
from waymark.operators.rollup import active_frame, aggregate_tracks


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_range_and_value_filters(spark):
    points = filters_small(spark)
    assert column(ops.filter_points(points, [RangeFilter("score", 2.0)]), "track_id") == [2, 3]
    keep = ops.filter_points(points, [ValueFilter("label", ["keep"])])
    assert column(keep, "track_id") == [1, 3]
    both = [RangeFilter("score", 1.0, 2.0), ValueFilter("label", ["reject"])]
    assert column(ops.filter_points(points, both), "track_id") == [2]
    # no bound and no value restrict nothing
    nothing = [RangeFilter("score"), ValueFilter("label")]
    assert ops.filter_points(points, nothing).count() == 3


def test_filter_kinds_and_column_lists(spark):
    points = filters_small(spark)
    assert filter_kinds(points) == {"score": "continuous", "label": "discrete"}
    assert rollup_features(points) == ["score"]
    assert feature_columns(points) == ["score"]
    assert grouping_columns(points) == ["score", "label"]
    assert unused_name(["a", "a_1"], "a") == "a_2"
    with pytest.raises(ValueError, match="reserved"):
        require_point_table(points, "track_id")
    with pytest.raises(ValueError, match="lacks"):
        require_point_table(points, "nope")


def test_bounds_and_options(spark):
    points = frame(
        spark,
        "track_id long, score double, flat int, empty double, label string",
        [(1, 1.0, 40, None, "b"), (2, 3.0, 40, None, None), (3, 2.0, 40, None, "a"), (3, 2.0, 40, None, "b")],
    )
    bounds = rows(ops.filter_bounds(points, ["score", "flat", "empty"]), "feature", "lower", "upper")
    assert bounds == [("empty", 0.0, 1.0), ("flat", 38.0, 42.0), ("score", 1.0, 3.0)]
    assert [r.label for r in ops.value_options(points, "label").collect()] == ["b", "a"]
    assert [r.label for r in ops.class_options(points, "label").collect()] == ["a", "b"]
    found = rows(ops.label_candidates(points, exclude=[ROW_ID]), "column", "distinct_values")
    assert found == [("label", 2), ("score", 3), ("track_id", 3)]
    found = rows(ops.label_candidates(points, minimum=0, maximum=2, exclude=[ROW_ID]), "column")
    assert found == [("empty",), ("flat",), ("label",)]


def test_complete_tracks_and_their_rollup(spark):
    points = tracks_small(spark)
    over = [RangeFilter("snr", 12.5)]
    assert column(ops.matching_tracks(points, over), "snr") == [10.0, 14.0]
    rolled = active_frame(
        points, over, level="Track", methods_by_column={"snr": ["mean"]}
    )
    assert rolled.columns == ["track_id", "track_length", "snr_mean", "label"]
    assert rows(rolled, "track_id", "snr_mean") == [(2, 12.0)]
    assert active_frame(points, over).count() == 1
    none = active_frame(points, [RangeFilter("snr", 99)], level="Track", methods_by_column={"snr": ["mean"]})
    assert none.count() == 0
    with pytest.raises(ValueError, match="Point or Track"):
        active_frame(points, [], level="Orbit")


def test_rollup_names_order_and_values(spark):
    rolled = aggregate_tracks(tracks_small(spark), methods=["mean", "max"])
    assert rolled.columns == ["track_id", "track_length", "snr_mean", "snr_max", "label"]
    assert rows(rolled, "track_id", "track_length", "snr_mean", "snr_max", "label") == [
        (1, 2, 2.0, 3.0, "a"),
        (2, 2, 12.0, 14.0, "b"),
    ]
    with pytest.raises(ValueError, match="Unsupported aggregation"):
        aggregate_tracks(tracks_small(spark), methods=["mode"])


def test_rollup_null_handling(spark):
    points = frame(
        spark,
        "track_id long, x double, label string",
        [(1, None, None), (1, 4.0, "late"), (1, None, "later"), (2, None, None)],
    )
    every = ["mean", "median", "min", "max", "std", "sum", "first", "last"]
    found = {r.track_id: r.asDict() for r in aggregate_tracks(points, methods=every).collect()}
    one, two = found[1], found[2]
    assert one["x_sum"] == 4.0 and two["x_sum"] == 0.0
    assert one["x_first"] is None and one["x_last"] is None
    assert one["x_std"] is None and two["x_mean"] is None
    assert one["label"] == "late" and two["label"] is None


def test_label_rows_and_tracks(spark):
    points = tracks_small(spark)
    picked = ops.filter_points(points, [RangeFilter("snr", 3.0, 3.0)])
    by_row = ops.label_selection(points, picked, " review ", "good")
    assert column(by_row, "review") == [None, "good", None, None]
    track = spark.createDataFrame([(2,)], "track_id long")
    by_track = ops.label_selection(points, track, "label", "x")
    assert column(by_track, "label") == ["a", "a", "x", "x"]
    for name, text in [("", "needs the name"), ("track_id", "reserved"), (ROW_ID, "reserved"), ("snr", "strings")]:
        with pytest.raises(ValueError, match=text):
            ops.label_selection(points, picked, name, "good")
    with pytest.raises(ValueError, match="no rows to label"):
        ops.label_selection(points, picked.limit(0), "review", "good")


def test_row_selection_and_summary(spark):
    points = tracks_small(spark)
    assert column(ops.select_rows(points, [0, 3, 99]), "snr") == [1.0, 14.0]
    table = spark.createDataFrame([(1,), (1,), (7,)], f"{ROW_ID} long")
    assert column(ops.select_rows(points, table), "snr") == [3.0]
    assert ops.selection_summary(points).first().asDict() == {"rows": 4, "tracks": 2}
    assert ops.selection_summary(points.limit(0)).first().asDict() == {"rows": 0, "tracks": 0}


def test_binary_violations(spark):
    df = spark.createDataFrame(
        [(0, 2, None, True), (1, 0, None, False), (None, 1, None, None)],
        "good int, bad int, empty int, flag boolean",
    )
    assert ops.binary_violations(df, df.columns) == ["bad"]
    assert ops.binary_violations(df, []) == []


def test_nan_is_no_largest_value(spark):
    nan = float("nan")
    points = frame(spark, "track_id long, x double, k int", [(1, 2.0, 1), (1, nan, 3), (2, nan, None), (2, None, 2)])
    rolled = aggregate_tracks(points, methods=["max", "median"]).orderBy("track_id").collect()
    assert [(r.x_max if r.x_max == r.x_max else "nan", r.k_max) for r in rolled] == [(2.0, 3), ("nan", 2)]
    bounds = {r.feature: (r.lower, r.upper) for r in ops.filter_bounds(points, ["x", "k"]).collect()}
    assert bounds == {"x": (1.0, 3.0), "k": (1.0, 3.0)}


def test_medians_of_all_tracks(spark):
    rows = [(t % 7 if t % 11 else None, float(t * 37 % 101) if t % 5 else None) for t in range(300)]
    points = frame(spark, "track_id long, x double", rows)
    plain = points.groupBy("track_id").agg({"x": "median"}).collect()
    found = aggregate_tracks(points, methods=["median"])
    assert {(r.track_id, r.x_median) for r in found.collect()} == {tuple(r) for r in plain}
