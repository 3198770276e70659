import math
import random
from bisect import bisect_right

import numpy as np
import pytest
from frames import frame
from pyspark.sql import functions as F

from waymark.functions.bijection import grid, round_keys, shuffled
from waymark.functions.ranges import RangeFilter
from waymark.operators import ordering, sampling
from waymark.operators.ordering import bucket_of, cumulative_counts, hash_ranks
from waymark.operators.profile import ecdf, histogram


def skewed(spark, size=3000, seed=1):
    """A third of the rows share one value and one group."""
    rng = random.Random(seed)
    data = [
        (i % 7, 0.25 if i % 3 == 0 else rng.random(), "big" if i % 3 == 0 else rng.choice("ab"))
        for i in range(size)
    ]
    return frame(spark, "track_id long, x double, g string", data), data


def test_histogram_counts_every_row_once(spark):
    points = frame(spark, "track_id long, x double", [(1, v) for v in [0.0, 0.1, 4.9, 5.0, None, float("nan")]])
    found = {r.bin: (r.lower, r.upper, r.rows) for r in histogram(points, "x", bins=5).collect()}
    assert found == {0: (0.0, 1.0, 2), 4: (4.0, 5.0, 2)}
    with pytest.raises(ValueError, match="Bins"):
        histogram(points, "x", bins=4)
    flat = histogram(frame(spark, "track_id long, x double", [(1, 2.0)] * 3), "x").collect()
    assert sum(r.rows for r in flat) == 3 and flat[0].lower <= 2.0 < flat[0].upper
    assert histogram(points.limit(0), "x").count() == 0


def test_ecdf_matches_brute_force(spark):
    points, data = skewed(spark)
    overall = {r.x: (r.rows, r.ecdf) for r in ecdf(points, "x").collect()}
    values = sorted(x for _, x, _ in data)
    assert sum(n for n, _ in overall.values()) == len(data)
    assert all(
        share == pytest.approx(bisect_right(values, x) / len(values))
        for x, (_, share) in overall.items()
    )
    grouped = ecdf(points, "x", group="g").collect()
    for name in "ab":
        values = sorted(x for _, x, g in data if g == name)
        mine = [r for r in grouped if r.g == name]
        assert len(mine) == len(set(values))
        assert all(r.ecdf == pytest.approx(bisect_right(values, r.x) / len(values)) for r in mine)


NUMBERS = [
    0.0, -0.0, 1e-300, 1e-9, 0.5, 1.0, 1.0 + 1e-15, 2.0, 1e15, 1e15 + 0.5, 1e308, math.inf,
    -1e-9, -0.5, -1.0, -1e15, -1e308, -math.inf,
]


@pytest.mark.parametrize("scale", [ordering.COARSE, ordering.FINE])
def test_buckets_never_fall(spark, scale):
    rng = random.Random(1)
    values = NUMBERS + [rng.uniform(-1, 1) * 10 ** rng.uniform(-12, 18) for _ in range(2000)]
    points = frame(spark, "x double", [(x,) for x in [*values, math.nan]])
    placed = points.select("x", bucket_of(F.col("x"), scale).alias("b")).collect()
    known = sorted((r.x, r.b) for r in placed if not math.isnan(r.x))
    assert [b for _, b in known] == sorted(b for _, b in known)
    assert all(r.b == ordering.LARGEST_LONG for r in placed if math.isnan(r.x))


def test_crowded_buckets_are_cut_finer(spark, monkeypatch):
    points, data = skewed(spark, 3000)
    weights = {"n": F.lit(1)}

    def counted():
        return sorted(tuple(r) for r in cumulative_counts(points, ["g"], "x", weights).collect())

    whole = counted()
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 3)
    assert counted() == whole
    for g, x, n, upto, total in whole:
        same = [v for _, v, h in data if h == g]
        assert (n, upto, total) == (same.count(x), sum(v <= x for v in same), len(same))


def test_numbers_have_no_gaps(spark):
    ids = spark.range(0, 3000, 7, numPartitions=5).select((F.col("id") * -3).alias("id"))
    rows, size = ordering.numbered(ids, "id", "number")
    found = {r.id: r.number for r in rows.collect()}
    assert size == len(found)
    assert [found[k] for k in sorted(found)] == list(range(len(found)))


@pytest.mark.parametrize("size", [1, 2, 3, 17, 256, 997, 4099])
def test_places_are_a_permutation(spark, size):
    orders = [
        [r[0] for r in spark.range(size).select(shuffled(F.col("id"), size, round_keys(7, f))).collect()]
        for f in range(3)
    ]
    assert all(sorted(order) == list(range(size)) for order in orders)
    if size > 900:
        for order in orders:
            assert sum(k == x for k, x in enumerate(order)) < 12
            assert abs(np.corrcoef(order, range(size))[0, 1]) < 0.15
        assert abs(np.corrcoef(orders[0], orders[1])[0, 1]) < 0.15


def test_large_grids_have_few_spare_cells():
    for size in (10**9 + 7, 10**12 + 39, 2**31 - 1):
        a, b = grid(size)
        assert 0 <= a * b - size <= 15 and a > 1000


def test_cumulative_counts_with_null_group_and_nan(spark):
    nan = float("nan")
    points = frame(spark, "g string, x double", [(None, 1.0), (None, nan), ("a", nan), ("a", nan), (None, 2.0)])
    found = cumulative_counts(points, ["g"], "x", {"n": F.lit(1)}).collect()
    shown = sorted((str(r.g), str(r.x), r.n, r.n_upto, r.n_total) for r in found)
    assert shown == [("None", "1.0", 1, 1, 3), ("None", "2.0", 1, 2, 3), ("None", "nan", 1, 3, 3), ("a", "nan", 2, 2, 2)]


def test_hash_ranks_are_dense(spark):
    points, data = skewed(spark, 900)
    ranked = hash_ranks(points, ["g"], sampling.shuffle_key(5, "__row_id"), "__row_id", rank="r", total="t")
    by_group = {}
    for row in ranked.collect():
        by_group.setdefault(row.g, []).append(row)
    for group in by_group.values():
        assert sorted(r.r for r in group) == list(range(1, len(group) + 1))
        assert {r.t for r in group} == {len(group)}


def test_samples(spark):
    points, _ = skewed(spark, 600)
    one = sampling.random_sample(points, 50, seed=3)
    assert one.count() == 50
    assert sorted(one.collect()) == sorted(sampling.random_sample(points.repartition(5), 50, seed=3).collect())
    assert sampling.random_sample(points, 10_000).count() == 600
    picked = sampling.picked_groups(points, "track_id", 100).collect()
    assert sum(r.rows for r in picked) >= 100
    assert sum(r.rows for r in picked) - min(r.rows for r in picked) < 100
    whole = sampling.group_sample(points, "track_id", 100)
    sizes = {r.track_id: r["count"] for r in whole.groupBy("track_id").count().collect()}
    assert sizes == {r.track_id: r.rows for r in picked}
    assert sampling.group_sample(points, "track_id", 600).count() == 600
    assert sampling.sample_rows(points, 10, group="nope").count() == 10
    assert [r["__row_id"] for r in sampling.background_rows(points, limit=3).collect()] == [0, 1, 2]


def test_folds_spread_each_class(spark):
    points, _ = skewed(spark, 500)
    folded = sampling.stratified_folds(points, "g", 5)
    sizes = folded.groupBy("g", "fold").count().collect()
    for name in ("big", "a", "b"):
        counts = [r["count"] for r in sizes if r.g == name]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    assert sampling.fold_count(3, 100) == 3
    with pytest.raises(ValueError, match="two rows of each"):
        sampling.fold_count(1, 9)
    assert RangeFilter("x").predicate() is None
