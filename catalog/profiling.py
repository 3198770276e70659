"""Histograms, empirical distributions and samples."""

from __future__ import annotations

from waymark.operators import sampling
from waymark.operators.profile import ecdf as ecdf_of
from waymark.operators.profile import histogram as histogram_of

from .registry import EV, POINTS, event_points, line_items, query


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo,
  (max(l_extendedprice) - min(l_extendedprice)) / 40 AS w FROM lineitem)
SELECT CAST(b AS INTEGER) AS bin, round(lo + b * w, 4) AS lower,
  round(lo + (b + 1) * w, 4) AS upper, count(*) AS rows
FROM (SELECT lo, w, least(floor((l_extendedprice - lo) / w), 39) AS b FROM lineitem, e)
GROUP BY b, lo, w""", digits=4)
def histogram(spark, sf_dir):
    return histogram_of(line_items(spark, sf_dir), "l_extendedprice")


@query(f"""WITH {EV}, e AS (SELECT min(value) AS lo,
  (max(value) - min(value)) / 25 AS w FROM ev)
SELECT event_type, CAST(b AS INTEGER) AS bin, round(lo + b * w, 4) AS lower,
  round(lo + (b + 1) * w, 4) AS upper, count(*) AS rows
FROM (SELECT event_type, lo, w, least(floor((value - lo) / w), 24) AS b FROM ev, e)
GROUP BY event_type, b, lo, w""", digits=4)
def histogram_by_group(spark, sf_dir):
    points = event_points(spark, sf_dir)
    return histogram_of(points, "value", group="event_type", bins=25)


@query("""SELECT l_extendedprice, count(*) AS rows, round(max(c), 6) AS ecdf
FROM (SELECT l_extendedprice, cume_dist() OVER (ORDER BY l_extendedprice) AS c
  FROM lineitem) GROUP BY l_extendedprice""")
def ecdf(spark, sf_dir):
    return ecdf_of(line_items(spark, sf_dir), "l_extendedprice")


@query("""SELECT l_returnflag, l_quantity, count(*) AS rows, round(max(c), 6) AS ecdf
FROM (SELECT l_returnflag, l_quantity,
    cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS c FROM lineitem)
GROUP BY l_returnflag, l_quantity""")
def ecdf_by_group(spark, sf_dir):
    return ecdf_of(line_items(spark, sf_dir), "l_quantity", group="l_returnflag")


@query(f"""WITH {EV} SELECT row_id, track_id, round(value, 6) AS value FROM ev
ORDER BY md5(concat('7:', row_id)), row_id LIMIT 500""")
def random_sample(spark, sf_dir):
    sample = sampling.random_sample(event_points(spark, sf_dir), 500, POINTS)
    return sample.select("row_id", "track_id", "value")


PICKED = EV + """, sz AS (SELECT track_id, count(*) AS rows FROM ev GROUP BY track_id),
pk AS (SELECT track_id, rows FROM (SELECT *, sum(rows) OVER (
    ORDER BY md5(concat('7:', track_id)), track_id
    ROWS UNBOUNDED PRECEDING) - rows AS before FROM sz) WHERE before < 500)"""


@query(f"WITH {PICKED} SELECT * FROM sz")
def group_sizes(spark, sf_dir):
    return sampling.group_sizes(event_points(spark, sf_dir), "track_id")


@query(f"WITH {PICKED} SELECT * FROM pk")
def picked_groups(spark, sf_dir):
    return sampling.picked_groups(event_points(spark, sf_dir), "track_id", 500)


@query(f"""WITH {PICKED} SELECT row_id, track_id, round(value, 6) AS value
FROM ev WHERE track_id IN (SELECT track_id FROM pk)""")
def group_sample(spark, sf_dir):
    sample = sampling.sample_rows(
        event_points(spark, sf_dir), 500, POINTS, group="track_id"
    )
    return sample.select("row_id", "track_id", "value")


@query(f"""WITH {EV} SELECT row_id, round(value, 6) AS value, k FROM ev
ORDER BY row_id LIMIT 100""")
def background_rows(spark, sf_dir):
    return sampling.background_rows(event_points(spark, sf_dir), POINTS).select(
        "row_id", "value", "k"
    )


@query(f"""WITH {EV} SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label
  ORDER BY md5(concat('7:', row_id)), row_id) - 1) % 5 AS INTEGER) AS fold FROM ev""")
def stratified_folds(spark, sf_dir):
    points = event_points(spark, sf_dir)
    folded = sampling.stratified_folds(points, "label", 5, POINTS)
    return folded.select("row_id", "label", "fold")
