"""Model paths and Python confirmation logic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from waymark.functions.ranges import RangeRule
from waymark.functions.scores import with_model_path
from waymark.operators import confirm
from waymark.operators.evaluators import (
    MergeableLogic,
    batch_evaluator,
    mergeable_evaluator,
    row_evaluator,
)
from waymark.plans.comparison import compare, trigger_points
from waymark.sources.models import LinearModel, ModelSpec

from .registry import EV, POINTS, event_points, query

LINEAR = ModelSpec("linear", LinearModel([0.02, -0.05], -0.5), ("value", "k"))


@query(f"""WITH {EV}, sc AS (
  SELECT row_id, 1 / (1 + exp(-(0.02 * value - 0.05 * k - 0.5))) AS s FROM ev)
SELECT row_id, round(s, 6) AS linear_path_score, CAST(s >= 0.4 AS TINYINT) AS linear_path
FROM sc""")
def linear_model_path(spark, sf_dir):
    scored = with_model_path(event_points(spark, sf_dir), "linear_path", LINEAR, 0.4)
    return scored.select("row_id", "linear_path_score", "linear_path")


def _saturating(batch: pd.DataFrame) -> np.ndarray:
    return np.minimum(batch["value"] / 200, 1.0)


@query(f"""WITH {EV} SELECT row_id, round(least(value / 200, 1.0), 6) AS capped_path_score,
  CAST(least(value / 200, 1.0) >= 0.75 AS TINYINT) AS capped_path FROM ev""")
def callable_model_path(spark, sf_dir):
    spec = ModelSpec("capped", _saturating, ("value",))
    scored = with_model_path(event_points(spark, sf_dir), "capped_path", spec, 0.75)
    return scored.select("row_id", "capped_path_score", "capped_path")


@query(f"""WITH {EV} SELECT row_id, CAST(value >= 100 OR k <= 2 AS TINYINT) AS manual
FROM ev""")
def python_row_evaluator(spark, sf_dir):
    def logic(config, batch):
        fired = (batch["value"] >= config["level"]) | (batch["k"] <= 2)
        return pd.DataFrame({"manual": fired.astype("int8")})

    points = event_points(spark, sf_dir).select("row_id", "value", "k")
    return row_evaluator(points, logic, {"level": 100}, ["manual"]).select(
        "row_id", "manual"
    )


@query(f"""WITH {EV} SELECT row_id, CAST(coalesce(value > lag(value) OVER (
  PARTITION BY track_id ORDER BY time, row_id), false) AS TINYINT) AS rising FROM ev""")
def python_evaluator_path(spark, sf_dir):
    """History-dependent logic: a point fires when it exceeds the one before."""

    def logic(config, batches):
        last = np.inf
        for batch in batches:
            before = batch["value"].shift(1)
            before.iloc[0] = last
            last = batch["value"].iloc[-1]
            yield pd.DataFrame({"rising": (batch["value"] > before).astype("int8")})

    points = event_points(spark, sf_dir).select("row_id", "track_id", "time", "value")
    found = batch_evaluator(points, logic, {}, ["rising"], POINTS)
    # The verdict goes back to the points by row id.
    return points.join(found.select("row_id", "rising"), "row_id", "left").select(
        "row_id", "rising"
    )


class Records(MergeableLogic):
    """A point fires if it beats all before it by a margin."""

    def summary(self, config, points):
        return points["value"].max()

    def merge(self, first, then):
        return max(first, then)

    def paths(self, config, points, before):
        highest = points["value"].cummax().shift(1)
        highest.iloc[0] = before
        if before is not None:
            highest = highest.clip(lower=before)
        return pd.DataFrame({"record": (points["value"] > highest + config["by"]).astype("int8")})


@query(f"""WITH {EV} SELECT row_id, CAST(coalesce(value > 1 + max(value) OVER (
  PARTITION BY track_id ORDER BY time, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  false) AS TINYINT) AS record FROM ev""")
def mergeable_evaluator_path(spark, sf_dir):
    """History logic that needs no track to stay on one task."""
    points = event_points(spark, sf_dir).select("row_id", "track_id", "time", "value")
    found = mergeable_evaluator(
        points, Records(), {"by": 1}, ["record"], POINTS, stretch_rows=5_000
    )
    return found.select("row_id", "record")


@query(f"""WITH {EV}, tr AS (SELECT *, value >= 150 AND coalesce(lag(value) OVER (
    PARTITION BY track_id ORDER BY time, row_id) >= 40, false) AS fired FROM ev)
SELECT track_id, arg_min(label, row_id) AS label,
  min(time) FILTER (WHERE fired) AS default_first_confirmation_time,
  min(time) FILTER (WHERE fired OR k <= 1) AS candidate_first_confirmation_time
FROM tr GROUP BY track_id""")
def evaluator_comparison(spark, sf_dir):
    """Comparison whose default path comes from Python logic and is detected."""

    def logic(config, batches):
        last = -np.inf
        for batch in batches:
            before = batch["value"].shift(1)
            before.iloc[0] = last
            last = batch["value"].iloc[-1]
            fired = (batch["value"] >= config["level"]) & (before >= 40)
            yield pd.DataFrame({"sustained": fired.astype("int8")})

    def evaluator(section, points):
        return batch_evaluator(points, logic, section, ["sustained"], POINTS)

    payload = {"dynamic_specific": {"track_qa_config": {"level": 150}}}
    result = compare(
        event_points(spark, sf_dir),
        payload,
        evaluator=evaluator,
        rules=[RangeRule("small_k", "k", maximum=1.0)],
        columns=POINTS,
        keep_cells=False,
    )
    return result.first_times.select(
        "track_id", "label", confirm.DEFAULT_TIME, confirm.CANDIDATE_TIME
    )


@query(f"""WITH {EV} SELECT row_id, round(value, 6) AS value,
  CAST(value >= 150 AS TINYINT) AS strong, value >= 150 AS default_triggered,
  value >= 150 OR value >= 300 AS candidate_triggered FROM ev""")
def evaluator_paths_joined(spark, sf_dir):
    """Logic that overwrites an input column: only its path reaches the points."""

    def evaluator(section, points):
        fired = F.col("value") >= section["level"]
        return points.withColumn("strong", fired).withColumn("value", F.lit(0.0))

    result = trigger_points(
        event_points(spark, sf_dir),
        {"dynamic_specific": {"track_qa_config": {"level": 150}}},
        evaluator=evaluator,
        rules=[RangeRule("high", "value", minimum=300.0)],
        columns=POINTS,
    )
    return result.points.select(
        "row_id", "value", "strong", "default_triggered", "candidate_triggered"
    )
