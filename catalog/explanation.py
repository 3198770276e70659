"""Default models and Shapley values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from waymark.functions.scores import with_model_path
from waymark.functions.trees import Tree, TreeEnsemble
from waymark.operators import explain, ranking
from waymark.operators.default_model import build_default_model
from waymark.sources.models import ModelSpec

from .newton import newton_ctes
from .registry import EV, POINTS, event_points, query
from .scoring import LINEAR

FEATURES = ["value", "k"]

_SHAP = EV + """, bg AS (SELECT avg(value) AS mv, avg(k) AS mk FROM (
  SELECT value, k FROM ev ORDER BY row_id LIMIT 100)),
sh AS (
  SELECT row_id AS row_index, 0 AS pos, 'value' AS feature, value AS feature_value,
    0.02 * (value - mv) AS shap_value, 0.02 * mv - 0.05 * mk - 0.5 AS base_value FROM ev, bg
  UNION ALL SELECT row_id, 1, 'k', k, -0.05 * (k - mk), 0.02 * mv - 0.05 * mk - 0.5
  FROM ev, bg)"""
_STEPS = _SHAP + """, wf AS (SELECT row_index, feature, feature_value,
    shap_value AS contribution,
    row_number() OVER (PARTITION BY row_index ORDER BY abs(shap_value) DESC, pos) AS step,
    base_value + sum(shap_value) OVER (PARTITION BY row_index
      ORDER BY abs(shap_value) DESC, pos ROWS UNBOUNDED PRECEDING) AS "end"
  FROM sh)"""
_WATERFALL = """SELECT row_index, CAST(step AS INTEGER) AS step, feature,
  round(feature_value, 6) AS feature_value, round(contribution, 6) AS contribution,
  round("end" - contribution, 6) AS start, round("end", 6) AS "end",
  CASE WHEN contribution >= 0 THEN 'Increases output' ELSE 'Decreases output' END
    AS direction FROM wf"""


def _frame(spark, sf_dir):
    return ranking.labelled_features(
        event_points(spark, sf_dir), FEATURES, "label", "matched", POINTS
    )


def _linear(spark, sf_dir):
    return explain.shap_contributions(
        _frame(spark, sf_dir), LINEAR, POINTS, explainer="Linear"
    )


@query(f"""WITH {_SHAP} SELECT row_index, round(base_value, 6) AS base_value, feature,
  round(feature_value, 6) AS feature_value, round(shap_value, 6) AS shap_value FROM sh""")
def linear_shap(spark, sf_dir):
    return explain.shap_rows(_linear(spark, sf_dir), POINTS)


@query(f"""WITH {_SHAP} SELECT feature, '{ranking.SHAP}' AS method,
  round(avg(abs(shap_value)), 6) AS score, round(avg(abs(shap_value)), 6) AS importance,
  'non-directional' AS direction FROM sh GROUP BY feature""")
def shap_importance(spark, sf_dir):
    return explain.shap_importance(explain.shap_rows(_linear(spark, sf_dir), POINTS))


@query(f"WITH {_STEPS} {_WATERFALL}")
def shap_waterfall(spark, sf_dir):
    return explain.shap_waterfall(_linear(spark, sf_dir), POINTS)


@query(f"WITH {_STEPS} {_WATERFALL} WHERE step <= 1")
def shap_top_contributions(spark, sf_dir):
    return explain.shap_waterfall(_linear(spark, sf_dir), POINTS, top=1)


@query(f"""WITH {_STEPS}, e AS (
  SELECT min(least("end", "end" - contribution)) AS lo,
    max(greatest("end", "end" - contribution)) AS hi FROM wf)
SELECT round(lo - greatest((hi - lo) * 0.05, 0.01), 6) AS lower,
  round(hi + greatest((hi - lo) * 0.05, 0.01), 6) AS upper FROM e""")
def shap_range(spark, sf_dir):
    return explain.shap_range(explain.shap_waterfall(_linear(spark, sf_dir), POINTS))


_DENSITY = _SHAP + """, s AS (SELECT feature, min(feature_value) AS f0,
    max(feature_value) AS f1, min(shap_value) AS s0, max(shap_value) AS s1,
    greatest(8, least(40, round_even(sqrt(count(*)) * 2, 0))) AS bins
  FROM sh GROUP BY feature),
b AS (SELECT sh.*, f0, f1,
    least(bins - 1, floor((shap_value - s0) / ((s1 - s0) / bins))) AS bin
  FROM sh JOIN s ON sh.feature = s.feature),
r AS (SELECT *, row_number() OVER (PARTITION BY feature, bin ORDER BY row_index) - 1 AS place,
    count(*) OVER (PARTITION BY feature, bin) AS m FROM b),
dn AS (SELECT feature, row_index, feature_value,
    (feature_value - f0) / (f1 - f0) AS relative_value, shap_value,
    (place - (m - 1) / 2) * 0.7 / max(m) OVER (PARTITION BY feature) AS density_offset
  FROM r)"""
_DENSITY_COLUMNS = """feature, row_index, round(feature_value, 6) AS feature_value,
  round(relative_value, 6) AS relative_value, round(shap_value, 6) AS shap_value,
  round(density_offset, 6) AS density_offset"""


@query(f"WITH {_DENSITY} SELECT {_DENSITY_COLUMNS} FROM dn")
def shap_density(spark, sf_dir):
    return explain.shap_density(explain.shap_rows(_linear(spark, sf_dir), POINTS))


@query(f"""WITH {_DENSITY}, pl AS (
  SELECT feature, row_number() OVER (ORDER BY avg(abs(shap_value)), feature) - 1 AS place
  FROM sh GROUP BY feature),
dp AS (SELECT dn.*, place FROM dn JOIN pl ON dn.feature = pl.feature)
SELECT {_DENSITY_COLUMNS}, round(place + density_offset, 6) AS plot_y FROM dp""")
def shap_beeswarm(spark, sf_dir):
    rows = explain.shap_rows(_linear(spark, sf_dir), POINTS)
    return explain.shap_beeswarm(explain.shap_density(rows))


def _model(spark, sf_dir, kind, **parameters):
    return build_default_model(
        event_points(spark, sf_dir),
        FEATURES,
        "label",
        "matched",
        kind,
        POINTS,
        class_weight_mode="Balanced",
        parameters=parameters,
    )


def _scored(spark, sf_dir, spec):
    scored = with_model_path(event_points(spark, sf_dir), "model", spec, 0.5)
    return scored.select("row_id", "label", "model_score", "model")


_FIT_STEPS = 9


# Balanced class weights, standardised inputs and a squared penalty of 1/2.
@query(f"""WITH {EV}, st AS (SELECT avg(value) AS c1, stddev_pop(value) AS d1, avg(k) AS c2,
    stddev_pop(k) AS d2, count(*) AS n, count(*) FILTER (WHERE label = 'matched') AS p FROM ev),
ro AS MATERIALIZED (SELECT row_id, label, CAST(label = 'matched' AS INTEGER) AS y,
    (value - c1) / d1 AS z1, (k - c2) / d2 AS z2,
    CASE WHEN label = 'matched' THEN n / (2 * p) ELSE n / (2 * (n - p)) END AS class_weight
  FROM ev, st),
mo AS (SELECT 0 AS one, 1 AS m1, 1 AS m2),
{newton_ctes("ro", "mo", ["one"], 3, match="true", steps=_FIT_STEPS, weight="class_weight",
             penalty="1.0")},
sd AS (SELECT row_id, label, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) AS s
  FROM ro, w{_FIT_STEPS})
SELECT row_id, label, round(s, 3) AS model_score, CAST(s >= 0.5 AS TINYINT) AS model FROM sd""",
       digits=3)
def default_logistic_scores(spark, sf_dir):
    return _scored(spark, sf_dir, _model(spark, sf_dir, "Logistic regression"))


@query()
def default_forest_scores(spark, sf_dir):
    spec = _model(spark, sf_dir, "Random forest", n_estimators=10, max_depth=5)
    return _scored(spark, sf_dir, spec)


@query()
def default_boosting_scores(spark, sf_dir):
    spec = _model(spark, sf_dir, "Gradient boosting", n_estimators=5)
    return _scored(spark, sf_dir, spec)


@query()
def tree_shap(spark, sf_dir):
    spec = _model(spark, sf_dir, "Random forest", n_estimators=5, max_depth=4)
    frame = _frame(spark, sf_dir)
    return explain.shap_rows(explain.shap_contributions(frame, spec, POINTS), POINTS)


def _score(value: str, k: str) -> str:
    return f"1 / (1 + exp(-(-0.5 + 0.02 * {value} + -0.05 * {k})))"


# Both features known, one of them, or none; the unknown ones run over the background.
@query(f"""WITH {EV}, bg AS (
  SELECT value AS bv, k AS bk FROM ev ORDER BY row_id LIMIT 100),
n AS (SELECT avg({_score("bv", "bk")}) AS base FROM bg),
v AS (SELECT row_id, value, k, {_score("value", "k")} AS known,
    avg({_score("value", "bk")}) AS v_only, avg({_score("bv", "k")}) AS k_only
  FROM ev, bg GROUP BY row_id, value, k)
SELECT row_id AS row_index, round(base, 6) AS base_value, 'value' AS feature,
  round(value, 6) AS feature_value,
  round((known - k_only + v_only - base) / 2, 6) AS shap_value FROM v, n
UNION ALL SELECT row_id, round(base, 6), 'k', k,
  round((known - v_only + k_only - base) / 2, 6) FROM v, n""")
def permutation_shap(spark, sf_dir):
    contributions = explain.shap_contributions(
        _frame(spark, sf_dir), LINEAR, POINTS, explainer="Permutation"
    )
    return explain.shap_rows(contributions, POINTS)


def _ensemble() -> TreeEnsemble:
    """Two small trees: value, then k, then value again; and k alone."""
    first = Tree(
        feature=np.array([0, 1, 0, -1, -1, -1, -1]),
        threshold=np.array([60.0, 4.0, 150.0, 0.0, 0.0, 0.0, 0.0]),
        left=np.array([1, 3, 5, -1, -1, -1, -1]),
        right=np.array([2, 4, 6, -1, -1, -1, -1]),
        value=np.array([0.0, 0.0, 0.0, 0.125, 0.5, 0.75, -0.25]),
        cover=np.array([80.0, 48.0, 32.0, 12.0, 36.0, 24.0, 8.0]),
    )
    second = Tree(
        feature=np.array([1, -1, -1]),
        threshold=np.array([6.0, 0.0, 0.0]),
        left=np.array([1, -1, -1]),
        right=np.array([2, -1, -1]),
        value=np.array([0.0, 0.25, 1.0]),
        cover=np.array([64.0, 40.0, 24.0]),
    )
    return TreeEnsemble([first, second], [0.5, 0.25], logistic=False)


# With two features a value is the mean of what it adds alone and to the other. An
# unknown split goes both ways by its shares: 48 and 32 of 80, 12 and 36 of 48, 24
# and 8 of 32, 40 and 24 of 64.
@query(f"""WITH {EV}, v AS (SELECT row_id, value, k,
    CASE WHEN value <= 60 THEN CASE WHEN k <= 4 THEN 0.125 ELSE 0.5 END
      WHEN value <= 150 THEN 0.75 ELSE -0.25 END AS both1,
    CASE WHEN value <= 60 THEN 0.25 * 0.125 + 0.75 * 0.5
      WHEN value <= 150 THEN 0.75 ELSE -0.25 END AS value1,
    0.6 * CASE WHEN k <= 4 THEN 0.125 ELSE 0.5 END + 0.4 * (0.75 * 0.75 + 0.25 * -0.25) AS k1,
    0.6 * (0.25 * 0.125 + 0.75 * 0.5) + 0.4 * (0.75 * 0.75 + 0.25 * -0.25) AS none1,
    CASE WHEN k <= 6 THEN 0.25 ELSE 1 END AS k2, 0.625 * 0.25 + 0.375 * 1 AS none2 FROM ev),
s AS (SELECT *, 0.5 * none1 + 0.25 * none2 AS base,
    0.5 * (both1 - k1 + value1 - none1) / 2 AS of_value,
    0.5 * (both1 - value1 + k1 - none1) / 2 + 0.25 * (k2 - none2) AS of_k FROM v)
SELECT row_id AS row_index, round(base, 9)::DOUBLE AS base_value, 'value' AS feature,
  round(value, 9)::DOUBLE AS feature_value, round(of_value, 9)::DOUBLE AS shap_value FROM s
UNION ALL SELECT row_id, round(base, 9)::DOUBLE, 'k', round(k, 9)::DOUBLE, round(of_k, 9)::DOUBLE FROM s""", digits=9)
def tree_shap_two_trees(spark, sf_dir):
    """Path-dependent values of a given ensemble, whose covers are stated."""
    spec = ModelSpec("two trees", _ensemble(), tuple(FEATURES))
    frame = _frame(spark, sf_dir)
    return explain.shap_rows(explain.shap_contributions(frame, spec, POINTS), POINTS)


def _explained(spark, sf_dir, kind, **parameters):
    """Rows, whether scores rank above chance, and whether values add up to scores."""
    spec = _model(spark, sf_dir, kind, **parameters)
    frame = _frame(spark, sf_dir)
    scored = with_model_path(frame, "model", spec, 0.5)
    added = F.col("base_value") + F.aggregate(
        "contributions", F.lit(0.0), lambda total, part: total + part["shap_value"]
    )
    margin = F.col("model_score")
    if spec.model.logistic:
        margin = F.log(margin / (1 - margin))
    explained = explain.shap_contributions(frame, spec, POINTS).select(
        "row_id", added.alias("added")
    )
    both = scored.join(explained, "row_id").withColumn("one", F.lit(""))
    auc = ranking.score_auc(both, "one", "model_score").select(
        (F.col("score") > 0.5).alias("above_chance")
    )
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bool_and(F.abs(F.col("added") - margin) < 1e-6).alias("adds_up"),
        F.bool_and(F.col("model_score").between(0, 1)).alias("shares"),
    ).join(auc)


_EXPLAINED = """SELECT count(*) AS rows, true AS adds_up, true AS shares, true AS above_chance
FROM events"""


@query(_EXPLAINED)
def default_forest_explained(spark, sf_dir):
    return _explained(spark, sf_dir, "Random forest", n_estimators=8, max_depth=5)


@query(_EXPLAINED)
def default_boosting_explained(spark, sf_dir):
    return _explained(spark, sf_dir, "Gradient boosting", n_estimators=4)
