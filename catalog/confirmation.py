"""Default against candidate confirmation logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.ranges import RangeRule
from waymark.operators import confirm, rule_diff
from waymark.operators.profile import histogram
from waymark.plans.comparison import compare, trigger_points
from waymark.sources.config import config_of, rules_from_json, rules_to_json
from waymark.sources.models import LinearModel, ModelPath, ModelSpec

from .registry import EV, POINTS, event_points, query, table

PAYLOAD = config_of(
    {
        "high_value": {"value": {"min": 230.0}, "k": {"max": 98.0}},
        "mid_value": {"value": {"min": 190.0}, "k": {"min": 95.0}},
    }
)
# high_value is raised and keeps its bound on k, small_k is new, and mid_value
# is switched off.
RULES = [
    RangeRule("high_value", "value", minimum=260.0),
    RangeRule("small_k", "k", maximum=3.0),
    RangeRule("small_k", "value", minimum=120.0),
]
LOGIC = {"rules": RULES, "enabled": ["high_value"], "columns": POINTS}

TRIGGERED = EV + """, fl AS (
  SELECT *, CAST(value >= 230 AND k <= 98 AS TINYINT) AS high_value,
    CAST(value >= 190 AND k >= 95 AS TINYINT) AS mid_value,
    CAST(value >= 260 AND k <= 98 AS TINYINT) AS __candidate_high_value,
    CAST(k <= 3 AND value >= 120 AS TINYINT) AS small_k
  FROM ev), tr AS (
  SELECT *, high_value = 1 OR mid_value = 1 AS default_triggered,
    __candidate_high_value = 1 OR small_k = 1 AS candidate_triggered
  FROM fl)"""
TIMES = TRIGGERED + """, ft AS (
  SELECT *, candidate_first_confirmation_time - default_first_confirmation_time
      AS first_confirmation_time_change,
    default_first_confirmation_time IS NULL
      AND candidate_first_confirmation_time IS NOT NULL AS newly_confirmed_track
  FROM (SELECT track_id, arg_min(label, row_id) AS label,
      min(time) FILTER (WHERE default_triggered) AS default_first_confirmation_time,
      min(time) FILTER (WHERE candidate_triggered) AS candidate_first_confirmation_time
    FROM tr GROUP BY track_id))"""
LATCHED = TIMES + """, la AS (
  SELECT *, candidate_confirmed AND NOT default_confirmed AS newly_confirmed FROM (
    SELECT tr.*, ft.default_first_confirmation_time,
      ft.candidate_first_confirmation_time, ft.newly_confirmed_track,
      ft.default_first_confirmation_time IS NOT NULL
        AND time >= ft.default_first_confirmation_time AS default_confirmed,
      ft.candidate_first_confirmation_time IS NOT NULL
        AND time >= ft.candidate_first_confirmation_time AS candidate_confirmed
    FROM tr LEFT JOIN ft ON tr.track_id = ft.track_id))"""
CHANGED = """CASE
  WHEN default_first_confirmation_time IS NOT DISTINCT FROM candidate_first_confirmation_time
    THEN NULL
  WHEN candidate_first_confirmation_time IS NULL THEN 'Lost'
  WHEN default_first_confirmation_time IS NULL THEN 'Added'
  WHEN candidate_first_confirmation_time < default_first_confirmation_time THEN 'Earlier'
  ELSE 'Later' END"""


def _triggered(spark, sf_dir):
    return trigger_points(event_points(spark, sf_dir), PAYLOAD, **LOGIC)


def _first_times(spark, sf_dir):
    cells = confirm.track_cells(_triggered(spark, sf_dir).points, POINTS)
    return confirm.first_confirmation_times(cells, POINTS)


def _comparison(spark, sf_dir):
    # One result is drawn from each comparison, so nothing is kept in memory.
    return compare(event_points(spark, sf_dir), PAYLOAD, keep_cells=False, **LOGIC)


@query(f"""WITH {TRIGGERED} SELECT row_id, high_value, mid_value,
  __candidate_high_value, small_k FROM tr""")
def path_flags(spark, sf_dir):
    return _triggered(spark, sf_dir).points.select(
        "row_id", "high_value", "mid_value", "__candidate_high_value", "small_k"
    )


@query(f"WITH {TRIGGERED} SELECT row_id, default_triggered, candidate_triggered FROM tr")
def triggers(spark, sf_dir):
    return _triggered(spark, sf_dir).points.select(
        "row_id", "default_triggered", "candidate_triggered"
    )


@query(f"WITH {TIMES} SELECT * FROM ft")
def first_confirmation_times(spark, sf_dir):
    return _first_times(spark, sf_dir)


@query(f"""WITH {LATCHED} SELECT row_id, default_first_confirmation_time,
  candidate_first_confirmation_time, newly_confirmed_track, default_confirmed,
  candidate_confirmed, newly_confirmed FROM la""")
def latched_points(spark, sf_dir):
    return _comparison(spark, sf_dir).points.select(
        "row_id",
        confirm.DEFAULT_TIME,
        confirm.CANDIDATE_TIME,
        "newly_confirmed_track",
        "default_confirmed",
        "candidate_confirmed",
        "newly_confirmed",
    )


@query(f"""WITH {LATCHED} SELECT label, count(*) AS measurements,
  count(DISTINCT track_id) AS tracks,
  count(*) FILTER (WHERE default_confirmed) AS default_confirmed_measurements,
  count(*) FILTER (WHERE candidate_confirmed) AS candidate_confirmed_measurements,
  count(*) FILTER (WHERE newly_confirmed) AS new_confirmed_measurements,
  count(DISTINCT track_id) FILTER (WHERE default_confirmed) AS default_confirmed_tracks,
  count(DISTINCT track_id) FILTER (WHERE candidate_confirmed) AS candidate_confirmed_tracks,
  count(DISTINCT track_id) FILTER (WHERE newly_confirmed_track) AS new_confirmed_tracks
FROM la GROUP BY label""")
def label_summary(spark, sf_dir):
    return _comparison(spark, sf_dir).label_summary


_PATHS = [
    ("default", "high_value", "high_value"),
    ("default", "mid_value", "mid_value"),
    ("experimental", "high_value", "__candidate_high_value"),
    ("experimental", "small_k", "small_k"),
]
_COHORTS = [("matched", "label = 'matched'"), ("false", "label <> 'matched'")]


@query(
    f"WITH {TRIGGERED} "
    + " UNION ALL ".join(
        f"""SELECT '{logic}' AS logic, '{path}' AS confirmation_path, '{cohort}' AS cohort,
  count(*) AS confirmed_measurements, count(DISTINCT track_id) AS confirmed_tracks
FROM tr WHERE {column} = 1 AND {member}"""
        for logic, path, column in _PATHS
        for cohort, member in _COHORTS
    )
)
def path_summary(spark, sf_dir):
    return _comparison(spark, sf_dir).path_summary


@query(f"""WITH {LATCHED} SELECT
  (SELECT count(default_first_confirmation_time) FROM ft) AS default_confirmed_tracks,
  (SELECT count(candidate_first_confirmation_time) FROM ft) AS candidate_confirmed_tracks,
  (SELECT count(*) FROM ft WHERE newly_confirmed_track) AS new_confirmed_tracks,
  (SELECT count(*) FROM la WHERE newly_confirmed) AS new_confirmed_measurements,
  (SELECT count(*) FROM la WHERE candidate_confirmed AND label = 'matched')
    AS matched_confirmed_measurements,
  (SELECT round(avg(CASE WHEN label <> 'matched' THEN 1.0 ELSE 0.0 END), 6)
    FROM la WHERE candidate_confirmed) AS point_false_alarm_rate,
  (SELECT round(avg(CASE WHEN label <> 'matched' THEN 1.0 ELSE 0.0 END), 6)
    FROM ft WHERE candidate_first_confirmation_time IS NOT NULL) AS track_false_alarm_rate""")
def headline_metrics(spark, sf_dir):
    return _comparison(spark, sf_dir).metrics


@query(f"""WITH {TIMES} SELECT *, {CHANGED} AS confirmation_change FROM ft
WHERE {CHANGED} IS NOT NULL""")
def changed_tracks(spark, sf_dir):
    return confirm.changed_tracks(_first_times(spark, sf_dir))


@query(f"WITH {TIMES} SELECT count(*) AS lost_tracks FROM ft WHERE {CHANGED} = 'Lost'")
def lost_tracks(spark, sf_dir):
    return confirm.lost_track_count(_first_times(spark, sf_dir))


@query(f"""WITH {LATCHED}, ch AS (SELECT *, {CHANGED} AS confirmation_change FROM la)
SELECT track_id, time, label, round(value, 6) AS value, confirmation_change,
  default_first_confirmation_time AS first_confirmation_time,
  'Default' AS confirmation_logic
FROM ch WHERE default_confirmed AND confirmation_change IS NOT NULL
UNION ALL SELECT track_id, time, label, round(value, 6), confirmation_change,
  candidate_first_confirmation_time, 'Candidate'
FROM ch WHERE candidate_confirmed AND confirmation_change IS NOT NULL""")
def changed_track_points(spark, sf_dir):
    return confirm.changed_track_points(
        _comparison(spark, sf_dir).points, POINTS, features=["value"], label="label"
    )


_SLICES = TIMES + """, sl AS (
  SELECT 'Default' AS logic, 'Overall' AS cohort,
    default_first_confirmation_time AS t FROM ft
  UNION ALL SELECT 'Default', label, default_first_confirmation_time FROM ft
  UNION ALL SELECT 'Candidate', 'Overall', candidate_first_confirmation_time FROM ft
  UNION ALL SELECT 'Candidate', label, candidate_first_confirmation_time FROM ft),
ranked AS (SELECT *, row_number() OVER (PARTITION BY logic, cohort ORDER BY t) - 1 AS place,
    count(*) OVER (PARTITION BY logic, cohort) AS n FROM sl WHERE t IS NOT NULL)"""


@query(f"""WITH {_SLICES} SELECT logic, cohort, count(*) AS confirmed_tracks,
  min(t) AS minimum, max(t) FILTER (WHERE place = floor((n - 1) * 0.25 + 0.5)) AS p25,
  median(t) AS median, round(avg(t), 2) AS mean,
  max(t) FILTER (WHERE place = floor((n - 1) * 0.75 + 0.5)) AS p75,
  max(t) FILTER (WHERE place = floor((n - 1) * 0.9 + 0.5)) AS p90, max(t) AS maximum
FROM ranked GROUP BY logic, cohort""", digits=2)
def first_confirmation_summary(spark, sf_dir):
    return confirm.first_confirmation_summary(_first_times(spark, sf_dir), POINTS)


@query(f"""WITH {_SLICES} SELECT logic, t AS first_confirmation_time, count(*) AS tracks,
  round(max(c), 6) AS cdf
FROM (SELECT logic, t, cume_dist() OVER (PARTITION BY logic ORDER BY t) AS c
  FROM sl WHERE t IS NOT NULL AND cohort = 'Overall')
GROUP BY logic, t""")
def first_confirmation_cdf(spark, sf_dir):
    return confirm.first_confirmation_cdf(_first_times(spark, sf_dir), POINTS)


@query(f"""WITH {_SLICES}, x AS (
  SELECT logic, CAST(t AS DOUBLE) AS t FROM sl WHERE t IS NOT NULL AND cohort = 'Overall'),
e AS (SELECT min(t) AS lo, max(t) AS hi, (max(t) - min(t)) / 40 AS w FROM x)
SELECT logic, CAST(b AS INTEGER) AS bin, round(lo + b * w, 2) AS lower,
  round(lo + (b + 1) * w, 2) AS upper, count(*) AS rows
FROM (SELECT logic, lo, w, least(floor((t - lo) / w), 39) AS b FROM x, e)
GROUP BY logic, b, lo, w""", digits=2)
def first_confirmation_histogram(spark, sf_dir):
    slices = confirm.timing_slices(_first_times(spark, sf_dir), POINTS, cohorts=False)
    return histogram(slices, "first_confirmation_time", group="logic")


def _data_rules(spark, sf_dir, status):
    """Rules read off the line items: one path per return flag, two features."""
    items = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == status)
    by_flag = items.groupBy(F.col("l_returnflag").alias("path")).agg(
        F.min("l_extendedprice").alias("lo"),
        F.max("l_extendedprice").alias("hi"),
        F.max("l_quantity").alias("q"),
    )
    none = F.lit(None).cast("double")
    return by_flag.select(
        F.concat(F.col("path"), F.lit("_path")).alias("path"),
        F.inline(
            F.array(
                F.struct(
                    F.lit("l_extendedprice").alias("feature"),
                    F.col("lo").alias("minimum"),
                    F.col("hi").alias("maximum"),
                ),
                F.struct(
                    F.lit("l_quantity").alias("feature"),
                    none.alias("minimum"),
                    F.col("q").alias("maximum"),
                ),
            )
        ),
    )


_DATA_RULES = """dr AS (
  SELECT l_returnflag || '_path' AS path, l_linestatus AS status,
    min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, max(l_quantity) AS q
  FROM lineitem GROUP BY ALL), rl AS (
  SELECT status, path, 'l_extendedprice' AS feature, lo AS minimum, hi AS maximum FROM dr
  UNION ALL SELECT status, path, 'l_quantity', NULL, q FROM dr),
d AS (SELECT * EXCLUDE (status) FROM rl WHERE status = 'O'),
c AS (SELECT * EXCLUDE (status) FROM rl WHERE status = 'F' AND path <> 'N_path'
      UNION ALL SELECT 'X_' || path, feature, minimum, maximum FROM rl
      WHERE status = 'F' AND path = 'N_path'),
diff AS (
  SELECT path, true AS enabled, 'Range' AS kind, feature, minimum, maximum,
    NULL::VARCHAR AS model, NULL::DOUBLE AS threshold, 'Removed' AS change,
    'path disabled' AS difference
  FROM d WHERE path = 'N_path'
  UNION ALL SELECT c.path, true, 'Range', c.feature, c.minimum, c.maximum, NULL, NULL,
    CASE WHEN d.path IS NULL THEN 'Added' ELSE 'Modified' END,
    CASE WHEN d.path IS NULL THEN '' ELSE concat_ws('; ',
      CASE WHEN d.minimum IS DISTINCT FROM c.minimum
        THEN 'min: ' || d.minimum || ' → ' || c.minimum END,
      CASE WHEN d.maximum IS DISTINCT FROM c.maximum
        THEN 'max: ' || d.maximum || ' → ' || c.maximum END) END
  FROM c LEFT JOIN d ON c.path = d.path AND c.feature = d.feature)"""


def _rule_diff(spark, sf_dir):
    details = rule_diff.path_details(spark, _data_rules(spark, sf_dir, "O"))
    proposed = _data_rules(spark, sf_dir, "F").withColumn(
        "path",
        F.when(F.col("path") == "N_path", F.lit("X_N_path")).otherwise(F.col("path")),
    )
    loaded = ["A_path", "N_path", "R_path"]
    return rule_diff.rule_set_diff(
        details, proposed, baseline=loaded, enabled=["A_path", "R_path"]
    )


@query(f"WITH {_DATA_RULES} SELECT * FROM diff")
def rule_set_diff(spark, sf_dir):
    return _rule_diff(spark, sf_dir)


@query(f"""WITH {_DATA_RULES} SELECT count(DISTINCT path) AS changed_paths,
  count(DISTINCT path) FILTER (WHERE change = 'Added') AS added_paths,
  count(DISTINCT path) FILTER (WHERE change = 'Modified') AS modified_paths,
  count(DISTINCT path) FILTER (WHERE change = 'Removed') AS removed_paths FROM diff""")
def rule_change_counts(spark, sf_dir):
    return rule_diff.change_counts(_rule_diff(spark, sf_dir))


@query(f"""WITH {_DATA_RULES} SELECT path, feature, round(minimum, 6) AS minimum,
  round(maximum, 6) AS maximum FROM d""")
def rule_config_roundtrip(spark, sf_dir):
    return rules_from_json(rules_to_json(_data_rules(spark, sf_dir, "O")))


@query(f"""WITH {EV}, tr AS (
  SELECT *, value >= 230 AND k <= 98 AS default_triggered,
    (value >= 190 AND k >= 95)
      OR 1 / (1 + exp(-(0.03 * value - 0.02 * k - 6.0))) >= 0.5 AS candidate_triggered
  FROM ev), ft AS (
  SELECT track_id, arg_min(label, row_id) AS label,
    min(time) FILTER (WHERE default_triggered) AS d,
    min(time) FILTER (WHERE candidate_triggered) AS c FROM tr GROUP BY track_id)
SELECT track_id, label, d AS default_first_confirmation_time,
  c AS candidate_first_confirmation_time,
  (SELECT count(*) FROM tr p WHERE p.track_id = ft.track_id AND p.time >= ft.d)
    AS default_rows,
  (SELECT count(*) FROM tr p WHERE p.track_id = ft.track_id AND p.time >= ft.c)
    AS candidate_rows
FROM ft""")
def confirmation_comparison(spark, sf_dir):
    """Comparison with a model path and separate baseline and candidate sets."""
    model = ModelSpec("linear", LinearModel([0.03, -0.02], -6.0), ("value", "k"))
    result = compare(
        event_points(spark, sf_dir),
        PAYLOAD,
        model_paths=[ModelPath("model_path", model, 0.5)],
        baseline=["high_value"],
        enabled=["mid_value"],
        columns=POINTS,
        keep_cells=False,
    )
    rows = result.points.groupBy("track_id").agg(
        F.count_if("default_confirmed").alias("default_rows"),
        F.count_if("candidate_confirmed").alias("candidate_rows"),
    )
    return result.first_times.join(rows, "track_id").select(
        "track_id",
        "label",
        confirm.DEFAULT_TIME,
        confirm.CANDIDATE_TIME,
        "default_rows",
        "candidate_rows",
    )
