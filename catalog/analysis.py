"""Feature statistics against a binary label, over whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from waymark.functions.bijection import PRIME, ROUNDS, SPARE, round_keys
from waymark.operators import ranking
from waymark.operators.incremental import incremental_auc
from waymark.operators.permutation import permutation_importance as permutation_of
from waymark.operators.rollup import active_frame
from waymark.plans.analysis import analyze_features
from waymark.plans.analysis import correlation_matrix as matrix_of

from .registry import (
    EV,
    GAPS,
    LINE_FEATURES,
    POINTS,
    document_labels,
    embedding_features,
    event_points,
    gap_points,
    line_items,
    query,
)
from .newton import newton_ctes
from .profiling import PICKED
from .scoring import LINEAR

DIRECTION = """CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative'
  ELSE 'none' END"""

_LONG_LINES = "lf AS (" + " UNION ALL ".join(
    f"""SELECT '{name}' AS feature, {name} AS value,
  CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem"""
    for name in LINE_FEATURES
) + ")"

_LONG_VECTORS = """lf AS (SELECT 'e' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature,
  CAST(embedding[i] AS DOUBLE) AS value, CAST(label = 3 AS INTEGER) AS y
  FROM embeddings, range(1, 65) t(i))"""

_LONG_LABELS = """lf AS (SELECT 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS value,
  CAST(quality = 1 AS INTEGER) AS y
  FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"""

_CORRELATION = """SELECT feature, coalesce(round(nullif(corr(value, y), 'nan'), 6), 0) AS score
  FROM lf GROUP BY feature"""
_AUC = """SELECT feature, (sum(r) FILTER (WHERE y = 1) - p * (p + 1) / 2) / (p * (n - p)) AS score
  FROM (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY value)
      + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r,
      sum(y) OVER (PARTITION BY feature) AS p, count(*) OVER (PARTITION BY feature) AS n
    FROM lf) GROUP BY feature, p, n"""
_INFORMATION = """vc AS (SELECT feature, value, y, count(*) AS c FROM lf GROUP BY ALL),
st AS (SELECT feature, count(*) AS n,
    greatest(2, least(10, floor(sqrt(count(*))))) AS bins FROM lf GROUP BY feature),
od AS (SELECT feature, value,
    row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS place FROM lf),
ct AS (SELECT DISTINCT od.feature, od.value AS cut FROM st, range(1, 10) t(i), od
  WHERE i < bins AND od.feature = st.feature AND place = least(n - 1, floor(i * n / bins))),
bn AS (SELECT vc.feature, vc.value, y, c, count(cut) AS b
  FROM vc LEFT JOIN ct ON vc.feature = ct.feature AND cut <= vc.value GROUP BY ALL),
jt AS (SELECT feature, b, y, sum(c) AS c FROM bn GROUP BY ALL),
mi AS (SELECT feature, sum(c / n * ln((c / n) / ((cb / n) * (cy / n)))) AS score FROM (
    SELECT feature, c, sum(c) OVER (PARTITION BY feature, b) AS cb,
      sum(c) OVER (PARTITION BY feature, y) AS cy,
      sum(c) OVER (PARTITION BY feature) AS n FROM jt) GROUP BY feature)"""


def _result(
    method: str, source: str, importance: str, direction: str, digits: int = 6
) -> str:
    return f"""SELECT feature, '{method}' AS method, round(score, {digits}) AS score,
  round({importance}, {digits}) AS importance, {direction} AS direction FROM ({source})"""


def _correlation_result() -> str:
    return _result(ranking.CORRELATION, _CORRELATION, "abs(score)", DIRECTION)


def _auc_result() -> str:
    return _result(
        ranking.UNIVARIATE_AUC,
        _AUC,
        "greatest(score, 1 - score)",
        "CASE WHEN score >= 0.5 THEN 'positive' ELSE 'negative' END",
    )


def _information_result() -> str:
    return _result(
        ranking.INFORMATION, "SELECT * FROM mi", "score", "'non-directional'"
    )


def _line_frame(spark, sf_dir):
    return ranking.labelled_features(
        line_items(spark, sf_dir), LINE_FEATURES, "l_returnflag", "R", POINTS
    )


@query(
    f"""WITH {EV}, tr AS (
  SELECT track_id, avg(value) AS value_mean, max(k) AS k_max,
    arg_min(label, row_id) AS label FROM ev GROUP BY track_id),
lf AS (
  SELECT 'value_mean' AS feature, round(value_mean, 9) AS value,
    CAST(label = 'matched' AS INTEGER) AS y FROM tr
  UNION ALL SELECT 'k_max', k_max, CAST(label = 'matched' AS INTEGER) FROM tr)
{_correlation_result()} UNION ALL {_auc_result()}"""
)
def track_feature_ranking(spark, sf_dir):
    """Statistics over the rolled-up tracks, which are the rows here."""
    tracks = active_frame(
        event_points(spark, sf_dir),
        [],
        POINTS,
        level="Track",
        methods_by_column={"value": ["mean"], "k": ["max"]},
    ).withColumn("value_mean", F.round("value_mean", 9))
    return analyze_features(
        tracks,
        ["value_mean", "k_max"],
        [ranking.CORRELATION, ranking.UNIVARIATE_AUC],
        label="label",
        positive="matched",
        columns=replace(POINTS, row="track_id"),
        sample_size=None,
    )


@query(f"""WITH {GAPS}, md AS (SELECT median(value) AS m FROM gp)
SELECT row_id, CASE WHEN value IS NULL OR isnan(value) THEN round(m, 6)
  ELSE round(value, 6) END AS value, k FROM gp, md""")
def imputed_features(spark, sf_dir):
    return ranking.imputed(gap_points(spark, sf_dir), ["value", "k"], keep=["row_id"])


@query(f"WITH {_LONG_LINES} {_correlation_result()}")
def point_biserial(spark, sf_dir):
    return ranking.point_biserial(_line_frame(spark, sf_dir), LINE_FEATURES)


def _matrix_sql(pairs: list[tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS row, '{b}' AS "column",
  coalesce(round(nullif(corr("{a}", "{b}"), 'nan'), 6), 0) AS correlation FROM {source}"""
        for a, b in pairs
    )


_LINE_MATRIX = [*LINE_FEATURES, "l_returnflag = R"]
_GAP_MATRIX = ["value", "k", "label = matched"]


@query(
    """WITH x AS (SELECT *, CAST(l_returnflag = 'R' AS DOUBLE) AS "l_returnflag = R"
FROM lineitem) """
    + _matrix_sql([(a, b) for a in _LINE_MATRIX for b in _LINE_MATRIX], "x")
)
def correlation_matrix(spark, sf_dir):
    return matrix_of(
        line_items(spark, sf_dir),
        LINE_FEATURES,
        label="l_returnflag",
        positive="R",
        sample_size=None,
    )


@query(
    f"""WITH {GAPS}, x AS (SELECT CASE WHEN NOT isnan(value) THEN value END AS value, k,
CAST(label = 'matched' AS DOUBLE) AS "label = matched" FROM gp) """
    + _matrix_sql([(a, b) for a in _GAP_MATRIX for b in _GAP_MATRIX], "x")
)
def correlation_matrix_with_gaps(spark, sf_dir):
    return matrix_of(
        gap_points(spark, sf_dir),
        ["value", "k"],
        label="label",
        positive="matched",
        sample_size=None,
    )


@query(f"""WITH {_LONG_VECTORS}, id AS (
  SELECT vec_id, 'e' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS name,
    CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)
  UNION ALL SELECT vec_id, 'label = 3', CAST(label = 3 AS DOUBLE) FROM embeddings)
SELECT a.name AS row, b.name AS "column",
  coalesce(round(nullif(corr(a.v, b.v), 'nan'), 6), 0) AS correlation
FROM id a JOIN id b ON a.vec_id = b.vec_id GROUP BY a.name, b.name""")
def correlation_matrix_wide(spark, sf_dir):
    points, names = embedding_features(spark, sf_dir)
    return matrix_of(points, names, label="label", positive=3, sample_size=None)


@query(f"WITH {_LONG_LINES}, {_INFORMATION} {_information_result()}")
def mutual_information(spark, sf_dir):
    frame = _line_frame(spark, sf_dir)
    return ranking.mutual_information(ranking.class_profile(frame, LINE_FEATURES))


@query(f"WITH {_LONG_LINES} {_auc_result()}")
def univariate_auc(spark, sf_dir):
    frame = _line_frame(spark, sf_dir)
    return ranking.univariate_auc(ranking.class_profile(frame, LINE_FEATURES))


@query(f"WITH {_LONG_VECTORS} {_auc_result()}")
def univariate_auc_wide(spark, sf_dir):
    points, names = embedding_features(spark, sf_dir)
    frame = ranking.labelled_features(points, names, "label", 3, POINTS)
    return ranking.univariate_auc(ranking.class_profile(frame, names))


@query(
    f"WITH {_LONG_LABELS}, {_INFORMATION} {_information_result()} UNION ALL {_auc_result()}"
)
def document_quality_ranking(spark, sf_dir):
    return analyze_features(
        document_labels(spark, sf_dir),
        ["n_chars"],
        [ranking.INFORMATION, ranking.UNIVARIATE_AUC],
        label="quality",
        positive=1,
        columns=POINTS,
        sample_size=None,
    )


@query(
    f"""WITH {_LONG_LINES}, {_INFORMATION} {_correlation_result()}
UNION ALL {_information_result()} UNION ALL {_auc_result()}"""
)
def feature_ranking(spark, sf_dir):
    return analyze_features(
        line_items(spark, sf_dir),
        LINE_FEATURES,
        [ranking.CORRELATION, ranking.INFORMATION, ranking.UNIVARIATE_AUC],
        label="l_returnflag",
        positive="R",
        columns=POINTS,
        sample_size=None,
    )


@query(
    f"""WITH {PICKED}, sm AS (SELECT * FROM ev WHERE track_id IN (SELECT track_id FROM pk)),
lf AS (
  SELECT 'value' AS feature, value, CAST(label = 'matched' AS INTEGER) AS y FROM sm
  UNION ALL SELECT 'k', k, CAST(label = 'matched' AS INTEGER) FROM sm)
{_correlation_result()} UNION ALL {_auc_result()}"""
)
def sampled_feature_ranking(spark, sf_dir):
    """About 500 rows of complete, randomly picked tracks."""
    return analyze_features(
        event_points(spark, sf_dir),
        ["value", "k"],
        [ranking.CORRELATION, ranking.UNIVARIATE_AUC],
        label="label",
        positive="matched",
        columns=POINTS,
        sample_size=500,
        group="track_id",
    )


_MOVED = ["value", "k"]
_TURNS = """SELECT f, num, turn, n, a, b, x // b AS u, x % b AS v, a AS mu, b AS mv
  FROM wk, gr WHERE turn = 0 OR x >= n"""
for _k in range(ROUNDS):
    _key = " ".join(
        f"WHEN '{name}' THEN {round_keys(7, place)[_k]}" for place, name in enumerate(_MOVED)
    )
    _c = f"((v + CASE f {_key} END) % {PRIME})"
    _TURNS = (
        f"SELECT f, num, turn, n, a, b, v AS u, (u + {_c} * {_c} % {PRIME} * {_c} % {PRIME}) % mu AS v, "
        f"mv AS mu, mu AS mv FROM ({_TURNS})"
    )


# Near-equal scores are ties or not by the last bit of a sum, so the twin adds in
# the same order and two digits less are compared. ``wk`` turns the network until a
# number is back in the range.
@query(f"""WITH RECURSIVE {EV}, o AS MATERIALIZED (
  SELECT *, CAST(label = 'matched' AS INTEGER) AS y,
    row_number() OVER (ORDER BY row_id) - 1 AS num FROM ev),
sz AS (SELECT count(*) AS n FROM ev),
gr AS (SELECT n, max(t.a) AS a, (n + max(t.a) - 1) // max(t.a) AS b FROM sz, range(1, 10001) t(a)
  WHERE t.a * t.a <= n AND (t.a - n % t.a) % t.a <= {SPARE} GROUP BY n),
wk AS (
  SELECT f, num, num AS x, 0 AS turn FROM o, (VALUES ('value'), ('k')) t(f)
  UNION ALL SELECT f, num, u * b + v, turn + 1 FROM ({_TURNS})),
sent AS (SELECT f, num AS origin, x AS num FROM wk, gr WHERE turn > 0 AND x < n),
lf AS (
  SELECT '' AS feature, y, 1 / (1 + exp(-(-0.5 + 0.02 * value + -0.05 * k))) AS value FROM o
  UNION ALL SELECT 'value', o.y, 1 / (1 + exp(-(-0.5 + 0.02 * s.value + -0.05 * o.k)))
    FROM o JOIN sent ON sent.f = 'value' AND sent.num = o.num JOIN o s ON s.num = origin
  UNION ALL SELECT 'k', o.y, 1 / (1 + exp(-(-0.5 + 0.02 * o.value + -0.05 * s.k)))
    FROM o JOIN sent ON sent.f = 'k' AND sent.num = o.num JOIN o s ON s.num = origin),
auc AS ({_AUC}),
loss AS (SELECT a.feature, b.score - a.score AS score FROM auc a, auc b
  WHERE b.feature = '' AND a.feature <> '')
{_result(ranking.PERMUTATION, "SELECT * FROM loss", "abs(score)", DIRECTION, 4)}""",
       digits=4)
def permutation_importance(spark, sf_dir):
    frame = ranking.labelled_features(
        event_points(spark, sf_dir), ["value", "k"], "label", "matched", POINTS
    )
    return permutation_of(frame, LINEAR, ["value", "k"], POINTS)


_STEPS = 9
_FOLDED = f"""{EV}, fo AS (SELECT row_id, CAST(label = 'matched' AS INTEGER) AS y,
    value::DOUBLE AS x1, k::DOUBLE AS x2, time::DOUBLE AS x3,
    (row_number() OVER (PARTITION BY label ORDER BY md5(concat('7:', row_id)), row_id) - 1) % 5
      AS fold FROM ev),
sc AS (SELECT held, {", ".join(
    f"avg(x{i}) AS c{i}, stddev_pop(x{i}) AS d{i}" for i in (1, 2, 3))}
  FROM fo, range(5) t(held) WHERE fold <> held GROUP BY held),
ro AS MATERIALIZED (SELECT y, fold, held AS of_held, {", ".join(
    f"(x{i} - c{i}) / d{i} AS z{i}" for i in (1, 2, 3))} FROM fo, sc),
mo AS (SELECT held, name, CAST(name <> 'value' AS INTEGER) AS m1,
    CAST(name <> 'k' AS INTEGER) AS m2, CAST(name <> 'time' AS INTEGER) AS m3
  FROM range(5) t(held), (VALUES (''), ('value'), ('k'), ('time')) f(name))"""


# The twin fits every model from zero by Newton steps spelled out in SQL.
@query(f"""WITH {_FOLDED},
{newton_ctes("ro", "mo", ["name", "held"], 4, match="of_held = held AND fold <> held",
             steps=_STEPS, ridge="1e-4")},
lf AS (SELECT name AS feature, y,
    1 / (1 + exp(-(b0 + b1 * m1 * z1 + b2 * m2 * z2 + b3 * m3 * z3))) AS value
  FROM mo JOIN w{_STEPS} USING (name, held) JOIN ro ON of_held = held AND fold = held),
auc AS ({_AUC}),
gain AS (SELECT a.feature, b.score - a.score AS score FROM auc a, auc b
  WHERE b.feature = '' AND a.feature <> '')
{_result(ranking.INCREMENTAL_AUC, "SELECT * FROM gain", "greatest(score, 0)", DIRECTION, 5)}""",
       digits=5)
def incremental_cv_auc(spark, sf_dir):
    frame = ranking.labelled_features(
        event_points(spark, sf_dir), ["value", "k", "time"], "label", "matched", POINTS
    )
    return incremental_auc(frame, ["value", "k", "time"], POINTS)
