import math
import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from frames import features_small, frame, incremental
from pyspark.sql import functions as F

from waymark.functions.trees import Tree, TreeEnsemble
from waymark.operators import explain, ranking
from waymark.operators import incremental as incremental_sums
from waymark.operators.default_model import build_default_model
from waymark.operators.incremental import (
    FoldModel,
    fit_models,
    packed,
    training_scales,
    unpacked,
)
from waymark.operators.permutation import shuffled_copies
from waymark.operators.sampling import stratified_folds
from waymark.plans.analysis import analyze_features, correlation_matrix
from waymark.sources.models import LinearModel, ModelSpec

BOTH = ["signal", "noise"]
LABELS = {"label": "label", "positive": "matched"}


def scores(result, method=None, field="score"):
    return {r.feature: r[field] for r in result.collect() if method in (None, r.method)}


def noisy(spark, size=400, seed=2, gaps=False):
    rng = random.Random(seed)
    data = []
    for i in range(size):
        y = rng.random() < 0.4
        a = rng.choice([0.0, 1.0, 2.0]) if i % 3 else 1.0
        b = rng.gauss(1.0 if y else 0.0, 1.0)
        if gaps and i % 9 == 0:
            b = None if i % 2 else float("nan")
        data.append((i % 11, a, b, 3.0, "matched" if y else "unmatched"))
    schema = "track_id long, a double, b double, flat double, label string"
    return frame(spark, schema, data), data


def brute_auc(pairs):
    hits = [x for x, y in pairs if y]
    misses = [x for x, y in pairs if not y]
    won = sum((h > m) + 0.5 * (h == m) for h in hits for m in misses)
    return won / (len(hits) * len(misses))


def test_selected_features_only(spark):
    found = analyze_features(features_small(spark), ["signal"], [ranking.CORRELATION], **LABELS)
    rows = found.collect()
    assert [r.feature for r in rows] == ["signal"]
    assert rows[0].score > 0.9 and rows[0].direction == "positive"


def test_information_and_auc_rank_the_signal_first(spark):
    found = analyze_features(
        features_small(spark), BOTH, [ranking.INFORMATION, ranking.UNIVARIATE_AUC], **LABELS
    )
    for method in (ranking.INFORMATION, ranking.UNIVARIATE_AUC):
        importance = scores(found, method, "importance")
        assert importance["signal"] > importance["noise"]
    assert [r.method for r in found.collect()] == [ranking.INFORMATION] * 2 + [ranking.UNIVARIATE_AUC] * 2


def test_auc_and_information_match_brute_force(spark):
    points, data = noisy(spark)
    frame_ = ranking.labelled_features(points, ["a", "b", "flat"], "label", "matched")
    negated = frame_.withColumn("a", -F.col("a"))
    profile = ranking.class_profile(frame_, ["a", "b", "flat"])
    auc = scores(ranking.univariate_auc(profile))
    for name, place in (("a", 1), ("b", 2)):
        expected = brute_auc([(r[place], r[4] == "matched") for r in data])
        assert auc[name] == pytest.approx(expected)
    assert auc["flat"] == 0.5
    mirrored = ranking.class_profile(negated, ["a"])
    mirrored = scores(ranking.univariate_auc(mirrored))
    assert auc["a"] + mirrored["a"] == pytest.approx(1.0)

    found = scores(ranking.mutual_information(profile))
    n = len(data)
    k = max(2, min(10, math.isqrt(n)))
    for name, place in (("a", 1), ("b", 2), ("flat", 3)):
        ordered = sorted(r[place] for r in data)
        cuts = {ordered[min(n - 1, i * n // k)] for i in range(1, k)}
        joint = {}
        for r in data:
            cell = (sum(c <= r[place] for c in cuts), r[4])
            joint[cell] = joint.get(cell, 0) + 1
        px, py = {}, {}
        for (b, y), c in joint.items():
            px[b] = px.get(b, 0) + c
            py[y] = py.get(y, 0) + c
        expected = sum(c / n * math.log(c * n / (px[b] * py[y])) for (b, y), c in joint.items())
        assert found[name] == pytest.approx(expected, abs=1e-12)
        assert found[name] >= -1e-12


def test_constant_feature_has_no_correlation(spark):
    points, _ = noisy(spark)
    frame_ = ranking.labelled_features(points, ["a", "flat"], "label", "matched")
    found = ranking.point_biserial(frame_, ["a", "flat"]).collect()
    flat = next(r for r in found if r.feature == "flat")
    assert (flat.score, flat.importance, flat.direction) == (0.0, 0.0, "none")


def test_gaps_are_filled_with_the_median(spark):
    points, data = noisy(spark, gaps=True)
    points = points.withColumn("void", F.lit(None).cast("double"))
    # NaN counts as the largest value, NULL not at all
    ordered = sorted((r[2] for r in data if r[2] is not None), key=lambda v: (math.isnan(v), v))
    n = len(ordered)
    expected = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    medians = ranking.feature_medians(points, ["b", "void"])
    assert medians == {"b": pytest.approx(expected), "void": 0.0}
    filled = ranking.imputed(points, ["b", "void"])
    assert filled.filter("b IS NULL OR isnan(b) OR void != 0").count() == 0
    with pytest.raises(ValueError, match="must be numeric"):
        ranking.imputed(points, ["label"])


def test_correlation_matrix(spark):
    points, data = noisy(spark, gaps=True)
    narrow = correlation_matrix(points, ["a", "b", "flat"], **LABELS, sample_size=None)
    cells = {(r.row, r.column): r.correlation for r in narrow.collect()}
    assert len(cells) == 16
    label = "label = matched"
    y = [float(r[4] == "matched") for r in data]
    assert cells["a", label] == pytest.approx(np.corrcoef([r[1] for r in data], y)[0, 1])
    known = [r[2] is not None and not math.isnan(r[2]) for r in data]
    b = [r[2] for r, k in zip(data, known) if k]
    a = [r[1] for r, k in zip(data, known) if k]
    assert cells["a", "b"] == cells["b", "a"] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert cells["flat", "flat"] == 0.0 and cells["b", "b"] == pytest.approx(1.0)
    assert correlation_matrix(points, ["a"], **LABELS, sample_size=50).count() == 4


def test_matrix_from_tiles_equals_expressions(spark, monkeypatch):
    points, _ = noisy(spark, gaps=True)

    def cells():
        found = correlation_matrix(points.repartition(5), ["a", "b", "flat"], **LABELS, sample_size=None)
        return {(r.row, r.column): r.correlation for r in found.collect()}

    monkeypatch.setattr(ranking, "EXPRESSION_PAIRS", 99)
    one_aggregate = cells()
    monkeypatch.setattr(ranking, "EXPRESSION_PAIRS", 0)
    for columns in (1, 2, 3, 128):
        monkeypatch.setattr(ranking, "TILE_COLUMNS", columns)
        tiled = cells()
        assert tiled.keys() == one_aggregate.keys()
        assert all(tiled[k] == pytest.approx(v, abs=1e-9) for k, v in one_aggregate.items())


def test_permutation_importance(spark):
    model = ModelSpec("signal_model", lambda batch: batch["signal"] / 10, ("signal", "noise"))
    found = analyze_features(
        features_small(spark), ["signal"], [ranking.PERMUTATION], model=model, **LABELS
    ).collect()
    assert [r.feature for r in found] == ["signal"]
    assert found[0].importance > 0


def test_shuffled_values_are_a_permutation(spark):
    points, data = noisy(spark)
    frame_ = ranking.labelled_features(points, ["a", "b"], "label", "matched")
    copies = shuffled_copies(frame_, ["a", "b"], ["a", "b"]).collect()
    assert len(copies) == 2 * len(data)
    for name, place in (("a", 1), ("b", 2)):
        drawn = sorted(r.drawn for r in copies if r.feature == name)
        assert drawn == sorted(r[place] for r in data)
        same = sum(r.drawn == r[name] for r in copies if r.feature == "b")
        assert same < len(data) / 10


def test_incremental_auc(spark):
    found = analyze_features(
        incremental(spark), BOTH, [ranking.INCREMENTAL_AUC], label="outcome", positive="yes"
    )
    gains = scores(found)
    assert gains["signal"] > 0.4
    assert gains["noise"] <= gains["signal"]
    alone = analyze_features(
        incremental(spark), ["signal"], [ranking.INCREMENTAL_AUC], label="outcome", positive="yes"
    )
    assert scores(alone)["signal"] == pytest.approx(0.5)


@pytest.mark.parametrize("files", [32, -1], ids=["few files", "sums in a tree"])
def test_newton_agrees_with_numpy(spark, monkeypatch, files):
    monkeypatch.setattr(incremental_sums, "SUM_SHARDS", files)
    points, _ = noisy(spark, 200)
    frame_ = ranking.labelled_features(points, ["a", "b"], "label", "matched")
    rows = stratified_folds(frame_, ranking.TARGET, 3).persist()
    means, scales = training_scales(rows, ["a", "b"], 3)
    models = [FoldModel(h, [0, 1]) for h in range(3)]
    fit_models(rows, ["a", "b"], models, means, scales)
    local = rows.toPandas()
    for model in models:
        train = local[local.fold != model.fold]
        x = train[["a", "b"]].to_numpy()
        assert means[model.fold] == pytest.approx(x.mean(axis=0))
        assert scales[model.fold] == pytest.approx(x.std(axis=0))
        design = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / x.std(axis=0)])
        y, beta = train[ranking.TARGET].to_numpy(), np.zeros(3)
        for _ in range(100):
            p = 1 / (1 + np.exp(-design @ beta))
            beta += np.linalg.solve((design.T * (p * (1 - p))) @ design, design.T @ (y - p))
        assert model.done and model.coefficients == pytest.approx(beta, abs=1e-5)
    rows.unpersist()


def test_argument_checks(spark):
    points = features_small(spark)

    def run(features=BOTH, methods=(ranking.CORRELATION,), data=points, **extra):
        return analyze_features(data, features, methods, **{**LABELS, **extra})

    for arguments, text in [
        ({"features": []}, "at least one feature"),
        ({"methods": []}, "one method"),
        ({"features": ["nope"]}, "lacks"),
        ({"methods": ["Guess"]}, "unknown are"),
        ({"methods": [ranking.SHAP]}, "explain a model"),
        ({"data": points.limit(0)}, "no rows to rank"),
        ({"positive": "other"}, "both label classes"),
        ({"features": ["track_id"], "methods": [ranking.SHAP], "model": ModelSpec("m", LinearModel([1.0]), ("signal",))}, "reads none of"),
    ]:
        with pytest.raises(ValueError, match=text):
            run(**arguments)
    assert run(methods=[ranking.MATRIX]).count() == 0


def test_default_models(spark):
    points, data = noisy(spark, 300)
    logistic = build_default_model(points, ["a", "b"], "label", "matched", "Logistic regression")
    assert logistic.name == "Default Logistic regression"
    found = analyze_features(points, ["a", "b"], [ranking.PERMUTATION, ranking.SHAP], model=logistic, **LABELS)
    assert set(scores(found, ranking.SHAP)) == {"a", "b"}
    assert scores(found, ranking.PERMUTATION)["b"] > 0.1
    # l2 optimum of the scaled problem: gradient vanishes
    x = np.array([[r[1], r[2]] for r in data])
    y = np.array([float(r[4] == "matched") for r in data])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    beta = np.array(logistic.model.weights) * x.std(axis=0)
    p = logistic.model.predict_proba(x)[:, 1]
    assert z.T @ (y - p) - beta == pytest.approx([0, 0], abs=0.05)

    with pytest.raises(ValueError, match="model type"):
        build_default_model(points, ["a"], "label", "matched", "Perceptron")
    with pytest.raises(ValueError, match="class-weight"):
        build_default_model(points, ["a"], "label", "matched", "Random forest", class_weight_mode="x")
    with pytest.raises(ValueError, match="above zero"):
        build_default_model(points, ["a"], "label", "matched", "Random forest", positive_weight=0)
    with pytest.raises(ValueError, match="at least one feature"):
        build_default_model(points, [], "label", "matched", "Random forest")
    with pytest.raises(ValueError, match="depth 30 at most"):
        build_default_model(points, ["a"], "label", "matched", "Random forest", parameters={"max_depth": 31})
    with pytest.raises(ValueError, match="learning rates"):
        build_default_model(points, ["a"], "label", "matched", "Gradient boosting", parameters={"learning_rate": 2.0})
    with pytest.raises(ValueError, match="parameters"):
        build_default_model(points, ["a"], "label", "matched", "Gradient boosting", parameters={"depth": 2})


@pytest.mark.parametrize(
    "kind, parameters",
    [
        ("Random forest", {"n_estimators": 5, "max_depth": 3, "criterion": "entropy", "max_features": None, "bootstrap": False, "min_samples_leaf": 1}),
        ("Gradient boosting", {"n_estimators": 5, "learning_rate": 0.2, "max_depth": 2, "min_samples_leaf": 2, "subsample": 0.75}),
    ],
)
def test_tree_models_score_and_explain(spark, kind, parameters):
    points, data = noisy(spark, 200)
    spec = build_default_model(
        points, ["a", "b", "flat"], "label", "matched", kind, class_weight_mode="Balanced", parameters=parameters
    )
    ensemble = spec.model
    assert len(ensemble.trees) == 5
    x = np.array([[r[1], r[2], r[3]] for r in data])
    frame_ = ranking.labelled_features(points, ["a", "b", "flat"], "label", "matched")
    found = explain.shap_contributions(frame_, spec).orderBy("__row_id").collect()
    for row, margin in zip(found, ensemble.margin(x)):
        parts = [c.shap_value for c in row.contributions]
        assert row.base_value + sum(parts) == pytest.approx(margin, abs=1e-9)
        assert parts[2] == 0.0
    # against the definition, by enumerating coalitions over every tree
    def expectation(known, at):
        total = 0.0
        for weight, tree in zip(ensemble.weights, ensemble.trees):
            for value, path in tree.leaves():
                part = value
                for f, (low, high, share) in path.items():
                    part *= float(low < at[f] <= high) if f in known else share
                total += weight * part
        return total

    at = x[5]
    for i in range(3):
        expected = 0.0
        others = [j for j in range(3) if j != i]
        for size in range(3):
            for s in combinations(others, size):
                weight = factorial(size) * factorial(2 - size) / factorial(3)
                expected += weight * (expectation({*s, i}, at) - expectation(set(s), at))
        assert found[5].contributions[i].shap_value == pytest.approx(expected, abs=1e-9)
    auc = brute_auc(list(zip(ensemble.predict_proba(x)[:, 1], [r[4] == "matched" for r in data])))
    assert auc > 0.6


def grown(rng, depth, features):
    """A random tree; features come again on a path, and covers add up."""
    feature, threshold, left, right, value, cover = ([] for _ in range(6))

    def add(level, rows):
        node = len(feature)
        inner = level < depth and rows >= 2 and rng.random() < 0.9
        feature.append(int(rng.integers(features)) if inner else -1)
        threshold.append(rng.uniform(0.2, 0.8))
        left.append(-1)
        right.append(-1)
        value.append(rng.normal())
        cover.append(float(rows))
        if inner:
            part = int(rng.integers(1, rows))
            left[node] = add(level + 1, part)
            right[node] = add(level + 1, rows - part)
        return node

    add(0, 10_000)
    return Tree(*map(np.array, (feature, threshold, left, right, value, cover)))


@pytest.mark.parametrize("seed", range(8))
def test_tree_values_by_enumeration(seed):
    rng = np.random.default_rng(seed)
    features = 1 + seed % 5
    tree = grown(rng, 7, features)
    rows = rng.uniform(size=(6, features))
    found = tree.shap(rows)

    def expectation(known, at):
        total = 0.0
        for value, path in tree.leaves():
            for f, (low, high, share) in path.items():
                value *= float(low < at[f] <= high) if f in known else share
            total += value
        return total

    for at, values in zip(rows, found):
        for i in range(features):
            others = [j for j in range(features) if j != i]
            expected = sum(
                factorial(n) * factorial(features - n - 1) / factorial(features)
                * (expectation({*s, i}, at) - expectation(set(s), at))
                for n in range(features)
                for s in combinations(others, n)
            )
            assert values[i] == pytest.approx(expected, abs=1e-9)


def test_linear_equals_enumeration_on_the_margin(spark):
    points, _ = noisy(spark, 150)
    frame_ = ranking.labelled_features(points, ["a", "b"], "label", "matched")
    linear = ModelSpec("l", LinearModel([0.7, -1.1], 0.2), ("a", "b"))
    margin = ModelSpec("m", lambda batch: 0.2 + 0.7 * batch["a"] - 1.1 * batch["b"], ("a", "b"))
    closed = explain.shap_contributions(frame_, linear, explainer="Linear").orderBy("__row_id").collect()
    sampled = explain.shap_contributions(frame_, margin, explainer="Permutation").orderBy("__row_id").collect()
    for x, y in zip(closed, sampled):
        assert x.base_value == pytest.approx(y.base_value)
        for p, q in zip(x.contributions, y.contributions):
            assert p.shap_value == pytest.approx(q.shap_value)


def test_sampled_coalitions_add_up():
    for size, rounds in ((1, None), (2, None), (7, None), (9, 10), (40, 3)):
        masks, weights = explain.coalition_plan(size, 7, rounds)
        values = np.random.default_rng(1).normal(size=len(masks))
        full = values[masks.all(axis=1)][0]
        empty = values[~masks.any(axis=1)][0]
        assert (weights @ values).sum() == pytest.approx(full - empty)
    assert len(explain.coalition_plan(7, 7)[0]) == 128
    with pytest.raises(ValueError, match="state the rounds"):
        explain.coalition_plan(16, 7)


def test_a_deep_tree_is_explained_in_array_steps():
    rng = np.random.default_rng(3)
    depth, rows = 10, rng.uniform(size=(2000, 10))
    inner = 2**depth - 1
    node = np.arange(2 * inner + 1)
    cover = np.floor(1e6 / 2 ** np.floor(np.log2(node + 1)))
    tree = Tree(
        np.where(node < inner, node % 10, -1), rng.uniform(0.3, 0.7, len(node)),
        2 * node + 1, 2 * node + 2, rng.normal(size=len(node)), cover,
    )
    ensemble = TreeEnsemble([tree], [1.0], False)
    values, base = ensemble.shap(rows)
    assert (base + values.sum(axis=1)) == pytest.approx(ensemble.margin(rows))


@pytest.mark.parametrize("explainer", ["Permutation", "Linear"])
def test_contributions_are_computed_once(spark, explainer, capsys):
    points, _ = noisy(spark, 30)
    frame_ = ranking.labelled_features(points, ["a", "b"], "label", "matched")
    linear = ModelSpec("l", LinearModel([0.7, -1.1], 0.2), ("a", "b"))
    contributions = explain.shap_contributions(frame_, linear, explainer=explainer, background=5)
    for table in (explain.shap_rows(contributions), explain.shap_waterfall(contributions)):
        table.explain()
        assert capsys.readouterr().out.count("ArrowEvalPython") == (explainer == "Permutation")
    explain.shap_density(explain.shap_rows(contributions)).explain()
    assert "ArrowEvalPython" not in capsys.readouterr().out


def test_explainer_choice(spark):
    linear = ModelSpec("m", LinearModel([1.0]), ("a",))
    assert explain.choose_explainer(linear) == "Linear"
    assert explain.choose_explainer(ModelSpec("c", len, ("a",))) == "Permutation"
    with pytest.raises(ValueError, match="Unsupported SHAP"):
        explain.choose_explainer(linear, "Kernel")
    with pytest.raises(ValueError, match="not compatible"):
        explain.choose_explainer(linear, "Tree")


def test_shap_tables(spark):
    values = [0.0, 0.01, 0.02, 0.03, 0.9]
    rows = spark.createDataFrame(
        [("f", i, float(i), v) for i, v in enumerate(values)] + [("g", i, 1.0, 0.5) for i in range(5)],
        "feature string, row_index long, feature_value double, shap_value double",
    )
    density = explain.shap_density(rows).orderBy("feature", "row_index").collect()
    offsets = [r.density_offset for r in density if r.feature == "f"]
    assert offsets[:4] == pytest.approx([-0.2625, -0.0875, 0.0875, 0.2625])
    assert offsets[4] == 0.0
    assert [r.relative_value for r in density[:5]] == [0.0, 0.25, 0.5, 0.75, 1.0]
    flat = [r for r in density if r.feature == "g"]
    assert {(r.density_offset, r.relative_value) for r in flat} == {(0.0, 0.0)}
    part = "struct<feature: string, feature_value: double, shap_value: double>"
    contributions = spark.createDataFrame(
        [(0, 0.5, [("a", 1.0, 0.1), ("b", 2.0, -0.4), ("c", 3.0, 0.2)])],
        f"__row_id long, base_value double, contributions array<{part}>",
    )
    steps = explain.shap_waterfall(contributions)
    found = [(r.feature, r.start, r.end, r.direction) for r in steps.orderBy("step").collect()]
    assert [f[0] for f in found] == ["b", "c", "a"]
    assert [x for f in found for x in f[1:3]] == pytest.approx([0.5, 0.1, 0.1, 0.3, 0.3, 0.4])
    assert [f[3] for f in found] == ["Decreases output", "Increases output", "Increases output"]
    assert explain.shap_waterfall(contributions, top=1).count() == 1
    limits = explain.shap_range(steps).first()
    assert (limits.lower, limits.upper) == pytest.approx((0.08, 0.52))
    assert tuple(explain.shap_range(steps.limit(0)).first()) == (-1.0, 1.0)


def test_shap_frame_size(spark):
    points = frame(
        spark,
        "track_id long, x double, y double, label string",
        [(i // 4, float(i), float(i % 5), "ab"[i % 2]) for i in range(24)],
    )
    frame_ = ranking.labelled_features(points, ["x", "y"], "label", "a")
    spec = ModelSpec("m", lambda batch: batch["x"] / 24, ("x", "y"))
    contributions = explain.shap_contributions(frame_, spec)
    assert contributions.count() == 24
    rows = explain.shap_rows(contributions)
    assert rows.count() == 48
    assert explain.shap_rows(contributions, features=["x"]).count() == 24
    ranked = scores(explain.shap_importance(rows))
    assert ranked["y"] == pytest.approx(0.0) and ranked["x"] > 0


def plain_newton(x, y, steps=100):
    """Standardised columns with an intercept; the unregularised fit."""
    design = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / x.std(axis=0)])
    beta = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve((design.T * (p * (1 - p))) @ design, design.T @ (y - p))
    return beta


def test_forty_features_without_each(spark):
    """Models without one feature start from the full fit and end where they would alone."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 40)) @ (np.eye(40) + 0.2 * rng.normal(size=(40, 40)))
    y = (x[:, 0] - x[:, 1] + rng.logistic(size=900) * 2 > 0).astype(int)
    names = [f"f{k}" for k in range(40)]
    rows = spark.createDataFrame(
        [(k, int(t), k % 2, *map(float, v)) for k, (t, v) in enumerate(zip(y, x))],
        f"__row_id long, {ranking.TARGET} int, fold int, " + ", ".join(f"{n} double" for n in names),
    ).repartition(7)
    means, scales = training_scales(rows, names, 2)
    every = list(range(40))
    full = [FoldModel(held, every) for held in range(2)]
    starts = fit_models(rows, names, full, means, scales)
    assert sorted(starts) == [0, 1] and all(len(s) == 40 for s in starts.values())
    part = []
    for held in range(2):
        for left_out in (0, 17, 39):
            model = FoldModel(held, [k for k in every if k != left_out])
            model.coefficients = starts[held][left_out]
            part.append(model)
    fit_models(rows, names, part, means, scales)
    for model in [*full, *part]:
        train = np.arange(900) % 2 != model.fold
        expected = plain_newton(x[train][:, model.used], y[train])
        assert model.done and model.coefficients == pytest.approx(expected, abs=1e-5)


def test_packed_triangles():
    matrix = np.array([[1.0, 2, 3], [2, 4, 5], [3, 5, 6]])
    assert packed(matrix).tolist() == [1, 2, 3, 4, 5, 6]
    assert (unpacked(packed(matrix), 3) == matrix).all()
