"""Ridge and boosting against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import boosting as B
from tidemill.operators import metrics as M
from tidemill.operators import models as L
from tidemill.operators import ridge as R


def data(seed=0, n=240, d=5, classes=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * [1, 2, 0.5, 1, 3][:d] + 50
    y = (x[:, 0] - x[:, 1] + r.normal(size=n) * 0.3 > 0).astype(int) + (x[:, 2] > 50.2)
    return x, np.minimum(y, classes - 1), x @ np.arange(1, d + 1) + r.normal(size=n)


def frame(spark, x, label, target, weight=None):
    w = weight if weight is not None else np.ones(len(x))
    return spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in x[i]], int(label[i]), float(target[i]), float(w[i]), i % 3) for i in range(len(x))],
                                 "sample_id bigint, features array<double>, label int, y double, w double, part int")


def solve(x, y, alpha, w=None):
    w = np.ones(len(x)) if w is None else w
    mx, my = np.average(x, axis=0, weights=w), np.average(y, axis=0, weights=w)
    a = (x - mx).T @ ((x - mx) * w[:, None]) + alpha * np.eye(x.shape[1])
    coef = np.linalg.solve(a, (x - mx).T @ ((y - my) * (w if y.ndim == 1 else w[:, None])))
    return coef, my - mx @ coef


def test_ridge_is_the_normal_equations_with_weights(spark):
    x, label, y = data()
    w = np.random.default_rng(1).uniform(0.1, 3, len(x))
    m = R.Ridge("features", "y", [7.0], weight="w").fit(frame(spark, x, label, y, w).repartition(5))
    coef, b = solve(x, y, 7.0, w)
    assert np.allclose(m.coefficients[:, 0], coef) and np.allclose(m.intercepts, b)


@pytest.mark.parametrize("folds", [3, None])
def test_ridge_chooses_the_penalty_by_the_error_left_out(spark, folds):
    x, label, y = data(2, n=90)
    alphas = [0.01, 1.0, 30.0, 1000.0]
    m = R.Ridge("features", "y", alphas, folds=folds, fold="part" if folds else None).fit(frame(spark, x, label, y))
    parts = [np.arange(90) % 3 == f for f in range(3)] if folds else [np.arange(90) == i for i in range(90)]
    for a in alphas:
        want = 0
        for held in parts:
            coef, b = solve(x[~held], y[~held], a)
            want += ((y[held] - x[held] @ coef - b) ** 2).sum()
        assert m.errors[a] == pytest.approx(want / 90, rel=1e-6)
    assert m.alpha == min(m.errors, key=m.errors.get)


def test_ridge_classifier_scores_and_one_pass(spark):
    x, label, y = data(3)
    df = frame(spark, x, label, y)
    m = R.Ridge("features", "label", [2.0], classify=True).fit(df)
    signs = np.where(label[:, None] == np.arange(3), 1.0, -1.0)
    coef, b = solve(x, signs, 2.0)
    got = np.array([r.scores for r in m.transform(df).orderBy("sample_id").collect()])
    assert np.allclose(got, x @ coef + b)
    assert [r.prediction for r in m.transform(df).orderBy("sample_id").collect()] == (x @ coef + b).argmax(axis=1).tolist()


def test_wide_features_take_the_other_solver(spark, monkeypatch):
    x, label, y = data(4, n=60)
    df = L.with_vector(frame(spark, x, label, y), "features")
    near = L.make_model("ridge_regression", label="y", alphas=(1.0,)).fit(df).transform(df)
    monkeypatch.setattr(R, "MOMENT_BYTES", 100)
    far = L.make_model("ridge_regression", label="y", alphas=(1.0,)).fit(df).transform(df)
    a, b = ([r.prediction for r in d.orderBy("sample_id").collect()] for d in (near, far))
    assert np.allclose(a, b, rtol=1e-3)
    with pytest.raises(R.TooWide):
        R.Ridge("features", "y").fit(df)


def test_class_weights_reach_the_fit(spark):
    r = np.random.default_rng(5)
    label = (r.random(400) < 0.06).astype(int)
    x = r.normal(size=(400, 2)) + label[:, None] * 1.2
    df = L.with_vector(frame(spark, x, label, x[:, 0]), "features")
    for model, params in (("ridge_classifier", {"alphas": (1.0,)}), ("decision_tree", {"maxDepth": 2}), ("xgboost", {"rounds": 2, "max_depth": 2}), ("ada_boost", {"rounds": 1})):
        found = []
        for weight in (None, "balanced"):
            pred = L.classify(df, df, model, "sample_id", "label", class_weight=weight, **params)
            found.append(pred.filter("pred = 1").count())
        assert found[1] > found[0], model
    with pytest.raises(ValueError):
        L.classify(df, df, "mlp", "sample_id", "label", class_weight="balanced", layers=[2, 2])
    with pytest.raises(ValueError):
        L.classify(df, df, "decision_tree", "sample_id", "label", class_weight="heavy")


def plain_tree(x, g, h, l2, depth, rate):
    """Values by the best second-order splits over all distinct values, missing values tried on both sides."""
    def score(m):
        return g[m].sum() ** 2 / (h[m].sum() + l2)

    out = np.zeros(len(g))

    def grow(rows, level):
        best = None
        if level < depth:
            for f in range(x.shape[1]):
                for c in np.unique(x[~np.isnan(x[:, f]), f])[:-1]:
                    for side in (True, False):
                        left = rows & np.where(np.isnan(x[:, f]), side, x[:, f] <= c)
                        right = rows & ~left
                        if left.any() and right.any():
                            gain = (score(left) + score(right) - score(rows)) / 2
                            if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                                best = gain, left, right
        if best is None:
            out[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2) if level else 0
        else:
            grow(best[1], level + 1)
            grow(best[2], level + 1)

    grow(np.ones(len(g), bool), 0)
    return out


def test_depthwise_boosting_is_the_plain_one(spark):
    x, label, y = data(6, n=150, d=3)
    x = np.round(x, 1)
    x[::7, 1] = np.nan
    df = frame(spark, x, label, y).repartition(4)
    got = B.Boosting(label="label", rounds=3, max_depth=2, l2=1.0, rate=0.3, min_hessian=0).fit(df).transform(df)
    margins = np.repeat(np.log(np.bincount(label) / len(label))[None], len(x), axis=0)
    for _ in range(3):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        g, h = p - np.eye(3)[label], p * (1 - p)
        margins = margins + np.stack([plain_tree(x, g[:, k], h[:, k], 1.0, 2, 0.3) for k in range(3)], axis=1)
    want = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
    assert np.allclose(np.array([r.scores for r in got.orderBy("sample_id").collect()]), want, atol=1e-9)


def test_blocks_of_features_give_the_same(spark, monkeypatch):
    x, label, y = data(7, n=120)
    df = frame(spark, x, label, y)
    fit = lambda: [r.scores for r in B.Boosting(loss="squared", label="y", rounds=2, max_depth=3).fit(df).transform(df).orderBy("sample_id").collect()]
    whole = fit()
    monkeypatch.setattr(B, "HISTOGRAM_BYTES", 1)
    assert np.allclose(whole, fit())


def test_leafwise_growth_has_its_own_shape(spark):
    x, label, y = data(8, n=300)
    df = frame(spark, x, label, y)
    m = B.Boosting(loss="squared", label="y", rounds=1, growth="leaf", max_leaves=5, min_rows=10, l2=0.0).fit(df)
    tree = m.trees[0][0]
    assert sum(f < 0 for f in tree.feature) == 5
    rows = np.bincount(tree.leaves(B.to_bins(x, m.cuts), 255))
    assert min(rows[rows > 0]) >= 10


@pytest.mark.parametrize("model, params", [("hist_gradient_boosting", {"rounds": 3, "max_leaves": 4}), ("xgboost", {"rounds": 3, "max_depth": 3})])
def test_boosting_learns(spark, model, params):
    x, label, y = data(9, n=300)
    df = frame(spark, x, label, y)
    pred = L.classify(df.filter("sample_id % 4 <> 0"), df.filter("sample_id % 4 = 0"), model, "sample_id", "label", **params)
    assert M.accuracy(pred).first().accuracy > 0.7


def test_awkward_rows(spark):
    x = np.array([[1.0, np.nan], [2.0, np.nan], [3.0, np.nan], [4.0, np.nan]])
    df = frame(spark, x, np.array([0, 0, 1, 1]), np.arange(4)).withColumn("label", F.when(F.col("sample_id") < 9, F.col("label")))
    m = B.Boosting(rounds=2, max_depth=1, min_hessian=0).fit(df)
    assert [r.prediction for r in m.transform(df).orderBy("sample_id").collect()] == [0, 0, 1, 1]
    assert m.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        B.Boosting().fit(df.limit(0))
    with pytest.raises(ValueError):
        B.Boosting(growth="sideways")
