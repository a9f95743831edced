"""Softmax students: optimality of the fit on the distillation objective, rules, early stop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from floe.operators.softmax import SoftmaxRegression, predictions

FEATURES = ["f 0", "f1"]


def _rows(n=400, k=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    w = rng.normal(size=(k, 3))
    z = x @ w[:, :-1].T + w[:, -1]
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rng.choice(k, p=row) for row in p])
    return x, y, rng.dirichlet(np.ones(k) * 3, size=n)


def _frame(spark, x, y, q):
    rows = [(i, int(b), [float(v) for v in s], float(r[0]), float(r[1])) for i, (r, b, s) in enumerate(zip(x, y, q))]
    return spark.createDataFrame(rows, "row_id long, y int, q array<double>, `f 0` double, f1 double").repartition(4)


def _objective(w, x, y, q, alpha, t, scale):
    w = w.reshape(-1, x.shape[1] + 1)
    z = x @ w[:, :-1].T + w[:, -1]

    def logs(v):
        m = v.max(1, keepdims=True)
        return v - m - np.log(np.exp(v - m).sum(1, keepdims=True))
    hard = -logs(z)[np.arange(len(x)), y]
    soft = (q * (np.log(q) - logs(z / t))).sum(1)
    return (alpha * hard + (1 - alpha) * scale * soft).mean()


@pytest.mark.parametrize("options", [
    {}, {"soft_col": "q", "alpha": 0.5}, {"soft_col": "q", "alpha": 0.1, "temperature": 4.0, "t2_scale": False},
    {"soft_col": "q", "alpha": 0.5, "solver": "bound", "max_steps": 80}])
def test_fit_reaches_the_optimum(spark, options):
    x, y, q = _rows()
    model = SoftmaxRegression(FEATURES, **options).fit(_frame(spark, x, y, q))
    alpha, t = options.get("alpha", 1.0), options.get("temperature", 10.0)
    args = (x, y, q, alpha, t, t * t if options.get("t2_scale", True) else 1.0)
    w = model.weights.ravel()
    slope = [(_objective(w + 1e-5 * e, *args) - _objective(w - 1e-5 * e, *args)) / 2e-5 for e in np.eye(len(w))]
    assert np.abs(slope).max() < 1e-4
    assert model.history == sorted(model.history, reverse=True)
    assert abs(model.history[-1] - _objective(w, *args)) < 1e-4


def test_separable_and_collinear_rows_stay_finite(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2), 1.0 - i % 2) for i in range(40)],
                               "row_id long, y int, a double, b double")
    model = SoftmaxRegression(["a", "b"], max_steps=60).fit(df)
    assert np.isfinite(model.weights).all() and model.history == sorted(model.history, reverse=True)
    got = predictions(model, df).collect()
    assert all(r.pred == r.y and r.p_pred > 0.99 for r in got) and len(got) == 40


def test_early_stop_keeps_the_best_step(spark):
    x, y, q = _rows()
    train, held = _frame(spark, x, y, q), _frame(spark, *_rows(seed=5))      # another truth: fitting hurts
    est = SoftmaxRegression(FEATURES, patience=2)
    model = est.fit(train, validation=held)
    assert len(model.validation) <= len(est.fit(train).history)
    best = min(range(len(model.validation)), key=lambda i: model.validation[i])
    if best == 0:
        assert not model.weights.any()
    assert est._hard_loss(held, model) == pytest.approx(model.validation[best], abs=1e-4)


def test_rows_without_a_value_fail_the_fit(spark):
    good = [(1, 0, 1.0), (2, 1, 2.0)]
    for bad in ((3, None, 1.0), (3, 1, None), (3, -1, 1.0)):
        df = spark.createDataFrame(good + [bad], "row_id long, y int, f1 double")
        with pytest.raises(Exception, match="null|index|INVALID"):
            SoftmaxRegression(["f1"]).fit(df)
    with pytest.raises(ValueError):
        SoftmaxRegression(["f1"]).fit(spark.createDataFrame([], "row_id long, y int, f1 double"))
    with pytest.raises(ValueError):
        SoftmaxRegression(["f1"], alpha=0.5).fit(spark.createDataFrame(good, "row_id long, y int, f1 double"))


def test_class_without_rows_gets_low_probability(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(20)], "row_id long, y int, f1 double")
    model = SoftmaxRegression(["f1"]).fit(df, num_classes=4)
    assert model.weights.shape == (4, 2)
    p = model.transform(df, "p").select(F.max(F.get("p", 2)).alias("c"), F.max(F.get("p", 3)).alias("d")).first()
    assert p.c < 0.01 and p.d < 0.01


def test_many_sums_are_matrix_products(spark):
    """A fit of 7,000 Hessian sums a step; as aggregates of one plan it would not be compiled."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 12)), rng.integers(0, 12, 300)
    rows = spark.createDataFrame([(int(b), *map(float, r)) for r, b in zip(x, y)],
                                 "y int, " + ", ".join(f"f{i} double" for i in range(12))).repartition(3)
    est = SoftmaxRegression([f"f{i}" for i in range(12)], ridge=1e-2)
    plain, k = est._rows(rows, None)
    w = rng.normal(size=(12, 13)) / 5
    loss, gradient, curvature = est._pass(plain, w, None)
    x1 = np.column_stack([x, np.ones(300)])
    p = np.exp(x1 @ w.T)
    p /= p.sum(1, keepdims=True)
    assert k == 12 and abs(loss + np.log(p[np.arange(300), y]).mean()) < 1e-9
    assert np.allclose(gradient, ((p - np.eye(12)[y]).T @ x1 / 300).ravel())
    want = sum(np.kron(np.diag(q) - np.outer(q, q), np.outer(v, v)) for q, v in zip(p, x1)) / 300
    assert np.allclose(curvature, want)


def test_rows_left_out_fail_the_fit(spark):
    for bad in [(None, 1.0), (1, None), (-1, 1.0)]:
        df = spark.createDataFrame([(i % 2, float(i)) for i in range(6)] + [bad], "y int, a double")
        with pytest.raises(ValueError, match="1 rows have"):
            SoftmaxRegression(["a"]).fit(df)
