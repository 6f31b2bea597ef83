import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from retrofit_spark.operators import ml
from retrofit_spark.operators.svm import LinearSVM


def rows(n, d, noise, seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, (n, d))
    truth = np.where(np.arange(d) < 3, rng.normal(0, 4, d), 0)
    y = ((x - 0.5) @ truth + rng.normal(0, noise, n) > 0).astype(float)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(v, float(t)) for v, t in zip(x.tolist(), y, strict=True)], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").repartition(3)


def objective(x, y, w, b, alpha, l1):
    return np.maximum(0, 1 - np.where(y > 0, 1, -1) * (x @ w + b)).mean() + alpha * ((1 - l1) / 2 * w @ w + l1 * np.abs(w).sum())


def least(x, y, alpha, l1):
    """The least objective that long runs of accelerated descent find on one machine."""
    s = np.where(y > 0, 1.0, -1.0)
    z = np.column_stack((x, np.ones(len(x)))) * s[:, None]
    best = np.inf
    w = np.zeros(z.shape[1])
    top = np.linalg.eigvalsh(z.T @ z / len(z))[-1]
    for width in (1, 0.3, 0.1, 0.03, 0.01, 3e-3, 1e-3, 3e-4):
        step, v, t = 1 / (top / width + alpha), w, 1.0
        for _ in range(1500):
            slope = np.clip((1 - z @ v) / width, 0, 1)
            g = -(slope @ z) / len(z) + np.append(alpha * (1 - l1) * v[:-1], 0)
            a = v - step * g
            a[:-1] = np.sign(a[:-1]) * np.maximum(np.abs(a[:-1]) - step * alpha * l1, 0)
            u = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, w, t = a + (t - 1) / u * (a - w), a, u
        best = min(best, objective(x, y, w[:-1], w[-1], alpha, l1))
    return best


@pytest.mark.parametrize(("alpha", "l1", "noise"), [(1e-4, 0.15, 0.3), (1e-2, 0.5, 0.5), (2e-2, 1.0, 0.1)])
def test_objective_is_least(spark, alpha, l1, noise):
    x, y = rows(600, 8, noise, 1)
    model = LinearSVM(alpha=alpha, l1_ratio=l1, tol=1e-5).fit(frame(spark, x, y))
    own = objective(x, y, model.coefficients, model.intercept, alpha, l1)
    assert own == pytest.approx(model.objective, abs=1e-9) and own <= least(x, y, alpha, l1) + 1e-3


def test_strong_l1_leaves_zeros(spark):
    x, y = rows(800, 12, 0.1, 3)
    model = LinearSVM(alpha=0.03, l1_ratio=1.0, tol=1e-6).fit(frame(spark, x, y))
    assert (model.coefficients[3:] == 0).sum() >= 8 and np.abs(model.coefficients[:3]).max() > 0.5
    assert (LinearSVM(alpha=50.0, l1_ratio=1.0).fit(frame(spark, x, y)).coefficients == 0).all()


def test_ends_by_tolerance_and_by_steps(spark):
    x, y = rows(300, 4, 0.2, 4)
    df = frame(spark, x, y)
    assert LinearSVM(max_iter=2).fit(df).steps == 2
    assert LinearSVM(tol=0.05).fit(df).steps < LinearSVM(tol=1e-6).fit(df).steps < 300
    with pytest.raises(ValueError):
        LinearSVM().fit(df.limit(0))


def test_as_a_model_by_name(spark):
    x, y = rows(500, 3, 0.05, 5)
    df = spark.createDataFrame([(k, bool(t), *v) for k, (v, t) in enumerate(zip(x.tolist(), y, strict=True))], "home long, pump boolean, a double, b double, c double")
    out = ml.train_and_predict(df, "pump", ["a", "b", "c"], "home", "Linear Support Vector Classifier")
    assert out.where("`pump: error`").count() <= 40
    assert ml.estimator("Linear Support Vector Classifier", "f", "l", 10, {"alpha": 0.5, "tol": 0.1}) == LinearSVM("f", "l", 0.5, 0.15, 0.1)
