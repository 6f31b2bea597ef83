import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from retrofit_spark.operators import forest, ml
from retrofit_spark.operators.forest import DeepForest, drawn


def tree(x, y, min_leaf, min_split, depth, cuts):
    """A regression tree by trying every split at one of the features' cuts, as a function of a row."""
    if len(y) >= max(min_split, 2 * min_leaf) and depth:
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in cuts[f][np.searchsorted(cuts[f], values[:-1])]:
                left = x[:, f] <= cut
                if min(left.sum(), (~left).sum()) >= min_leaf:
                    gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, cut
        if best:
            _, f, cut = best
            left = x[:, f] <= cut
            a, b = (tree(x[side], y[side], min_leaf, min_split, depth - 1, cuts) for side in (left, ~left))
            return lambda row: a(row) if row[f] <= cut else b(row)
    return lambda row: y.mean()


def frame(spark, x, y):
    rows = [(k, v, float(t)) for k, (v, t) in enumerate(zip(x.tolist(), y, strict=True))]
    return spark.createDataFrame(rows, "k int, x array<double>, label double").select("k", array_to_vector("x").alias("features"), "label").repartition(3)


def predictions(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("k").collect()])


@pytest.mark.parametrize(("min_leaf", "min_split", "depth"), [(8, 15, 90), (20, 100, 3)])
def test_a_tree_equals_brute_force(spark, min_leaf, min_split, depth):
    rng = np.random.default_rng(min_leaf)
    x = np.column_stack((rng.normal(0, 1, 500), rng.integers(0, 5, 500), rng.uniform(0, 1, 500)))
    y = np.sin(3 * x[:, 0]) + (x[:, 1] > 2) + rng.normal(0, 0.3, 500)
    model = DeepForest(n_trees=1, max_depth=depth, min_leaf=min_leaf, min_split=min_split, max_features="auto", bootstrap=False, bins=500).fit(frame(spark, x, y))
    fresh = np.column_stack((rng.normal(0, 1, 100), rng.integers(0, 5, 100), rng.uniform(0, 1, 100)))
    whole = np.vstack((x, fresh))
    want = tree(x, y, min_leaf, min_split, depth, [(v[:-1] + v[1:]) / 2 for v in map(np.unique, x.T)])
    assert predictions(model, frame(spark, whole, np.zeros(600))) == pytest.approx([want(row) for row in whole], abs=1e-9)
    assert len(model.levels) <= depth


def test_depth_beyond_thirty(spark):
    """A staircase of fourfold steps takes one value off at each level."""
    n = 40
    x, y = np.arange(n, dtype=float)[:, None], 4.0 ** np.arange(n)
    df = frame(spark, x, y)
    model = DeepForest(n_trees=1, max_depth=33, min_leaf=1, min_split=2, max_features=1, bootstrap=False).fit(df)
    assert len(model.levels) == 33
    assert (np.abs(predictions(model, df) / y - 1)[-30:] < 1e-9).all()


def test_forest(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 1, (400, 6))
    y = 2 * x[:, 0] + (x[:, 1] > 0.5) + rng.normal(0, 0.1, 400)
    forest = DeepForest(n_trees=12, min_leaf=3, min_split=6, max_features=3)
    model = forest.fit(frame(spark, x[:300], y[:300]))
    got = predictions(model, frame(spark, x[300:], y[300:]))
    assert np.mean((got - y[300:]) ** 2) < 0.15 * np.var(y[300:])
    with pytest.raises(ValueError):
        forest.fit(frame(spark, x[:300], y[:300]).limit(0))


@pytest.mark.parametrize("local", [0, 150, 1 << 14])
def test_small_nodes_are_grown_in_one_task(spark, monkeypatch, local):
    """nodes of few rows are finished in one job, whatever their depth, and a tree is the same however it was grown."""
    rng = np.random.default_rng(3)
    x = np.column_stack((rng.normal(0, 1, 300), rng.integers(0, 5, 300), np.zeros(300)))
    y = np.cos(3 * x[:, 0]) + (x[:, 1] > 2) + rng.normal(0, 0.3, 300)
    calls, splits = [], DeepForest._splits
    monkeypatch.setattr(forest, "LOCAL", local)
    monkeypatch.setattr(DeepForest, "_splits", lambda self, *args: calls.append(1) or splits(self, *args))
    df = frame(spark, x, y)
    model = DeepForest(n_trees=1, min_leaf=4, max_features="auto", bootstrap=False, bins=300).fit(df)
    want = tree(x, y, 4, 15, 90, [(v[:-1] + v[1:]) / 2 for v in map(np.unique, x.T)])
    assert predictions(model, df) == pytest.approx([want(row) for row in x], abs=1e-9)
    assert len(model.levels) > 3
    assert len(calls) > 3 if not local else len(calls) < 3 if local < 300 else not calls


def test_draws(spark):
    got = spark.range(20_000).select(drawn(F.col("id"), F.lit(3), 42).alias("n")).groupBy("n").count().collect()
    share = {r.n: r["count"] / 20_000 for r in got}
    assert share[0] == pytest.approx(0.368, abs=0.02) and share[1] == pytest.approx(0.368, abs=0.02) and share[2] == pytest.approx(0.184, abs=0.02)


def test_as_a_model_by_name():
    forest = ml.estimator("Random Forest Regressor", "f", "l", 100)
    assert (forest.n_trees, forest.max_depth, forest.min_leaf, forest.min_split, forest.max_features) == (175, 90, 8, 15, 5)
    assert ml.estimator("Random Forest Regressor", "f", "l", 100, {"max_depth": None, "n_trees": 3}).n_trees == 3
