"""How often operators work out the rows that they are given, which may be a query over large tables."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector

from retrofit_spark.operators import entries, ml, sampling
from retrofit_spark.operators.svm import LinearSVM
from retrofit_spark.plans import training

FEATURES = ["a", "b"]


@pytest.fixture
def counted(spark):
    """(a frame of 60 rows, a count of the rows that it was asked for)."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(k, float(k % 7), float(k % 11) if k % 5 else None, k % 3 == 0, (k % 7) / 10, None) for k in range(60)]
    schema = "k long, a double, b double, flag boolean, share double"
    return spark.createDataFrame([r[:5] for r in rows], schema).repartition(2).mapInArrow(run, schema), seen


def test_folds(counted):
    df, seen = counted
    assert ml.cross_validate(df, "share", FEATURES, "k", "Linear Regression", folds=3).count() == 3
    assert seen.value == 60


def test_search(counted):
    df, seen = counted
    assert ml.search_parameters(df, "share", FEATURES, "k", "Linear Regression", draws=2, folds=2).count() == 2
    assert seen.value == 60


def test_models(counted):
    df, seen = counted
    scores, found = ml.evaluate_models(df, ["flag"], FEATURES, "k", ml.CLASSIFIERS)
    assert scores.count() == 4 and all(out.count() == 60 for out in found.values())
    assert seen.value == 60


def test_prediction(counted):
    """With a column of nulls that have no type."""
    df, seen = counted
    out = ml.train_and_predict(df.selectExpr("k", "null AS nothing", "a", "b", "flag"), "flag", FEATURES, "k", "Logistic Regression")
    assert out.columns[:5] == ["k", "nothing", "a", "b", "flag"] and dict(out.dtypes)["nothing"] == "void" and out.where("nothing IS NULL").count() == 60
    assert seen.value == 60


def test_training(counted, tmp_path):
    df, seen = counted
    sets = {"Current HP Status": training.LabelledSet(df, ("flag",), tuple(FEATURES), "k"), "HP Growth by Area": training.LabelledSet(df, ("share", "a"), ("b",), "k")}
    models = {"Current HP Status": ("Logistic Regression",), "HP Growth by Area": ("Linear Regression",)}
    assert len(training.train_parts(sets, str(tmp_path), models)) == 3 and seen.value == 120
    assert training.train_parts(sets, str(tmp_path), models) == [] and seen.value == 120


def test_entry_counts(counted):
    """Two passes over the rows for one key, and one more for each further key; a key may be a count that was made before."""
    df, seen = counted
    found = entries.with_entry_counts(df, {"n_a": "a", "n_b": "b", "n_n": "n_b", "n_k": "k"}, heavy=8).collect()
    assert len(found) == 60 and {(r.n_a, r.n_k) for r in found} == {("5.0+", "1")}
    b = Counter(r.b for r in found)
    named = [None if r.b is None else "5.0+" if b[r.b] >= 5 else str(b[r.b]) for r in found]
    n = Counter(named)
    assert [r.n_b for r in found] == named and [r.n_n for r in found] == [None if x is None else "5.0+" if n[x] >= 5 else str(n[x]) for x in named]
    assert seen.value <= 5 * 60


def test_a_split_ranks_one_bucket(spark, monkeypatch):
    """F8 F9: rows aren't ranked but for those of the bucket that the share ends in; flags are those of a whole ranking."""
    rows = [(k, [True, False, None][k % 3]) for k in range(3000)] + [(7, True), (7, True), (None, False)]
    df = spark.createDataFrame(rows, "k int, s boolean").repartition(3)

    def unused(*args, **kwargs):
        raise AssertionError("all rows are ranked")

    monkeypatch.setattr(sampling, "_ranked", unused)
    for share, stratify in ((0.1, "s"), (0.37, None), (1.0, "s"), (0.0, None)):
        got = Counter((r.k, r.s, r["training set"]) for r in sampling.split(df, "k", share, stratify).collect())
        want = Counter()
        for stratum in ({True, False, None} if stratify else {0}):
            own = [r for r in rows if not stratify or r[1] is stratum]
            known = sorted(((hashlib.md5(f"{k}42".encode()).hexdigest(), k, s) for k, s in own if k is not None), key=lambda r: r[:2])
            none = len(own) - len(known)  # rows without a key are dropped, but take the first places
            want += Counter((k, s, i + none > math.ceil(len(own) * share)) for i, (_, k, s) in enumerate(known, 1))
        assert got == want, (share, stratify)


def test_preparation_is_one_affine_map(spark):
    """F8 F9: ranges, means and products come from two passes, and give what Spark ML's stages give one after the other."""
    rng = np.random.default_rng(4)
    x = np.column_stack((rng.normal(5, 100, 300), rng.integers(0, 4, 300), rng.uniform(1e6, 1e6 + 1, 300), np.full(300, 3.0)))
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double")
    stages = [VectorAssembler(inputCols=list("abcd"), outputCol="raw"), MinMaxScaler(inputCol="raw", outputCol="scaled")]
    stages += [StandardScaler(inputCol="scaled", outputCol="centred", withMean=True, withStd=False), PCA(k=4, inputCol="centred", outputCol="turned")]
    want = np.array([[*r.scaled, *r.turned] for r in Pipeline(stages=stages).fit(df).transform(df).collect()])
    for variance, own in ((None, want[:, :4]), (1.1, want[:, 4:])):
        medians, preparation = ml.fit_preparation(df, list("abcd"), variance)
        assert isinstance(preparation, ml.Preparation)
        got = np.array([list(r.features) for r in preparation.transform(ml.impute(df, medians)).collect()])
        assert np.abs(np.abs(got) - np.abs(own)).max() < 1e-8
    with pytest.raises(ValueError):
        ml.fit_preparation(df.limit(0), list("abcd"))


def test_a_step_of_the_svm_is_one_pass(spark):
    """step lengths and the slopes of the next step are measured together."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 3))
    y = (x @ [1, -2, 0.5] + rng.normal(0, 0.5, 400) > 0).astype(float)
    df = spark.createDataFrame([(v, float(t)) for v, t in zip(x.tolist(), y, strict=True)], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    spark.sparkContext.setJobGroup("svm", "svm")
    model = LinearSVM().fit(df)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("svm"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model.steps > 5 and jobs < 1.5 * model.steps + 6 + 6
