import os

import duckdb
import numpy as np
import pytest

from retrofit_spark.plans import training

MODELS = {"Current HP Status": ("Logistic Regression",), "HP Growth by Area": ("Linear Regression",)}


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (300, 2))
    rows = [(k, float(a), float(b), bool(a + b + e > 1), float(min(1, max(0, a / 2 + e))), float(b)) for k, ((a, b), e) in enumerate(zip(x, rng.normal(0, 0.1, 300), strict=True))]
    df = spark.createDataFrame(rows, "home long, a double, b double, HP_INSTALLED boolean, GROWTH double, HP_COVERAGE_FUTURE double")
    return {"Current HP Status": training.LabelledSet(df, ("HP_INSTALLED",), ("a", "b"), "home"), "HP Growth by Area": training.LabelledSet(df, ("GROWTH", "HP_COVERAGE_FUTURE"), ("a",), "home")}


def test_parts_are_finished_once(spark, sets, tmp_path):
    root = str(tmp_path / "parts")
    with pytest.raises(FileNotFoundError):
        training.stored_metrics(spark, sets, root, MODELS)
    status = {"Current HP Status": sets["Current HP Status"]}
    assert training.train_parts(status, root, MODELS) == [("Current HP Status", "Logistic Regression", "HP_INSTALLED")]
    assert training.train_parts(status, root, MODELS) == []
    broken = training.part_path(root, "Current HP Status", "Logistic Regression", "HP_INSTALLED")
    os.remove(f"{broken}/_SUCCESS")
    assert len(training.train_parts(sets, root, MODELS, params={"Linear Regression": {"regParam": 0.01}})) == 3
    assert training.train_parts(sets, root, MODELS) == []
    got = {(r.version, r.target, r["training set"]): r.metrics for r in training.stored_metrics(spark, sets, root, MODELS).collect()}
    assert len(got) == 6
    own = got["Current HP Status", "HP_INSTALLED", False]
    sql = 'avg((HP_INSTALLED = "HP_INSTALLED: prediction")::INT), count(*) FILTER (HP_INSTALLED AND "HP_INSTALLED: prediction") / count(*) FILTER (HP_INSTALLED)'
    accuracy, recall = duckdb.sql(f"SELECT {sql} FROM read_parquet('{broken}/*.parquet') WHERE NOT \"training set\"").fetchall()[0]
    assert own["accuracy"] == pytest.approx(accuracy) and own["recall"] == pytest.approx(recall) and accuracy > 0.8
    path = training.part_path(root, "HP Growth by Area", "Linear Regression", "GROWTH")
    rmse, n = duckdb.sql(f"""SELECT sqrt(avg(power(greatest(0, least(1, "GROWTH: prediction")) - GROWTH, 2))), count(*) FROM read_parquet('{path}/*.parquet') WHERE "training set" """).fetchall()[0]
    assert got["HP Growth by Area", "GROWTH", True]["rmse"] == pytest.approx(rmse) and n == 270
