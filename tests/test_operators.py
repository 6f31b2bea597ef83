import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrofit_spark.functions import encode
from retrofit_spark.operators import areas, entries, grid, installs, joins, metrics, ml, profile, sampling
from retrofit_spark.plans import jobs

D = dt.date


@pytest.fixture(scope="module")
def history(spark):
    rows = [("a", 1, D(2010, 1, 1), False), ("a", 2, D(2012, 1, 1), True), ("a", 3, None, False), ("b", 4, D(2011, 1, 1), True), ("unknown", 5, D(2010, 1, 1), False), ("unknown", 6, D(2013, 1, 1), False), (None, 7, D(2014, 1, 1), True)]
    return spark.createDataFrame(rows, "UPRN string, BUILDING_REFERENCE_NUMBER long, INSPECTION_DATE date, HP_INSTALLED boolean")


def ids(df):
    return sorted(r.BUILDING_REFERENCE_NUMBER for r in df.collect())


def test_latest_takes_null_dates_and_collapses_the_sentinel(history):
    assert ids(entries.pick_entry(history, "UPRN", "latest entry")) == [3, 4, 7]
    assert ids(entries.pick_entry(history, "UPRN", "first entry", null_key="keep")) == [1, 4, 5, 6, 7]
    with pytest.raises(ValueError):
        entries.pick_entry(history, "UPRN", "newest")


def test_year_filter_is_pushed_down(history, spark, tmp_path):
    history.write.parquet(str(tmp_path / "t"))
    df = entries.up_to_year(spark.read.parquet(str(tmp_path / "t")), 2011)
    assert ids(df) == [1, 4, 5] and "LessThan(INSPECTION_DATE" in df._jdf.queryExecution().toString()
    assert ids(entries.up_to_year(history, 2011, up_to=False)) == [4] and entries.up_to_year(history, "all").count() == 7


def test_counts(spark):
    df = entries.with_entry_counts(spark.createDataFrame([("a",)] * 5 + [("b",), (None,)], "k string"), {"n": "k"})
    assert sorted((r.k or "", r.n) for r in df.collect() if r.k != "a") == [("", None), ("b", "1")] and df.where("n = '5.0+'").count() == 5


def test_status_changes(history):
    got = entries.status_changes(history, "UPRN").select("UPRN", "HP_ADDED").collect()
    assert [tuple(r) for r in sorted(got)] == [("a", False), ("unknown", False)]


def test_reconcile(spark):
    rows = [("a", 1, D(2010, 1, 1), False, D(2011, 6, 1)), ("a", 2, D(2012, 1, 1), False, D(2011, 6, 1)), ("b", 3, D(2010, 1, 1), True, None), ("b", 4, D(2009, 1, 1), False, None), (None, 5, D(2010, 1, 1), True, None), ("c", 6, None, True, None)]
    df = spark.createDataFrame(rows, "UPRN string, BUILDING_REFERENCE_NUMBER long, INSPECTION_DATE date, HP_INSTALLED boolean, HP_INSTALL_DATE date")
    out = installs.reconcile_install_dates(df)
    got = sorted((r.BUILDING_REFERENCE_NUMBER, r.ARTIFICIALLY_DUPL, r.INSPECTION_DATE, r.HP_INSTALLED, r.HP_INSTALL_DATE or D(1, 1, 1)) for r in out.collect())
    none = D(1, 1, 1)
    assert got == [
        (1, False, D(2010, 1, 1), False, none), (1, True, D(2011, 6, 1), True, D(2011, 6, 1)), (2, False, D(2012, 1, 1), False, D(2011, 6, 1)),
        (3, False, D(2010, 1, 1), True, D(2010, 1, 1)), (4, False, D(2009, 1, 1), False, none), (5, False, D(2010, 1, 1), True, none),
    ]
    assert out.where(f"`{installs.AFTER}`").select("BUILDING_REFERENCE_NUMBER").head()[0] == 2
    assert out.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_joins(spark):
    df = spark.createDataFrame([(1, "ab1 2cd", "1 High St", None), (2, "zz1 1zz", None, "x")], "k int, POSTCODE string, ADDRESS1 string, ADDRESS2 string")
    imd = spark.createDataFrame([("ab12cd", 7)], "Postcode string, rank int")
    assert [(r.k, r["rank"]) for r in joins.join_deprivation(df, imd).collect()] == [(1, 7)]
    register = spark.createDataFrame([("1highstab12cd", D(2012, 1, 1), 2), ("1highstab12cd", D(2011, 1, 1), 1), (None, D(2000, 1, 1), 3)], "compressed_epc_address string, date date, version int")
    key = joins.address_key(F.col("ADDRESS1"), F.col("ADDRESS2"), F.col("POSTCODE"))
    got = sorted((r.k, r.HP_INSTALL_DATE, r.v) for r in joins.join_installations(df, register, key, values={"version": "v"}).collect())
    assert got == [(1, D(2011, 1, 1), 1), (2, None, None)]


def test_areas(spark):
    rows = [("x", "b", 1.0), ("x", "a", 2.0), ("x", None, 4.0), ("y", "b", None), (None, "b", 1.0)]
    df = spark.createDataFrame(rows, "area string, f string, v double")
    assert sorted(map(tuple, areas.most_frequent(df, "area", "f").collect())) == [("x", "a"), ("y", "b")]
    wide = {r.area: r for r in areas.category_shares_wide(df, "area", ["f"]).collect()}
    assert wide["x"]["f: a"] == 0.5 and wide["x"].area_TOTAL == 2 and wide["x"].MOST_FREQUENT_f == "a" and wide["y"]["f: b"] == 1
    shares = areas.category_shares(df, "area", ["f"]).groupBy("area", "feature").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in shares)
    assert sorted(map(tuple, areas.value_count(df, "area", "f", "b", "n").collect())) == [("x", 1), ("y", 1)]
    assert {r.area: r.v for r in areas.medians(df, "area", ["v"]).collect()} == {"x": 2.0, "y": None}
    with pytest.raises(ValueError):
        areas.growth(df, "area", 1, 2, "none")


def test_complete_groups_stay_whole(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 37)
    out = sampling.complete_groups(df, "g", 200)
    sizes = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    whole = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    assert all(whole[g] == n for g, n in sizes.items()) and 200 <= sum(sizes.values()) < 200 + max(whole.values())


def test_balance_and_split(spark):
    df = spark.range(1000).withColumn("y", F.col("id") % 20 == 0)
    out = sampling.balance(df, "y", "id", 0.8)
    assert out.where("y").count() == 50 and out.where("not y").count() == 200
    split = sampling.split(df, "id", 0.1, "y")
    assert {(r.y, r["training set"]): r["count"] for r in split.groupBy("y", "training set").count().collect()} == {(True, False): 5, (True, True): 45, (False, False): 95, (False, True): 855}
    assert 60 < sampling.split_by_hash(df, "id").where("not `training set`").count() < 140
    assert 60 < sampling.sample_with_replacement(df, 100).count() < 140


def test_bins(spark):
    df = spark.createDataFrame([(1.0,), (0.575,), (0.0,), (0.05,), (None,)], "x double")
    assert [r.b for r in df.select(metrics.percentage_bin(F.col("x")).alias("b")).collect()] == [19, 11, 0, 1, None]
    assert df.select(metrics.bin_label(F.lit(19)).alias("b")).head().b == "95-100%"


def test_cells(spark):
    df = grid.with_cell(spark.createDataFrame([(54.0, -1.0), (54.0, -1.001), (55.0, -1.0), (None, 1.0)], "LATITUDE double, LONGITUDE double"))
    a, b, c, none = (r.hex_id for r in df.collect())
    assert a == b != c and (none is None or ":" not in none)


def test_profile(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.1, None), (3.0, 6.0, None)], "a double, b double, c string")
    assert profile.drop_null_columns(df).columns == ["a", "b"]
    assert [r.feature for r in profile.correlated_features(df, ["a", "b"]).collect()] == ["b"]
    out, watch = profile.observed(df, "stage")
    out.collect()
    assert watch.get == {"rows": 3}


def test_models(spark):
    df = spark.range(400).select("id", F.rand(1).alias("a"), F.when(F.col("id") % 9 != 0, F.rand(2)).alias("b")).withColumn("y", F.col("a") > 0.5)
    out = ml.train_and_predict(df, "y", ["a", "b"], "id", "Logistic Regression", variance=None)
    assert out.where("`y: error`").count() < 60 and {"proba 0", "proba 1", "training set"} <= set(out.columns)
    area = df.withColumn("z", F.col("a") * 0.5)
    assert ml.cross_validate(area, "z", ["a", "b"], "id", "Linear Regression").where("test_score < 0.2").count() == 5
    assert ml.important_coefficients(df, "y", ["a", "b"]).orderBy(F.abs("importance").desc()).head().feature == "a"
    with pytest.raises(ValueError):
        ml.estimator("Oracle", "features", "label", 1)


def test_models_after_an_observation(spark):
    """An observed stage leaves a manager in the session that can't be sent to tasks; models must not carry the session."""
    df = spark.range(300).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("y", F.col("a") > 0.5).withColumn("z", F.col("a") * 2)
    out, watch = profile.observed(df, "stage")
    out.collect()
    assert watch.get == {"rows": 300}
    for model, target in (("Logistic Regression", "y"), ("Linear Support Vector Classifier", "y"), ("Linear Regression", "z"), ("Poisson Regression", "z"), ("Decision Tree Regressor", "z")):
        found = ml.train_and_predict(df, target, ["a", "b"], "id", model, variance=None)
        assert found.where(F.col(f"{target}: error").cast("double") > 0.5).count() < 30, model


def test_linear_regression_solves_the_normal_equations(spark):
    rows = [(k, float(k % 7), float(k % 5), 3.0 * (k % 7) - 2.0 * (k % 5) + 1 + 0.1 * ((k * 13) % 11)) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    out = ml.train_and_predict(df, "y", ["a", "b"], "id", "Linear Regression", variance=None, fit_on="train").collect()
    x = np.array([[1, r.a, r.b] for r in out if r["training set"]])
    w = np.linalg.lstsq(x, np.array([r.y for r in out if r["training set"]]), rcond=None)[0]
    assert all(abs(r["y: prediction"] - (w[0] + w[1] * r.a + w[2] * r.b)) < 1e-5 for r in out)


def test_components_and_singular_values(spark):
    rnd = np.random.default_rng(2)
    data = rnd.random((120, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")
    scaled = (data - data.min(0)) / (data.max(0) - data.min(0))
    variance = np.sort(np.linalg.eigvalsh(np.cov(scaled.T)))[::-1]
    got = ml.explained_variance(df, ["a", "b", "c"]).orderBy("component").collect()
    assert np.allclose([r.share for r in got], variance / variance.sum())
    got = ml.singular_values(df, ["a", "b", "c"], 2).orderBy("component").collect()
    assert np.allclose([r.singular_value for r in got], np.linalg.svd(scaled, compute_uv=False)[:2])


def test_poisson_tail(spark):
    cases = [(0, 0.5), (3, 2.0), (40, 31.5), (900, 1000.0), (None, 1.0)]
    df = spark.createDataFrame(cases, "n int, mean double").select("n", "mean", ml.poisson_tail(F.col("n"), F.col("mean")).alias("p"))
    for r in df.collect():
        want = None if r.n is None else 1 - sum(math.exp(i * math.log(r.mean) - r.mean - math.lgamma(i + 1)) for i in range(r.n + 1))
        assert r.p is want if want is None else abs(r.p - want) < 1e-9


def test_poisson_rates(spark):
    """The fitted means have the observed sums: the score equations of the intercept and of the feature."""
    rnd = np.random.default_rng(4)
    rows = [(int(rnd.poisson(n * math.exp(-2 + x))), n, float(x)) for n, x in zip(rnd.integers(50, 200, 80).tolist(), rnd.random(80), strict=True)]
    out = ml.poisson_rates(spark.createDataFrame(rows, "pumps int, homes int, x double"), "pumps", "homes", ["x"]).collect()
    assert abs(sum(r.expected - r.pumps for r in out)) < 1e-3 and abs(sum((r.expected - r.pumps) * r.x for r in out)) < 1e-3
    assert all(0 <= r.exceedance <= 1 for r in out)


def test_medians(spark):
    rnd = np.random.default_rng(3)
    few, many = rnd.integers(0, 4, 5001).astype(float), rnd.normal(size=5001)
    df = spark.createDataFrame([(float(a), float(b) if k % 3 else None, None) for k, (a, b) in enumerate(zip(few, many, strict=True))], "a double, b double, c double")
    want = {"a": float(np.median(few)), "b": float(np.median(many[[k % 3 > 0 for k in range(5001)]])), "c": 0.0}
    assert ml.fit_medians(df, ["a", "b", "c"]) == pytest.approx(want)


def test_places_have_two_levels(spark):
    """Splits and lowest rows are those of a sort by hash of each whole stratum, null being one."""
    rows = [(k, [True, False, None][k % 3]) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, s boolean")
    order = lambda k: (hashlib.md5(f"{k}42".encode()).hexdigest(), k)
    held = set()
    for s in (True, False, None):
        own = sorted((k for k, v in rows if v is s), key=order)
        held |= set(own[: -(-len(own) // 10)])
    assert {r.id for r in sampling.split(df, "id", 0.1, "s").where("NOT `training set`").collect()} == held
    assert {r.id for r in sampling.lowest(df, sampling.seeded(F.col("id")), 57, "id").collect()} == set(sorted(range(400), key=order)[:57])


def test_many_rows_without_a_key(spark):
    """A third of all rows have the sentinel key: it counts as one property in growth and changes, and has no history in installations."""
    rows = [(k, "unknown" if k % 3 == 0 else f"u{k % 20}", D(2010 + k % 9, 1, 1), k % 4 == 1, "A" if k % 2 else "B") for k in range(120)]
    df = spark.createDataFrame(rows, "BUILDING_REFERENCE_NUMBER long, UPRN string, INSPECTION_DATE date, HP_INSTALLED boolean, area string")
    one = df.withColumn("UPRN", F.when(F.col("UPRN") == "unknown", "a key like others").otherwise(F.col("UPRN")))
    assert sorted(map(tuple, areas.growth(df, "area", 2013, 2016).collect())) == sorted(map(tuple, areas.growth(one, "area", 2013, 2016).collect()))
    pick = lambda d: sorted((r.BUILDING_REFERENCE_NUMBER, r.HP_ADDED) for r in entries.status_changes(d).collect())
    assert pick(df) == pick(one)
    plan = entries.status_changes(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "unknown" in plan
    dated = installs.reconcile_install_dates(df.withColumn("HP_INSTALL_DATE", F.lit(None).cast("date")))
    assert dated.where("UPRN = 'unknown' AND ANY_HP IS NOT NULL").count() == 0


def test_wide_features_are_no_categories(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("address"))
    with pytest.raises(ValueError, match="address"):
        encode.categories(df, ["address"], most=1000)


def test_household_encoding(spark, tmp_path):
    row = {"TENURE": "owner-occupied", "UPRN": "1", "CURRENT_ENERGY_RATING": "C"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    first, again = jobs.household_encoding(df), jobs.household_encoding(df, str(tmp_path / "encoded"))
    assert first.count() == again.count() == 1 and sorted(first.columns) == sorted(again.columns)


def test_jobs(spark, tmp_path):
    rows = [("1", "100", "1 High St", "ab1 2cd", "2010-01-02", "Air source heat pump", None, "A"), ("2", "100", "1 High St", "ab1 2cd", "0012-01-02", "Boiler and radiators, mains gas", None, "B"), ("3", "unknown", "2 High St", "ab1 2cd", "INVALID!", None, None, "C")]
    raw = spark.createDataFrame(rows, "BUILDING_REFERENCE_NUMBER string, UPRN string, ADDRESS1 string, POSTCODE string, INSPECTION_DATE string, MAINHEAT_DESCRIPTION string, SECONDHEAT_DESCRIPTION string, CURRENT_ENERGY_RATING string")
    out = jobs.preprocess(raw, str(tmp_path), "2021")
    assert sorted(r.BUILDING_REFERENCE_NUMBER for r in out.collect()) == ["2", "3"]
    assert spark.read.parquet(str(tmp_path / "2021" / "preprocessed")).count() == 3
    imd = spark.createDataFrame([("AB12CD", 4)], "Postcode string, `IMD Rank` int")
    register = spark.createDataFrame([("1highstab12cd", D(2011, 1, 1))], "compressed_epc_address string, date date")
    ready = jobs.prepare(out.withColumns({"ADDRESS2": F.lit(""), "BUILDING_REFERENCE_NUMBER": F.col("BUILDING_REFERENCE_NUMBER").cast("long")}), imd, register)
    assert ready.select("POSTCODE_AREA", "HP_INSTALL_DATE").distinct().collect() == [("AB", D(2011, 1, 1))]
    with pytest.raises(ValueError):
        jobs.labelled(out, "Tomorrow")
