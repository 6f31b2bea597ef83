"""Operators on groups that hold a third of all rows, on many columns, and on deep trees."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from retrofit_spark.operators import areas, entries, ml, profile, sampling


def test_correlations_of_180_columns(spark):
    """All 16,110 pairs in one job, equal to pandas' over rows where both are there."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 180)) @ rng.normal(0, 1, (180, 180)) + 1e4
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 8] = 3.0, np.nan
    names = [f"c.{k}" for k in range(180)]
    frame = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x], ", ".join(f"`{n}` double" for n in names)).repartition(3)
    got = {(r.feature_a, r.feature_b): r.r for r in profile.correlations(df).collect()}
    want = frame.corr()
    assert len(got) == 16_110
    for (a, b), r in got.items():
        assert r is None and np.isnan(want.loc[a, b]) or r == pytest.approx(want.loc[a, b], abs=1e-9)
    assert profile.correlations(df.limit(0)).where("r IS NOT NULL").count() == 0 and profile.correlations(df.select("`c.1`")).count() == 0


@pytest.mark.parametrize("buckets", [4, 1024])
def test_heavy_medians(spark, monkeypatch, buckets):
    monkeypatch.setattr(areas, "BUCKETS", buckets)
    rng = np.random.default_rng(2)
    n = 3000
    rows = [(int(k), float(a), float(b), None if k == 1 else 1.5, int(c)) for k, a, b, c in zip(rng.choice([0, 0, 0, 1, 2, 3], n), rng.lognormal(0, 6, n), rng.integers(0, 3, n), rng.integers(-1000, 1000, n), strict=True)]
    rows += [(0, None, None, None, None), (None, 1.0, 1.0, 1.0, 1), (4, None, 2.0, None, 7), (5, -1e308, 1e308, 0.0, 0), (5, 1e308, -1e308, 0.0, 0)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d long").repartition(3)
    for heavy in (0, 40, 10_000):
        got = {r.k: tuple(r)[1:] for r in areas.medians(df, "k", heavy=heavy).collect()}
        want = pd.DataFrame(rows, columns=list("kabcd")).dropna(subset=["k"]).groupby("k").median()
        assert set(got) == set(want.index)
        for k, row in want.iterrows():
            for a, b in zip(got[k], row, strict=True):
                assert a is None and np.isnan(b) or a == pytest.approx(b)


def test_entry_counts_of_heavy_keys(spark):
    keys = ["unknown"] * 50 + [None] * 20 + ["a"] * 5 + ["b"] * 4 + ["c"] * 12 + ["d"]
    df = spark.createDataFrame(list(enumerate(keys)), "i int, k string").repartition(4)
    n = Counter(keys)
    want = {(i, None if k is None else "5.0+" if n[k] >= 5 else str(n[k])) for i, k in enumerate(keys)}
    for heavy in (0, 10, 1000):
        assert {(r.i, r.n) for r in entries.with_entry_counts(df, {"n": "k"}, heavy=heavy).select("i", "n").collect()} == want


def test_exact_sample(spark):
    df = spark.range(500).withColumnRenamed("id", "home")
    one = sampling.exact_sample(df.repartition(7), 2000, "home")
    two = sampling.exact_sample(df.repartition(2), 2000, "home")
    a, b = Counter(r.home for r in one.collect()), Counter(r.home for r in two.collect())
    assert a == b and a.total() == 2000 and one.columns == ["home"] and len(a) > 450 and max(a.values()) < 20
    assert Counter(r.home for r in sampling.exact_sample(df, 2000, "home", seed=1).collect()) != a
    assert sampling.exact_sample(df, 0, "home").count() == 0 and sampling.exact_sample(df.limit(0), 5, "home").count() == 0


def test_truncated_svd_of_many_columns(spark):
    x = np.random.default_rng(3).uniform(0, 1, (200, 40))
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    names = [f"c{k}" for k in range(40)]
    got = [r.singular_value for r in ml.singular_values(spark.createDataFrame(x.tolist(), names), names, 40).orderBy("component").collect()]
    assert got == pytest.approx(np.linalg.svd(x, compute_uv=False).tolist(), rel=1e-6)


def test_small_and_large_poisson_tails(spark):
    """Against sums in fractions; a tail of 1e-40 has its digits, and a count of a million needs no array of a million."""
    from fractions import Fraction
    from math import exp, factorial

    rows = [(c, m) for m in (0.25, 1.0, 7.5, 30.0) for c in (0, 1, 5, 20, 60)]
    df = spark.createDataFrame([*rows, (-1, 2.0), (3, 0.0), (None, 1.0), (2, None), (1_000_000, 1e6), (999_000, 1e6)], "c long, m double")
    got = [r.p for r in df.coalesce(1).select(ml.poisson_tail(df["c"], df["m"]).alias("p")).collect()]
    for (c, m), p in zip(rows, got, strict=False):
        tail = float(sum(Fraction(m) ** i / factorial(i) for i in range(c + 1, c + 200))) * exp(-m)
        assert p == pytest.approx(tail, rel=1e-10), (c, m)
    assert got[len(rows) : len(rows) + 4] == [1.0, 0.0, None, None]
    assert got[-2] == pytest.approx(0.49973, abs=1e-4) and got[-1] == pytest.approx(0.8413, abs=1e-3)
