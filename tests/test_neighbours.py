from collections import Counter, defaultdict

import numpy as np
import pytest

from retrofit_spark.operators import neighbours

SCHEMA = "home long, features array<double>, pump boolean, row string, cell string, part string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)


def by_force(rows, k):
    rows = [r for r in rows if None not in r and not any(x is None or x != x for x in r[1])]
    out = Counter()
    for home, v, pump in rows:
        if pump:
            found = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), n) for n, w, other in rows if not other)
            out.update((home, n, rank, round(d, 6)) for rank, (d, n) in enumerate(found[:k], 1))
    return out


def found(df, **options):
    got = neighbours.nearest_non_adopters(df, "home", "features", "pump", **options).collect()
    return Counter((r.adopter, r.neighbour, r.rank, round(r.distance, 6)) for r in got)


def homes(n, dims, seed, share=0.2, spread=0.1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 3, (12, dims))
    x = np.round(middles[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, dims)), 3)
    return [(k, v, bool(p)) for k, (v, p) in enumerate(zip(x.tolist(), rng.random(n) < share, strict=True))]


@pytest.mark.parametrize(("n", "dims", "k", "block", "cells"), [(600, 6, 5, 20, 16), (300, 1, 3, 4096, 64), (200, 3, 40, 7, 5)])
def test_nearest(spark, monkeypatch, n, dims, k, block, cells):
    """Ties, repeated rows and keys, nulls in each column, and a vector that a third of all rows share."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "ASKING", 16)
    rows = homes(n, dims, n)
    rows += [rows[0], rows[0], rows[1], (5, rows[9][1], True), (5, rows[9][1], False), (None, rows[3][1], True), (901, None, False), (902, rows[3][1], None), (903, [None] * dims, False), (904, [float("nan")] * dims, True)]
    rows += [(1000 + i, rows[7][1], i % 4 == 0) for i in range(n // 2)]
    assert found(table(spark, rows), k=k, cells=cells) == by_force(rows, k)


def test_more_cells_for_more_rows(spark, monkeypatch):
    """A cell doesn't grow with the table, and results stay exact."""
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    cells, assign = [], neighbours._assign
    monkeypatch.setattr(neighbours, "_assign", lambda centres: cells.append(len(centres)) or assign(centres))
    rows = homes(900, 4, 2)
    assert found(table(spark, rows)) == by_force(rows, 5)
    assert 64 < cells[0] <= 112
    monkeypatch.setattr(neighbours, "MOST_CELLS", 80)
    assert found(table(spark, rows)) == by_force(rows, 5) and cells[1] <= 80


def test_vectors_are_never_broadcast(spark):
    """joins of vectors go by a shuffle, however small Spark takes them to be; only tables of keys may pass the driver."""
    df = neighbours.nearest_non_adopters(table(spark, homes(300, 4, 5)), "home", "features", "pump")
    plan = df._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert [line for line in joins if "cell" in line and "SortMergeJoin" in line], plan
    assert not [line for line in joins if "cell" in line and "Broadcast" in line], plan


def test_edges(spark):
    assert found(table(spark, [])) == Counter()
    assert found(table(spark, [(1, [], True), (2, [], False)])) == Counter()
    one = [(1, [0.0, 1.0], True)]
    assert found(table(spark, one)) == Counter()
    assert found(table(spark, [*one, (2, [3.0, 5.0], False)])) == Counter({(1, 2, 1, 5.0): 1})
    few = [(k, [float(k)], k % 3 == 0) for k in range(7)]
    assert found(table(spark, few), k=10) == by_force(few, 10)
    far = [(k, [1e8 + k * 1e-3, -1e8], k % 5 == 0) for k in range(60)]  # products lose all digits of these distances
    got = neighbours.nearest_non_adopters(table(spark, far), "home", "features", "pump", k=4).collect()
    assert Counter((r.adopter, r.neighbour, r.rank) for r in got) == Counter(dict.fromkeys([x[:3] for x in by_force(far, 4)], 1))


def test_only_cells_that_matter_are_asked():
    """By the triangle inequality: far cells aren't met, and no neighbour is in them."""
    rng = np.random.default_rng(1)
    centres = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0], [50.0, 50.0]])
    x = centres[rng.integers(0, 4, 400)] + rng.uniform(-1, 1, (400, 2))
    cell = neighbours._away(x, centres).argmin(1)
    radii = np.array([neighbours._away(x[cell == c], centres[c : c + 1]).max() for c in range(4)])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(400)), pa.array(x.tolist()), pa.array(np.full(400, 0.5))], ["row", "vector", "bound"])
    asked = [r for b in neighbours._ask(centres, np.bincount(cell), radii, None, False)([batch]) for r in b.to_pylist()]
    met = defaultdict(set)
    for r in asked:
        for row in np.frombuffer(r["rows"], "<i8").tolist():
            met[row].add(r["cell"])
    assert all(met[k] == {int(cell[k])} for k in range(400))


def test_probes_miss_little(spark):
    """Few cells find nine in ten neighbours on rows without clusters; all cells find all."""
    rows = homes(3000, 8, 4, spread=4.0)
    df, want = table(spark, rows), by_force(rows, 5)
    pairs = {x[:2] for x in want}
    near = {x[:2] for x in found(df, cells=32, probes=16)}
    assert len(near & pairs) / len(pairs) >= 0.9
    assert found(df, cells=32) == want


def test_areas(spark):
    rows = [(1, "A", True), (2, "A", False), (3, "A", False), (4, "B", False), (5, None, False), (6, "C", True)]
    near = spark.createDataFrame([(1, 2, 1, 1.0), (1, 4, 2, 2.0), (6, 2, 1, 3.0), (6, 5, 2, 4.0)], "adopter long, neighbour long, rank int, distance double")
    got = neighbours.similar_areas(near, spark.createDataFrame(rows, "home long, area string, pump boolean"), "home", "area", "pump").collect()
    assert {tuple(r) for r in got} == {("A", 2, 1, 0.5, 2, 2.0), ("B", 1, 1, 1.0, 1, 2.0)}
