import numpy as np
import pytest

from retrofit_spark.operators import spatial


def hexagons(n, seed):
    rng = np.random.default_rng(seed)
    return sorted({(int(q), int(r)) for q, r in rng.integers(-6, 7, (n, 2))})


def laplacian(cells):
    at = {c: k for k, c in enumerate(cells)}
    out = np.zeros((len(cells), len(cells)))
    for (q, r), k in at.items():
        for dq, dr in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)):
            if (q + dq, r + dr) in at:
                out[k, k] += 1
                out[k, at[q + dq, r + dr]] -= 1
    return out


def test_rings():
    assert len(spatial.ring(1)) == 6 and len(spatial.ring(2)) == 18 and len(spatial.ring(5)) == 90


def test_neighbouring_cells(spark):
    cells = hexagons(60, 1)
    df = spark.createDataFrame([(f"{q}:{r}",) for q, r in cells] + [("0:0",), (None,)] * 2, "hex_id string")
    got = {(r.cell, r.neighbour) for r in spatial.neighbouring_cells(df).collect()}
    lap, names = laplacian(sorted({*cells, (0, 0)})), [f"{q}:{r}" for q, r in sorted({*cells, (0, 0)})]
    assert got == {(names[i], names[j]) for i, j in zip(*np.nonzero(lap < 0), strict=True)}


@pytest.mark.parametrize("strength", [0.3, 20.0])
def test_smoothed_effects(spark, strength):
    """Against a dense solution; one cell without a value, one that stands twice, two without neighbours (one of them without weight)."""
    rng, cells = np.random.default_rng(2), [*hexagons(50, 2), (40, 40), (60, 60)]
    values, weights = rng.normal(0, 1, len(cells)), rng.uniform(0.5, 30, len(cells))
    weights[3] = 0
    rows = [(f"{q}:{r}", float(v), float(w)) for (q, r), v, w in zip(cells, values, weights, strict=True)]
    rows[3] = (rows[3][0], None, 5.0)
    rows[-1] = (rows[-1][0], None, None)
    weights[-1] = 0
    rows.append((rows[5][0], 4.0, 2.0))
    rows.append((None, 1.0, 1.0))
    pull = weights * values
    pull[5], weights[5] = pull[5] + 8, weights[5] + 2
    df = spark.createDataFrame(rows, "hex_id string, value double, weight double")
    got = {r.hex_id: r.effect for r in spatial.smoothed_effects(df, spatial.neighbouring_cells(df), "hex_id", "value", "weight", strength).collect()}
    want = np.linalg.solve(np.diag(weights)[:-1, :-1] + strength * laplacian(cells)[:-1, :-1], pull[:-1])
    assert [got[n] for n, *_ in rows[: len(cells) - 1]] == pytest.approx(want.tolist(), abs=1e-6)
    assert got["60:60"] == 0 and len(got) == len(cells)


def test_smoothed_effects_of_nothing(spark):
    df = spark.createDataFrame([], "hex_id string, value double, weight double")
    assert spatial.smoothed_effects(df, spatial.neighbouring_cells(df), "hex_id", "value", "weight", 1.0).count() == 0


def test_spatial_poisson(spark):
    """Effects are the mode of the penalised likelihood (its gradient is nothing), and they find a raised patch that the feature doesn't explain."""
    rng, cells = np.random.default_rng(5), hexagons(70, 5)
    x, homes = rng.normal(0, 1, len(cells)), rng.integers(50, 400, len(cells))
    patch = np.array([q > 2 for q, _ in cells])
    counts = rng.poisson(homes * np.exp(-2.5 + 0.3 * x + 1.2 * patch))
    df = spark.createDataFrame([(f"{q}:{r}", float(a), int(n), int(y)) for (q, r), a, n, y in zip(cells, x, homes, counts, strict=True)], "hex_id string, x double, homes long, pumps long")
    got = {r.hex_id: r for r in spatial.spatial_poisson(df, spatial.neighbouring_cells(df), "hex_id", "pumps", "homes", ["x"], 2.0).collect()}
    effect = np.array([got[f"{q}:{r}"].effect for q, r in cells])
    expected = np.array([got[f"{q}:{r}"].expected for q, r in cells])
    assert np.abs(counts - expected - 2.0 * laplacian(cells) @ effect).max() < 1e-5
    assert effect[patch].mean() > effect[~patch].mean() + 0.6
    assert all(0 <= r.exceedance <= 1 for r in got.values())
