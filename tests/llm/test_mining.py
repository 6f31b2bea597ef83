from collections import Counter

import numpy as np
import pytest

from retrofit_spark.llm import mining

SCHEMA = "id long, label long, vector array<long>, anchor boolean, score string, rank string, shard string, key string"


def by_force(rows):
    """(anchor, positive, rank, negative, scores) of (id, label, vector, anchor) rows, each a row of its own."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    score = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=False))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = Counter()
    for k, (i, label, v, anchor) in enumerate(rows):
        if not anchor or i is None:
            continue
        others = [(score(v, w), j, m == label) for n, (j, m, w, _) in enumerate(rows) if n != k]
        for high, p, _ in sorted((x for x in others if x[2]), key=order)[:5]:
            fits = sorted((x for x in others if not x[2] and 80 * high <= 100 * x[0] <= 100 * high), key=order)[:5]
            out.update((i, p, rank, n, high, s) for rank, (s, n, _) in enumerate(fits, 1))
    return out


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", "z", "k") for r in rows], SCHEMA).repartition(parts)


def mined(df):
    return Counter(tuple(r) for r in mining.mine(df).collect())


def vectors(rng, n, dims, spread=40):
    middles = rng.integers(-150, 150, (6, dims))
    return (middles[rng.integers(0, 6, n)] + rng.integers(-spread, spread + 1, (n, dims))).tolist()


@pytest.mark.parametrize(("n", "dims", "labels", "shard", "step"), [(400, 8, 3, 64, 16), (300, 5, 2, 1 << 14, 1024), (250, 2, 4, 50, 1), (120, 1, 2, 30, 7)])
def test_mine(spark, monkeypatch, n, dims, labels, shard, step):
    """Ties, rows that repeat, ids that repeat, nulls in each column; many shards and small steps."""
    monkeypatch.setattr(mining, "SHARD", shard)
    monkeypatch.setattr(mining, "STEP", step)
    rng = np.random.default_rng(n)
    rows = [(k, int(rng.integers(0, labels)), v, k % 10 == 0) for k, v in enumerate(vectors(rng, n, dims, 3))]
    rows += [rows[0], rows[0], rows[10], (5, 1, rows[7][2], True), (None, 0, rows[3][2], True), (None, 1, rows[3][2], False), (900, None, rows[1][2], True), (901, 1, None, True), (902, 1, [None] * dims, True), (903, 1, rows[2][2], None), (-20, 0, rows[4][2], True)]
    rows += [(1000 + k, k % 2, rows[9][2], k % 15 == 0) for k in range(60)]  # one vector that many rows share
    assert mined(table(spark, rows)) == by_force(rows)


def test_mine_edges(spark):
    assert mined(table(spark, [])) == Counter()
    one = [(0, 1, [1, 2], True)]
    assert mined(table(spark, one)) == Counter()
    odd = [(0, 0, [2, 1, 1], True), (1, 0, [3], False), (2, 1, [2, 1], False), (3, 1, [], False), (4, 1, [2, 2, 2, 9], True), (5, 0, [0, 0], False), (6, 1, [-3, 1], False)]
    longest = max(len(r[2]) for r in odd)
    assert mined(table(spark, odd)) == by_force([(*r[:2], r[2] + [0] * (longest - len(r[2])), r[3]) for r in odd])
    empty = [(k, k % 2, [], k < 3) for k in range(9)]
    assert mined(table(spark, empty)) == by_force(empty)


@pytest.mark.parametrize("scale", [1, 1 << 14, 1 << 20])
def test_scores_are_exact_at_any_size(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(k, int(rng.integers(0, 2)), [int(x) * scale + int(rng.integers(0, 2)) for x in v], k % 20 == 0) for k, v in enumerate(vectors(rng, 200, 4))]
    assert mined(table(spark, rows)) == by_force(rows)


def test_scores_beyond_64_bits(spark):
    rows = [(k, k % 2, [1 << 40, 1 << 40], k == 0) for k in range(5)]
    with pytest.raises(Exception, match="64 bits"):
        mined(table(spark, rows))


def shard_of(rng, n, dims):
    x = np.array(vectors(rng, n, dims, 10))
    half = dims // 2
    books = tuple(mining.codebook(p.astype(float), 6) for p in (x[:, :half], x[:, half:]))
    cells = mining._codes(x[:, :half], books[0]) * len(books[1]) + mining._codes(x[:, half:], books[1])
    labels = rng.integers(0, 3, n)
    order = np.lexsort((labels, cells))
    return mining.Shard(x[order], np.arange(n), np.zeros(n, np.uint8), labels[order], cells[order].astype(np.int32), books), x[order], labels[order]


def test_cells_come_by_bound_and_hold_their_scores():
    rng = np.random.default_rng(8)
    shard, x, _ = shard_of(rng, 3000, 10)
    for q in x[:20]:
        cells, scores = list(shard.cells(q.astype(float))), x @ q
        assert [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True)
        assert sorted(k for _, _, a, b in cells for k in range(a, b)) == list(range(len(x)))
        assert all(least <= scores[a:b].min() and scores[a:b].max() <= most for most, least, a, b in cells)


def test_certified_searches_end_early():
    """Windows end the walk: on clustered rows a search scores a part of them and still finds what a full scan finds."""
    rng = np.random.default_rng(9)
    shard, x, labels = shard_of(rng, 6000, 16)
    seen = 0
    for k in range(0, 6000, 200):
        scores = x @ x[k]
        for same in (True, False):
            allowed = np.flatnonzero((labels == labels[k]) == same)
            high = int(np.sort(scores[allowed])[-20])
            windows = [(-(1 << 63), (1 << 63) - 1), (high * 8 // 10, high)]
            best, n = shard.search(x[k], int(labels[k]), same, windows, 5)
            seen += n
            for (low, top), (found, _) in zip(windows, best, strict=True):
                fits = scores[allowed][(scores[allowed] >= low) & (scores[allowed] <= top)]
                assert found.tolist() == np.sort(fits)[::-1][:5].tolist()
    assert seen < 0.5 * 30 * 6000


def test_of_embeddings(spark):
    nan = float("nan")
    rows = [(0, [0.5, -0.001], 3), (7, [1.0, 0.25], 9), (100, [0.1, 0.2], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [None, 1.0], 1), (6, [1.0, 1.0], None), (-14, [0.0, 1.0], 0), (None, [1.0, 1.0], 5)]
    got = mining.of_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.id: (r.label, r.vector, r.anchor) for r in got} == {0: (4, [128, -1], True), 7: (0, [256, 64], False), 100: (1, [25, 51], True), -14: (1, [0, 256], False), None: (5, [256, 256], False)}
