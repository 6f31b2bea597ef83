"""Nearest non-adopters of each adopter, and the areas that they are in.

A blocked similarity join. Rows that aren't adopters are dealt to the cells of a k-means model fitted on a bounded sample; a
cell is cut into blocks of bounded size, whatever its share of the rows. An adopter first meets one block of its nearest cell, which
gives a bound on the distance of its k-th neighbour. By the triangle inequality a cell whose radius doesn't reach into this bound holds no
neighbour; the adopter meets the blocks of the other cells. What a block shows is ranked again by differences of
components, and blocks' best are merged by rank. Nothing is lost by that: the result is exact. `probes` limits the cells to the nearest
ones, which is faster and may miss neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: Rows that the k-means model is fitted on, about; cells at least and at most; rows of a block; adopters that meet a block at once.
SAMPLE, CELLS, MOST_CELLS, BLOCK, ASKING = 20_000, 64, 1024, 4096, 256


def _matrix(lists: pa.Array) -> np.ndarray:
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _away(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows from centres."""
    squares = (x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def _assign(centres: np.ndarray):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ASKING):
                batch = whole.slice(at, ASKING)
                away = _away(_matrix(batch.column(2)), centres)
                cell = away.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])], ["row", "key", "vector", "adopted", "cell", "away"])

    return run


def _packed(table: pa.Table) -> pa.Table:
    """One row for each block: its keys and vectors."""
    keys, x = table.column("key").to_numpy().astype("<i8"), _matrix(table.column("vector").combine_chunks())
    return pa.table({"cell": table.column("cell").slice(0, 1), "part": table.column("part").slice(0, 1), "keys": pa.array([keys.tobytes()], pa.binary()), "vectors": pa.array([x.astype("<f8").tobytes()], pa.binary())})


_ASKED = pa.schema([("cell", pa.int32()), ("rows", pa.binary()), ("queries", pa.binary()), ("bounds", pa.binary())])


def _ask(centres: np.ndarray, counts: np.ndarray, radii: np.ndarray, probes: int | None, first: bool):
    """For each cell that some adopters have to meet: these adopters and the bounds of their search. At first only the nearest cell that has rows."""
    filled = np.flatnonzero(counts)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows if len(filled) else 0, ASKING):
                batch = whole.slice(at, ASKING)
                rows, x = batch.column(0).to_numpy().astype("<i8"), _matrix(batch.column(1))
                away = _away(x, centres[filled])
                bounds = np.full(len(x), np.inf) if first else batch.column(2).fill_null(np.inf).to_numpy(zero_copy_only=False)
                needed = np.zeros(away.shape, bool)
                if first:
                    needed[np.arange(len(x)), away.argmin(1)] = True
                else:
                    needed = away - radii[filled] <= bounds[:, None] * (1 + 1e-9) + 1e-9
                    if probes is not None:
                        places = away.argsort(1, kind="stable").argsort(1, kind="stable")
                        needed &= places < probes
                asked = []
                for k in np.flatnonzero(needed.any(0)).tolist():
                    own = needed[:, k]
                    asked.append({"cell": int(filled[k]), "rows": rows[own].tobytes(), "queries": x[own].astype("<f8").tobytes(), "bounds": bounds[own].astype("<f8").tobytes()})
                if asked:
                    yield pa.RecordBatch.from_pylist(asked, schema=_ASKED)

    return run


def nearest_of(queries: np.ndarray, bounds: np.ndarray, keys: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distances, keys) of each query's first k rows within its bound, by distance and then key."""
    near = _away(queries, x)
    least = np.partition(near, k - 1, axis=1)[:, k - 1] if len(keys) > k else np.full(len(queries), np.inf)
    out = []
    for q, row, bound in zip(queries, near, np.minimum(least, bounds), strict=True):
        # Products lose digits where lengths are large beside the distance: some more rows are looked at than needed.
        slack = 1e-6 * (1 + np.sqrt((q**2).sum()) + bound) if np.isfinite(bound) else 0.0
        some = np.flatnonzero(row <= bound + slack)
        away = np.sqrt(((x[some] - q) ** 2).sum(1))
        best = np.lexsort((keys[some], away))[:k]
        out.append((away[best], keys[some][best]))
    return out


def _meet(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows, keys = np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["keys"], "<i8")
                x = np.frombuffer(r["vectors"], "<f8").reshape(len(keys), -1)
                found = nearest_of(np.frombuffer(r["queries"], "<f8").reshape(len(rows), -1), np.frombuffer(r["bounds"], "<f8"), keys, x, k)
                sizes = [len(a) for a, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, sizes)), pa.array(np.concatenate([n for _, n in found])), pa.array(np.concatenate([a for a, _ in found]))], ["row", "neighbour", "distance"])

    return run


def _best(met: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("row").orderBy("distance", "neighbour"))
    return met.withColumn("rank", place).where(F.col("rank") <= k)


def nearest_non_adopters(df: DataFrame, key: str, vector: str, adopted: str, k: int = 5, cells: int | None = None, probes: int | None = None, seed: int = 42) -> DataFrame:
    """adopter, neighbour, rank, distance: the k nearest rows without the flag of each row with it (all, if fewer), by Euclidean distance and then key.

    Rows with a null key, flag, vector or component take no part, nor do those whose vector has another length than most. Rows that repeat are rows of their own. `probes` is the number of cells that an adopter looks into; None looks into all that could matter. There are as many cells as blocks would
    fill, from CELLS to MOST_CELLS, so that a cell doesn't grow with the table.
    """
    whole = F.transform(F.col(vector), lambda x: x.cast("double"))
    own = df.select(F.col(key).cast("long").alias("key"), whole.alias("vector"), F.col(adopted).cast("boolean").alias("adopted"))
    own = own.where(F.col("key").isNotNull() & F.col("adopted").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    empty = df.sparkSession.createDataFrame([], "adopter long, neighbour long, rank int, distance double")
    shape = own.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if shape is None or not shape.dims:
        return empty
    own = own.where(F.size("vector") == shape.dims)
    picked = F.pmod(F.xxhash64("key", "vector", F.lit(seed)), F.lit(1 << 40)) < F.lit(min(1 << 40, (SAMPLE << 40) // shape["count"]))
    sample = own.where(~F.col("adopted") & picked).select("vector")
    if sample.distinct().limit(2).count() < 2:  # nothing to tell cells apart by
        centres = np.zeros((1, shape.dims))
    else:
        cells = cells or min(MOST_CELLS, max(CELLS, shape["count"] // BLOCK))
        # The usual start runs k-means over some thousand candidates on the driver.
        centres = np.array(KMeans(k=cells, seed=seed, maxIter=10, initMode="k-means||" if cells <= CELLS else "random").fit(sample.select(array_to_vector("vector").alias("features"))).clusterCenters())
    celled = own.select(F.monotonically_increasing_id().alias("row"), "key", "vector", "adopted").mapInArrow(_assign(centres), "row long, key long, vector array<double>, adopted boolean, cell int, away double")
    celled = staged(celled)
    others, adopters = celled.where(~F.col("adopted")), celled.where("adopted")
    stats = {r.cell: r for r in others.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}  # a row per cell
    counts = np.array([stats[c].n if c in stats else 0 for c in range(len(centres))])
    radii = np.array([stats[c].radius if c in stats else 0.0 for c in range(len(centres))])
    parts = -(-counts // BLOCK)
    n_parts = F.element_at(F.split(F.lit(",".join(str(n) for n in np.maximum(parts, 1))), ",").cast("array<int>"), F.col("cell") + 1)
    dealt = others.select("cell", F.pmod(F.xxhash64("row"), n_parts).cast("int").alias("part"), "key", "vector")
    blocks = staged(dealt.groupBy("cell", "part").applyInArrow(_packed, "cell int, part int, keys binary, vectors binary"))
    asked_schema = "cell int, rows binary, queries binary, bounds binary"
    met_schema = "row long, neighbour long, distance double"
    # Both sides hold vectors, whose size Spark underrates: unless told to merge, it may broadcast them, all through the driver.
    asking = adopters.select("row", "vector", "cell").repartitionByRange("cell", "row").sortWithinPartitions("cell")
    home = asking.select("row", "vector").mapInArrow(_ask(centres, counts, radii, probes, True), asked_schema).withColumn("part", F.lit(0))
    bounds = home.join(blocks.hint("merge"), ["cell", "part"]).mapInArrow(_meet(k), met_schema).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("bound"))
    bounds = bounds.select("row", F.when(F.col("n") >= k, F.col("bound")).alias("bound"))
    bounded = adopters.select("row", "vector", "cell").join(bounds, "row", "left").repartitionByRange("cell", "row").sortWithinPartitions("cell")
    asked = bounded.select("row", "vector", "bound").mapInArrow(_ask(centres, counts, radii, probes, False), asked_schema)
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    best = _best(asked.join(blocks.hint("merge"), ["cell", "part"]).mapInArrow(_meet(k), met_schema), k)
    return best.join(adopters.select("row", F.col("key").alias("adopter")), "row").select("adopter", "neighbour", F.col("rank").cast("int").alias("rank"), "distance")


def similar_areas(neighbours: DataFrame, homes: DataFrame, key: str, area: str, adopted: str) -> DataFrame:
    """One row per area: homes without the flag, how many of them are neighbours of adopters, their share, how often they are, and the mean distance. `key` names a home."""
    met = neighbours.groupBy(F.col("neighbour").alias("__key")).agg(F.count(F.lit(1)).alias("times"), F.sum("distance").alias("away"))
    others = homes.where(F.col(area).isNotNull() & ~F.col(adopted)).select(F.col(area), F.col(key).cast("long").alias("__own"))
    joined = others.join(met, F.col("__own") == F.col("__key"), "left")
    out = joined.groupBy(area).agg(F.count(F.lit(1)).alias("homes"), F.count("times").alias("similar_homes"), F.coalesce(F.sum("times"), F.lit(0)).alias("times"), F.sum("away").alias("away"))
    return out.select(area, "homes", "similar_homes", (F.col("similar_homes") / F.col("homes")).alias("share"), "times", F.try_divide("away", F.col("times").cast("double")).alias("mean_distance"))
